"""Admission-level feature set (C20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.codes import is_not
from staywise.functions.times import days_between
from staywise.operators.cohort import keep_entities, multi_stay_entities
from staywise.operators.transitions import label_pairs, pair_count_aggregates, pair_probability_row
from staywise.plans.composite import CompositeSpec


def admission_features(transfers: DataFrame, stays: DataFrame, spec: CompositeSpec) -> DataFrame:
    """Moves, stays, readmissions, mean unit time and weighted pair counts per admission.

    Pair counts belong to the entity, the rest to the admission; admissions
    without a stay are left out. Entities have more than one stay.
    """
    repeated = multi_stay_entities(stays)
    kept = transfers.filter(
        is_not("prev_unit", *spec.excluded_pair_units) & is_not("curr_unit", *spec.excluded_pair_units)
    )
    time_in_unit = F.when(F.col("stay_id").isNotNull(), days_between("intime", "outtime", None))
    per_admission = kept.groupBy("entity_id", "admission_id").agg(
        F.count("*").alias("n_trav"),
        F.count("stay_id").alias("n_icutrav"),
        F.count_distinct("stay_id").alias("n_stays"),
        F.bround(F.avg(time_in_unit), 6).alias("avg_los"),
    ).filter(F.col("n_icutrav") > 0)
    moves = label_pairs(
        transfers.filter(F.col("stay_id").isNotNull()), excluded=spec.excluded_pair_units, blank=spec.blank_unit
    )
    moves = keep_entities(moves, repeated)
    names = spec.pair_columns
    counts = moves.groupBy("entity_id").agg(*pair_count_aggregates(spec.pairs, names, F.col("pair")))
    weights = pair_probability_row(moves, spec.pairs, names)
    readmitted = repeated.select("entity_id", (F.col("n_stays") - 1).alias("n_readm"))
    return (
        per_admission.join(readmitted, "entity_id")
        .join(counts, "entity_id", "left")
        .withColumn("_w", weights)
        .select(
            "entity_id", "admission_id", "n_readm", "n_trav", "n_icutrav", "n_stays", "avg_los",
            *[F.bround(F.coalesce(c, F.lit(0)) * F.col("_w")[c], 3).alias(c) for c in names],
        )
    )
