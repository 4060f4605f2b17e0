"""The composite feature table as one lazy plan.

Everything known per stay (ends, counts, first unit, pair counts, exclusion
flag) comes from a single grouping of the transfers; everything known from the
stay before comes from a single pass per entity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.codes import UNIT_CODES, encode, fill_blank, flag_between, is_not, pair_label
from staywise.operators.cohort import keep_entities, multi_stay_entities
from staywise.operators.ordered import NO_HOT_KEYS, HotKeys
from staywise.operators.stays import (
    STAY_KEYS,
    collapse_stays,
    los_days,
    readmissions,
    risk_counts,
    unit_after_stay,
    unit_at_start_aggregates,
    unit_end_aggregate,
    with_day_flags,
)
from staywise.operators.transitions import (
    DEFAULT_PAIRS,
    label_pairs,
    pair_count_aggregates,
    pair_probability_row,
)


@dataclass(frozen=True)
class CompositeSpec:
    """What varies between data sets; the defaults fit the care-episode tables."""

    window_days: float = 30
    unit_codes: Mapping[str, int] = field(default_factory=lambda: dict(UNIT_CODES))
    handoff_units: Sequence[str] = ("MICU", "CSRU", "SICU", "CCU", "TSICU", "NICU")
    flag_bounds: tuple[int, int] = (0, 7)
    excluded_stay_units: Sequence[str] = ("NICU",)
    excluded_pair_units: Sequence[str] = ("NICU", "NWARD")
    blank_unit: str = "nonicu"
    pairs: Sequence[str] = DEFAULT_PAIRS
    nulls: str = "drop"
    include_first: bool = False

    @property
    def pair_columns(self) -> list[str]:
        return ["pair_" + p.replace("-", "_") for p in self.pairs]


def stay_table(transfers: DataFrame, spec: CompositeSpec) -> DataFrame:
    """All per-stay facts from one grouping."""
    pair = F.when(
        is_not("prev_unit", *spec.excluded_pair_units) & is_not("curr_unit", *spec.excluded_pair_units),
        pair_label(fill_blank("prev_unit", spec.blank_unit), fill_blank("curr_unit", spec.blank_unit)),
    )
    touched = F.max(F.col("curr_unit").isin(*spec.excluded_stay_units).cast("int")).alias("touched")
    return collapse_stays(
        transfers,
        extra=[
            F.count("*").alias("n_transfers"),
            *unit_at_start_aggregates(),
            unit_end_aggregate(spec.handoff_units),
            touched,
            *pair_count_aggregates(spec.pairs, spec.pair_columns, pair),
        ],
    )


def composite_features(
    transfers: DataFrame,
    spec: CompositeSpec,
    keep: DataFrame | None = None,
    los: DataFrame | None = None,
    hot: HotKeys = NO_HOT_KEYS,
    with_times: bool = False,
) -> DataFrame:
    """Feature table, label ``los`` last.

    ``keep`` limits the entities (adults); ``los`` (stay_id, los) replaces the
    computed length of stay for the label and the stay before; ``with_times``
    keeps the ends of the stay for further joins.
    """
    table = stay_table(transfers, spec)
    if los is not None:
        table = table.join(los.select("stay_id", F.col("los").alias("_los")), "stay_id", "left")
    else:
        table = table.withColumn("_los", los_days())
    linked = readmissions(table, include_first=spec.include_first, hot=hot, los="_los")
    cohort = linked.filter(F.col("touched") == 0)
    if keep is not None:
        cohort = keep_entities(cohort, keep)
    near = F.coalesce(F.col("readm_days") <= spec.window_days, F.lit(spec.include_first))
    cohort = cohort.filter(near)
    moved = unit_after_stay(cohort, transfers, spec.handoff_units)
    counted = with_day_flags(risk_counts(moved, hot=hot))

    moves = label_pairs(
        transfers.filter(F.col("stay_id").isNotNull()),
        excluded=spec.excluded_pair_units,
        blank=spec.blank_unit,
    )
    moves = keep_entities(moves, multi_stay_entities(table))
    weights = pair_probability_row(moves, spec.pairs, spec.pair_columns)
    low, high = spec.flag_bounds
    code = {
        "curr_cu": encode("first_unit", spec.unit_codes),
        "prev_cu": encode("unit_before", spec.unit_codes),
        "disch_cu": encode("next_unit", spec.unit_codes),
    }
    final = counted.withColumns({**code, "_w": weights}).select(
        *STAY_KEYS,
        *(["stay_in", "stay_out"] if with_times else []),
        "readm_days",
        "prev_los",
        "n_transfers",
        "curr_cu",
        "prev_cu",
        flag_between("prev_cu", low, high).alias("prev_flag"),
        "disch_cu",
        flag_between("disch_cu", low, high).alias("disch_flag"),
        "in_day",
        "out_day",
        "readm_risk",
        *[F.bround(F.col(c) * F.col("_w")[c], 3).alias(c) for c in spec.pair_columns],
        F.col("_los").alias("los"),
    )
    if spec.nulls == "drop":
        return final.na.drop()
    if spec.nulls == "zero":
        return final.na.fill(0)
    return final
