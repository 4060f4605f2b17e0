"""Unit-to-unit transitions: pairs, probabilities, per-stay counts and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise.functions.codes import fill_blank, is_not, pair_label

# The ten pairs weighted by default.
DEFAULT_PAIRS = (
    "nonicu-MICU", "nonicu-SICU", "nonicu-TSICU", "nonicu-CSRU", "MICU-MICU",
    "TSICU-TSICU", "nonicu-CCU", "CCU-CCU", "CSRU-CSRU", "SICU-SICU",
)


def label_pairs(
    transfers: DataFrame,
    prev_unit: str = "prev_unit",
    unit: str = "curr_unit",
    excluded: Sequence[str] = ("NICU", "NWARD"),
    blank: str = "nonicu",
) -> DataFrame:
    """Drop moves touching an excluded unit, name blanks, add ``pair``."""
    kept = transfers.filter(is_not(prev_unit, *excluded) & is_not(unit, *excluded))
    return kept.withColumns(
        {prev_unit: fill_blank(prev_unit, blank), unit: fill_blank(unit, blank)}
    ).withColumn("pair", pair_label(prev_unit, unit))


def pair_table(pairs: DataFrame, places: int = 6) -> DataFrame:
    """Count, overall share and P(previous | current) of each pair, from one count."""
    counts = transition_probabilities(pairs)
    total = counts.select(F.sum("n_trans")).scalar()
    return counts.select(
        pair_label("prev_unit", "curr_unit").alias("pair"),
        "n_trans",
        F.bround(F.col("n_trans") / total, places).alias("share"),
        F.bround("prob", places).alias("prob"),
    )


def top_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent pairs, ties broken by label, with their rank."""
    best = (
        pairs.groupBy("pair").agg(F.count("*").alias("n_trans"))
        .orderBy(F.col("n_trans").desc(), F.col("pair")).limit(k)
    )
    # at most k rows are gathered
    way = F.array_sort(F.collect_list(F.struct((-F.col("n_trans")).alias("order"), "pair", "n_trans")))
    return best.agg(way.alias("_best")).select(F.posexplode("_best").alias("_at", "_pair")).select(
        "_pair.pair", "_pair.n_trans", (F.col("_at") + 1).cast("bigint").alias("pair_rank")
    )


def transition_probabilities(
    pairs: DataFrame, prev_unit: str = "prev_unit", unit: str = "curr_unit"
) -> DataFrame:
    """P(previous | current) in long form; the window runs over the counted pairs only."""
    counts = pairs.groupBy(prev_unit, unit).agg(F.count("*").alias("n_trans"))
    into = F.sum("n_trans").over(Window.partitionBy(unit))
    return counts.withColumn("prob", F.col("n_trans") / into)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``row`` x ``column`` for the given column values."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0, list(values))


def pair_count_aggregates(labels: Sequence[str], names: Sequence[str], pair: Column) -> list[Column]:
    """Per-stay counts of given pairs as plain aggregates, for one shared grouping."""
    return [F.count_if(pair == label).alias(name) for label, name in zip(labels, names)]


def ranked_pair_counts(
    pairs: DataFrame, keys: Sequence[str] = ("entity_id", "stay_id"), k: int = 10
) -> DataFrame:
    """Per-stay counts of the ``k`` most frequent pairs as ``pair_1 .. pair_k``.

    ``keys`` tell stays apart. Counts are reduced to (stay, pair) before the ranks are attached; the rank
    table has ``k`` rows, so it is broadcast.
    """
    ranks = top_pairs(pairs, k).select("pair", "pair_rank")
    counted = pairs.groupBy(*keys, "pair").agg(F.count("*").alias("n"))
    wide = (
        counted.join(F.broadcast(ranks), "pair", "left")
        .groupBy(*keys)
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("pair_rank") == i, F.col("n"))), F.lit(0)).alias(f"pair_{i}")
                for i in range(1, k + 1)
            ]
        )
    )
    return wide


def ranked_pair_weights(
    pairs: DataFrame, keys: Sequence[str] = ("entity_id", "stay_id"), k: int = 10, places: int = 3
) -> DataFrame:
    """Per-stay pair counts times P(previous | current) of the pair."""
    probs = transition_probabilities(pairs).withColumn("pair", pair_label("prev_unit", "curr_unit"))
    ranked = top_pairs(pairs, k).join(probs.select("pair", "prob"), "pair")
    weights = ranked.agg(
        *[
            F.coalesce(F.max(F.when(F.col("pair_rank") == i, F.col("prob"))), F.lit(0.0)).alias(f"w_{i}")
            for i in range(1, k + 1)
        ]
    )
    one = weights.select(F.struct("*").alias("w")).scalar()
    counts = ranked_pair_counts(pairs, keys, k).withColumn("_w", one)
    return counts.select(
        *keys, *[F.bround(F.col(f"pair_{i}") * F.col("_w")[f"w_{i}"], places).alias(f"pair_{i}") for i in range(1, k + 1)]
    )


def pair_probability_row(pairs: DataFrame, labels: Sequence[str], names: Sequence[str]) -> Column:
    """P(previous | current) of given pairs as one scalar struct; unseen pairs weigh 0."""
    probs = transition_probabilities(pairs).withColumn("pair", pair_label("prev_unit", "curr_unit"))
    row = probs.agg(
        *[
            F.coalesce(F.max(F.when(F.col("pair") == label, F.col("prob"))), F.lit(0.0)).alias(name)
            for label, name in zip(labels, names)
        ]
    )
    return row.select(F.struct("*").alias("w")).scalar()
