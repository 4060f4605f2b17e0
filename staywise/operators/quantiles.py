"""Exact quantiles without gathering a group's values in one task.

``percentile`` / ``median`` keep every distinct value of a group in one buffer.
Here one pass builds a mergeable sketch per group that brackets each wanted
rank, and a last pass counts what lies below each bracket and ranks the few
values inside it. Brackets that hold more than ``BRACKET_ROWS`` rows are
narrowed first, by sketches of the values inside them, and widened where they
miss their rank, so what one task ranks does not grow with the group. The result
is exact (linear interpolation between neighbours, as pandas does).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise.session import reliable_checkpoint

ACCURACY = 100_000  # a bracket spans about 4 / ACCURACY of a group's rows
BROADCAST_GROUPS = 10_000
BRACKET_ROWS = 100_000  # rows that a bracket may hold in the last pass
STEPS = 512  # quantiles of a bracket's values that narrow it


def exact_quantiles(
    df: DataFrame,
    value: Column | str,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    broadcast_groups: int = BROADCAST_GROUPS,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """One row per group: ``by`` columns plus one column per probability.

    Runs the sketch pass when called. Up to ``broadcast_groups`` brackets are
    brought back and broadcast; beyond that they are joined.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = [f"_g{i}" for i in range(len(by))]
    data = df.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)], value.cast("double").alias("_v")
    ).filter(F.col("_v").isNotNull())
    bracketed = _with_brackets(data, keys, probs, accuracy, broadcast_groups, bracket_rows)
    targets = range(len(probs))
    low, high = [F.col(f"_lo{i}") for i in targets], [F.col(f"_hi{i}") for i in targets]
    v = F.col("_v")

    # Values in a bracket keep their own row, all others of the group share the NULL row.
    kept = F.lit(False)
    for i in targets:
        kept = kept | v.between(low[i], high[i])
    counted = bracketed.groupBy(*keys, F.when(kept, v).alias("_value")).agg(
        F.count("*").alias("_c"),
        *[F.max(f"{end}{i}").alias(f"{end}{i}") for end in ("_lo", "_hi") for i in targets],
        *[F.count_if(v < low[i]).alias(f"_below{i}") for i in targets],
        *[F.max(F.when(v < low[i], v)).alias(f"_under{i}") for i in targets],
        *[F.min(F.when(v > high[i], v)).alias(f"_over{i}") for i in targets],
    )
    # From here on a group has only its bracketed values left.
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    spread = counted.select(
        *keys,
        "_value",
        "_c",
        F.sum("_c").over(group).alias("_n"),
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"),
                    F.lit(float(p)).alias("p"),
                    F.col("_value").between(low[i], high[i]).alias("inside"),
                    F.sum(f"_below{i}").over(group).alias("below"),
                    F.max(f"_under{i}").over(group).alias("under"),
                    F.min(f"_over{i}").over(group).alias("over"),
                )
                for i, p in enumerate(probs)
            ]
        ).alias("_targets"),
    )
    exploded = spread.select(*keys, "_value", "_c", "_n", F.explode("_targets").alias("t")).filter("t.inside")
    walk = Window.partitionBy(*keys, "t.i").orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = exploded.withColumn("_end", F.col("t.below") + F.sum("_c").over(walk))
    start, end = F.col("_end") - F.col("_c"), F.col("_end")
    position = F.col("t.p") * (F.col("_n") - 1)
    first, second = F.floor(position), F.ceil(position)

    def at_rank(rank: Column) -> Column:
        found = F.max(F.when((start <= rank) & (rank < end), F.col("_value")))
        edge = F.max(
            F.when(rank == F.col("t.below") - 1, F.col("t.under")).when(rank >= F.col("t.below"), F.col("t.over"))
        )
        return F.coalesce(found, edge)

    picked = (
        ranked.groupBy(*keys, F.col("t.i").alias("_i"))
        .agg(
            at_rank(first).alias("_a"),
            at_rank(second).alias("_b"),
            F.max(position - first).alias("_w"),
            (F.min(first) < F.min("t.below") - 1).alias("_short"),
            (F.max(second) > F.max(end)).alias("_long"),
        )
        .withColumn(
            "_q",
            F.when(
                F.col("_short") | F.col("_long"),
                F.raise_error(F.lit("quantile left its bracket")).cast("double"),
            ).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")),
        )
    )
    return picked.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, by)]).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)]
    )


def _ends(probs: Sequence[float]) -> list[str]:
    return [f"{end}{i}" for end in ("_lo", "_hi") for i in range(len(probs))]


def _with_brackets(
    data: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: int, most: int, bracket_rows: int
) -> DataFrame:
    """Add ``_lo<i>`` / ``_hi<i>``: per probability, values safely around the wanted rank."""
    slack, ends = 2.0 / accuracy, _ends(probs)
    at = [F.lit(min(max(p + shift, 0.0), 1.0)) for shift in (-slack, slack) for p in probs]
    both = data.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*at), accuracy).alias("_b"), F.count("*").alias("_n"))
    if not keys:
        found = both.first()
        values = found["_b"] or [None] * len(ends)
        if found["_n"] * 2 * slack > bracket_rows:
            one = data.sparkSession.createDataFrame([(0, *map(float, values))], "_one int, " + ", ".join(f"{end} double" for end in ends))
            narrow = _narrowed(data.withColumn("_one", F.lit(0)), ["_one"], one, probs, bracket_rows, most).first()
            values = [narrow[end] for end in ends]
        return data.withColumns({end: F.lit(x).cast("double") for end, x in zip(ends, values)})
    named = both.select(*keys, *[F.col("_b")[j].alias(end) for j, end in enumerate(ends)], "_n")
    rows = named.limit(most + 1).collect()
    few = len(rows) <= most
    if few:
        largest = max((r["_n"] for r in rows), default=0)
        named = data.sparkSession.createDataFrame(rows, named.schema)
    else:
        largest = named.agg(F.max("_n")).first()[0]
    if largest * 2 * slack > bracket_rows:
        named = _narrowed(data, keys, named.drop("_n"), probs, bracket_rows, most)
    return _bracketed(data, keys, named, few).drop("_n")


def _bracketed(data: DataFrame, keys: Sequence[str], brackets: DataFrame, few: bool) -> DataFrame:
    brackets = brackets.withColumnsRenamed({k: f"{k}_b" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}_b"))
    return data.join(F.broadcast(brackets) if few else brackets, match).drop(*[f"{k}_b" for k in keys])


def _narrowed(data: DataFrame, keys: Sequence[str], brackets: DataFrame, probs: Sequence[float], bracket_rows: int, most: int) -> DataFrame:
    """Brackets of which each holds its rank, and at most ``bracket_rows`` rows unless one value has more.

    A round counts what lies below and inside each open bracket and takes ``STEPS`` quantiles of the inside; the new
    bracket lies between the ones around the rank. A bracket that misses its rank moves to the side it missed.
    """
    ends = _ends(probs)
    waiting, done = brackets, None
    while True:
        v = F.col("_v")
        grid = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
        inside = [v.between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(probs))]
        counted = _bracketed(data, keys, waiting, waiting.limit(most + 1).count() <= most).groupBy(*keys).agg(
            F.count("*").alias("_n"),
            *[F.first(end).alias(end) for end in ends],
            *[F.count_if(v < F.col(f"_lo{i}")).alias(f"_below{i}") for i in range(len(probs))],
            *[F.count_if(inside[i]).alias(f"_in{i}") for i in range(len(probs))],
            *[F.percentile_approx(F.when(inside[i], v), grid, 10 * STEPS).alias(f"_at{i}") for i in range(len(probs))],
        )
        new, opened = [], F.lit(False)
        for i, p in enumerate(probs):
            low, high, below, size = (F.col(f"{c}{i}") for c in ("_lo", "_hi", "_below", "_in"))
            rank = F.lit(float(p)) * (F.col("_n") - 1)
            left, right = F.floor(rank) < below, F.ceil(rank) >= below + size
            # places among the steps, two steps wide of the rank on either side
            start = F.floor((F.floor(rank) - below) / size * STEPS).cast("int") - 2
            stop = F.ceil((F.ceil(rank) - below + 1) / size * STEPS).cast("int") + 2
            wide = size > bracket_rows
            lower = F.when(left, F.lit(float("-inf"))).when(right, F.least(low, high)).when(wide & (start > 0), F.get(f"_at{i}", start)).otherwise(low)
            upper = F.when(right, F.lit(float("inf"))).when(left, high).when(wide & (stop < STEPS), F.get(f"_at{i}", stop)).otherwise(high)
            new += [lower.alias(f"_lo{i}"), upper.alias(f"_hi{i}")]
            opened = opened | left | right | (wide & ((lower > low) | (upper < high)))
        moved = reliable_checkpoint(counted.select(*keys, *new, opened.alias("_open")))
        closed = moved.filter(~F.col("_open")).drop("_open").select(*keys, *ends)
        done = closed if done is None else done.unionByName(closed)
        waiting = moved.filter("_open").select(*keys, *ends)
        if waiting.isEmpty():
            return done
