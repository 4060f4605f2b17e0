"""Repeatable resampling: every draw follows from a hash of the row key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.codes import hash_unit

def poisson_terms(rate: float) -> int:
    """Copies beyond which a 32-bit uniform number cannot reach at this rate."""
    reached = term = math.exp(-rate)
    i = 0
    while reached < 1.0 - 2.0**-33 and i < 10_000:
        i += 1
        term *= rate / i
        reached += term
    return i + 1


def poisson_copies(u: Column, rate: float) -> Column:
    """Poisson count by inversion of a uniform number (the bootstrap in the limit of many rows)."""
    reached = term = math.exp(-rate)
    steps = []
    for i in range(1, poisson_terms(rate) + 1):
        steps.append(reached)
        term *= rate / i
        reached += term
    copies = F.lit(0)
    for step in steps:
        copies = copies + F.when(u >= F.lit(step), 1).otherwise(0)
    return copies


def bootstrap(df: DataFrame, keys: Sequence[str], seed: str, draws: int | None = None) -> DataFrame:
    """Copies of the rows drawn with replacement: as many as there are rows, or about ``draws``.

    ``draws`` needs the row count, which is one small job.
    """
    rate = 1.0
    if draws is not None:
        n = df.count()
        if n == 0:
            return df.withColumn("copy", F.lit(0))
        rate = draws / n
    whole = int(rate // 32)  # beyond 32 per row, the sum of several independent counts
    parts = [(f"{seed}/{i}", 32.0) for i in range(whole)]
    parts.append((seed, rate - 32.0 * whole))
    copies = F.lit(0)
    for name, part in parts:
        copies = copies + poisson_copies(hash_unit(name, *keys), part)
    return (
        df.withColumn("_copies", copies)
        .filter(F.col("_copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "_copies")))
        .drop("_copies")
    )


def oversample(
    df: DataFrame, draws: Sequence[tuple[Column, str, int | None]], keys: Sequence[str]
) -> DataFrame:
    """All rows (``copy`` 0) plus bootstrap copies of each ``(condition, seed, draws)`` subset.

    Resample after splitting, so copies of a training row cannot reach the test rows.
    """
    out = df.withColumn("copy", F.lit(0))
    for condition, seed, n in draws:
        out = out.unionByName(bootstrap(df.filter(condition), keys, seed, n))
    return out


def undersample_entities(
    df: DataFrame, entity: str, common: Column, rare: Column, n: int, seed: str
) -> DataFrame:
    """All rows of ``n`` entities chosen from the common rows, plus all rare rows.

    Rare rows of a chosen entity appear twice, as in a plain concatenation.
    """
    chosen = (
        df.filter(common).select(entity).distinct()
        .orderBy(hash_unit(seed, entity), entity).limit(n)
    )
    return df.join(chosen, entity, "left_semi").unionByName(df.filter(rare))

