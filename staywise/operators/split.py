"""Train / test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.codes import hash_unit
from staywise.operators.ordered import NO_HOT_KEYS, HotKeys, ordered

MAX_SHARE = 0.83


def split_random(df: DataFrame, train: float = 0.7, seed: int = 2) -> tuple[DataFrame, DataFrame]:
    """Random split by row (M1)."""
    left, right = df.randomSplit([train, 1 - train], seed)
    return left, right


def split_by_hash(df: DataFrame, *keys: str, train: float = 0.7, seed: str = "2") -> DataFrame:
    """Add ``part``: repeatable on any partitioning, because only the key decides (M1)."""
    return df.withColumn("part", F.when(hash_unit(seed, *keys) < train, "train").otherwise("test"))


def split_by_entity(
    df: DataFrame,
    entity: str,
    time: str,
    tie: str,
    train: float = 0.75,
    hot: HotKeys = NO_HOT_KEYS,
) -> DataFrame:
    """Add ``part``: the earliest share of each entity's rows trains, at least one row.

    Entities with one or two rows give one training row.
    """
    if train > MAX_SHARE:
        raise ValueError(f"a training share above {MAX_SHARE} leaves small entities without test rows")
    one = F.lit(1)
    counted = ordered(df, [entity], time, [tie], running={"_nth": one}, totals={"_n": one}, hot=hot)
    quota = F.when(F.col("_n") > 2, F.bround(F.col("_n") * train, 0)).otherwise(1)
    return counted.withColumn("part", F.when(F.col("_nth") <= quota, "train").otherwise("test")).drop("_nth", "_n")
