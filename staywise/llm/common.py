"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 1 << 17  # rows of a bit table: 2**23 bits, 2 MB, whatever the input
HOT_PARTS = 1000  # a key is hot above 1/HOT_PARTS of all rows, so fewer than HOT_PARTS keys are


def ship(module: str) -> None:
    """Pickle the module's functions by value: executors then need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; one of its own only where that is unset, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and reread it: computed once, read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_of(column: str) -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """All pairs equal, NULL equal to NULL."""
    match = F.lit(True)
    for a, b in zip(left, right):
        match = match & a.eqNullSafe(b)
    return match


def _word(h: Column) -> Column:
    return F.pmod(h, F.lit(WORDS))


def _bit(h: Column) -> Column:
    shift = F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), shift)


def bit_table(df: DataFrame, *cols: Column) -> DataFrame:
    """A one-hash bit set of the given keys, as at most ``WORDS`` rows (w, bits): a bounded broadcast."""
    h = F.xxhash64(*cols)
    return df.select(_word(h).alias("w"), _bit(h).alias("b")).groupBy("w").agg(F.bit_or("b").alias("bits"))


def split_by_bits(df: DataFrame, bits: DataFrame, *cols: Column) -> DataFrame:
    """Add ``_maybe``: false where the key is surely not in the set the bits were made of.

    The table has at most ``WORDS`` rows by construction, so its broadcast has
    a fixed bound; a fuller set only lets more rows through.
    """
    h = F.xxhash64(*cols)
    found = df.join(F.broadcast(bits.withColumnRenamed("w", "_w").withColumnRenamed("bits", "_bits")), _word(h) == F.col("_w"), "left")
    return found.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(_bit(h)) != 0, F.lit(False))).drop("_w", "_bits")


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to one fact row per key, hot keys by broadcast.

    ``size`` is the fact column with the number of rows of the key. Keys above
    1/HOT_PARTS of ``total`` rows (fewer than HOT_PARTS of them) reach the rows
    where they are; all others by a shuffle on the key.
    """
    limit = max(total // HOT_PARTS, 10_000)
    renamed = facts.select(*[F.col(k).alias(f"_f_{k}") for k in keys], *[c for c in facts.columns if c not in keys])
    match = same([F.col(k) for k in keys], [F.col(f"_f_{k}") for k in keys])
    drops = [f"_f_{k}" for k in keys]
    hot = renamed.filter(F.col(size) > limit)
    if total <= limit or hot.isEmpty():
        return rows.join(renamed, match).drop(*drops)
    marks = hot.select(*drops)
    cold = rows.join(F.broadcast(marks), match, "left_anti")
    return rows.join(F.broadcast(hot), match).drop(*drops).unionByName(
        cold.join(renamed.filter(F.col(size) <= limit), match).drop(*drops)
    )
