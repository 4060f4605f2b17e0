"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; rank r of n
sits at the fraction (r - 0.5) / n. Sorting all rows by that fraction deals the
sources evenly over the whole order, and cutting the order into equal runs
gives every shard the mixture of the whole, with counts at most one apart.

Neither sort runs in one task: the hash and the fraction are spread evenly, so
both are cut into buckets of equal width, ranked bucket by bucket and shifted by
the totals of the buckets before. A source that holds most rows has as many
more rows per bucket, never more than a bucket's share of all rows.

A NULL source is a source of its own. NULL texts have no bytes. Rows that repeat
a doc_id are ordered by their text's checksum and size; fully equal rows are
interchangeable. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise.llm.common import checkpoint, text_of

BUCKET_ROWS = 100_000
ROW_BYTES = 8  # what a row takes besides its text
SPAN = 1 << 32


def _bucket(fraction: Column, buckets: int) -> Column:
    return F.least(F.floor(fraction * buckets), F.lit(buckets - 1)).cast("int")


def interleave(df: DataFrame, shards: int, key: str, text: str, source: str, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: key, source, size, text_crc32, shard, slot."""
    body = F.encode(text_of(text), "UTF-8")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    rows = checkpoint(
        df.select(
            F.col(key).alias("k"),
            F.col(source).alias("s"),
            (F.octet_length(text_of(text)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(body).alias("crc"),
            drawn.alias("h"),
        )
    )
    total = rows.count()
    # a source that holds most rows still has a share of every bucket, so of every task
    buckets = max(-(-total // bucket_rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("b", _bucket(F.col("h") / SPAN, buckets))
    # per source and bucket: rows before it, and rows of the source
    counts = rows.groupBy("s", "b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(
        F.col("s").alias("s2"),
        F.col("b").alias("b2"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"),
        F.sum("n").over(Window.partitionBy("s")).alias("of"),
    )
    local = Window.partitionBy("s", "b").orderBy("h", "k", "crc", "size")
    ranked = rows.withColumn("r", F.row_number().over(local)).join(
        shift, F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2"))
    )
    placed = ranked.withColumn("f", (F.col("ahead") + F.col("r") - F.lit(0.5)) / F.col("of"))
    placed = checkpoint(placed.select("k", "s", "size", "crc", "h", "f", _bucket(F.col("f"), buckets).alias("c")))
    # one row per bucket of BUCKET_ROWS rows, so one task orders few rows
    ends = placed.groupBy("c").agg(F.count("*").alias("n"))
    whole = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(F.col("c").alias("c2"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("start"))
    inner = Window.partitionBy("c").orderBy("f", "s", "h", "k", "crc", "size")
    at = placed.withColumn("at", F.row_number().over(inner) - 1).join(starts, F.col("c") == F.col("c2")).withColumn(
        "at", F.col("at") + F.col("start")
    )
    shard = F.expr(f"(at * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return at.withColumn("shard", shard).select(
        F.col("k").alias(key),
        F.col("s").alias(source),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") - first).alias("slot"),
    )
