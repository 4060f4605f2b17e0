"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. All blocks are sorted and
equal blocks get one integer name; adjacent names are paired, and the pairs are
named the same way, until each text has a single name. Texts of equal block
count are equal exactly when their last names are equal: names come from
comparing contents, so there are no collisions.

Sorting is a range shuffle on (hash of the block, row), so a block that a third
of all rows share is spread over many tasks. Only the hash runs at the edges of
a partition can continue in the next one; their names are joined afterwards
(at most a few rows per partition).

NULL texts count as empty; an empty text is one empty block. Rows that repeat a
doc_id are told apart by their text; of fully equal rows one is kept. A NULL
doc_id is never smaller than another. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import checkpoint, join_facts, same, ship, text_of

BLOCK_BYTES = 4096
SPACES = r"[\x20\x09-\x0D]+"


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names for rows sorted by (h, block); at the end one marker row per block of the edge hash runs."""
    base, count = TaskContext.get().partitionId() << 36, -1
    last_h = last_block = first_h = None
    edges: dict[bytes, int] = {}
    run: dict[bytes, int] = {}
    schema = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, block = batch.column("h").to_numpy(zero_copy_only=False), batch.column("block")
        new = np.ones(len(h), dtype=bool)
        new[1:] = pc.not_equal(block[1:], block[:-1]).to_numpy(zero_copy_only=False)
        new[1:] |= h[1:] != h[:-1]
        new[0] = last_h is None or h[0] != last_h or block[0].as_py() != last_block
        names = base + count + np.cumsum(new)
        first_h = h[0] if first_h is None else first_h
        if first_h == h[0]:
            for i in np.flatnonzero(new & (h == first_h)):
                edges[block[int(i)].as_py()] = int(names[i])
        if last_h is None or h[-1] != last_h:
            run = {}
        for i in np.flatnonzero(new & (h == h[-1])):
            run[block[int(i)].as_py()] = int(names[i])
        count, last_h, last_block = int(names[-1]) - base, h[-1], block[len(h) - 1].as_py()
        if schema is None:
            kept = [f for f in batch.schema if f.name not in ("h", "block")]
            schema = pa.schema([pa.field(f.name, f.type) for f in kept] + [("name", pa.int64()), ("edge", pa.binary())])
        columns = [batch.column(name) for name in schema.names[:-2]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.int64()), pa.nulls(len(h), pa.binary())], schema=schema)
    edges |= run
    if edges:
        nulls = [pa.nulls(len(edges), t) for t in schema.types[:-2]]
        last = [pa.array(edges.values(), pa.int64()), pa.array(edges.keys(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*nulls, *last], schema=schema)


def name_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """Replace the binary column ``block`` by the integer ``name``: equal blocks, equal names.

    ``order`` are columns that tell rows apart, so that a hot block is cut
    across range partitions. The result is checkpointed.
    """
    hashed = df.withColumn("h", F.xxhash64("block"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = hashed.repartitionByRange(parts, "h", *order).sortWithinPartitions("h", "block")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "block")
    named = checkpoint(ranged.mapInArrow(_name, f"{fields}, name long, edge binary"))
    spans = named.filter(F.col("edge").isNotNull()).groupBy("edge").agg(
        F.min("name").alias("_first"), F.collect_list("name").alias("_names")
    )
    moved = spans.filter(F.size("_names") > 1).select("_first", F.explode("_names").alias("_name"))
    rows = named.filter(F.col("edge").isNull()).drop("edge")
    # a few blocks per range partition, so a small broadcast whatever the input
    return rows.join(F.broadcast(moved), F.col("name") == F.col("_name"), "left").withColumn(
        "name", F.coalesce("_first", "name")
    ).drop("_first", "_name")


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: key, keep_key, group_size, kept, text_sha256 (of the normalised text)."""
    normal = F.regexp_replace(text_of(text), SPACES, " ")
    rows = df.select(F.col(key).alias("k"), F.encode(normal, "UTF-8").alias("t"))
    n = F.greatest(F.ceil(F.octet_length("t") / F.lit(block_bytes)), F.lit(1)).cast("long")
    blocks = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
        lambda i: F.substring(F.col("t"), (i * block_bytes + 1).cast("int"), F.lit(block_bytes)),
    )
    cut = rows.select("k", F.sha2("t", 256).alias("sha"), n.alias("n"), "t").select(
        "k", "sha", "n", F.posexplode(blocks).alias("pos", "block")
    )
    level = name_blocks(cut.withColumns({"m": F.lit(1).cast("long"), "left": F.col("n")}), ["k", "sha", "pos"])
    ended = level.filter("left = 1")
    longest = level.agg(F.max("left")).first()[0] or 1
    while longest > 1:
        level = name_blocks(_pairs(level), ["k", "sha", "pos"])
        ended = ended.unionByName(level.filter("left = 1"))
        longest = (longest + 1) // 2
    done = ended.groupBy("k", "sha", "n", "name").agg(F.sum("m").alias("m"))
    groups = done.groupBy("n", "name").agg(
        F.min("k").alias("keep"), F.sum("m").alias("group_size"), F.count("*").alias("ids")
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))
    return (
        join_facts(done, groups, ["n", "name"], "ids", df.count())
        .select("k", "keep", "group_size", "sha", copies.alias("copy"))
        .select(
            F.col("k").alias(key),
            F.col("keep").alias("keep_id"),
            "group_size",
            (F.col("k").eqNullSafe(F.col("keep")) & (F.col("copy") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def _pairs(level: DataFrame) -> DataFrame:
    """Adjacent names of the texts that have more than one, as new blocks; ``m`` counts fully equal rows."""
    even = F.col("pos") % 2 == 0
    paired = level.filter("left > 1").groupBy("k", "sha", "n", "left", F.floor(F.col("pos") / 2).alias("pair")).agg(
        F.max(F.when(even, F.col("name"))).alias("a"),
        F.max(F.when(~even, F.col("name"))).alias("b"),
        F.sum(F.when(even, F.col("m"))).alias("m"),
    )
    block = F.encode(F.concat_ws(",", "a", "b"), "UTF-8")
    return paired.select(
        "k", "sha", "n", "m", F.col("pair").cast("int").alias("pos"), F.ceil(F.col("left") / 2).alias("left"), block.alias("block")
    )


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all their columns kept; rows that repeat key and text leave one."""
    kept = exact_dedup(df, key, text).filter("kept").select(F.col(key).alias("_k"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.encode(F.regexp_replace(text_of(text), SPACES, " "), "UTF-8"), 256)
    packed = df.select(F.struct("*").alias("row"), F.col(key).alias("k"), sha.alias("sha")).dropDuplicates(["k", "sha"])
    return packed.join(kept, same([F.col("k"), F.col("sha")], [F.col("_k"), F.col("_sha")]), "left_semi").select("row.*")


ship(__name__)
