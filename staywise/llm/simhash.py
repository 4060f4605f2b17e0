"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: words are runs of bytes other than ASCII white space, A-Z in lower
case; every shingle of ``length`` words votes with its XXH64; a bit is set where
over half of the votes are. A text of fewer words is one shingle, one without
words has fingerprint zero.

Links: fingerprints within ``most`` differing bits. Equal fingerprints are one
node, so a group of copies of any size costs one. The top of the index splits
the 64 bits into most + 2 blocks: two fingerprints within ``most`` bits agree on
at least two blocks, so each fingerprint enters the node of every block pair and
meets all its partners there. Nodes are dealt out over the tasks by a shuffle. In
a task the members of all nodes lie in Gray order within their node; runs of
members form upper levels that hold the bits all of them share (mask and
pattern). A query walks down from the top of its own node, adds up the
differences and drops a whole run as soon as they exceed ``most``; all queries
walk together, as arrays. Only a spanning forest of the links found leaves a
task. Components are then found on Spark, and no link list reaches the driver.

NULL texts count as empty. Rows that repeat a doc_id each get their own line. A
NULL doc_id takes part but never is a component's name unless there is no other.
Extra columns are ignored by ``near_dedup`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import bit_table, checkpoint, join_facts, same, ship, split_by_bits, text_of
from staywise.llm.components import components

SEED = 42
FANOUT = 8
WALK_PAIRS = 2_000_000  # (query, run) pairs looked at together
VOTES = 1 << 17  # shingles of one text counted together
MEMBERS = 1 << 20  # members of one index; a larger partition is cut between nodes


def fingerprint(text: str, length: int) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    first, last = (starts[: -length + 1 or None], ends[length - 1 :]) if len(words) >= length else (starts[:1], ends[-1:])
    digest, n = xxhash.xxh64_intdigest, len(first)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, VOTES):
        spans = zip(first[i : i + VOTES].tolist(), last[i : i + VOTES].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(k, d, f): the key, a digest of the text and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py(), length) for t in batch.column("t")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("d"), found], names=["k", "d", "f"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), text_of(text).alias("t")).withColumn("d", F.xxhash64("t"))
    return rows.mapInArrow(run, f"k {kind}, d long, f long")


def blocks(most: int) -> list[int]:
    """Masks of most + 2 blocks of the 64 bits, as even as they can be."""
    parts = most + 2
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Nodes of members in Gray order below levels of runs that hold their shared bits."""

    def __init__(self, nodes: np.ndarray, values: np.ndarray):
        order = np.lexsort((gray_rank(values), nodes))
        self.values = values[order]
        node = nodes[order]
        new = np.r_[True, node[1:] != node[:-1]]
        self.node_of = np.cumsum(new) - 1
        # a level: first member of each run, its mask and pattern, and the first run of each node
        first, starts = np.arange(len(node)), np.flatnonzero(new)
        ones = np.full(len(node), ~np.uint64(0))
        self.levels = [(np.r_[starts, len(first)], ones, self.values)]
        while (np.diff(self.levels[-1][0]) > FANOUT).any():
            bounds, mask, pattern = self.levels[-1]
            sizes = -(-np.diff(bounds) // FANOUT)
            up = np.r_[0, np.cumsum(sizes)]
            which = np.repeat(np.arange(len(sizes)), sizes)
            begin = bounds[:-1][which] + (np.arange(up[-1]) - up[:-1][which]) * FANOUT
            every, some = np.bitwise_and.reduceat(pattern, begin), np.bitwise_or.reduceat(pattern, begin)
            shared = np.bitwise_and.reduceat(mask, begin) & ~(every ^ some)
            self.levels.append((up, shared, every & shared))

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of places within ``most`` bits, the second place after the first, in bounded lots."""
        top_bounds = self.levels[-1][0]
        width = np.diff(top_bounds)[self.node_of]
        cost = np.cumsum(width)
        begin = 0
        while begin < len(self.values):
            stop = max(int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + WALK_PAIRS // FANOUT)), begin + 1)
            query = np.arange(begin, stop)
            yield from self._walk(np.repeat(query, width[begin:stop]), _ranges(top_bounds[self.node_of[query]], width[begin:stop]), len(self.levels) - 1, most)
            begin = stop

    def _walk(self, query: np.ndarray, run: np.ndarray, level: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, mask, pattern = self.levels[level]
        for i in range(0, len(query), WALK_PAIRS):
            q, r = query[i : i + WALK_PAIRS], run[i : i + WALK_PAIRS]
            near = np.bitwise_count((self.values[q] ^ pattern[r]) & mask[r]) <= most
            q, r = q[near], r[near]
            if level == 0:
                later = r > q
                yield q[later], r[later]
                continue
            up, below = self.levels[level][0], self.levels[level - 1][0]
            node = self.node_of[q]
            child = below[node] + (r - up[node]) * FANOUT
            count = np.minimum(FANOUT, below[node + 1] - child)
            yield from self._walk(np.repeat(q, count), _ranges(child, count), level - 1, most)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


class _Forest:
    """Keeps the links that join two trees."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, a: int) -> int:
        root = self.root
        while (up := root.get(a, a)) != a:
            root[a] = root.get(up, up)
            a = up
        return a

    def joins(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)
        return a != b


def _link_nodes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, f) sorted by node in; links (a, b) out."""
    names = ["a", "b"]
    held_n, held_f, size, forest = [], [], 0, _Forest()

    def flush(nodes: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        index = GrayIndex(nodes, values.view(np.uint64))
        signed = index.values.view(np.int64)
        for a, b in index.links(most):
            pairs = [(x, y) for x, y in zip(signed[a].tolist(), signed[b].tolist()) if forest.joins(x, y)]
            if pairs:
                left, right = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=names)

    for batch in batches:
        held_n.append(batch.column("node").to_numpy(zero_copy_only=False))
        held_f.append(batch.column("f").to_numpy(zero_copy_only=False))
        size += batch.num_rows
        if size >= MEMBERS:
            nodes, values = np.concatenate(held_n), np.concatenate(held_f)
            cut = int(np.searchsorted(nodes, nodes[-1]))  # the last node may go on
            if cut:
                yield from flush(nodes[:cut], values[:cut])
            held_n, held_f, size = [nodes[cut:]], [values[cut:]], len(nodes) - cut
    if size:
        yield from flush(np.concatenate(held_n), np.concatenate(held_f))


def near_links(distinct: DataFrame, most: int) -> DataFrame:
    """Links (a, b) of the distinct fingerprints ``f``: enough to join all within ``most`` bits of each other."""
    masks = [a | b for a, b in combinations(blocks(most), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    nodes = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("f").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)]))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("f", nodes.alias("node")).repartition(parts, "node").sortWithinPartitions("node")
    # a node of one member has no link
    return dealt.mapInArrow(lambda batches: _link_nodes(batches, most), "a long, b long").distinct()


def _named(df: DataFrame, key: str, text: str, length: int, most: int) -> DataFrame:
    """(k, d, f, name) per input row; name: the (none, k, d) of the first text of its component."""
    rows = checkpoint(fingerprints(df, key, text, length))
    place = F.struct(F.col("k").isNull().alias("none"), "k", "d")
    per = checkpoint(rows.groupBy("f").agg(F.min(place).alias("low"), F.count("*").alias("n")))
    reach = components(near_links(per.select("f"), most))
    named = per.join(reach, F.col("f") == F.col("node"), "left").withColumn("c", F.coalesce("component", "f")).drop("node", "component")
    names = named.groupBy("c").agg(F.min("low").alias("name")).withColumnRenamed("c", "_c")
    facts = checkpoint(named.join(names, F.col("c") == F.col("_c")).select("f", "n", "name"))
    return join_facts(rows, facts, ["f"], "n", rows.count())


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 4, most: int = 4) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component_id."""
    return _named(df, key, text, length, most).select(
        F.col("k").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("name.k").alias("component_id")
    )


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 4, most: int = 4) -> DataFrame:
    """The first document of each component, all its columns kept; of fully equal rows one stays."""
    named = _named(df, key, text, length, most)
    keep = F.col("k").eqNullSafe(F.col("name.k")) & (F.col("d") == F.col("name.d"))
    # what must be looked at: documents that go, and first ones that have equal rows
    gone = named.groupBy("k", "d").agg(F.max(keep).alias("keep"), F.count("*").alias("m")).filter("not keep or m > 1")
    gone = checkpoint(gone.select(F.col("k").alias("_k"), F.col("d").alias("_d"), "keep"))
    bits = checkpoint(bit_table(gone, F.col("_k"), F.col("_d")))
    packed = df.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text_of(text)).alias("d"))
    marked = split_by_bits(packed, bits, F.col("k"), F.col("d"))
    hit = marked.filter("_maybe").join(gone, same([F.col("k"), F.col("d")], [F.col("_k"), F.col("_d")]), "left")
    first = hit.filter(F.coalesce("keep", F.lit(True))).dropDuplicates(["k", "d"])
    return marked.filter("not _maybe").select("row.*").unionByName(first.select("row.*"))


ship(__name__)
