"""Suffix-array dedup of byte strings over a whole corpus.

Every byte covered by a string of ``span`` bytes that also starts earlier (smaller
key, or same text and earlier start) is removed; overlaps count, and strings are
judged on the input.

One suffix array over all texts has no place to stand, so the corpus is cut into
parts that share no string of ``span`` bytes:

1. Each window of ``span`` bytes names two anchors, its 32-byte grams of smallest
   and of largest hash (the leftmost of ties). They depend on the window's bytes
   alone, so equal windows have equal anchors. Windows of one text with the same
   two anchors are consecutive and form a segment.
2. Anchor pairs are counted over the corpus, combined on the map side. A pair that
   occurs once cannot belong to a repeat. Those that occur more often go into a
   bit set of fixed size that every task gets.
3. Segments whose pair passes are sent, with their bytes, to the part their
   smallest anchor names; neighbours with the same smallest anchor go as one piece.
   Equal pieces that one task meets are sent once; a passage that a third of all
   texts share costs a row or so per task.
4. In a part, of equal pieces the earliest stays. The pieces of an anchor that
   differ are joined into one text and sorted as suffixes: those smaller than their
   successors directly, the others induced by bucket scans. Runs of adjacent common
   prefixes of ``span`` bytes are the repeats; the earliest start of each run stays.

Windows are compared by their bytes; hashes only say which can be equal.

NULL texts count as empty. A NULL key ranks after all others. Rows that repeat a
key are told apart, and ordered, by a digest of their text; fully equal rows are
one text and lose the same bytes. Extra columns are kept by ``drop_repeated_bytes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm import suffix_sort
from staywise.llm.common import bit_table, checkpoint, same, ship, split_by_bits, text_of

SPAN, GRAM = 100, 32
STEP = 1 << 16  # window starts looked at together: few enough for a core's cache
BITS = 1 << 27  # of the set of repeated anchors: 16 MB, whatever the input
SEEN_BYTES = 32 << 20  # segments a task remembers, to send equal ones once
SORT_BYTES = 2 << 20  # bytes sorted together
PLACE = np.uint64((1 << 24) - 1)
BYTE_HASH = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each place on."""
    h = BYTE_HASH[data]
    width = 1
    for odd in ODD:
        h = h[:-width] * odd + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    h *= np.uint64(0x2545F4914F6CDD1D)
    h ^= h >> np.uint64(32)
    return h


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = pick(out[: len(out) - (width - have)], out[width - have :])
    return out


class _Buffer:
    """The texts of a batch as one byte array."""

    def __init__(self, column: pa.Array):
        kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]

    def segments(self, span: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(text number, first start, last start, place and hash of the smallest anchor, hash of the pair), lot by lot."""
        n, grams = len(self.data), span - GRAM + 1
        for begin in range(0, max(n - span + 1, 0), STEP):
            stop = min(begin + STEP, n - span + 1)
            hashes = gram_hashes(self.data[begin : stop + span - 1])
            places = np.arange(len(hashes), dtype=np.uint64)
            low = _sliding(hashes & ~PLACE | places, grams, np.minimum) & PLACE
            starts = np.arange(begin, stop)
            row = np.searchsorted(self.offsets, starts, side="right") - 1
            valid = starts + span <= self.offsets[row + 1]
            high = PLACE - (_sliding(hashes & ~PLACE | (PLACE - places), grams, np.maximum) & PLACE)
            new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]]
            first = np.flatnonzero(new & valid)
            if not len(first):
                continue
            edges = np.r_[np.flatnonzero(new | ~valid), len(starts)]
            last = edges[np.searchsorted(edges, first, side="right")] - 1
            least = hashes[low[first]]
            yield row[first], starts[first], starts[last], low[first], least, least * np.uint64(3) ^ hashes[high[first]] * ODD[0]


def _anchor_counts(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *_, pair in _Buffer(batch.column("t")).segments(span):
            found, counts = np.unique(pair.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], names=["h", "n"])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], span: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ranges to remove (c is NULL) and segments to compare, by first and last start: (k, d, lo, hi, p, c)."""
    seen: dict[bytes, tuple] = {}
    held, schema = 0, None
    for batch in batches:
        keys, digests = batch.column("k").to_pylist(), batch.column("d").to_pylist()
        schema = schema or pa.schema([
            pa.field("k", batch.schema.field("k").type), ("d", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("p", pa.int64()), ("c", pa.binary()),
        ])
        buffer = _Buffer(batch.column("t"))
        raw, offsets = buffer.data.tobytes(), buffer.offsets
        for row, first, last, at, low, pair in buffer.segments(span):
            word = bits[(pair >> np.uint64(6)) & np.uint64(BITS // 64 - 1)]
            wanted = np.flatnonzero((word >> (pair & np.uint64(63))) & np.uint64(1))
            if not len(wanted):
                continue
            row, first, last, at, low = row[wanted], first[wanted], last[wanted], at[wanted], low[wanted]
            # neighbours with the same smallest anchor are one piece, in which no window repeats
            new = np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)]
            last = last[np.r_[np.flatnonzero(new)[1:] - 1, len(new) - 1]]
            row, first, part = row[new], first[new], low[new].view(np.int64)
            gone: dict[int, list[tuple[int, int]]] = {}
            sent: list[tuple] = []
            for r, a, b, p in zip(row.tolist(), first.tolist(), last.tolist(), part.tolist()):
                piece, base = raw[a : b + span], int(offsets[r])
                key = keys[r]
                place = (key is None, key, digests[r], a - base)
                known = seen.get(piece)
                if known is not None and known < place:
                    gone.setdefault(r, []).append((a - base, b - base + span))
                    continue
                if known == place:
                    continue
                seen[piece] = place
                held += len(piece)
                sent.append((key, digests[r], a - base, b - base, p, piece))
                if held > SEEN_BYTES:
                    seen, held = {}, 0
            sent += [(keys[r], digests[r], a, b, digests[r] ^ a, None) for r, spans in gone.items() for a, b in _merged(spans)]
            if sent:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sent), schema)], schema=schema)


def _repeats(classes: list[tuple], span: int) -> list[tuple]:
    """(k, d, start) of all windows of the pieces (k, d, lo, c) that also start earlier, as spans."""
    texts = sorted({(k is None, k, d) for k, d, _, _ in classes})
    rank = {t: i for i, t in enumerate(texts)}
    sizes = np.array([len(c) for *_, c in classes], np.int64)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    symbols = np.zeros(int(ends[-1]), np.int64)
    inner = np.ones(len(symbols), bool)
    inner[ends - 1] = False
    symbols[inner] = np.frombuffer(b"".join(c for *_, c in classes), np.uint8).astype(np.int64) + 1
    words = suffix_sort.pack(symbols)
    order = suffix_sort.suffix_array(symbols, words, span + suffix_sort.PER_WORD)
    shared = suffix_sort.common_prefixes(order, words, span)
    piece = np.searchsorted(ends, order, side="right")
    offset = order - begins[piece]
    start = np.array([lo for _, _, lo, _ in classes], np.int64)[piece] + offset
    of = np.array([rank[k is None, k, d] for k, d, _, _ in classes], np.int64)[piece]
    run = np.cumsum(shared < span)
    again = np.zeros(len(order), bool)
    # a prefix that runs over a separator is no string of one text
    multiple = np.flatnonzero((np.r_[shared[1:] >= span, False] | (shared >= span)) & (offset + span <= sizes[piece]))
    if len(multiple):
        at = multiple[np.lexsort((start[multiple], of[multiple], run[multiple]))]
        lead = np.r_[True, run[at][1:] != run[at][:-1]]
        lead = at[np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))]
        again[at] = (of[at] != of[lead]) | (start[at] != start[lead])
    out = []
    hits = np.flatnonzero(again)
    hits = hits[np.lexsort((start[hits], of[hits]))]
    for i, s in zip(of[hits].tolist(), start[hits].tolist()):
        if out and out[-1][0] == i and s <= out[-1][2]:
            out[-1][2] = s + span
        else:
            out.append([i, s, s + span])
    return [(texts[i][1], texts[i][2], a, b) for i, a, b in out]


def _compare(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (p, c, place): of equal pieces the earliest, of others the suffixes."""
    schema = None
    group: list[tuple] = []  # distinct pieces of the anchor at hand
    lot: list[tuple] = []  # distinct pieces of anchors that have several
    size = group_size = 0
    last_p = last_c = first = None
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        schema = schema or pa.schema([pa.field("k", batch.schema.field("k").type), ("d", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
        columns = [batch.column(c).to_pylist() for c in ("k", "d", "lo", "hi", "p", "c")]
        for k, d, lo, hi, p, c in zip(*columns):
            if c is None:
                out.append((k, d, lo, hi))
                continue
            if p == last_p and c == last_c:
                if (k, d, lo) != first:  # a fully equal row is the same text
                    out.append((k, d, lo, hi + span))
                continue
            if p != last_p:
                if len(group) > 1:
                    lot += group
                    size += group_size
                group, group_size = [], 0
                if size > SORT_BYTES:
                    out += _repeats(lot, span)
                    lot, size = [], 0
            group.append((k, d, lo, c))
            group_size += len(c)
            last_p, last_c, first = p, c, (k, d, lo)
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
    if len(group) > 1:
        lot += group
    if lot:
        out += _repeats(lot, span)
    if out:
        yield batch_of(out)


def _repeated_anchors(rows: DataFrame, span: int) -> np.ndarray:
    """Bit set of the anchor pairs that occur more than once; at most BITS / 64 rows come back."""
    counts = rows.select("t").mapInArrow(lambda batches: _anchor_counts(batches, span), "h long, n long")
    often = counts.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    word = F.shiftright("h", 6).bitwiseAND(BITS // 64 - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    found = often.groupBy(word.cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(k, d, spans): per text that loses bytes, the ascending, disjoint byte ranges [lo, hi) to remove."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), text_of(text).alias("t")).withColumn("d", F.xxhash64("t"))
    bits = df.sparkSession.sparkContext.broadcast(_repeated_anchors(rows, span))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.mapInArrow(lambda b: _pieces(b, span, bits.value), f"k {kind}, d long, lo long, hi long, p long, c binary")
    dealt = pieces.repartition(parts, "p").sortWithinPartitions("p", "c", F.col("k").isNull(), "k", "d", "lo")
    gone = dealt.mapInArrow(lambda b: _compare(b, span), f"k {kind}, d long, lo long, hi long")
    # the ranges of one text, never more than it has bytes
    return gone.groupBy("k", "d").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, spans = [], []
        for text, ranges in zip(batch.column("t"), batch.column("spans")):
            whole, at, parts = text.as_py(), 0, []
            merged = _merged([(r["lo"], r["hi"]) for r in ranges.as_py() or ()])
            for a, b in merged:
                parts.append(whole[at:a])
                at = b
            kept.append(b"".join(parts) + whole[at:])
            spans.append([list(r) for r in merged])
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns |= {"t": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def drop_repeated_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(row, t, spans) per input row: the row as it was, the bytes that stay, the byte ranges [lo, hi) removed."""
    spans = checkpoint(repeated_spans(df, key, text, span))
    bits = checkpoint(bit_table(spans, F.col("k"), F.col("d")))
    packed = df.select(F.struct("*").alias("row"), F.col(key).alias("k"), text_of(text).alias("t")).withColumn("d", F.xxhash64("t"))
    packed = packed.withColumn("t", F.encode("t", "UTF-8"))
    marked = split_by_bits(packed, bits, F.col("k"), F.col("d"))
    whole = marked.filter("not _maybe").select("row", "t", F.array().cast("array<array<bigint>>").alias("spans"))
    facts = spans.select(F.col("k").alias("_k"), F.col("d").alias("_d"), "spans")
    hit = marked.filter("_maybe").join(facts, same([F.col("k"), F.col("d")], [F.col("_k"), F.col("_d")]), "left")
    return whole.unionByName(hit.select("row", "t", "spans").mapInArrow(_cut, whole.schema))


ship(__name__)
ship(suffix_sort.__name__)
