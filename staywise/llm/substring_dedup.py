"""Substring dedup by hashing the units of lines and paragraphs.

A text is cut into units: lines, and within a line its sentences. A sentence also
starts at a capitalised word that follows a word without an end mark, so a
passage pasted into the middle of a sentence has units of its own. Units are
normalised (case folded, white space collapsed) and digested (128 bits), digests
are grouped over the whole corpus, and the occurrence of smallest (key, offset)
of each digest is the one that stays. With ``lines``, lines of several sentences
are digested as a whole too, and a line that occurred before is removed whatever
its length (and so is a paragraph, line by line). Of other repeats, which are
parts of lines, a run of consecutive ones is removed when it holds at least
``min_words`` words and one unit of at least ``min_unit_words``; shorter ones are
phrases that happen to recur and stay. With ``lines``, two letters of a script
without spaces between words count as a word. Removed spans keep their offsets
(code points) in the original text.

Scale: texts are cut and digested once, into a table of the shared folder that later
steps read by column. Counts are combined on the map side, so a unit that a third of all texts
share costs one row per task. Only units whose digest occurs more than once, by a
bit set of fixed size, go to the exact join; the keepers of the most frequent
digests reach them by broadcast. Texts without a removed span are not shuffled.

NULL texts count as empty. A NULL key ranks after all others. Rows that repeat a
key are told apart by their text; fully equal rows are one occurrence and keep or
lose the same units. Extra columns are kept by ``drop_repeats``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import bit_table, checkpoint, join_facts, same, ship, split_by_bits, stored, text_of

MIN_WORDS = 20
MIN_UNIT_WORDS = 5
BATCH_UNITS = 50_000
BREAK = re.compile(r"\n+|(?<=[.!?…])\s+|(?<=[^\s.!?…])\s+(?=[A-ZÀ-ÖØ-Þ])")
END_MARKS = re.compile("[。！？｡।॥؟۔።။៕]")  # no space need follow these
CLOSING = "。！？｡।॥؟۔።။៕」』”’）》"
BREAK_ALL = re.compile(rf"{BREAK.pattern}|(?<={END_MARKS.pattern})(?![{CLOSING}])\s*|(?<={END_MARKS.pattern}[」』”’）》])(?![{CLOSING}])\s*")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")
LETTERS_A_WORD = 2  # of a script without spaces between words


def units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the units, without the space around them."""
    at = 0
    cut = BREAK if text.isascii() or not END_MARKS.search(text) else BREAK_ALL
    for gap in cut.finditer(text):
        if gap.start() > at:
            yield at, gap.start()
        at = gap.end()
    if at < len(text):
        yield at, len(text)


def _digested(batches: Iterator[pa.RecordBatch], lines: bool) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh128_digest
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            begin, row, own = at, [], []
            starts, stops, numbers, words, wholes, digests = [], [], [], [], [], []

            def add(start: int, stop: int, number: int, count: int, whole: int, normal: str) -> None:
                starts.append(start)
                stops.append(stop)
                numbers.append(number)
                words.append(count)
                wholes.append(whole)
                digests.append(digest(normal.casefold()))

            while at < batch.num_rows and len(starts) < BATCH_UNITS:
                text = batch.column("t")[at].as_py()
                own.append(text_digest(text))
                known = len(starts)
                unspaced = lines and not text.isascii() and UNSPACED.search(text)
                line: list[tuple[int, int, int, str, int]] = []

                def close() -> None:
                    for start, stop, number, normal, count in line:
                        add(start, stop, number, count, int(lines and len(line) == 1 and count > 0), normal)
                    if lines and len(line) > 1 and any(u[4] for u in line):
                        normal = " ".join(text[line[0][0] : line[-1][1]].split())
                        add(line[0][0], line[-1][1], line[0][2], sum(u[4] for u in line), len(line), normal)
                    line.clear()

                for number, (start, stop) in enumerate(units(text)):
                    if line and text.find("\n", line[-1][1], start) >= 0:
                        close()
                    parts = text[start:stop].split()
                    normal, count = " ".join(parts), len(parts)
                    if unspaced:
                        count += len(UNSPACED.findall(normal)) // LETTERS_A_WORD
                    line.append((start, stop, number, normal, count))
                close()
                row.append(len(starts) - known)
                at += 1
            both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            which = np.repeat(np.arange(begin, at), row)
            columns = [batch.column("k").take(pa.array(which)), pa.array(np.repeat(np.array(own, np.int64), row))]
            columns += [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
            columns += [pa.array(c, pa.int32()) for c in (starts, stops, numbers, words, wholes)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "d", "h1", "h2", "start", "stop", "unit", "words", "whole"])


def text_digest(text: str) -> int:
    """What Spark's xxhash64 gives for the text."""
    return int.from_bytes(xxhash.xxh64_digest(text, 42), "big", signed=True)


def unit_digests(df: DataFrame, key: str, text: str, lines: bool = False) -> DataFrame:
    """(k, d, h1, h2, start, stop, unit, words, whole) per unit; d is the digest of the whole text.

    ``whole`` is 0 for a part of a line, else the number of units of the line that the row stands for.
    """
    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("k"), text_of(text).alias("t"))
    return source.mapInArrow(
        lambda batches: _digested(batches, lines),
        f"k {kind}, d long, h1 long, h2 long, start int, stop int, unit int, words int, whole int",
    )


def _runs(found: list[dict], min_words: int, min_unit_words: int) -> list[dict]:
    """Runs of consecutive units, sorted by unit, that are long enough to go."""
    out, run = [], []

    def close() -> None:
        if run and sum(u["words"] for u in run) >= min_words and max(u["words"] for u in run) >= min_unit_words:
            out.append({"start": run[0]["start"], "stop": run[-1]["stop"], "units": len(run)})
        run.clear()

    for unit in found:
        if run and unit["unit"] != run[-1]["unit"] + 1:
            close()
        run.append(unit)
    close()
    return out


def _spans(found: list[dict], min_words: int, min_unit_words: int) -> list[dict]:
    """Whole lines and the runs that are long enough, put together where they touch."""
    runs = _runs([u for u in found if u["whole"] < 2], min_words, min_unit_words)
    first = {u["start"]: u["unit"] for u in found}
    parts = [(first[r["start"]], r["units"], r["start"], r["stop"]) for r in runs]
    parts += [(u["unit"], u["whole"], u["start"], u["stop"]) for u in found if u["whole"]]
    out: list[dict] = []
    begin = end = -1
    for unit, n, start, stop in sorted(parts):
        if out and unit <= end:
            end = max(end, unit + n)
            out[-1]["stop"] = max(out[-1]["stop"], stop)
        else:
            begin, end = unit, unit + n
            out.append({"start": start, "stop": stop})
        out[-1]["units"] = end - begin
    return out


def repeated_spans(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_unit_words: int = MIN_UNIT_WORDS,
    lines: bool = False,
) -> DataFrame:
    """(k, d, spans): per text that loses something, an ascending array of (start, stop, units) in code points."""
    found = stored(unit_digests(df, key, text, lines))
    place = F.struct(F.col("k").isNull().alias("none"), "k", "d", "start")
    repeated = checkpoint(
        found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    )
    total = repeated.agg(F.sum("n")).first()[0] or 0
    bits = checkpoint(bit_table(repeated, F.col("h1"), F.col("h2")))
    likely = split_by_bits(found, bits, F.col("h1"), F.col("h2")).filter("_maybe").drop("_maybe")
    later = join_facts(likely, repeated, ["h1", "h2"], "n", total).filter(F.col("first") != place)
    per_text = later.groupBy("k", "d").agg(F.sort_array(F.collect_set(F.struct("unit", "start", "stop", "words", "whole"))).alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("units", pa.int32())]))
        for batch in batches:
            spans = [_spans(u, min_words, min_unit_words) for u in batch.column("u").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("d"), pa.array(spans, span)], names=["k", "d", "spans"])

    kind = df.schema[key].dataType.simpleString()
    spans = per_text.mapInArrow(run, f"k {kind}, d long, spans array<struct<start:int,stop:int,units:int>>")
    return spans.filter(F.size("spans") > 0)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("t"), batch.column("spans")):
            whole, at, parts = text.as_py(), 0, []
            for span in spans.as_py() or ():
                parts.append(whole[at : span["start"]])
                at = span["stop"]
            texts.append("".join(parts) + whole[at:])
        columns = {name: batch.column(name) for name in batch.schema.names} | {"t": pa.array(texts, pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def drop_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_unit_words: int = MIN_UNIT_WORDS,
    lines: bool = False,
) -> DataFrame:
    """(row, t, spans) per input row: the row as it was, its text without the spans, and the spans (NULL if none)."""
    spans = checkpoint(repeated_spans(df, key, text, min_words, min_unit_words, lines))
    bits = checkpoint(bit_table(spans, F.col("k"), F.col("d")))
    packed = df.select(F.struct("*").alias("row"), F.col(key).alias("k"), text_of(text).alias("t")).withColumn("d", F.xxhash64("t"))
    marked = split_by_bits(packed, bits, F.col("k"), F.col("d"))
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    whole = marked.filter("not _maybe").select("row", "t", none.alias("spans"))
    facts = spans.select(F.col("k").alias("_k"), F.col("d").alias("_d"), "spans")
    hit = marked.filter("_maybe").join(facts, same([F.col("k"), F.col("d")], [F.col("_k"), F.col("_d")]), "left")
    hit = hit.select("row", "t", "spans")
    return whole.unionByName(hit.mapInArrow(_cut, hit.schema))


ship(__name__)
