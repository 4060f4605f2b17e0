"""Phrase collocations from one count of the longest windows.

Words: A-Z in lower case, pieces end at ``[.,;:!?\\n-\\r]``, words are runs without blank and tab. Everything is counted
per language, NULL as ``und``.

Top-order marginalisation: each word position gives one window, the word and the ``longest - 1`` that follow it in
its piece, padded with empty words at the piece's end. Only these windows are counted. The count of a shorter phrase
is the sum over all windows that begin with it, so Spark's ROLLUP over the window's columns gives every phrase of
every length, the words, and the number of words of the language. No shorter phrase is ever exploded.

Folding: a part of a phrase occurs at least as often as the phrase, so no number below ``least`` is ever needed, but
its occurrences still count for the prefixes. After the windows' counts met in the task of their first words, in the
order of the words, one pass folds every prefix below ``least`` into its padded shorter prefix. It is exact, and only
what is left, far less than the text, enters the ROLLUP.

Where the data goes: a task counts windows of at most ``BUFFER`` words at a time, so a frequent window leaves it once
per buffer, not once per occurrence; the counts are shuffled once and sorted; nothing is gathered but one row per
prefix. In the shuffle the ``CODES`` words that are most frequent in a sample of ``SAMPLE`` rows stand as codes of
three or four bytes, and windows that begin with one are dealt by their first two words; those that begin with any
other word, which is rare, by that word. The sample decides sizes only, never a count. The joins of phrases with the
counts of their parts are sort-merge joins, which adaptive execution splits where a part is hot. The best phrases of
a language are found in salted groups first, in rounds of ever fewer groups.

Results: the ``top`` phrases of each language by score, count and bytes of the phrase. score is the least over the
cuts into two parts of ``scale * a * a / (l * r)``, floored, in decimals of 38 digits (exact while the counts stay
below 10**15). Phrases inside a longer one that holds ``inside`` per cent of their occurrences are dropped. NULL and
empty texts, and texts of marks only, have no words; repeated rows count as often as they occur; extra columns are
ignored; an empty table gives no rows. Long texts are cut into slices for the tokeniser, never shortened.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise.llm.common import ship, stored, text_of

SCALE = 1_000_000
BUFFER = 1 << 21  # words whose windows a task counts at a time
SLICE = 1 << 22  # bytes the tokeniser splits at a time
CHUNK = 1 << 16  # rows of an Arrow batch that leaves a task
CODES = 1 << 16  # words that stand as codes in the shuffle, about 1 MB on the driver and in each task
SAMPLE = 10_000  # rows whose words are counted to choose them
DIGITS = [chr(c) for c in range(0x21, 0x7F)]
MARK = "\t"  # begins a code; no word holds it
END = 0xFF  # stands for the end of a piece; never a byte of UTF-8
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(END if b in _ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Words(dict):
    """Word to id, in the order of first sight; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({bytes([END]): 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = new = len(self)
        return new


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, ends of pieces between them, in slices cut at a blank or an end."""
    data, begin = text.translate(_TABLE), 0
    while begin < len(data):
        stop = begin + SLICE
        if stop < len(data):
            cut = max(data.rfind(b" ", begin, stop), data.rfind(b"\xff", begin, stop))
            later = [at for at in (data.find(b" ", stop), data.find(b"\xff", stop)) if at >= 0]
            stop = cut + 1 if cut >= begin else min(later, default=len(data) - 1) + 1
        yield data[begin:stop].replace(b"\xff", b" \xff ").split()
        begin = stop


def _counted(ids: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different windows of a run of ids, one array per column, and how often each occurs."""
    columns = [ids]
    for n in range(1, longest):
        following = np.r_[ids[n:], np.zeros(min(n, len(ids)), ids.dtype)]
        columns.append(np.where(columns[-1] == 0, 0, following))
    here = ids != 0
    columns = [c[here] for c in columns]
    code, several = columns[0], np.int64(ids.max(initial=0)) + 1
    for column in columns[1:]:
        _, code = np.unique(code, return_inverse=True)
        code = code * several + column
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return [c[first] for c in columns], counts


def _code(rank: int) -> str:
    """Two digits for the most frequent words, three for others; no blank, so codes split like words."""
    base = len(DIGITS)
    short = DIGITS[rank // base % base] + DIGITS[rank % base]
    return MARK + (short if rank < base * base else DIGITS[rank // base**2 - 1] + short)


def _codes(df: DataFrame) -> dict[str, str]:
    """Word to code for the words most frequent in a sample of the texts."""
    total = df.count()
    drawn = df.sample(min(1.0, SAMPLE / total), seed=1) if total else df

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("t"):
                for tokens in _tokens(text.as_py()):
                    found = pa.array([t.decode() for t in tokens if t[0] != END], pa.string()).value_counts()
                    yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["w", "n"])

    counted = drawn.mapInArrow(words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    best = counted.orderBy(F.desc("n"), "w").limit(CODES).collect()
    return {r["w"]: _code(i) for i, r in enumerate(best)}


def _escaped(lang: str) -> str:
    """The language without blanks and line feeds."""
    return lang.replace("\\", "\\\\").replace("\n", "\\n").replace(" ", "\\s")


def _unescaped(lang: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "s": " "}.get(m[1], m[1]), lang)


def _windows(batches: Iterator[pa.RecordBatch], longest: int, codes: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """(lang, t) in; (key, n) out: language, line feed, the words or their codes joined by blanks."""
    words: dict[str, _Words] = {}
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            columns, counts = _counted(np.concatenate(parts), longest)
            known = ["", *[w.decode() for w in list(words[lang])[1:]]]
            short = [codes.get(w, w) for w in known]
            vocabulary, heads = pa.array(short, pa.string()), pa.array([f"{_escaped(lang)}\n{w}" for w in short], pa.string())
            for i in range(0, len(counts), CHUNK):
                taken = [pa.array(c[i : i + CHUNK]) for c in columns]
                keys = pc.binary_join_element_wise(heads.take(taken[0]), *[vocabulary.take(t) for t in taken[1:]], " ")
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts[i : i + CHUNK], pa.int64())], names=["key", "n"])
        held.clear()
        words.clear()

    end = np.zeros(1, np.int64)
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, text in enumerate(batch.column("t")):
            ids = words.setdefault(langs[i], _Words())
            parts = held.setdefault(langs[i], [])
            for tokens in _tokens(text.as_py()):
                parts.append(np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)))
                size += len(tokens)
            parts.append(end)
            if size >= BUFFER:
                yield from flush()
                size = 0
    yield from flush()


def _new(columns: Sequence[pa.Array]) -> np.ndarray:
    """True where a row differs from the one before it."""
    changed = np.zeros(len(columns[0]) - 1, bool)
    for column in columns:
        changed |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.r_[True, changed]


def _fold(batches: Iterator[pa.RecordBatch], longest: int, least: int, codes: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, n) in; windows (lang, w1, ..., n) with every prefix below ``least`` folded into a shorter one out.

    Each level, from whole windows up to first words, sums equal prefixes. A prefix of ``least`` occurrences gives out
    those that no longer one gave out before it; any other hands them to the padded prefix one word shorter. The last
    prefix of a level may go on in the next batch, so it waits: one row per level, however large its group.
    """
    names = ["lang", *[f"w{i}" for i in range(1, longest + 1)], "n"]
    plain = {code: word for word, code in codes.items()}
    waiting: list[tuple | None] = [None] * (longest + 1)

    def spelled(column: pa.Array, change) -> pa.Array:
        coded = column.dictionary_encode()
        return pa.array([change(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    def step(columns: list[pa.Array], total: np.ndarray, rest: np.ndarray, final: bool) -> Iterator[pa.RecordBatch]:
        for level in range(longest, 0, -1):
            if waiting[level] is not None:
                columns = [pa.concat_arrays([w, c]) for w, c in zip(waiting[level][0], columns)]
                total, rest = np.r_[waiting[level][1], total], np.r_[waiting[level][2], rest]
                waiting[level] = None
            if not len(total):
                if final:
                    continue
                return
            starts = np.flatnonzero(_new(columns[:level]))
            columns = [c.take(pa.array(starts)) for c in columns]
            total, rest = np.add.reduceat(total, starts), np.add.reduceat(rest, starts)
            if not final:
                waiting[level] = [c.slice(len(starts) - 1) for c in columns], total[-1:], rest[-1:]
                columns, total, rest = [c.slice(0, len(starts) - 1) for c in columns], total[:-1], rest[:-1]
            out = rest > 0
            if level > 1:
                out &= (total >= least) & pc.not_equal(columns[level - 1], "").to_numpy(zero_copy_only=False)
            if out.any():
                pick = pa.array(np.flatnonzero(out))
                head, *later = [c.take(pick) for c in columns[:level]]
                lang = spelled(head, lambda w: _unescaped(w.partition("\n")[0]))
                first = spelled(head, lambda w: plain.get(w := w.partition("\n")[2], w))
                later = [spelled(c, lambda w: plain.get(w, w)) for c in later]
                pads = [pa.array([""] * len(pick), pa.string())] * (longest - level)
                yield pa.RecordBatch.from_arrays([lang, first, *later, *pads, pa.array(rest[out])], names=names)
                rest = np.where(out, 0, rest)

    for batch in batches:
        if batch.num_rows:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            parts = pc.split_pattern(batch.column("key"), " ").flatten()  # longest parts each
            place = np.arange(0, len(parts), longest)
            yield from step([parts.take(pa.array(place + i)) for i in range(longest)], n, n, False)
    yield from step([pa.array([], pa.string())] * longest, np.zeros(0, np.int64), np.zeros(0, np.int64), True)


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, k, phrase, f): the phrases of k words that occur ``least`` times or more; k = 0 holds the number of words."""
    names = [f"w{i}" for i in range(1, longest + 1)]
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).cast("binary").alias("t"))
    codes = _codes(rows)
    windows = rows.mapInArrow(lambda b: _windows(b, longest, codes), "key string, n long")
    group = F.when(F.contains("key", F.lit("\n" + MARK)), F.substring_index("key", " ", 2)).otherwise(F.substring_index("key", " ", 1))
    dealt = windows.repartition(group).sortWithinPartitions("key")
    split = dealt.mapInArrow(lambda b: _fold(b, longest, least, codes), ", ".join(f"{c} string" for c in ("lang", *names)) + ", n long")
    # level of the ROLLUP: 0 for whole windows, 1, 3, 7 ... for prefixes of one word less each
    summed = split.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    k = F.lit(None).cast("int")
    for words in range(longest + 1):
        whole = F.col(names[words - 1]) != "" if words else F.lit(True)
        k = F.when((F.col("g") == (1 << longest - words) - 1) & whole, words).otherwise(k)
    phrases = summed.select("lang", k.alias("k"), F.concat_ws(" ", *names).alias("phrase"), "f")
    return phrases.filter((F.col("k") == 0) | (F.col("k") > 0) & (F.col("f") >= least))


def _part(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language."""
    counts = stored(phrase_counts(df, text, lang, longest, least))
    facts = counts.filter("k > 0").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    phrases = counts.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    pair = F.transform(
        F.sequence(F.lit(1), F.col("k") - 1),
        lambda i: F.struct(i.alias("cut"), _part("words", F.lit(1), i).alias("left"), _part("words", i + 1, F.col("k") - i).alias("right")),
    )
    cuts = phrases.select("lang", "phrase", "a", F.inline(pair))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(facts, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))).withColumn(name, F.col("_f")).drop("_lang", "_part", "_f")
    exact = {c: f"cast({c} AS decimal(19, 0))" for c in "alr"}
    score = F.expr(f"({exact['a']} * {exact['a']} * cast({SCALE} AS decimal(7, 0))) div ({exact['l']} * {exact['r']})")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("worst"), F.lit(None).cast("long").alias("longer"))
    # the shorter phrases inside each phrase, down to two words
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    inner = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: _part("words", i, n))))
    within = phrases.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit(None).cast(scored.schema["worst"].dataType).alias("worst"), F.col("a").alias("longer"))
    judged = scored.unionByName(within).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("worst").alias("worst"), F.max("longer").alias("longer"))
    kept = judged.filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside)).select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best, salt = kept.withColumn("rank", F.lit(0)), F.pmod(F.xxhash64("phrase"), F.lit(parts))
    # each round leaves the best of fewer, larger groups, so the last task of a language reads at most sqrt(parts) * top rows
    for group in (salt, F.pmod(salt, F.lit(math.isqrt(parts))), F.lit(0)):
        ranks = Window.partitionBy("lang", "salt").orderBy(*order)
        best = best.withColumn("salt", group).withColumn("rank", F.row_number().over(ranks).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("k = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    return best.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ship(__name__)
