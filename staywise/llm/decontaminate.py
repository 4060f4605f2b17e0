"""Benchmark decontamination by template canonicalisation.

Texts are cut into tokens and made into templates: numbers, units and names
become typed slots (neighbouring numbers, and neighbouring names, one slot), all
other words are literals in lower case. Three templates stand side by side:
``SENTENCE``, where names are capitalised words that do not begin a sentence;
``WORDING``, where they are capitalised words, wherever they stand, that the
benchmark does not also write in lower case; and ``PLAIN``, the tokens in lower case
without slots, which finds copies in other case and items made mostly of numbers and
names. Windows of ``window`` template tokens of the benchmark (shorter items: the
whole item) and of the documents are hash-joined and compared literally. Matches of
one text and item that lie on one diagonal (same offset between the two) or on
diagonals a few tokens apart are put together; each name of the item must stand for
one name of the text throughout. A question with other numbers or names is therefore
caught, a text that merely shares its scaffolding is not. A text is contaminated when
consistent matches cover ``min_tokens`` tokens of an item or, for shorter items,
``min_share`` of it.

Scale: documents are read in one pass that keeps the windows whose hash is in a
bit set of the benchmark's (2**23 bits, whatever the benchmark's size), so what is
joined follows the leaks, not the corpus. The benchmark's windows are broadcast
only when counted small.

NULL texts count as empty and are never contaminated; neither is an item without
words (windows of the slotted templates need MIN_LITERALS literals, plain ones a
word). Rows of one key are told apart by their text, NULL keys too; fully equal rows
share the verdict. Extra columns are kept by ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import WORDS, bit_table, checkpoint, same, ship, split_by_bits, text_of

WINDOW, MIN_LITERALS = 8, 4
MIN_TOKENS, MIN_SHARE = 12, 0.6
SMALL = 200_000  # windows of a benchmark that is broadcast
KNOWN = 500_000  # tokens a task remembers
SLICE = 200_000  # tokens worked at once, whole texts
APART = 4  # tokens by which diagonals that add up may differ, at least
SENTENCE, WORDING, PLAIN = MODES = range(3)
BITS = WORDS * 64
TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%$€£°]|[.!?…\n]")
NUMBER_WORDS = frozenset(
    "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
)
UNITS = frozenset(
    "% $ € £ ° mm cm m km inch inches ft feet yard yards mile miles mg g kg gram grams lb lbs oz ml l litre litres liter liters "
    "kmh mph hz khz mhz ghz kb mb gb tb w kw volt volts watt watts dollar dollars cent cents euro euros pound pounds "
    "second seconds minute minutes hour hours day days week weeks month months year years degree degrees percent".split()
)
FUNCTION_WORDS = frozenset(
    "a an the what which who whom whose when where why how if is are was were be do does did has have had can could will would shall "
    "should may might must in on at of for to from by with and or but as it its this that these those there he she they we you i his "
    "her their my your our each every all some any no not let find give after before while then".split()
)
END, NUMBER, UNIT, NAME = (np.uint64(i) for i in range(4))
KIND_END, KIND_NUMBER, KIND_UNIT, KIND_CAPITAL, KIND_WORD = range(5)
MARKS = {int(NUMBER): "<number>", int(UNIT): "<unit>", int(NAME): "<name>"}


class _Tokens(dict):
    """Token -> (kind, hash of the lower-case form), packed as hash * 8 + kind."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token in ".!?…\n":
            kind = KIND_END
        elif low[0].isdigit() or low in NUMBER_WORDS:
            kind = KIND_NUMBER
        elif low in UNITS:
            kind = KIND_UNIT
        else:
            kind = KIND_CAPITAL if token[0].isupper() else KIND_WORD
        if len(self) > KNOWN:
            self.clear()
        packed = self[token] = (xxhash.xxh64_intdigest(low) >> 3 << 3) | kind
        return packed


class _Slice:
    """Tokens of some texts, in one array per template."""

    def __init__(self, texts: list[str], known: _Tokens):
        self.tokens, sizes = [], []
        for text in texts:
            found = TOKEN.findall(text)
            self.tokens += found
            sizes.append(len(found))
        packed = np.fromiter(map(known.__getitem__, self.tokens), np.uint64, len(self.tokens))
        owner = np.repeat(np.arange(len(texts)), sizes)
        kind = (packed & np.uint64(7)).astype(np.int8)
        ended = kind == KIND_END
        begins = np.r_[True, ended[:-1] | (owner[1:] != owner[:-1])][: len(kind)]
        self.place = np.flatnonzero(~ended)
        self.begins, self.kind, self.owner = begins[self.place], kind[self.place], owner[self.place]
        ids = packed[self.place] >> np.uint64(3)
        self.ids = np.where(ids < np.uint64(16), ids + np.uint64(16), ids)
        self.texts = len(texts)

    def template(self, mode: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, is a literal, first token, text) per token of the template."""
        if mode == PLAIN:
            return self.ids, (self.kind != KIND_NUMBER) & (self.kind != KIND_UNIT), np.arange(len(self.ids)), self.owner
        ids = self.ids.copy()
        ids[self.kind == KIND_NUMBER] = NUMBER
        ids[self.kind == KIND_UNIT] = UNIT
        capital = self.kind == KIND_CAPITAL
        if mode == SENTENCE:
            ids[capital & ~self.begins] = NAME
        else:
            at = np.flatnonzero(capital)
            ids[at[~_in_bits(lower, ids[at])]] = NAME
        first = np.ones(len(ids), bool)
        first[1:] = (ids[1:] != ids[:-1]) | ((ids[1:] != NUMBER) & (ids[1:] != NAME)) | self.begins[1:]
        first = np.flatnonzero(first)
        return ids[first], ids[first] > NAME, first, self.owner[first]


def _in_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[(h & np.uint64(BITS - 1)) >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def window_hashes(ids: np.ndarray, window: int, seed: int) -> np.ndarray:
    """A 64-bit hash per window, put together from halves."""
    n = len(ids) - window + 1
    part, total, done, length, power = ids, np.full(n, seed, np.uint64), 0, 1, 0x9E3779B97F4A7C15
    while True:
        if window & length:
            total = total * np.uint64(power) + part[done : done + n]
            done += length
        if 2 * length > window:
            break
        part = part[:-length] * np.uint64(power) + part[length:]
        length, power = 2 * length, power * power % (1 << 64)
    total ^= total >> np.uint64(32)
    return total * np.uint64(0x94D049BB133111EB)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    begin, texts, held = 0, [], 0
    for i, text in enumerate(batch.column("t")):
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held > 5 * SLICE:
            yield begin, texts
            begin, texts, held = i + 1, [], 0
    if texts:
        yield begin, texts


def _window_rows(
    batches: Iterator[pa.RecordBatch], window: int, lower: np.ndarray, bits: np.ndarray | None, sizes: list[tuple[int, int]]
) -> Iterator[pa.RecordBatch]:
    """(k, d, mode, h, size, at, tokens, kinds, n): windows of the wanted modes and sizes whose hash may be one of the benchmark's."""
    known = _Tokens()
    names = ("k", "d", "mode", "h", "size", "at", "tokens", "kinds", "n")
    for batch in batches:
        out: dict[str, list] = {c: [] for c in names}
        for begin, texts in _slices(batch):
            part = _Slice(texts, known)
            for mode in MODES:
                wanted = [size for m, size in sizes if m == mode]
                if not wanted:
                    continue
                ids, literal, first, owner = part.template(mode, lower)
                count = np.bincount(owner, minlength=part.texts)
                start = np.cumsum(count) - count
                literals = np.r_[0, np.cumsum(literal)]
                least = MIN_LITERALS if mode != PLAIN else 1
                for size in wanted:
                    n = len(ids) - size + 1
                    if n <= 0:
                        continue
                    whole = (owner[:n] == owner[size - 1 :]) & (literals[size:] - literals[:-size] >= min(least, size))
                    if bits is None:
                        whole &= np.minimum(count, window)[owner[:n]] == size
                    hashes = window_hashes(ids, size, 16 * mode + size)
                    if bits is not None:
                        whole &= _in_bits(bits, hashes)
                    for i in np.flatnonzero(whole).tolist():
                        text = int(owner[i])
                        stops = [*first[i + 1 : i + size].tolist(), int(first[i + size]) if i + size < len(first) else len(part.place)]
                        out["k"].append(batch.column("k")[begin + text])
                        out["d"].append(batch.column("d")[begin + text].as_py())
                        out["mode"].append(mode)
                        out["h"].append(int(hashes[i].view(np.int64)))
                        out["size"].append(size)
                        out["at"].append(i - int(start[text]))
                        out["tokens"].append([
                            " ".join(part.tokens[j].lower() for j in part.place[a:b].tolist())
                            for a, b in zip(first[i : i + size].tolist(), stops)
                        ])
                        out["kinds"].append([MARKS.get(x, "") for x in ids[i : i + size].tolist()])
                        out["n"].append(int(count[text]))
        if out["k"]:
            out["k"] = [k.as_py() for k in out["k"]]
            strings = pa.list_(pa.string())
            types = [batch.schema.field("k").type, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), strings, strings, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), types)], names=list(names))


def _windows(
    df: DataFrame, key: str, text: str, window: int, lower: np.ndarray, bits: np.ndarray | None = None,
    sizes: list[tuple[int, int]] | None = None,
) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.xxhash64(text_of(text)).alias("d"), F.col(text).cast("string").alias("t"))
    wanted = [(m, n) for m in MODES for n in range(1, window + 1)] if bits is None else sizes or []
    return rows.mapInArrow(
        lambda batches: _window_rows(batches, window, lower, bits, wanted),
        f"k {kind}, d long, mode int, h long, size int, at int, tokens array<string>, kinds array<string>, n int",
    )


def _lower_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Tokens()
    for batch in batches:
        for _, texts in _slices(batch):
            part = _Slice(texts, known)
            words = np.unique(part.ids[part.kind == KIND_WORD])
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64))], names=["h"])


def _lower_bits(benchmark: DataFrame, text: str) -> np.ndarray:
    """The bit set of the words that the benchmark writes in lower case, and of function words."""
    out = _bit_array(benchmark.select(F.col(text).cast("string").alias("t")).mapInArrow(_lower_words, "h long"))
    for word in FUNCTION_WORDS:
        h = xxhash.xxh64_intdigest(word) >> 3
        out[h % BITS >> 6] |= np.uint64(1 << (h & 63))
    return out


def _bit_array(hashes: DataFrame) -> np.ndarray:
    """The bit set of the hashes ``h``; at most 2**17 rows come back."""
    word = F.shiftright(F.col("h").bitwiseAND(BITS - 1), 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    rows = hashes.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(WORDS, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_tokens: int = MIN_TOKENS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """(key, _d, items): each contaminated document, the digest of its text, and the ascending items found in it."""
    lower = _lower_bits(benchmark, item_text)
    items = checkpoint(_windows(benchmark, item, item_text, window, lower))
    count = items.count()
    sizes = sorted((r["mode"], r["size"]) for r in items.select("mode", "size").distinct().collect())  # at most 3 x ``window``
    found = _windows(df, key, text, window, lower, _bit_array(items), sizes)
    wanted = items.select(
        F.col("k").alias("item"), F.col("d").alias("item_d"), F.col("h").alias("h2"), F.col("mode").alias("mode2"), F.col("size").alias("size2"),
        F.col("at").alias("item_at"), F.col("tokens").alias("item_tokens"), F.col("kinds").alias("item_kinds"), F.col("n").alias("item_n"),
    )
    wanted = F.broadcast(wanted) if count <= SMALL else wanted
    literal = F.zip_with("tokens", "kinds", lambda t, k: F.when(k == "", t).otherwise(k))
    item_literal = F.zip_with("item_tokens", "item_kinds", lambda t, k: F.when(k == "", t).otherwise(k))
    same_window = (F.col("h") == F.col("h2")) & (F.col("size") == F.col("size2")) & (F.col("mode") == F.col("mode2"))
    matched = found.join(wanted, same_window).filter(literal == item_literal)
    names = F.filter(F.arrays_zip("item_kinds", "item_tokens", "tokens"), lambda s: s["item_kinds"] == MARKS[int(NAME)])
    shift = F.col("at") - F.col("item_at")
    # the diagonal itself, and two bands of diagonals that overlap by half
    bands = F.array(*[
        F.struct(F.lit(i).alias("band"), F.floor((shift + add) / wide).cast("int").alias("line"))
        for i, (add, wide) in enumerate(((0, 1), (0, 2 * APART), (APART, 2 * APART)))
    ])
    diagonal = matched.withColumn("on", F.explode(bands)).groupBy("k", "d", "item", "item_d", "item_n", "mode", "size", "on").agg(
        F.sort_array(F.collect_set("item_at")).alias("places"),
        F.array_distinct(F.flatten(F.collect_set(names))).alias("names"),
    )
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + p + F.col("size") - F.greatest(p, acc["end"])).alias("n"), (p + F.col("size")).alias("end")
        ),
    )["n"]
    one_name = F.size(F.array_distinct(F.transform("names", lambda s: s["item_tokens"]))) == F.size("names")
    enough = covered >= F.least(F.lit(min_tokens), F.ceil(F.col("item_n") * min_share))
    hits = diagonal.filter(one_name & enough)
    return hits.groupBy("k", "d").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.col("k").alias(key), F.col("d").alias("_d"), "items")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is not contaminated, all their columns kept."""
    bad = checkpoint(contaminated(df, benchmark, key, text).select(F.col(key).alias("_k"), "_d"))
    bits = checkpoint(bit_table(bad, F.col("_k"), F.col("_d")))
    rows = df.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text_of(text)).alias("d"))
    marked = split_by_bits(rows, bits, F.col("k"), F.col("d"))
    rest = marked.filter("_maybe").join(bad, same([F.col("k"), F.col("d")], [F.col("_k"), F.col("_d")]), "left_anti")
    return marked.filter("not _maybe").select("row.*").unionByName(rest.select("row.*"))


ship(__name__)
