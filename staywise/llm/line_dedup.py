"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line (trimmed; blank lines are left alone) is dropped where the same line
occurred before, or a different line within ``most`` edits occurred before; before
means a smaller (key, line number) of first occurrences. Lines shorter than
``min_chars`` match exactly only: with five characters per allowed edit, partners
agree to 80 %.

Edit join: two lines within ``most`` edits share one of ``most + 1`` segments of
the shorter one, at a place that the edits before and after it allow. Each
distinct line enters its segments under (length, segment number, text) and probes
with its segments and with the other substrings of itself that can match a segment
of a line of its own length or up to ``most`` shorter. A probe meets a segment by
an equi-join on the hash; both rows carry counts of sixteen common letters (mod
16), and a pair whose counts cannot come from ``most`` edits is dropped inside the
join. The texts of the pairs left are verified: one bit per diagonal of the band,
one word per number of edits, moved along the line by an aggregate.

Scale: equal lines are combined on the map side, so a line that a third of all
texts share costs one row per task. Segment and probe rows hold two longs, never
text. Two bit sets of fixed size, of the segments' keys and of the keys that can meet,
keep out of the join what has no partner; texts are fetched, letters counted and
occurrences joined behind such sets too. A fuller set lets more rows through, never
fewer: above some 30 million distinct lines they let most
through, and the join and the fetch then see every line once per key. Texts that lose
no line are not shuffled.

NULL and empty texts have no lines to drop. A NULL key ranks after all others.
Rows that repeat a key are told apart by their text; fully equal rows lose the
same lines. Line ends are ``\\n``; all kept lines stay as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import bit_table, checkpoint, join_facts, same, split_by_bits, stored, text_of

MOST = 2
MIN_CHARS = 10
LETTERS = "eainrtoshdlucmpg"
SPACE = " \t\r\x0b\x0c"
WIDE = 4  # bytes of a character in UTF-32
KEY_ROWS = 1 << 19  # of a set of segment keys
WORDS_A_ROW = 4  # 64-bit words in a row: 16 MB, whatever the input


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, d, at, line) per line that is not blank."""
    whole = text_of(text)
    rows = df.select(F.col(key).alias("k"), F.xxhash64(whole).alias("d"), F.posexplode(F.split(whole, "\n")).alias("at", "raw"))
    return rows.select("k", "d", "at", F.btrim("raw", F.lit(SPACE)).alias("line")).filter("line != ''")


def _names(kind: str) -> list[str]:
    return [f"{kind}{j}" for j in range(WORDS_A_ROW)]


def _slot(key: Column) -> tuple[Column, list[Column]]:
    """The row of a key, which is a hash already, and its bit in each word of that row."""
    bits = [F.shiftright(key, 6 * j).bitwiseAND(63).cast("int") for j in range(WORDS_A_ROW)]
    return F.shiftright(key, 6 * WORDS_A_ROW).bitwiseAND(KEY_ROWS - 1), bits


def _key_bits(rows: DataFrame) -> DataFrame:
    """(w, any0.., more0..): sets of the keys, and of the keys of several rows, four bits a key; at most KEY_ROWS rows."""
    slots = rows.groupBy(F.col("key").bitwiseAND(KEY_ROWS * 64**WORDS_A_ROW - 1).alias("key")).agg(F.count("*").alias("n"))
    w, bits = _slot(F.col("key"))
    ones = [F.call_function("shiftleft", F.lit(1).cast("long"), bit) for bit in bits]
    several = [F.when(F.col("n") > 1, one).otherwise(F.lit(0).cast("long")) for one in ones]
    sets = [F.bit_or(c).alias(name) for c, name in zip([*ones, *several], [*_names("any"), *_names("more")])]
    return slots.groupBy(w.alias("w")).agg(*sets)


def _with_bit(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose key is in a set; its broadcast has a fixed bound, and a fuller set only lets more rows through."""
    w, bits_of = _slot(F.col("key"))
    found = rows.join(F.broadcast(bits.select("w", *_names("any"))), w == F.col("w"))
    held = F.lit(1).cast("long")
    for name, bit in zip(_names("any"), bits_of):
        held = held.bitwiseAND(F.call_function("shiftright", F.col(name), bit))
    return found.filter(held == 1).select(*rows.columns)


def _digest(line: str = "line") -> list[Column]:
    """128 bits that tell lines apart; the first half alone is the handle of a line among candidates."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _counts(line: Column) -> Column:
    """Counts of the common letters, four bits each."""
    out = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        times = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        out = out + F.shiftleft(times.bitwiseAND(15).cast("long"), 4 * i)
    return out


def _can_match(a: Column, b: Column, most: int) -> Column:
    """Letters only one of the two has more of: at most one per edit, on either side."""
    more, less = F.lit(0), F.lit(0)
    for i in range(len(LETTERS)):
        gap = (F.shiftright(a, 4 * i).bitwiseAND(15) - F.shiftright(b, 4 * i).bitwiseAND(15)).bitwiseAND(15).cast("int")
        more = more + F.when(gap < 8, gap).otherwise(0)
        less = less + F.when(gap >= 8, 16 - gap).otherwise(0)
    return (more <= most) & (less <= most)


def _segment(length: Column, i: int, most: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of a line of the given length."""
    start = F.floor(length * i / (most + 1)).cast("int")
    return start, F.floor(length * (i + 1) / (most + 1)).cast("int") - start


def _keys(wide: Column, n: Column, most: int, own: bool) -> list[Column]:
    """Hashes of the segments of a line, or of its other substrings that may be a partner's segment.

    ``wide`` is the line with four bytes per character, so that a substring is
    a slice of bytes and need not be searched from the start of the line.
    """
    keys = []
    for shorter in range(1 if own else most + 1):
        length = n - shorter
        for i in range(most + 1):
            start, size = _segment(length, i, most)
            for shift in range(max(-i, shorter - (most - i)), min(i, shorter + (most - i)) + 1):
                if (shorter == shift == 0) == own:
                    keys.append(F.xxhash64(length, F.lit(i), F.substring(wide, (start + shift) * WIDE + 1, size * WIDE)))
    return keys


def within(a: Column, b: Column, most: int) -> Column:
    """Whether two strings are within ``most`` edits, by bit-parallel steps over the band's diagonals.

    Bit ``c`` of word ``e`` after ``j`` characters of ``b``: the first
    ``j + c - most`` characters of ``a`` are reached with at most ``e`` edits.
    """
    width = 2 * most + 1
    full = (1 << width) - 1

    def masks(x: Column, y: Column) -> Column:
        """Per character of ``b``, the diagonals on which it equals that of ``a``."""

        def mask(t: Column, j: Column) -> Column:
            out = F.lit(0)
            for c in range(width):
                out = out.bitwiseOR(F.when(F.get(x, j + (c - most)) == t, 1 << c).otherwise(0))
            return out

        return F.transform(y, mask)

    def step(words: Column, mask: Column) -> Column:
        new: list[Column] = []
        for e in range(most + 1):
            word = F.get(words, F.lit(e)).bitwiseAND(mask)
            if e:
                old = F.get(words, F.lit(e - 1))
                word = word.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(full)
            new.append(word)
        return F.array(*new)

    # before any character of b: deleting the first i of a takes i edits
    start = F.array(*[F.lit(sum(1 << (most + i) for i in range(e + 1)) & full) for e in range(most + 1)])
    # one-element arrays bind the characters, so that they are split once
    split = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    last = F.get(F.transform(split, lambda s: F.aggregate(masks(s["x"], s["y"]), start, step)), F.lit(0))
    end = F.char_length(a) - F.char_length(b) + most
    reached = F.call_function("shiftright", F.get(last, F.lit(most)), end).bitwiseAND(1) == 1
    return F.when((F.char_length(b) > 0) & end.between(0, width - 1), reached).otherwise(
        (F.char_length(b) == 0) & (F.char_length(a) <= most)
    )


def _keys_that_meet(lines: DataFrame, most: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(id, key) of the segments and of the probes that can have a partner."""
    long_lines = lines.filter(F.char_length("line") >= min_chars)
    wide = long_lines.select("line", F.encode("line", "UTF-32").alias("wide"), F.char_length("line").alias("n"))
    facts = {}
    for kind, own in (("s", True), ("p", False)):
        facts |= {f"{kind}{i}": key for i, key in enumerate(_keys(F.col("wide"), F.col("n"), most, own))}
    # one row of numbers per distinct line: they are shuffled, its text is not
    rows = wide.select(*_digest(), *[column.alias(name) for name, column in facts.items()])
    told = stored(rows.groupBy("h1", "h2").agg(*[F.first(name).alias(name) for name in facts]).withColumnRenamed("h1", "id"))
    segments, probes = (F.array(*[name for name in facts if name[0] == kind]) for kind in "sp")
    left, shifted = (told.select("id", F.explode(keys).alias("key")) for keys in (segments, probes))
    # a probe needs a segment with its key; a segment a probe, or another segment, with its own
    held = checkpoint(_key_bits(left))
    shifted = stored(_with_bit(shifted, held))
    repeated = held.select("w", *[F.col(more).alias(name) for more, name in zip(_names("more"), _names("any"))])
    wanted = repeated.unionByName(_key_bits(shifted).select("w", *_names("any")))
    wanted = checkpoint(wanted.groupBy("w").agg(*[F.bit_or(name).alias(name) for name in _names("any")]))
    left = stored(_with_bit(left, wanted))

    return left, shifted


def _facts(lines: DataFrame, ids: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, line, first, n) per line that occurs more than once or may be among the ids; the text only of the latter."""
    bits = checkpoint(bit_table(ids, F.col("id")))
    place = F.struct(F.col("k").isNull().alias("none"), "k", "d", "at")
    marked = split_by_bits(lines.select("k", "d", "at", "line", *_digest()), bits, F.col("h1"))
    text = F.when(F.col("_maybe") & (F.char_length("line") >= min_chars), F.col("line"))
    found = marked.groupBy("h1", "h2", text.alias("line")).agg(F.min(place).alias("first"), F.count("*").alias("n"))
    return stored(found.filter("n > 1 or line is not null"))


def near_pairs(left: DataFrame, shifted: DataFrame, facts: DataFrame, most: int = MOST) -> DataFrame:
    """(line_a, line_b, first_a, first_b) for each pair of different lines within ``most`` edits, once."""
    texts = facts.filter("line is not null").select(F.col("h1").alias("id"), "line", "first")
    counts = checkpoint(texts.select("id", _counts(F.col("line")).alias("c")))
    left, shifted = (rows.join(counts, "id") for rows in (left, shifted))
    others = left.withColumn("own", F.lit(True)).unionByName(shifted.withColumn("own", F.lit(False)))
    others = others.select(F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("key").alias("key2"), "own")
    once = F.when(F.col("own"), F.col("id") < F.col("id2")).otherwise(F.col("id") != F.col("id2"))
    met = left.join(others, (F.col("key") == F.col("key2")) & once & _can_match(F.col("c"), F.col("c2"), most))
    candidates = checkpoint(met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct())
    sides = [texts.select(F.col("id").alias(f"id_{s}"), F.col("line").alias(f"line_{s}"), F.col("first").alias(f"first_{s}")) for s in "ab"]
    both = candidates.join(sides[0], F.col("a") == F.col("id_a")).join(sides[1], F.col("b") == F.col("id_b"))
    return both.filter(within(F.col("line_a"), F.col("line_b"), most)).select("line_a", "line_b", "first_a", "first_b")


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k, d, gone): per text that loses lines, their numbers (from 0), ascending."""
    lines = _lines(df, key, text)
    left, shifted = _keys_that_meet(lines, most, min_chars)
    known = _facts(lines, left.select("id").unionByName(shifted.select("id")), min_chars)
    pairs = near_pairs(left, shifted, known, most)
    later = F.when(F.col("first_a") < F.col("first_b"), F.col("line_b")).otherwise(F.col("line_a"))
    near = pairs.select(later.alias("line")).distinct()
    repeated = known.filter("n > 1").select("h1", "h2", "first", "n")
    # all occurrences of a line that has an earlier near one go; of others all but the first
    none = F.lit(None).cast(repeated.schema["first"].dataType)
    marked = near.select(*_digest(), none.alias("first"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("near"))
    facts = repeated.withColumn("near", F.lit(False)).unionByName(marked).groupBy("h1", "h2").agg(
        F.max("first").alias("first"), F.greatest(F.max("n"), F.lit(1)).alias("n"), F.max("near").alias("near")
    )
    facts = checkpoint(facts)
    total = facts.agg(F.sum("n")).first()[0] or 0
    bits = checkpoint(bit_table(facts, F.col("h1"), F.col("h2")))
    small, place = lines.select("k", "d", "at", *_digest()), F.struct(F.col("k").isNull().alias("none"), "k", "d", "at")
    likely = split_by_bits(small, bits, F.col("h1"), F.col("h2")).filter("_maybe").drop("_maybe")
    gone = join_facts(likely, facts, ["h1", "h2"], "n", total).filter(F.col("near") | (F.col("first") != place))
    return gone.groupBy("k", "d").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def drop_lines(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, t, gone) per input row: the row as it was, its text without the repeated lines, their numbers (NULL if none)."""
    gone = checkpoint(repeated_lines(df, key, text, most, min_chars))
    bits = checkpoint(bit_table(gone, F.col("k"), F.col("d")))
    packed = df.select(F.struct("*").alias("row"), F.col(key).alias("k"), text_of(text).alias("t")).withColumn("d", F.xxhash64("t"))
    marked = split_by_bits(packed, bits, F.col("k"), F.col("d"))
    whole = marked.filter("not _maybe").select("row", "t", F.lit(None).cast("array<int>").alias("gone"))
    facts = gone.select(F.col("k").alias("_k"), F.col("d").alias("_d"), "gone")
    hit = marked.filter("_maybe").join(facts, same([F.col("k"), F.col("d")], [F.col("_k"), F.col("_d")]), "left")
    # a one-element array binds the lines, so that a text is split once
    bound = F.array(F.struct(F.split("t", "\n").alias("lines"), F.col("gone")))
    kept = F.transform(bound, lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]))
    bound = F.transform(F.arrays_zip(bound.alias("b"), kept.alias("kept")), lambda z: F.array_join(F.transform(z["kept"], lambda i: F.get(z["b"]["lines"], i)), "\n"))
    cut = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.get(bound, F.lit(0)))
    return whole.unionByName(hit.select("row", cut.alias("t"), "gone"))
