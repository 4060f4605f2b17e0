"""Grouping by keyword, code range or fuzzy token."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.session import reliable_checkpoint

MOST_HITS = 100_000  # close tokens that are sent to all tasks


@dataclass(frozen=True)
class KeywordGroup:
    """LIKE patterns of which one must match, and patterns that must or must not."""

    name: str
    any_of: tuple[str, ...]
    require: str | None = None
    exclude: str | None = None


# Diagnosis groups, patterns over lower-cased descriptions.
DIAGNOSIS_GROUPS = (
    KeywordGroup("cardiovascular", (
        "%with acute myocardial infarction%", "%heart failure%", "%coronary bypass%", "%cardiac%",
        "%heart transplant%", "%cardiothoracic%", "%percutaneous cardiovascular procedure%",
    )),
    KeywordGroup("respiratory_surgical", (
        "%major chest%", "%pulmonary%", "%respiratory%", "%pneumonia%", "%asthma%",
    ), require="%proc%"),
    KeywordGroup("respiratory_medical", (
        "%major chest trauma%", "%pulmonary%", "%respiratory%", "%pneumonia%", "%asthma%",
        "%pleural effusion%", "%lung disease%", "%interstitial%", "%bronhitis%",
    ), exclude="%proc%"),
    KeywordGroup("musculoskeletal_surgical", (
        "%spinal fusion%", "%skn grft%", "%knee replacement%", "%hip replacement%", "%joint replacement%",
        "%amputation for musculoskeletal%", "%biopsies of musculo%", "%femur procedures%",
        "%limb reatacchment%", "%knee proc%", "%humer proc%", "%local excision%", "%soft tissue proc%",
        "%foot proc%", "%joint proc%", "%arthroscopy%", "forearm proc%", "%pathological fracture%",
    )),
    KeywordGroup("musculoskeletal_medical", (
        "%fractures%", "%sprains%", "%dislocation%", "%osteomyelitis%", "%connective tissue disorders%",
        "%arthritis%", "%back problem%", "%bone disease%", "%arthropathies%", "%tendonitis%",
        "%musculotskeletal system%", "%connective tissue diag",
    )),
    KeywordGroup("nervous_surgical", (
        "%nervous%", "%encephalopathy%", "%coma%", "%stupor%", "%cerebrovascular disorders%",
        "%nerve disorders%", "%meningitis%", "%cranial%", "%ventricular shunt%",
    ), require="%proc%"),
    KeywordGroup("nervous_medical", (
        "%nervous%", "%encephalopathy%", "%coma%", "%stupor%", "%cerebrovascular disorders%",
        "%nerve disorders%", "%meningitis%", "%multiple sclerosis%", "%degenerative nervous system%",
        "%cerebellar ataxia%", "%ischemic stroke%", "%cerebral infarction%", "%cranial hemmorrhage%",
        "%seizure%", "%headache%",
    ), exclude="%proc%"),
    KeywordGroup("infectious", ("%septicemia%", "%sepsis%", "%infectious & parsitic%")),
)
# Fuzzy keywords per group.
FUZZY_KEYWORDS = {
    "cardiovascular": ("coronary", "myocardial", "heart", "cardiac", "cardiothoracic", "cardiovascular"),
    "respiratory": ("pulmonary", "respiratory", "pneumonia", "asthma", "bronchi"),
    "musculoskeletal": (
        "muscoskeletal", "connective tissue", "hip", "femur", "joint", "shoulder", "elbow", "spinal fusion",
        "fracture", "bone", "osteomyelitis", "arthritis", "soft tissue",
    ),
    "nervous": ("nervous", "encephalopathy", "coma", "stupor", "cerebro", "nerve", "meningitis"),
    "infectious": ("infectious", "parisitic", "septicemia", "sepsis"),
}
# Major category -> code range (category 7 is published reversed and matches nothing).
CATEGORY_RANGES = {
    1: (20, 103), 2: (113, 125), 3: (129, 159), 4: (163, 208), 5: (215, 316), 6: (326, 395), 8: (453, 566),
    9: (573, 607), 10: (614, 645), 11: (652, 700), 12: (707, 730), 13: (734, 761), 16: (799, 816),
    17: (820, 849), 18: (853, 872), 19: (876, 887), 20: (894, 897), 21: (901, 923), 22: (927, 935),
    24: (955, 965), 25: (969, 977),
}


def like_any(text: Column, patterns: Sequence[str]) -> Column:
    hit = text.like(patterns[0])
    for pattern in patterns[1:]:
        hit = hit | text.like(pattern)
    return hit


def matches(text: Column | str, group: KeywordGroup) -> Column:
    """True when the lower-cased text belongs to the group."""
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    hit = like_any(text, group.any_of)
    if group.require:
        hit = hit & text.like(group.require)
    if group.exclude:
        hit = hit & ~text.like(group.exclude)
    return F.coalesce(hit, F.lit(False))


def group_names(text: Column | str, groups: Sequence[KeywordGroup], other: str = "other") -> Column:
    """Array of all matching groups; ``[other]`` when none matches (P10, Q7)."""
    named = F.array_compact(F.array(*[F.when(matches(text, g), F.lit(g.name)) for g in groups]))
    return F.when(F.size(named) == 0, F.array(F.lit(other))).otherwise(named)


def stratify(
    df: DataFrame, text: str, groups: Sequence[KeywordGroup], name: str = "grp", other: str = "other"
) -> DataFrame:
    """One row per (row, group); a row in several groups appears once in each."""
    return df.withColumn(name, F.explode(group_names(text, groups, other)))


def stratify_by_code(
    rows: DataFrame, codes: DataFrame, code: str, text: str, groups: Sequence[KeywordGroup],
    name: str = "grp", other: str = "other",
) -> DataFrame:
    """Groups found on a code table, attached to rows by code.

    A code belongs to every group one of its descriptions matches; ``other``
    only when none of them does.
    """
    flags = codes.groupBy(code).agg(*[F.max(matches(text, g)).alias(f"_g{i}") for i, g in enumerate(groups)])
    named = F.array_compact(
        F.array(*[F.when(F.col(f"_g{i}"), F.lit(g.name)) for i, g in enumerate(groups)])
    )
    table = flags.select(code, named.alias("_groups"))
    found = F.coalesce(F.col("_groups"), F.array().cast("array<string>"))
    return (
        rows.join(table, code, "left")
        .withColumn(name, F.explode(F.when(F.size(found) == 0, F.array(F.lit(other))).otherwise(found)))
        .drop("_groups")
    )


def numeric_code(code: Column | str) -> Column:
    """Integer value of a string code; empty or non-numeric gives NULL."""
    code = F.col(code) if isinstance(code, str) else code
    return F.nullif(code, F.lit("")).try_cast("int")


def category_counts(
    df: DataFrame, code: Column, ranges: dict[int, tuple[int, int]], sums: dict[str, Column] | None = None
) -> DataFrame:
    """Rows per code range, in one pass over the rows (P13); ranges may overlap."""
    for category, (low, high) in ranges.items():
        if low > high:
            raise ValueError(f"category {category}: reversed range {low}..{high}")
    named = {"n_rows": lambda hit: F.count_if(hit)}
    for name, c in (sums or {}).items():
        named[name] = lambda hit, c=c: F.sum(F.when(hit, c))
    wide = df.withColumn("_code", code).agg(
        *[
            make(F.col("_code").between(low, high)).alias(f"{name}_{category}")
            for category, (low, high) in ranges.items()
            for name, make in named.items()
        ]
    )
    rows = [
        F.struct(F.lit(category).alias("category"), *[F.col(f"{name}_{category}").alias(name) for name in named])
        for category in ranges
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def tokens(text: Column | str) -> Column:
    """Whitespace tokens of the lower-cased text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matched_length(a: Column, b: Column) -> Column:
    """Characters in the matching blocks of two strings, as an expression: the longest common run (the first in ``a``,
    then in ``b``), then the same left and right of it."""
    span = "struct<al:int,ah:int,bl:int,bh:int>"

    def longest(x: Column, y: Column) -> Column:
        """Length and negated start of the longest run of ``x`` that occurs in ``y``."""
        sizes = lambda i: F.size(F.filter(F.sequence(F.lit(1), F.length(x) - i + 1), lambda n: _locate(x.substr(i, n), y) > 0))
        return F.array_max(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.struct(sizes(i).alias("n"), (-i).alias("i"))))

    def step(state: Column, _: Column) -> Column:
        def split(top: Column) -> Column:
            x = a.substr(top["al"] + 1, top["ah"] - top["al"])
            y = b.substr(top["bl"] + 1, top["bh"] - top["bl"])

            def apart(best: Column) -> Column:
                n, i = best["n"], -best["i"] - 1
                j = _locate(x.substr(i + 1, n), y) - 1
                halves = F.array(
                    _span(top["al"], top["al"] + i, top["bl"], top["bl"] + j), _span(top["al"] + i + n, top["ah"], top["bl"] + j + n, top["bh"])
                )
                open_ = F.filter(halves, lambda h: (h["al"] < h["ah"]) & (h["bl"] < h["bh"]))
                rest = F.slice(state["todo"], F.lit(1), F.size(state["todo"]) - 1)
                return F.struct(F.when(n > 0, F.concat(rest, open_)).otherwise(rest).alias("todo"), (state["m"] + n).alias("m"))

            return _bind(longest(x, y), apart)

        return F.when(F.size(state["todo"]) == 0, state).otherwise(_bind(F.element_at(state["todo"], -1), split))

    whole = F.filter(F.array(_span(F.lit(0), F.length(a), F.lit(0), F.length(b))), lambda h: (h["ah"] > 0) & (h["bh"] > 0))
    start = F.struct(whole.cast(f"array<{span}>").alias("todo"), F.lit(0).alias("m"))
    steps = F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1)
    return F.aggregate(steps, start, step, lambda s: s["m"])


def _span(al: Column, ah: Column, bl: Column, bh: Column) -> Column:
    return F.struct(al.cast("int").alias("al"), ah.cast("int").alias("ah"), bl.cast("int").alias("bl"), bh.cast("int").alias("bh"))


def _locate(part: Column, text: Column) -> Column:
    return F.call_function("locate", part, text)


def similarity(a: Column, b: Column) -> Column:
    """Twice the matched characters over all characters (``difflib``'s ratio for keywords below 200 characters)."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * matched_length(a, b) / n)


def _grams(text: Column) -> Column:
    """Characters with their number of occurrence so far: equal for what two strings share, repeats included."""
    chars = F.split(text, "")
    nth = lambda c, i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c))
    return F.transform(chars, lambda c, i: F.concat(c, nth(c, i).cast("string")))


def _word_grams(word: str) -> list[str]:
    return [f"{c}{word[: i + 1].count(c)}" for i, c in enumerate(word)]


def fuzzy_tokens(
    df: DataFrame, text: str, keywords: Sequence[str], cutoff: float = 0.8, method: str = "ratio"
) -> DataFrame:
    """Distinct tokens close to any keyword.

    An inverted index of the fixed list's characters gives the pairs that share enough of them; only those are compared.
    ``ratio`` is the similarity by matching blocks; ``edits`` is edit distance <= (1 - cutoff) x longer length. Both
    are expressions.
    """
    vocabulary = df.select(F.explode(tokens(text)).alias("token")).distinct()
    if method != "ratio":
        met = vocabulary.select("token", F.explode(F.array(*[F.lit(w) for w in keywords])).alias("word"))
        a, b = F.length("token"), F.length("word")
        close = met.filter(F.levenshtein(F.col("token"), F.col("word")) <= F.bround((1 - cutoff) * F.greatest(a, b), 6))
        return close.select("token").distinct()
    # A ratio r needs matches M >= r (a + b) / 2: as many shared characters, and at most a + b - 2 M <= (1 - r)(a + b)
    # edits. Both sieves are exact, so few pairs reach the ratio.
    index = [(g, w, len(w)) for w in dict.fromkeys(keywords) for g in _word_grams(w)]
    words = df.sparkSession.createDataFrame(index, "gram string, word string, b int")
    least, most = min(map(len, keywords)) * cutoff / (2 - cutoff), max(map(len, keywords)) * (2 - cutoff) / cutoff
    lengths = [(a, w, len(w)) for a in range(int(least), int(most) + 2) for w in dict.fromkeys(keywords) if 2 * min(a, len(w)) >= (cutoff - 1e-9) * (a + len(w))]
    fitting = df.sparkSession.createDataFrame(lengths, "a int, word string, b int")
    # the edits of a pair cost far less than a token's characters, so they sift first
    near = vocabulary.select("token", F.length("token").alias("a")).join(F.broadcast(fitting), "a").filter(
        F.levenshtein(F.col("token"), F.col("word")) <= F.lit(1 - cutoff + 1e-9) * (F.col("a") + F.col("b"))
    )
    shared = (
        near.select("token", "a", "word", F.explode(_grams(F.col("token"))).alias("gram"))
        .join(F.broadcast(words), ["gram", "word"])
        .groupBy("token", "word", "a", "b")
        .agg(F.count("*").alias("shared"))
    )
    size = F.col("a") + F.col("b")
    met = shared.filter(2 * F.col("shared") >= F.lit(cutoff - 1e-9) * size)
    # written first: the optimizer would move the ratio, which only reads the keys, below the count that sifts the pairs
    met = reliable_checkpoint(met.select("token", "word"))
    close = met.filter(similarity(F.col("token"), F.col("word")) >= cutoff)
    return close.select("token").distinct()


def fuzzy_rows(
    df: DataFrame, key: str, text: str, keywords: Sequence[str], cutoff: float = 0.8, method: str = "ratio"
) -> DataFrame:
    """Rows with a token close to any keyword; the hit list joins back by token.

    The list is made once; while it is short it goes to the rows, so that no token of a text is shuffled.
    """
    hits = reliable_checkpoint(fuzzy_tokens(df, text, keywords, cutoff, method))
    if hits.limit(MOST_HITS + 1).count() <= MOST_HITS:
        hits = F.broadcast(hits)
    keys = df.select(key, F.explode(F.array_distinct(tokens(text))).alias("token")).join(
        hits, "token", "left_semi"
    )
    return df.join(keys.select(key).distinct(), key, "left_semi")
