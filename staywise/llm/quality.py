"""Quality classifier: a generalised additive model with pairwise interactions.

Features describe the shape of the whole text: shares of kinds of characters,
word and sentence lengths, repetition of words, lines and word pairs. Each
feature is cut into quantile bins. Training boosts in cycles: one shallow tree
per feature and round on that feature's bins, added to its lookup table, so no
feature gets in another's way; then the same over the feature pairs that explain
most of what is left, on coarser bins. The scores of a bag of such models are
averaged. A text is scored by adding its bins' table entries, for a whole batch of
rows at once; nothing else of the model is kept.

The model is fitted on at most ``most_rows`` labelled rows, those of smallest
hash of their key, brought to the driver as features (never as texts). Scoring is
one pass without a shuffle.

NULL and empty texts get a score like any other (all features zero). Labels with
a NULL label or key are left out; a key labelled twice trains twice. Without any
usable label every score is 0.5. Extra columns are kept; a column named as an
output is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.llm.common import ship

MOST_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, RATE = 100, 40, 0.1
PAIRS, BAGS, LEAVES = 8, 2, 3
SYMBOLS = "!#$%&*|.,?"


def features(text: str) -> list[float]:
    """Numbers about the whole text; all zero for an empty one."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    n, w = len(data), len(words)
    if not w:
        return [0.0] * len(FEATURES)
    counts = np.bincount(data, minlength=256)
    share = counts / n
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    used = share[share > 0]
    lengths = np.fromiter(map(len, words), np.int64, w)
    kinds = Counter(words)
    common = max(kinds.values())
    lines = [line for line in text.split("\n") if line.strip()]
    same_next = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    ends = counts[[33, 46, 63]].sum()
    words_per_line = w / len(lines)
    return [
        np.log1p(n), np.log1p(w), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        counts[65:91].sum() / max(letters, 1), counts[48:58].sum() / n, counts[128:].sum() / n,
        (n - letters - counts[48:58].sum() - counts[[9, 10, 13, 32]].sum()) / n,
        *(share[ord(c)] * 100 for c in SYMBOLS),
        len(kinds) / w, len(kinds) / np.sqrt(w), common / w, same_next / w, pairs / max(w - 1, 1),
        float(-(used * np.log2(used)).sum()), np.log1p(words_per_line), len(set(lines)) / len(lines),
        np.log1p(w / max(ends, 1)), sum(1 for word in words if not word[-1].isalnum()) / w,
        sum(1 for word in words if len(word) == 1 and not word.isalnum()) / w, float(lines[-1].rstrip()[-1:] in (".", "!", "?")),
    ]


FEATURES = (
    "bytes words word_length word_spread longest_word upper digits other_script marks".split()
    + [f"share_{ord(c)}" for c in SYMBOLS]
    + "kinds kinds_root top_word same_next word_pairs entropy line_words line_kinds end_words ended_words lone_marks ends_well".split()
)


@dataclass
class AdditiveModel:
    """Bin edges per feature, one table per feature, one per pair of features."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for (a, b), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[a], coarse[b]]
        return 1.0 / (1.0 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]


def _shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Value per bin of a tree with at most ``leaves`` leaves over ordered bins."""
    parts, out = [(0, len(gradient))], np.zeros(len(gradient))
    g, h = np.r_[0, np.cumsum(gradient)], np.r_[0, np.cumsum(weight)]

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    while len(parts) < leaves:
        best = (1e-9, None, None)
        for part in parts:
            a, b = part
            cuts = np.arange(a + 1, b)
            if len(cuts):
                gain = worth(a, cuts) + worth(cuts, b) - worth(a, b)
                gain[(h[cuts] - h[a] < 0.5) | (h[b] - h[cuts] < 0.5)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], part, int(cuts[i]))
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> AdditiveModel:
    """Cyclic boosting on the rows given; the tables are the mean of ``BAGS`` bags."""
    model = AdditiveModel(_edges(x, BINS), pair_edges=_edges(x, PAIR_BINS))
    d = x.shape[1]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(rate / (1 - rate)))
    fine = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(d)]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], side="right") for j in range(d)]
    sizes = [len(e) + 1 for e in model.edges]
    widths = [len(e) + 1 for e in model.pair_edges]
    model.tables = [np.zeros(n) for n in sizes]
    rng = np.random.default_rng(seed)
    bags = [rng.poisson(1.0, len(y)).astype(float) for _ in range(BAGS)] if len(y) > 50 else [np.ones(len(y))]
    totals = []
    for bag in bags:
        total = np.full(len(y), model.base)
        for _ in range(ROUNDS):
            for j in range(d):
                if sizes[j] == 1:
                    continue
                p = 1.0 / (1.0 + np.exp(-total))
                step = RATE * _shallow_tree(
                    np.bincount(fine[j], bag * (y - p), sizes[j]), np.bincount(fine[j], bag * p * (1 - p), sizes[j]), LEAVES
                )
                model.tables[j] += step / len(bags)
                total += step[fine[j]]
        totals.append(total)
    model.pairs = _best_pairs(coarse, widths, y, np.mean(totals, axis=0))
    model.pair_tables = [np.zeros((widths[a], widths[b])) for a, b in model.pairs]
    for bag, total in zip(bags, totals):
        for _ in range(PAIR_ROUNDS):
            for k, (a, b) in enumerate(model.pairs):
                p = 1.0 / (1.0 + np.exp(-total))
                step = RATE * _pair_tree(coarse[a], coarse[b], widths[a], widths[b], bag * (y - p), bag * p * (1 - p))
                model.pair_tables[k] += step / len(bags)
                total += step[coarse[a], coarse[b]]
    return model


def _grid(i: np.ndarray, j: np.ndarray, m: int, n: int, values: np.ndarray) -> np.ndarray:
    return np.bincount(i * n + j, values, m * n).reshape(m, n)


def _pair_tree(i: np.ndarray, j: np.ndarray, m: int, n: int, gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Best four-quadrant step: a cut of the first feature and, on each side, one of the second."""
    g, h = _grid(i, j, m, n, gradient), _grid(i, j, m, n, weight)
    best, out = 1e-9, np.zeros((m, n))
    for cut in range(1, m):
        step, gain = np.zeros((m, n)), 0.0
        for rows in (slice(0, cut), slice(cut, m)):
            gs, hs = g[rows].sum(0), h[rows].sum(0)
            tree = _shallow_tree(gs, hs, 2)
            step[rows] = tree
            gain += float((tree * gs).sum())
        if gain > best:
            best, out = gain, step
    return out


def _best_pairs(coarse: list[np.ndarray], widths: list[int], y: np.ndarray, total: np.ndarray) -> list[tuple[int, int]]:
    """Pairs whose cells explain most of the residual."""
    p = 1.0 / (1.0 + np.exp(-total))
    found = []
    for a in range(len(coarse)):
        for b in range(a + 1, len(coarse)):
            if widths[a] > 1 and widths[b] > 1:
                g = _grid(coarse[a], coarse[b], widths[a], widths[b], y - p)
                h = _grid(coarse[a], coarse[b], widths[a], widths[b], p * (1 - p))
                found.append((float((g**2 / (h + 1.0)).sum()), a, b))
    return [(a, b) for _, a, b in sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:PAIRS]]


def _scored(batches: Iterator[pa.RecordBatch], text: str, score: str, model: AdditiveModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if model is None:
            values = np.full(batch.num_rows, 0.5)
        else:
            rows = [features(t.as_py() or "") for t in batch.column(text)]
            values = model.score(np.array(rows, float).reshape(len(rows), len(FEATURES)))
        others = [f for f in batch.schema if f.name != score]
        schema = pa.schema([*others, pa.field(score, pa.float64())])
        yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(values)], schema=schema)


def train(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, usable: Column, most_rows: int = MOST_ROWS) -> AdditiveModel | None:
    """Fit on the labelled rows for which ``usable`` (an expression over the key) holds, ``most_rows`` at most."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).filter(usable)
    marked = marked.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y"))
    chosen = marked.orderBy(F.xxhash64("k"), "k", "y").limit(most_rows)
    texts = df.select(F.col(key).alias("k2"), F.col(text).cast("string").alias("t"))
    # at most most_rows rows of two numbers
    joined = texts.join(F.broadcast(chosen), F.col("k2") == F.col("k")).select("k", "y", "t")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([features(t.as_py() or "") for t in batch.column("t")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), rows], names=["k", "y", "x"])

    kind = df.schema[key].dataType.simpleString()
    rows = joined.mapInArrow(describe, f"k {kind}, y double, x array<double>").toArrow().to_pylist()
    if len({row["y"] for row in rows}) < 2:
        return None
    rows.sort(key=lambda row: (str(row["k"]), row["y"], row["x"]))
    return fit(np.array([row["x"] for row in rows]), np.array([row["y"] for row in rows]))


def score(df: DataFrame, model: AdditiveModel | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each row."""
    schema = T.StructType([f for f in df.schema if f.name != out]).add(out, T.DoubleType())
    return df.mapInArrow(lambda batches: _scored(batches, text, out, model), schema)


ship(__name__)
