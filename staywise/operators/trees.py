"""Regression trees grown level by level for many models at once.

Features are cut into bins at quantiles of the training rows. One pass over the rows grows every model's trees by one
level: each task adds up, per open node, feature and bin, the weight and the sum of the target, and for the absolute
error also per level of the target; one shuffle brings the cells of a node together, and one row per node, its best
split, reaches the driver. The trees of all folds, strata, criteria and forest sizes grow in the same passes, so a
grid costs as many passes as its trees are deep.

* ``squared``: the split that lowers the squared error most; leaves are means.
* ``absolute``: the split that lowers the sum of absolute distances from the median most; leaves are medians. Targets
  stand in at most ``levels`` groups of quantiles, each at its mean; with at most ``levels`` different targets nothing
  is rounded.

A tree's rows are weighed by a Poisson(1) draw from a hash of the row key and the tree's seed, the bootstrap of a
table too large to draw from; it repeats on any partitioning. A forest of n trees is the first n trees of a larger one.
Ties between splits go to the earlier feature, then to the lower bin. Rows with a NULL or NaN feature or label are
left out. A constant target or a group without rows gives a tree of one leaf.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from staywise.operators.least_squares import _complete

BINS, LEVELS = 32, 32
CELLS = 1 << 22  # cells of weights and sums that a task holds at a time; more models than that grow in lots
BLOCK = 1 << 15  # rows of one group that a block of binned rows holds at most
ACCURACY = 10_000  # of the quantiles at which features are cut
POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])  # Poisson(1), cumulated


@dataclass(frozen=True)
class Cuts:
    """Where features and targets are cut."""

    features: tuple[tuple[float, ...], ...]
    levels: tuple[float, ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The bin of each value: bin b holds values up to cut b."""
        return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(self.features)]).T


def cut_points(df: DataFrame, features: Sequence[str], label: str, bins: int = BINS, levels: int = LEVELS) -> Cuts:
    """Quantiles of the complete rows, in one aggregate."""

    def at(c: str, parts: int) -> Column:
        return F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(i / parts) for i in range(1, parts)]), ACCURACY)

    row = df.filter(_complete([*features, label])).agg(*[at(c, bins).alias(f"_{i}") for i, c in enumerate(features)], at(label, levels).alias("_y")).first()
    cut = [tuple(sorted(set(v or []))) for v in row]
    return Cuts(tuple(cut[:-1]), cut[-1])


def value_cuts(df: DataFrame, features: Sequence[str], label: str, most: int = 1000) -> Cuts:
    """A cut at every different value, for columns of at most ``most`` values: nothing is rounded."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate([*features, label])]))
    rows = df.filter(_complete([*features, label])).select(each.alias("p")).select("p.*").distinct().limit(most * (len(features) + 1) + 1).collect()
    found: list[list[float]] = [[] for _ in (*features, label)]
    for r in rows:
        found[r["i"]].append(r["v"])
    for c, values in zip((*features, label), found):
        if len(values) > most:
            raise ValueError(f"{c} has more than {most} different values")
    cut = [tuple(sorted(v)[:-1]) for v in found]
    return Cuts(tuple(cut[:-1]), cut[-1])


@dataclass
class Tree:
    """Nodes in heap order: the children of node i are 2 i + 1 (bins up to ``bin``) and 2 i + 2."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)

    def __post_init__(self):
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.bin = np.full(size, -1), np.zeros(size, int)
        self.value, self.gain = np.zeros(size), np.zeros(size)

    def _spread(self, bins: np.ndarray, values: np.ndarray, i: int = 0):
        """The value of the node each row of bins ends in: one comparison per inner node, column by column."""
        if self.feature[i] < 0:
            return values[i]
        down = bins[:, self.feature[i]] > self.bin[i]
        return np.where(down, self._spread(bins, values, 2 * i + 2), self._spread(bins, values, 2 * i + 1))

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node each row of bins ends in."""
        return np.full(len(bins), self._spread(bins, np.arange(len(self.feature))))

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.full(len(bins), self._spread(bins, self.value))


@dataclass(frozen=True)
class Model:
    """What one tree is grown on: the groups of rows that count, the criterion, and the seed of its draw (None: all rows once)."""

    groups: frozenset[int]
    criterion: str = "squared"
    seed: int | None = None


def draw(keys: np.ndarray, seed: int | None) -> np.ndarray:
    """Poisson(1) weights from row hashes."""
    if seed is None:
        return np.ones(len(keys))
    z = keys.view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    unit = (z ^ z >> np.uint64(31)).astype(np.float64) / 2.0**64
    return np.searchsorted(POISSON, unit, side="right").astype(float)


def binned(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], cuts: Cuts, group: Column | None = None) -> DataFrame:
    """(g, n, h, b, y): blocks of ``n`` complete rows of one group, their hashes, bins and labels as bytes.

    A pass over blocks costs what its sums cost: no row is turned into an Arrow row again.
    """
    rows = df.filter(_complete([*features, label])).select(
        F.xxhash64(*keys).alias("h"),
        (F.lit(0) if group is None else group).cast("int").alias("g"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        F.col(label).cast("double").alias("y"),
    )

    def packed(g: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, b, y = (np.concatenate(a, axis=-1) for a in zip(*parts))
        out = [pa.array([g], pa.int32()), pa.array([len(h)], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (h, b, y)]]
        return pa.RecordBatch.from_arrays(out, names=["g", "n", "h", "b", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features))
            bins = cuts.bins(x).T.astype(np.int16)
            h, g, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "y"))
            for group in np.unique(g).tolist():
                own = np.flatnonzero(g == group)
                if size.get(group, 0) + len(own) > BLOCK:
                    yield packed(group, held.pop(group))
                    size[group] = 0
                held.setdefault(group, []).append((h[own], bins[:, own], y[own]))
                size[group] = size.get(group, 0) + len(own)
        for group, parts in held.items():
            yield packed(group, parts)

    return rows.mapInArrow(run, "g int, n int, h binary, b binary, y binary")


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, groups, bins (row, feature) and labels of each block; a block's rows are of one group."""
    for g, n, *parts in zip(*(batch.column(c) for c in ("g", "n", "h", "b", "y"))):
        n = n.as_py()
        h, b, y = (np.frombuffer(p.as_buffer(), t) for p, t in zip(parts, (np.int64, np.int16, np.float64)))
        yield h, np.broadcast_to(np.int32(g.as_py()), n), b.reshape(-1, n).T, y


#: Target of a model, given its number, the bins and the labels: the label itself, or a gradient.
Target = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def _label(model: int, bins: np.ndarray, y: np.ndarray) -> np.ndarray:
    return y


def _fractions(w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and sum of absolute distances from it, of levels in the last axis given by weight and sum."""
    cw, cs = np.cumsum(w, axis=-1), np.cumsum(s, axis=-1)
    n, total = cw[..., -1:], cs[..., -1:]
    mean = np.divide(s, w, out=np.zeros_like(s), where=w > 0)
    pick = lambda a, i: np.take_along_axis(a, i, axis=-1)
    low = (cw < n / 2 - 1e-9).sum(axis=-1, keepdims=True).clip(max=w.shape[-1] - 1)
    high = (cw <= n / 2 + 1e-9).sum(axis=-1, keepdims=True).clip(max=w.shape[-1] - 1)
    high = np.where(pick(w, high) > 0, high, low)
    at = pick(mean, low)
    below_w, below_s = pick(cw, low) - pick(w, low), pick(cs, low) - pick(s, low)
    distance = at * below_w - below_s + (total - pick(cs, low)) - at * (n - pick(cw, low))
    return ((at + pick(mean, high)) / 2)[..., 0], distance[..., 0].clip(min=0)


def best_split(w: np.ndarray, s: np.ndarray, criterion: str) -> tuple[int, int, float, float, float, float]:
    """(feature, bin, gain, value, value left, value right) of a node from its cells by feature, bin and level.

    feature is -1 where no split lowers the error.
    """
    left_w, left_s = np.cumsum(w, axis=1), np.cumsum(s, axis=1)
    right_w, right_s = left_w[:, -1:] - left_w, left_s[:, -1:] - left_s
    if criterion == "absolute":
        value, error = _fractions(left_w[0, -1], left_s[0, -1])
        (left_v, left_e), (right_v, right_e) = _fractions(left_w, left_s), _fractions(right_w, right_s)
        gain = error - left_e - right_e
    else:
        n, t = left_w[0, -1].sum(), left_s[0, -1].sum()
        value = t / n if n else 0.0
        lw, ls, rw, rs = (a.sum(axis=-1) for a in (left_w, left_s, right_w, right_s))
        left_v = np.divide(ls, lw, out=np.zeros_like(ls), where=lw > 0)
        right_v = np.divide(rs, rw, out=np.zeros_like(rs), where=rw > 0)
        # squared error lost by the split, from the distance of the two means
        gain = np.divide(lw * rw, lw + rw, out=np.zeros_like(ls), where=lw + rw > 0) * (left_v - right_v) ** 2
    both = (left_w.sum(axis=-1) > 0) & (right_w.sum(axis=-1) > 0)
    gain = np.where(both, gain, 0.0)
    top = gain.max(initial=0.0)
    if top <= 1e-9 * max(1.0, abs(float(value))):
        return -1, 0, 0.0, float(value), 0.0, 0.0
    f, b = np.argwhere(gain >= top * (1 - 1e-9))[0]
    return int(f), int(b), float(gain[f, b]), float(value), float(left_v[f, b]), float(right_v[f, b])


def grow(rows: DataFrame, models: Sequence[Model], cuts: Cuts, depth: int, target: Target = _label) -> list[Tree]:
    """One tree per model, from ``depth`` passes over the binned rows."""
    trees = [Tree(depth) for _ in models]
    for level in range(depth):
        first = 2**level - 1
        nodes = [(m, i) for m, t in enumerate(trees) for i in range(first, 2 * first + 1) if level == 0 or t.feature[(i - 1) // 2] >= 0]
        if not nodes:
            break
        b = max(len(c) for c in cuts.features) + 1
        sizes = [len(cuts.features) * b * (len(cuts.levels) + 1 if models[m].criterion == "absolute" else 1) for m, _ in nodes]
        lots, held = [[]], 0
        for node, size in zip(nodes, sizes):
            if lots[-1] and held + size > CELLS:
                lots.append([])
                held = 0
            lots[-1].append(node)
            held += size
        for lot in lots:
            for m, i, f, cut, gain, value, left, right in _splits(rows, models, trees, cuts, lot, b, target):
                tree = trees[m]
                if level == 0:
                    tree.value[0] = value
                if f >= 0:
                    tree.feature[i], tree.bin[i], tree.gain[i] = f, cut, gain
                    tree.value[2 * i + 1], tree.value[2 * i + 2] = left, right
    return trees


def _splits(rows: DataFrame, models: Sequence[Model], trees: Sequence[Tree], cuts: Cuts, nodes: list[tuple[int, int]], b: int, target: Target) -> list[tuple]:
    """The best split of each node: one shuffle of the nodes' cells, one row per node back."""
    width, features = len(cuts.levels) + 1, len(cuts.features)
    own: dict[int, list[tuple[int, int]]] = {}
    for at, (m, i) in enumerate(nodes):
        own.setdefault(m, []).append((i, at))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = {m: width if models[m].criterion == "absolute" else 1 for m in own}
        held = {m: np.zeros((2, len(places) * features * b * levels[m])) for m, places in own.items()}
        for h, g, bins, y in (block for batch in batches for block in _arrays(batch)):
            for m, places in own.items():
                if int(g[0]) not in models[m].groups:
                    continue
                slot = np.full(len(trees[m].feature), -1)
                slot[[i for i, _ in places]] = np.arange(len(places))
                slot = np.full(len(y), trees[m]._spread(bins, slot))
                weight, x, t = draw(h, models[m].seed), bins, y
                if models[m].seed is not None or (slot < 0).any():
                    take = np.flatnonzero((slot >= 0) & (weight > 0))
                    if not len(take):
                        continue
                    slot, weight, t = slot[take], weight[take], y[take]
                    x = np.stack([bins[take, f] for f in range(features)]).T
                wanted = target(m, x, t)
                s = weight * wanted
                level = np.searchsorted(cuts.levels, wanted, side="left") if levels[m] > 1 else 0
                for f in range(features):
                    code = ((slot * features + f) * b + x[:, f]) * levels[m] + level
                    for i, weights in enumerate((weight, s)):
                        held[m][i] += np.bincount(code, weights, held[m].shape[1])
        for m, places in own.items():
            full = np.flatnonzero(held[m][0])
            size = features * b * levels[m]
            at = np.array([a for _, a in places])[full // size]
            out = [pa.array(v) for v in (at.astype(np.int64), full % size, held[m][0, full], held[m][1, full])]
            yield pa.RecordBatch.from_arrays(out, names=["node", "cell", "w", "s"])

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        at = int(part["node"].iloc[0])
        m, i = nodes[at]
        levels = width if models[m].criterion == "absolute" else 1
        w, s = np.zeros((2, features * b * levels))
        # in the order of the cells and sums, so that the last digits do not depend on the tasks' order
        part = part.sort_values(["cell", "w", "s"])
        np.add.at(w, part["cell"].to_numpy(), part["w"].to_numpy())
        np.add.at(s, part["cell"].to_numpy(), part["s"].to_numpy())
        shape = (features, b, levels)
        return pd.DataFrame([(m, i, *best_split(w.reshape(shape), s.reshape(shape), models[m].criterion))], columns=kind.names)

    kind = StructType([StructField(n, LongType()) for n in ("m", "i", "f", "cut")] + [StructField(n, DoubleType()) for n in ("gain", "value", "l", "r")])
    # a node's cells are bounded by features, bins and levels, whatever the number of rows
    summed = rows.mapInArrow(cells, "node long, cell long, w double, s double")
    found = summed.groupBy("node").applyInPandas(choose, kind)
    return sorted(tuple(r) for r in found.collect())


def importances(trees: Sequence[Tree], features: Sequence[str]) -> list[tuple[str, float]]:
    """Share of the error that each feature's splits took away, averaged over the trees."""
    total = np.zeros(len(features))
    for tree in trees:
        own = np.bincount(tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0], len(features))
        total += own / own.sum() if own.sum() else own
    return list(zip(features, (total / total.sum() if total.sum() else total).tolist()))


# --- forests -----------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Trees whose mean is the prediction."""

    trees: tuple[Tree, ...]
    cuts: Cuts

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(bins) for t in self.trees], axis=0)


def with_predictions(df: DataFrame, features: Sequence[str], models: dict[str, Forest], by: str | None = None, name: str = "prediction") -> DataFrame:
    """Add the prediction of each row's model: the one under its value of ``by``, or the only one; NULL where features or the model miss."""
    row = df.select(F.struct("*").alias("row")).schema["row"]
    packed = df.select(
        F.struct("*").alias("row"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        _complete(features).alias("ok"),
        (F.lit("") if by is None else F.col(by).cast("string")).alias("s"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, len(features))
            ok, out = batch.column("ok").to_numpy(zero_copy_only=False), np.full(batch.num_rows, np.nan)
            names = np.array(batch.column("s").to_pylist(), object)
            for s, forest in models.items():
                take = np.flatnonzero(ok & (names == s)) if by is not None else np.flatnonzero(ok)
                if len(take):
                    out[take] = forest.predict(forest.cuts.bins(x[take]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, mask=np.isnan(out))], names=["row", name])

    return packed.mapInArrow(run, StructType([row, StructField(name, DoubleType())])).select("row.*", name)


def strata_forests(
    train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], by: str, names: Sequence[str], trees: int = 10, depth: int = 5, criterion: str = "squared", seed: int = 2
) -> dict[str, Forest]:
    """One forest per value of ``by`` in ``names``, all grown in the same ``depth`` passes (R11). ``names`` is a short list."""
    cuts = cut_points(train, features, label)
    group = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(by).cast("string")) - 1
    rows = binned(train, features, label, keys, cuts, F.coalesce(group, F.lit(-1))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        grown = grow(rows, [Model(frozenset({g}), criterion, seed + t) for g in range(len(names)) for t in range(trees)], cuts, depth)
    finally:
        rows.unpersist()
    return {n: Forest(tuple(grown[g * trees : (g + 1) * trees]), cuts) for g, n in enumerate(names)}


@dataclass(frozen=True)
class ForestGrid:
    """Score of every criterion and size on every fold, the winner, and the forest of its kind on all rows."""

    scores: list[dict]
    best: dict
    forest: Forest

    def frame(self, df: DataFrame, places: int = 6) -> DataFrame:
        rows = [(s["criterion"], s["trees"], s["fold"], s["n_rows"], s["r2"], s["mean_r2"], int(s["best"])) for s in self.scores]
        out = df.sparkSession.createDataFrame(rows, "criterion string, trees int, fold int, n_rows long, r2 double, mean_r2 double, best int")
        return out.withColumns({c: F.bround(c, places) for c in ("r2", "mean_r2")})


def grid_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    fold: Column,
    folds: int = 3,
    sizes: Sequence[int] = (1, 3, 5, 10),
    criteria: Sequence[str] = ("squared", "absolute"),
    depth: int = 5,
    seed: int = 2,
) -> ForestGrid:
    """Cross-validated forests over criterion and number of trees (R5): ``depth`` passes grow, one pass scores them all."""
    cuts = cut_points(train, features, label)
    most = max(sizes)
    rows = binned(train, features, label, keys, cuts, fold).persist(StorageLevel.MEMORY_AND_DISK)
    everything = frozenset(range(folds))
    # the last round of each criterion grows on all rows
    models = [Model(everything - {f}, c, seed + t) for c in criteria for f in range(folds + 1) for t in range(most)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for _, g, bins, y in (block for batch in batches for block in _arrays(batch)):
            f = int(g[0])
            for c in range(len(criteria)):
                at = (c * (folds + 1) + f) * most
                upto = np.cumsum([t.predict(bins) for t in grown[at : at + most]], axis=0)
                for n in sizes:
                    e = y - upto[n - 1] / n
                    add = np.array([len(y), y.sum(), (y**2).sum(), (e**2).sum()])
                    sums[c, f, n] = sums.get((c, f, n), 0) + add
        out = [pa.array([k[i] for k in sums], pa.int32()) for i in range(3)] + [pa.array([float(v[i]) for v in sums.values()]) for i in range(4)]
        yield pa.RecordBatch.from_arrays(out, names=["c", "f", "t", "n", "s", "q", "e"])

    try:
        grown = grow(rows, models, cuts, depth)
        parts = rows.mapInArrow(score, "c int, f int, t int, n double, s double, q double, e double")
        added = parts.groupBy("c", "f", "t").agg(*[F.sum(x).alias(x) for x in "nsqe"]).orderBy("c", "t", "f").collect()
    finally:
        rows.unpersist()
    scores = []
    for r in added:
        spread = r["q"] - r["s"] ** 2 / r["n"]
        scores.append({"criterion": criteria[r["c"]], "trees": r["t"], "fold": r["f"], "n_rows": int(r["n"]), "r2": 1 - r["e"] / spread if spread > 0 else None})
    means = {}
    for s in scores:
        means.setdefault((s["criterion"], s["trees"]), []).append(s["r2"])
    means = {k: sum(x for x in v if x is not None) / max(sum(x is not None for x in v), 1) for k, v in means.items()}
    best = max(means, key=lambda k: (round(means[k], 9), -list(means).index(k)))
    for s in scores:
        kind = (s["criterion"], s["trees"])
        s |= {"mean_r2": means[kind], "best": kind == best}
    at = (criteria.index(best[0]) * (folds + 1) + folds) * most
    return ForestGrid(scores, {"criterion": best[0], "trees": best[1]}, Forest(tuple(grown[at : at + best[1]]), cuts))


# worker functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
