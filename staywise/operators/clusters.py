"""k-means and silhouettes of many column subsets in shared passes.

Greedy selection tries every remaining column beside the chosen ones. Here the clusterings of all candidates of a step
advance together: a pass over the rows adds up, per candidate and cluster, the rows and their sums, and one more pass
scores them all, so a step costs as many passes as Lloyd's rounds take, whatever the number of columns.

The silhouette uses plain Euclidean distances. The mean distance from a row to a cluster is taken over the cluster's
anchors: all of its rows while it has at most ``anchors`` of them, so the result is exact; else the rows whose hash
falls below the share that leaves about that many. The estimate's standard error is reported beside it.

Without anchors (``anchors=None``) the silhouette of a given clustering counts every pair of rows, whatever the sizes:
rows are sorted by cluster and cut into blocks of bounded size, and each pair of blocks meets in one task, which
measures its distances once for both sides. A few numbers per row leave the task, however many clusters there are: the
least mean distance to the clusters that lie whole in the other block, and the sums to those that blocks share.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import ceil, fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from staywise.functions.codes import hash_unit
from staywise.operators.least_squares import _complete, moments
from staywise.operators.support_vectors import standardised

ROUNDS = 20
ANCHORS = 1000  # rows per cluster that stand for it; the driver and each task hold them
LOT = 512  # rows whose distances to a cluster's anchors are held at once
PAIRS = 1 << 20  # pairs of a row and an anchor that a task holds at a time
CLOSE = 1e-6  # squared distances below this share of the vectors' squares are taken from the differences
BLOCK_VALUES = 1 << 21  # numbers in a block of rows at most; a task holds two blocks
LEAST_ROWS = 512  # rows per block below which blocks are not made smaller
TASKS = 4  # pairs of blocks per core that are wanted at least


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; ties to the first."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1).argmin(axis=1)


def lloyd(rows: DataFrame, subsets: Sequence[tuple[int, ...]], starts: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Centres per subset of columns, from the rows ``starts`` on; all subsets in each pass."""
    centres = [starts[:, list(s)].astype(float) for s in subsets]
    k = len(starts)
    moving = set(range(len(subsets)))
    for _ in range(rounds):
        now, wanted = list(centres), sorted(moving)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {s: np.zeros((k, len(subsets[s]) + 1)) for s in wanted}  # noqa: B023
            for batch in batches:
                x = _points(batch)
                for s in wanted:  # noqa: B023
                    own = x[:, list(subsets[s])]
                    near = nearest_centre(own, now[s])  # noqa: B023
                    sums[s][:, 0] += np.bincount(near, minlength=k)
                    for j in range(own.shape[1]):
                        sums[s][:, j + 1] += np.bincount(near, own[:, j], k)
            cells = [(s, c, j, v) for s, a in sums.items() for (c, j), v in np.ndenumerate(a) if a[c, 0]]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["s", "c", "j", "v"])

        parts = rows.mapInArrow(run, "s int, c int, j int, v double").groupBy("s", "c", "j").agg(F.sum("v").alias("v"))
        sums: dict[int, np.ndarray] = {s: np.zeros((k, len(subsets[s]) + 1)) for s in wanted}
        for r in parts.collect():
            sums[r["s"]][r["c"], r["j"]] = r["v"]
        for s in wanted:
            n = sums[s][:, :1]
            moved = np.where(n > 0, sums[s][:, 1:] / np.where(n > 0, n, 1), centres[s])
            if np.allclose(moved, centres[s], rtol=0, atol=1e-9):
                moving.discard(s)
            centres[s] = moved
        if not moving:
            break
    return centres


@dataclass(frozen=True)
class Silhouette:
    """Mean over all rows; the standard error that anchors bring, 0 where every row is one."""

    score: float | None
    error: float
    n_rows: int


def _ready(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_distances`` makes of the anchors first, for use with many lots of rows."""
    return (anchors**2).sum(axis=1), -2 * anchors.T


def _distances(x: np.ndarray, anchors: np.ndarray, ready: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Euclidean distances from each row to each anchor; memory for the pairs, whatever the number of columns.

    The squares come from a product of matrices; where that would cost digits, from the differences.
    """
    own, turned = ready or _ready(anchors)
    squares = (x**2).sum(axis=1)[:, None] + own
    d = x @ turned
    d += squares
    if d.size and d.min() > CLOSE * squares.max():
        return np.sqrt(d, out=d)
    step = max(1, PAIRS // max(x.shape[1], 1))
    rows, cols = np.nonzero(~(d > CLOSE * squares))
    for i in range(0, len(rows), step):
        r, c = rows[i : i + step], cols[i : i + step]
        d[r, c] = ((x[r] - anchors[c]) ** 2).sum(axis=1)
    return np.sqrt(d, out=d)


def _silhouettes(x: np.ndarray, own: np.ndarray, is_anchor: np.ndarray, anchors: Sequence[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Silhouette of each row and the variance of its own and its nearest other cluster's mean distance, relative to the score."""
    k = len(anchors)
    mean, var = np.full((len(x), k), np.inf), np.zeros((len(x), k))
    for c, a in enumerate(anchors):
        if not len(a):
            continue
        d = _distances(x, a)
        n = len(a) - ((own == c) & is_anchor)  # a row is no neighbour of itself
        mean[:, c] = np.divide(d.sum(axis=1), n, out=np.full(len(x), np.inf), where=n > 0)
        if sizes[c] > len(a):
            var[:, c] = d.var(axis=1) / len(a) * (1 - len(a) / sizes[c])
    rows = np.arange(len(x))
    a, a_var = mean[rows, own], var[rows, own]
    mean[rows, own] = np.inf
    other = mean.argmin(axis=1)
    b, b_var = mean[rows, other], var[rows, other]
    score, alone, top = _score(a, b)
    return score, np.where(alone, 0.0, a_var + b_var) / top**2


def _score(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Silhouettes from the mean distances to the own and the nearest other cluster, which rows have none, and what they are divided by."""
    alone = ~np.isfinite(a) | ~np.isfinite(b)  # the only row of its cluster, or the only cluster
    top = np.where(alone, 1.0, np.maximum(a, b))
    top = np.where(top > 0, top, 1.0)
    return np.where(alone, 0.0, (np.where(alone, 0, b) - np.where(alone, 0, a)) / top), alone, top


def silhouettes(rows: DataFrame, cluster, count: int, most: int, anchors: int = ANCHORS) -> list[Silhouette]:
    """Silhouettes of ``count`` clusterings of rows (u, x) into at most ``most`` clusters each, in three passes.

    ``u`` is a hash of the row in [0, 1). ``cluster(x)`` gives an array of one cluster number per row and clustering,
    and the columns each clustering is measured on.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((count, most), np.int64)
        for batch in batches:
            if batch.num_rows:
                for s, (own, _) in enumerate(cluster(batch)):
                    n[s] += np.bincount(own, minlength=most)
        s, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(c), pa.array(n[s, c])], names=["s", "c", "n"])

    size = np.zeros((count, most), np.int64)
    for r in rows.mapInArrow(sizes, "s long, c long, n long").groupBy("s", "c").agg(F.sum("n").alias("n")).collect():
        size[r["s"], r["c"]] = r["n"]
    share = np.where(size > anchors, anchors / np.maximum(size, 1), 1.0)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = batch.column("u").to_numpy(zero_copy_only=False)
                for s, (own, x) in enumerate(cluster(batch)):
                    take = np.flatnonzero(u < share[s, own])
                    flat = pa.array(x[take].ravel(), pa.float64())
                    ends = pa.array(np.arange(0, len(take) * x.shape[1] + 1, x.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), s)), pa.array(own[take].astype(np.int64)), pa.ListArray.from_arrays(ends, flat)], names=["s", "c", "x"])

    held: dict[tuple[int, int], list] = {}
    for r in rows.mapInArrow(drawn, "s long, c long, x array<double>").collect():  # about ``anchors`` rows per cluster
        held.setdefault((r["s"], r["c"]), []).append(r["x"])
    near = [[np.array(sorted(held.get((s, c), [])), float) for c in range(most)] for s in range(count)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            u = batch.column("u").to_numpy(zero_copy_only=False)
            for s, (own, x) in enumerate(cluster(batch)):
                lot = max(1, min(LOT, PAIRS // max(1, *(len(a) for a in near[s]))))
                for i in range(0, len(x), lot):
                    part = slice(i, i + lot)
                    value, var = _silhouettes(x[part], own[part], u[part] < share[s, own[part]], near[s], size[s])
                    sums[s] += [len(value), value.sum(), np.sqrt(var).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count)), *[pa.array(c) for c in sums.T.copy()]], names=["s", "n", "v", "e"])

    added = rows.mapInArrow(score, "s long, n double, v double, e double").groupBy("s").agg(*[F.sum(c).alias(c) for c in "nve"])
    out = {r["s"]: r for r in added.collect() if r["n"]}
    # anchors are shared by the rows, so their errors do not average out: the mean error is an upper estimate
    return [Silhouette(out[s]["v"] / out[s]["n"], out[s]["e"] / out[s]["n"], int(out[s]["n"])) if s in out else Silhouette(None, 0.0, 0) for s in range(count)]


def silhouette_of(
    df: DataFrame, features: Column, cluster: Column, keys: Sequence[str], clusters: int | None, anchors: int | None = ANCHORS
) -> Silhouette:
    """Silhouette of a given clustering, numbers from 0 on, over an array column.

    ``anchors`` None: exact, from all pairs of rows; then any numbers do, ``clusters`` is not asked, and rows without a
    cluster or a vector count 0.
    """
    if anchors is None:
        return _of_all_pairs(df, features, cluster, keys)
    rows = df.select(hash_unit("anchor", *keys).alias("u"), features.cast("array<double>").alias("x"), cluster.cast("int").alias("c"))

    def own(batch: pa.RecordBatch):
        return [(batch.column("c").to_numpy(zero_copy_only=False), _points(batch))]

    return silhouettes(rows, own, 1, clusters, anchors)[0]


# --- all pairs ---------------------------------------------------------------


@dataclass
class Seen:
    """What the clusters of another block are to the rows of this one.

    ``shared``: rows of each cluster that several blocks share; all others lie whole in one block.
    """

    c: np.ndarray
    shared: Mapping[int, int]
    best: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)
    sums: dict[int, np.ndarray] = field(init=False)

    def __post_init__(self):
        self.best, self.own, self.sums = np.full(len(self.c), np.inf), np.zeros(len(self.c)), {}

    def rows(self, part: slice, names: np.ndarray, sizes: np.ndarray, sums: np.ndarray) -> None:
        """Some rows' sums of distances to all clusters of the other block, names ascending."""
        whole = np.ones(len(names), bool)
        for at in {0, len(names) - 1}:  # only the first and the last can be shared
            name = int(names[at])
            if name in self.shared:
                whole[at] = False
                self.sums.setdefault(name, np.zeros(len(self.c)))[part] = sums[:, at]
        if not whole.any():
            return
        mean = sums / sizes
        mean[:, ~whole] = np.inf
        at = np.searchsorted(names, self.c[part]).clip(max=len(names) - 1)
        mine = np.flatnonzero((names[at] == self.c[part]) & whole[at])
        self.own[part][mine] = sums[mine, at[mine]]
        mean[mine, at[mine]] = np.inf
        np.minimum(self.best[part], mean.min(axis=1), out=self.best[part])

    def cluster(self, name: int, size: int, sums: np.ndarray) -> None:
        """All rows' sums of distances to one cluster, none of whose rows lies here unless it is shared."""
        if name in self.shared:
            self.sums[name] = sums
        else:
            np.minimum(self.best, sums / size, out=self.best)


def _first(c: np.ndarray) -> np.ndarray:
    """Where each cluster's rows begin."""
    return np.flatnonzero(np.r_[True, c[1:] != c[:-1]])


def meet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None, shared: Mapping[int, int]) -> tuple[Seen, Seen | None]:
    """What two blocks (clusters ascending, vectors) are to each other, or a block to itself; each distance is measured once."""
    c, x = a
    to, y = b or a
    mine, theirs = Seen(c, shared), Seen(to, shared) if b else None
    starts, lot, ready = _first(to), max(1, PAIRS // len(to)), _ready(y)
    names, sizes = to[starts], np.diff(np.r_[starts, len(to)])
    now, size, added = None, 0, None  # a cluster goes on into the next lot
    for i in range(0, len(c), lot):
        part = slice(i, min(i + lot, len(c)))
        d = _distances(x[part], y, ready)
        mine.rows(part, names, sizes, np.add.reduceat(d, starts, axis=1))
        if theirs is None:
            continue
        ends = np.r_[_first(c[part]), len(d)].tolist()
        for start, stop in zip(ends, ends[1:]):
            name, n, sums = int(c[i + start]), stop - start, d[start:stop].sum(axis=0)
            if name == now:
                size, added = size + n, added + sums
                continue
            if now is not None:
                theirs.cluster(now, size, added)
            now, size, added = name, n, sums
    if theirs is not None:
        theirs.cluster(now, size, added)
    return mine, theirs


def _of_all_pairs(df: DataFrame, features: Column, cluster: Column, keys: Sequence[str]) -> Silhouette:
    c, x = cluster.cast("long"), features.cast("array<double>")
    rows = df.select(c.alias("c"), x.alias("x"), F.xxhash64(*keys, x).alias("h"))
    whole = F.col("c").isNotNull() & F.col("x").isNotNull()
    facts = rows.agg(F.count("*").alias("all"), F.count_if(whole).alias("n"), F.max(F.size("x")).alias("width")).first()
    if not facts["n"]:
        return Silhouette(0.0 if facts["all"] else None, 0.0, facts["all"])
    # more blocks than their size asks for, so that every core gets pairs; 1.25: ranges are only about equal
    cores = df.sparkSession.sparkContext.defaultParallelism
    most = max(1, BLOCK_VALUES // max(facts["width"], 1))
    parts = max(ceil(1.25 * facts["n"] / most), min(ceil(sqrt(2 * TASKS * cores)), ceil(facts["n"] / LEAST_ROWS)))
    most = min(most, ceil(1.25 * facts["n"] / parts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held, size = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pa.RecordBatch:
            c, x = (np.concatenate(a) for a in zip(*held))
            out = [pa.array([v], pa.int64()) for v in (part, at, len(c), c[0], (c == c[0]).sum(), c[-1], (c == c[-1]).sum())]
            return pa.RecordBatch.from_arrays([*out, *[pa.array([a.tobytes()], pa.binary()) for a in (c, x)]], names=kinds)

        for batch in batches:
            if not batch.num_rows:
                continue
            c, x = batch.column("c").to_numpy(), _points(batch)
            start = 0
            while start < len(c):
                stop = min(len(c), start + most - size)
                held.append((c[start:stop], x[start:stop]))
                size, start = size + stop - start, stop
                if size == most:
                    yield packed()
                    at, held, size = at + 1, [], 0
        if held:
            yield packed()

    kinds = ["p", "i", "n", "low", "n_low", "high", "n_high", "c", "x"]
    ranged = rows.filter(whole).repartitionByRange(parts, "c", "h").sortWithinPartitions("c", "h").select("c", "x")
    blocks = ranged.mapInArrow(cut, ", ".join(f"{k} {'binary' if k in 'cx' else 'long'}" for k in kinds)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        edges = blocks.select(*kinds[:-2]).collect()
        met = _met(blocks, sorted(edges, key=lambda r: (r["p"], r["i"])), most)
        scored = sorted((r["to"], r["n"], r["v"]) for r in met.collect())
    finally:
        blocks.unpersist()
    if sum(n for _, n, _ in scored) != facts["n"]:
        raise RuntimeError("the blocks do not hold all rows")
    return Silhouette(fsum(v for _, _, v in scored) / facts["all"], 0.0, facts["all"])


def _met(blocks: DataFrame, edges: Sequence[Row], most: int) -> DataFrame:
    """(to, n, v): rows and sum of silhouettes of each block, of which small neighbours are joined up to ``most`` rows."""
    each = Counter(r["p"] for r in edges)
    before = np.cumsum([0, *(each[p] for p in range(max(each) + 1))])[:-1].tolist()
    home, size = [0], edges[0]["n"]  # the joined block of each
    for r in edges[1:]:
        fits = size + r["n"] <= most
        home.append(home[-1] if fits else home[-1] + 1)
        size = size + r["n"] if fits else r["n"]
    parts, count = Counter(home), home[-1] + 1
    rows, places = Counter(), set()
    for at, r in zip(home, edges):
        for name, n in {(r["low"], r["n_low"]), (r["high"], r["n_high"])}:
            rows[name] += n
            places.add((name, at))
    shared = {name: rows[name] for name, k in Counter(name for name, _ in places).items() if k > 1}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], dict[int, dict]] = {}

        def whole(held: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
            c, x = (np.concatenate(a) for a in zip(*(held[nth] for nth in sorted(held))))
            return c, x

        for batch in batches:
            for b, o, nth, c, x in zip(*(batch.column(k).to_pylist() for k in ("b", "o", "nth")), batch.column("c"), batch.column("x")):
                own = np.frombuffer(c.as_buffer(), np.int64)
                here = waiting.setdefault((min(b, o), max(b, o)), {b: {}, o: {}})
                here[b][nth] = own, np.frombuffer(x.as_buffer()).reshape(len(own), -1)
                if any(len(held) < parts[at] for at, held in here.items()):
                    continue
                i, j = min(b, o), max(b, o)
                del waiting[i, j]
                alone = i == j  # the block and itself
                for to, other, seen in zip((i, j), (j, i), meet(whole(here[i]), None if alone else whole(here[j]), shared)):
                    if seen is not None:
                        out = [pa.array([to]), pa.array([other]), pa.array([seen.best.tobytes()], pa.binary())]
                        out += [pa.array([a.tobytes() if alone else None], pa.binary()) for a in (seen.c, seen.own)]
                        out += [pa.array([list(seen.sums)], pa.list_(pa.int64())), pa.array([[s.tobytes() for s in seen.sums.values()]], pa.list_(pa.binary()))]
                        yield pa.RecordBatch.from_arrays(out, names=["to", "other", "best", "c", "own", "names", "sums"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sums: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for r in (r for batch in batches for r in batch.to_pylist()):
            to, near = r["to"], np.frombuffer(r["best"])
            best[to] = np.minimum(best[to], near) if to in best else near
            if r["c"] is not None:
                own[to] = np.frombuffer(r["c"], np.int64), np.frombuffer(r["own"])
            sums.setdefault(to, []).extend((name, r["other"], np.frombuffer(s)) for name, s in zip(r["names"], r["sums"]))
        for to, (c, same) in own.items():
            names, at, sizes = np.unique(c, return_inverse=True, return_counts=True)
            size, same, near = sizes[at], same.copy(), best[to].copy()
            added: dict[int, np.ndarray] = {}
            for name, _, s in sorted(sums[to], key=lambda s: s[:2]):  # so that the last digits do not depend on the tasks' order
                added[name] = added[name] + s if name in added else s
            for name, s in added.items():
                mine = c == name
                same[mine], size[mine] = s[mine], shared[name]
                near[~mine] = np.minimum(near[~mine], s[~mine] / shared[name])
            a = np.divide(same, size - 1, out=np.full(len(c), np.inf), where=size > 1)  # a row is no neighbour of itself
            yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([len(c)]), pa.array([_score(a, near)[0].sum()])], names=["to", "n", "v"])

    def looked_up(values: Sequence[int], at: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))

    nth = blocks.select((looked_up(before, F.col("p")) + F.col("i")).cast("long").alias("nth"), "c", "x")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    sent = nth.select("nth", looked_up(home, F.col("nth")).cast("long").alias("b"), "c", "x", others.alias("o"))
    high = F.greatest("b", "o")
    task = (F.floor(high * (high + 1) / 2) + F.least("b", "o")).cast("int")
    seen = sent.repartitionById(count * (count + 1) // 2, task).mapInArrow(
        pairs, "to long, other long, best binary, c binary, own binary, names array<long>, sums array<binary>"
    )
    return seen.repartitionById(count, F.col("to").cast("int")).mapInArrow(score, "to long, n long, v double")


def select_by_silhouette(
    train: DataFrame, features: Sequence[str], start: str, most: int, keys: Sequence[str], k: int = 2, rounds: int = ROUNDS, anchors: int = ANCHORS
) -> list[tuple[str, float | None, float]]:
    """Grow the columns by whichever gives the best silhouette of a ``k``-means clustering (M11): name, score, standard error.

    Columns are standardised by all rows. The first centres are the ``k`` rows with the smallest hash. Ties go to the
    column listed first.
    """
    whole = moments(train, list(features))[()]
    std = np.sqrt(np.diag(whole.spread) / max(whole.n, 1))
    rows = train.filter(_complete(features)).select(hash_unit("anchor", *keys).alias("u"), F.array(*standardised(features, whole.mean, std)).alias("x"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        starts = np.array([r["x"] for r in rows.orderBy("u", "x").limit(k).collect()])
        chosen, out = [list(features).index(start)], [(start, None, 0.0)]
        while len(chosen) < min(most, len(features)) and len(starts) == k:
            rest = [i for i in range(len(features)) if i not in chosen]
            subsets = [(*chosen, i) for i in rest]
            centres = lloyd(rows, subsets, starts, rounds)

            def own(batch: pa.RecordBatch):
                x = _points(batch)
                return [(nearest_centre(x[:, list(s)], c), x[:, list(s)]) for s, c in zip(subsets, centres)]  # noqa: B023

            scored = silhouettes(rows, own, len(subsets), k, anchors)
            best = max(range(len(rest)), key=lambda i: (round(scored[i].score, 9), -i))  # noqa: B023
            chosen.append(rest[best])
            out.append((features[rest[best]], scored[best].score, scored[best].error))
        return out
    finally:
        rows.unpersist()


# worker functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
