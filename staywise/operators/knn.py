"""Exact k-nearest-neighbour regression without pairing every test row with every training row.

A metric tree of two levels holds the training rows: each goes to the nearest
top pivot, and there to the nearest leaf pivot. The number of leaves follows the
number of rows. The triangle inequality bounds, for each test row, the distance
of its k-th neighbour; whole branches, then leaves, that cannot hold a nearer row
are left out. A test row travels once to each branch it visits, with the numbers
of the leaves to look at there; a branch's rows go only to the batches of test rows
that visit it. Both sides of a branch are cut into blocks of bounded size, whatever
their share of the rows, and a worker sees a bounded lot of pairs at a time.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise.functions.codes import hash_unit

LEAF_ROWS = 2048  # training rows per leaf, as far as MOST_LEAVES lets it
MOST_LEAVES = 4096  # pivots that the driver and each task hold
BLOCK_ROWS = 16384
CHUNK_VALUES = 4_000_000  # numbers held at once while comparing a block
LOT_PAIRS = 1 << 18  # (row, leaf) pairs held at once while looking for the leaves to visit


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64") if len(column) else np.empty((0, 0))


def _to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _gaps(wanted: np.ndarray, vectors: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared distances of the given pairs."""
    step = max(1, CHUNK_VALUES // max(vectors.shape[1], 1))
    parts = [((wanted[rows[i : i + step]] - vectors[cols[i : i + step]]) ** 2).sum(axis=1) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def best_pairs(rows: np.ndarray, cols: np.ndarray, gaps: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest gaps of each row, ties by column; in the order of the rows."""
    order = np.lexsort((cols, gaps, rows))
    first = np.r_[True, np.diff(rows[order]) != 0] if len(order) else np.empty(0, bool)
    start = np.flatnonzero(first)
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[nth < k]


def nearest(wanted: np.ndarray, vectors: np.ndarray, k: int, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, squared distance) of each wanted row's k nearest vectors, ties by column.

    A product of matrices tells which pairs may be among them, with a margin above its rounding; only those are
    measured. ``met`` (row, column): the pairs that count, all by default.
    """
    # about the middle of the vectors, so that far ones do not cost digits
    middle = vectors.mean(axis=0) if np.isfinite(vectors).all() else np.zeros(vectors.shape[1])
    w, v = wanted - middle, vectors - middle
    norms, own = (v**2).sum(axis=1), (w**2).sum(axis=1)
    margin = 1e-12 * (own + norms.max(initial=0.0))
    gap = w @ (-2 * v.T)
    gap += own[:, None]
    gap += norms
    if met is not None:
        gap[~met] = np.inf
    if len(vectors) > k:
        last = np.partition(gap, k - 1, axis=1)[:, k - 1] + margin
        may = ~(gap > last[:, None])
    else:
        may = np.ones(gap.shape, bool)
    if met is not None:
        may &= met
    rows, cols = np.nonzero(may)
    gaps = _gaps(wanted, vectors, rows, cols)
    best = best_pairs(rows, cols, gaps, k)
    return rows[best], cols[best], gaps[best]


class MetricTree:
    """Pivots in two levels, and what is known of the rows below each."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.tops = pivots[: math.isqrt(len(pivots) - 1) + 1]
        home = _to_pivots(pivots, self.tops).argmin(axis=1)
        self.children = [np.flatnonzero(home == t) for t in range(len(self.tops))]

    def know(self, k: int, leaves: Iterable[tuple[int, float, float, float, Sequence[float]]]) -> None:
        """Per leaf: radius about its pivot, least distance from it, radius about its top pivot, its k smallest distances."""
        n = len(self.pivots)
        self.k, self.radius, self.inner = k, np.full(n, -np.inf), np.full(n, np.inf)
        self.top_radius, self.smallest = np.full(len(self.tops), -np.inf), np.full((n, k), np.inf)
        top_of = np.zeros(n, int)
        for t, own in enumerate(self.children):
            top_of[own] = t
        for leaf, radius, inner, top_radius, smallest in leaves:
            self.radius[leaf], self.inner[leaf] = radius, inner
            self.top_radius[top_of[leaf]] = max(self.top_radius[top_of[leaf]], top_radius)
            self.smallest[leaf, : len(smallest)] = smallest

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf of each vector, its distance from the leaf's pivot, and from the top pivot."""
        far_top = _to_pivots(vectors, self.tops)
        # a top pivot is its own child, so no branch is empty
        home = far_top.argmin(axis=1)
        leaf, far = np.zeros(len(vectors), int), np.zeros(len(vectors))
        for t in np.unique(home):
            rows, own = np.flatnonzero(home == t), self.children[t]
            away = _to_pivots(vectors[rows], self.pivots[own])
            leaf[rows], far[rows] = own[away.argmin(axis=1)], away.min(axis=1)
        return leaf, far, far_top[np.arange(len(vectors)), home]

    def visits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs that may hold one of the row's k nearest."""
        n, slack = len(vectors), lambda b: b * (1 + 1e-9) + 1e-12
        far_top = _to_pivots(vectors, self.tops)
        reach = np.full((n, self.k), np.inf)  # k smallest upper bounds so far
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def look(t: int, rows: np.ndarray) -> None:
            own = self.children[t]
            away = _to_pivots(vectors[rows], self.pivots[own])
            upper = (away[:, :, None] + self.smallest[None, own]).reshape(len(rows), -1)
            reach[rows] = np.sort(np.concatenate([reach[rows], upper], axis=1), axis=1)[:, : self.k]
            least = np.maximum(away - self.radius[None, own], self.inner[None, own] - away)
            r, c = np.nonzero(np.isfinite(self.radius[own])[None, :] & (least <= slack(reach[rows, -1:])))
            seen.append((rows[r], own[c], least[r, c]))

        home = np.where(np.isfinite(self.top_radius)[None, :], far_top, np.inf).argmin(axis=1)
        for t in np.unique(home):
            look(t, np.flatnonzero(home == t))
        for t in range(len(self.tops)):
            rows = np.flatnonzero((home != t) & (far_top[:, t] - self.top_radius[t] <= slack(reach[:, -1])))
            if len(rows) and np.isfinite(self.top_radius[t]):
                look(t, rows)
        rows, leaves, least = (np.concatenate(x) for x in zip(*seen))
        need = least <= slack(reach[rows, -1])
        return rows[need], leaves[need]


def knn_regress(
    train: DataFrame,
    test: DataFrame,
    key: str,
    vector: str,
    label: str,
    k: int = 5,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``key`` and ``prediction``: mean label of the k nearest training rows, distance ties by key."""
    train = train.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).cast("double").alias("y"))
    test = test.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    kind = train.schema["id"].dataType.simpleString()
    element = train.schema["v"].dataType.simpleString()

    # Pivots only steer the pruning; any choice gives the same result.
    wanted = pivots or min(max(-(-train.count() // LEAF_ROWS), 64), MOST_LEAVES)
    picked = train.orderBy(hash_unit("pivot", "id"), "id").limit(wanted).select("v").collect()
    if not picked:
        return test.select(F.col("id").alias(key), F.lit(None).cast("double").alias("prediction"))
    tree = MetricTree(np.unique(np.array([row["v"] for row in picked], dtype="float64"), axis=0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, far, far_top = tree.assign(_matrix(batch["v"]))
                yield batch.assign(cell=cell.astype("int32"), far=far, far_top=far_top)

    celled = train.mapInPandas(assign, f"id {kind}, v {element}, y double, cell int, far double, far_top double")
    # Per leaf: size, radii and its k smallest pivot distances; one row per leaf reaches the driver.
    outward = Window.partitionBy("cell").orderBy("far", "id")
    sizes = celled.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("far").alias("radius"), F.min("far").alias("inner"), F.max("far_top").alias("top_radius")
    )
    close = (
        celled.select("cell", "far", F.row_number().over(outward).alias("r")).filter(F.col("r") <= k)
        .groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("nearest"))
    )
    summary = sizes.join(close, "cell").collect()
    tree.know(k, [(r["cell"], r["radius"], r["inner"], r["top_radius"], r["nearest"]) for r in summary])
    top_of = np.zeros(len(tree.pivots), "int32")
    for t, own in enumerate(tree.children):
        top_of[own] = t
    held = np.zeros(len(tree.tops), dtype="int64")
    for row in summary:
        held[top_of[row["cell"]]] += row["n"]
    parts = np.maximum(-(-held // block_rows), 1)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per (test row, branch that may hold one of its neighbours), with the leaves to look at."""
        lot = max(1, LOT_PAIRS // len(tree.pivots))
        for batch in batches:
            for i in range(0, len(batch), lot):
                some = batch.iloc[i : i + lot]
                rows, cells = tree.visits(_matrix(some["v"]))
                order = np.lexsort((cells, top_of[cells], rows))
                rows, cells = rows[order], cells[order].astype("int32")
                tops = top_of[cells]
                start = np.flatnonzero(np.r_[True, (np.diff(rows) != 0) | (np.diff(tops) != 0)]) if len(rows) else np.empty(0, int)
                yield pd.DataFrame(
                    {
                        "id": some["id"].to_numpy()[rows[start]], "v": some["v"].to_numpy()[rows[start]],
                        "top": tops[start], "cells": pd.Series(np.split(cells, start[1:]) if len(start) else [], dtype=object),
                    }
                )

    visits = test.mapInPandas(visit, f"id {kind}, v {element}, top int, cells array<int>")
    # Test rows of a branch are cut into `batch`es as their number asks; its training rows into `part`s. A branch that
    # no test row visits sends nothing.
    batches = np.zeros(len(tree.tops), dtype="int64")
    for row in visits.groupBy("top").count().collect():
        batches[row["top"]] = -(-row["count"] // block_rows)

    def per_top(counts: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(int(c)) for c in counts]), F.col("top") + 1)

    branch = F.element_at(F.array(*[F.lit(int(t)) for t in top_of]), F.col("cell") + 1)
    visited = celled.withColumn("top", branch).withColumn("_batches", per_top(batches)).filter("_batches > 0")
    train_parts = visited.withColumn("part", F.floor(hash_unit("part", "id") * per_top(parts)).cast("int")).withColumn(
        "batch", F.explode(F.sequence(F.lit(0), (F.col("_batches") - 1).cast("int")))
    )
    test_parts = visits.withColumn("batch", F.floor(hash_unit("batch", "id") * per_top(batches)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), (per_top(parts) - 1).cast("int")))
    )

    def search(probes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The k best of one block for each of its test rows, leaf by leaf."""
        rows = rows.sort_values("id", kind="stable")
        vectors, ids, labels = _matrix(rows["v"]), rows["id"].to_numpy(), rows["y"].to_numpy()
        wanted, cell = _matrix(probes["v"]), rows["cell"].to_numpy()
        looks = probes["cells"].to_numpy()
        who = np.repeat(np.arange(len(looks)), [len(c) for c in looks])
        leaf = np.concatenate(looks) if len(looks) else np.empty(0, int)
        best = np.empty(0, int), np.empty(0, int), np.empty(0)
        for c in np.unique(cell):
            own, asking = np.flatnonzero(cell == c), who[leaf == c]
            step = max(1, CHUNK_VALUES // len(own))
            found = [best]
            for i in range(0, len(asking), step):
                r, j, gap = nearest(wanted[asking[i : i + step]], vectors[own], k)
                found.append((asking[i + r], own[j], gap))
            if len(found) > 1:
                r, j, gap = (np.concatenate(x) for x in zip(*found))
                take = best_pairs(r, j, gap, k)
                best = r[take], j[take], gap[take]
        r, j, gap = best
        return pd.DataFrame({"id": probes["id"].to_numpy()[r], "gap": gap, "other": ids[j], "y": labels[j]})

    block = ["top", "part", "batch"]
    candidates = (
        test_parts.select("id", "v", "cells", *block).groupBy(*block)
        .cogroup(train_parts.select("id", "v", "y", "cell", *block).groupBy(*block))
        .applyInPandas(search, f"id {kind}, gap double, other {kind}, y double")
    )
    order = Window.partitionBy("id").orderBy("gap", "other")
    best = candidates.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return best.groupBy(F.col("id").alias(key)).agg(F.avg("y").alias("prediction"))


# the functions go to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
