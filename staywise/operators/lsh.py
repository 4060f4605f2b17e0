"""Approximate k-nearest-neighbour regression by bucketed random projections with multi-probe (R4 at scale).

Each of ``tables`` hash tables projects a vector on a few seeded directions and cuts the projections into cells; the
cells name its bucket. A test row looks into its own bucket and into the buckets whose borders are nearest to it. Both
sides are dealt into blocks of bounded size; every pair of blocks meets in one task, which names the buckets of its
rows, joins the two sides on them and measures the pairs that met. A vector travels once per block of the other side,
not once per table and probe, and no pair is shuffled: k rows per test row and pair of blocks are. Distances are exact.

The numbers of tables and probes are chosen per run: for a bounded sample of test rows the exact neighbours are found
by a scan, and the smallest setting whose probes meet at least ``target`` of them is taken and reported with its
recall. Where no setting reaches it the exact search runs, as it does for test rows that met fewer than k rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staywise.functions.codes import hash_unit
from staywise.operators.knn import BLOCK_ROWS, CHUNK_VALUES, _gaps, _matrix, best_pairs, knn_regress, nearest
from staywise.session import reliable_checkpoint

DIRECTIONS = 3  # projections per table
TABLES = (4, 8, 16, 32)
SAMPLE = 64  # test rows whose exact neighbours choose the setting
NEAR = 1000  # training rows from which the cells' width is taken
FEW = 0.05  # share of a block's pairs up to which they are measured one by one


class Projections:
    """Seeded directions; a cell is ``width`` standard deviations of the projections wide."""

    def __init__(self, dims: int, tables: int, spread: np.ndarray, width: float = 1.0, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(0, 1, (max(TABLES), DIRECTIONS, dims))[:tables]
        self.offsets = rng.uniform(0, 1, (max(TABLES), DIRECTIONS))[:tables]
        self.odd = rng.integers(1 << 62, size=(max(TABLES), DIRECTIONS))[:tables] * 2 + 1
        std = np.sqrt(np.einsum("tmd,de,tme->tm", self.directions, spread, self.directions))
        self.width = width * np.where(std > 0, std, 1.0)
        steps = np.array(list(product((0, -1, 1), repeat=DIRECTIONS)))
        self.steps, self.down, self.up = steps, (steps == -1).astype(float), (steps == 1).astype(float)

    def _cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tables, directions, dims = self.directions.shape
        place = (vectors @ self.directions.reshape(-1, dims).T).reshape(-1, tables, directions) / self.width + self.offsets
        cells = np.floor(place)
        return cells.astype(np.int64), place - cells

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        """A number per table and cells; different buckets may share one, which only adds candidates."""
        with np.errstate(over="ignore"):
            mixed = (cells * self.odd[None, :, None, :] if cells.ndim == 4 else cells * self.odd).sum(axis=-1)
            table = np.arange(len(self.odd), dtype=np.int64) * np.int64(0x1E3779B97F4A7C15)
            return mixed ^ (table[:, None] if cells.ndim == 4 else table)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """(row, table): the bucket of each vector."""
        return self._keys(self._cells(vectors)[0])

    def probes(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """(row, table, probe): a vector's own bucket first, then those whose borders are nearest."""
        cells, rest = self._cells(vectors)
        cost = rest**2 @ self.down.T + (1 - rest) ** 2 @ self.up.T
        order = np.argsort(cost, axis=-1, kind="stable")[..., :count]
        return self._keys(cells[:, :, None, :] + self.steps[order])


@dataclass(frozen=True)
class Approximate:
    """``frame``: key and prediction of each test row; the setting taken and its recall on the sample."""

    frame: DataFrame
    recall: float
    tables: int
    probes: int


def _exact_sample(train: DataFrame, sample: np.ndarray, k: int) -> list[np.ndarray]:
    """The k nearest training vectors of each sampled row: one scan, k rows per task and sampled row leave it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = _matrix(batch["v"])
            if not len(vectors):
                continue
            gap = (sample**2).sum(axis=1)[:, None] - 2 * sample @ vectors.T + (vectors**2).sum(axis=1)[None]
            best = np.argsort(gap, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(sample)), best.shape[1])
            flat = best.ravel()
            yield pd.DataFrame({"q": rows, "gap": gap[rows, flat], "id": batch["id"].to_numpy()[flat], "v": batch["v"].to_numpy()[flat]})

    kind = train.schema
    parts = train.select("id", "v").mapInPandas(run, f"q long, gap double, id {kind['id'].dataType.simpleString()}, v {kind['v'].dataType.simpleString()}")
    order = Window.partitionBy("q").orderBy("gap", "id")
    best = parts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).collect()
    out: list[list] = [[] for _ in sample]
    for row in best:
        out[row["q"]].append(row["v"])
    return [np.array(v, dtype=float) for v in out]


def recall(projections: Projections, probes: int, sample: np.ndarray, nearest: Sequence[np.ndarray]) -> float:
    """Share of the sampled rows' neighbours that lie in a bucket the row looks into."""
    asked = projections.probes(sample, probes)
    hits = total = 0
    for keys, near in zip(asked, nearest):
        held = projections.buckets(near)
        hits += int((held[:, :, None] == keys[None]).any(axis=(1, 2)).sum())
        total += len(near)
    return hits / total if total else 1.0


def _met(held: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """(row, column) pairs that share a bucket: ``held`` (column, table), ``asked`` (row, table, probe). Rows stand as bits."""
    met = np.zeros((len(held), -(-len(asked) // 8)), np.uint8)
    rows = np.arange(len(asked))[:, None]
    for t in range(held.shape[1]):
        names, code = np.unique(held[:, t], return_inverse=True)
        at = np.searchsorted(names, asked[:, t]).clip(max=len(names) - 1)
        looks = np.zeros((len(names), len(asked)), bool)
        hit = names[at] == asked[:, t]
        looks[at[hit], np.broadcast_to(rows, at.shape)[hit]] = True
        met |= np.packbits(looks, axis=1)[code]
    return np.unpackbits(met, axis=1, count=len(asked)).T.astype(bool)


def _search(projections: Projections, probes: int, wanted: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, squared distance) of the k nearest ids that each wanted row meets; ``ids`` ascend, a repeated one counts once."""
    code = pd.factorize(ids, use_na_sentinel=False)[0]
    most = k * int(np.bincount(code).max())  # places that k different ids can take
    held, step = projections.buckets(vectors), max(8, CHUNK_VALUES // len(vectors) // 8 * 8)
    found = []
    for i in range(0, len(wanted), step):
        some = wanted[i : i + step]
        met = _met(held, projections.probes(some, probes))
        if met.mean() <= FEW:
            r, j = np.nonzero(met)
            gap = _gaps(some, vectors, r, j)
        else:
            r, j, gap = nearest(some, vectors, most, met)
        if most > k:
            order = np.lexsort((j, gap, code[j], r))
            r, j, gap = r[order], j[order], gap[order]
            once = np.r_[True, (np.diff(r) != 0) | (np.diff(code[j]) != 0)] if len(r) else np.empty(0, bool)
            r, j, gap = r[once], j[once], gap[once]
        take = best_pairs(r, j, gap, k)
        found.append((i + r[take], j[take], gap[take]))
    return tuple(np.concatenate(x) for x in zip(*found))


def lsh_regress(
    train: DataFrame, test: DataFrame, key: str, vector: str, label: str, k: int = 5, target: float = 0.9, seed: int = 2
) -> Approximate:
    """Mean label of the k nearest training rows that share a bucket, for every test row."""
    rows = train.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y"))
    asks = test.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    near = rows.orderBy(hash_unit("width", "id"), "id").limit(NEAR).select("v").collect()
    drawn = asks.orderBy(hash_unit("sample", "id"), "id").limit(SAMPLE).select("v").collect()
    if not near or not drawn:
        return Approximate(knn_regress(train, test, key, vector, label, k), 1.0, 0, 0)
    sample = np.array([r["v"] for r in drawn], dtype=float)
    spread = np.atleast_2d(np.cov(np.array([r["v"] for r in near], dtype=float).T, bias=True))
    nearest = _exact_sample(rows, sample, k)
    chosen = None
    # more probes cost test rows only, more tables cost both sides
    for tables, count in [(TABLES[0], 3), (TABLES[0], 9), *[(t, 3**DIRECTIONS) for t in TABLES]]:
        projections = Projections(sample.shape[1], tables, spread, seed=seed)
        reached = recall(projections, count, sample, nearest)
        if reached >= target:
            chosen = projections, tables, count, reached
            break
    if chosen is None:
        return Approximate(knn_regress(train, test, key, vector, label, k), 1.0, 0, 0)
    projections, tables, count, reached = chosen
    kind = rows.schema["id"].dataType.simpleString()

    def search(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        """The k best of one pair of blocks for each of its test rows."""
        if not len(ask) or not len(have):
            return pd.DataFrame({"id": [], "other": [], "y": [], "gap": []})
        have = have.sort_values("id", kind="stable")
        ids = have["id"].to_numpy()
        r, j, gap = _search(projections, count, _matrix(ask["v"]), _matrix(have["v"]), ids, k)
        return pd.DataFrame({"id": ask["id"].to_numpy()[r], "other": ids[j], "y": have["y"].to_numpy()[j], "gap": gap})

    # rows of one id share a block, so that a block's k best are different ids
    parts, batches = (max(1, -(-side.count() // BLOCK_ROWS)) for side in (rows, asks))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = train.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).cast("double").alias("y"))
    held = held.withColumn("part", F.floor(hash_unit("part", "id") * parts).cast("int")).withColumn("batch", numbers(batches))
    asked = test.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    asked = asked.withColumn("batch", F.floor(hash_unit("batch", "id") * batches).cast("int")).withColumn("part", numbers(parts))
    candidates = asked.groupBy("part", "batch").cogroup(held.groupBy("part", "batch")).applyInPandas(search, f"id {kind}, other {kind}, y double, gap double")
    pairs = candidates.groupBy("id", "other").agg(F.first("y").alias("y"), F.min("gap").alias("gap"))
    order = Window.partitionBy("id").orderBy("gap", "other")
    best = pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    predicted = best.groupBy("id").agg(F.avg("y").alias("prediction"), F.count("*").alias("n"))
    predicted = reliable_checkpoint(predicted)  # one row per test row, read by what is left and by the result
    enough = predicted.filter(F.col("n") >= k).select(F.col("id").alias(key), "prediction")
    few = test.join(enough.select(key), key, "left_anti")
    rest = knn_regress(train, few, key, vector, label, k)
    return Approximate(enough.unionByName(rest), reached, tables, count)


# worker functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
