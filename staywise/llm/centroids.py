"""Centroid clustering by a progressive search over Walsh-Hadamard coefficients.

Vectors of exactly ``dims`` components, none NULL or non-finite, are kept; each component x becomes the integer
floor(scale * x). Centroids 0, 1, ... start as the ``clusters`` kept vectors with the smallest sha256 of
``<seed>:<key>``, in that order. Each round assigns every vector to the nearest centroid (squared Euclidean distance,
ties to the smaller number) and moves every centroid that has vectors to the floor of their mean, component by
component. Then every vector is assigned once more.

Search: vectors and centroids go through an exact integer Walsh-Hadamard transform, rows in order of sign changes, so
the coarse structure comes first. The sum of the squared differences of the first coefficients is a lower bound of
``dims`` times the squared distance, and equals it after the last one. After each block of coefficients the centroid
that looks best is finished; all whose sum is greater than the best finished distance are strictly worse and leave
(ties stay). Those that are left are finished over all coefficients.

Where the data goes: a round reads the vectors where they are and sends one row of sums per task, centroid and
component; the driver holds the centroids, clusters times dims integers. Nothing is shuffled by cluster, so a centroid
with a third of all vectors is no hot key. The last assignment is written to the shared folder, as its sums are needed
beside its rows. A retried task gives the same sums: they are integers.

Exactness: sums travel as three numbers of 60 bits, so any finite component counts in full; vectors and centroids
beyond 2**24 (for 64 components) go through the same search in Python's integers. A distance, or a sum of distances, above the largest
long is given as the largest long.

Results: one row per kept vector: ``row`` (the input columns, whatever their names), cluster, distance,
cluster_inertia, inertia, centroid_sha256. Rows with the same key that meet in the draw of the first centroids are
ordered by their components; a NULL key is drawn as an empty one. Fewer kept vectors than clusters give fewer
centroids; an empty table, or one without a kept vector, gives no rows. Repeated rows each count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from staywise.llm.common import ship, stored

SCALE = 64
LIMB = 60  # bits of the numbers that carry a sum
MOST = (1 << 63) - 1
BLOCKS = (1, 2, 4, 8, 16, 32)  # coefficients after which centroids are dropped
LOT = 4096  # vectors searched at once


def narrow(dims: int) -> int:
    """Integers below it keep every sum of the search within 64 bits: dims**2 * (2 * it)**2 is 2**62."""
    return (1 << 30) // dims


def transformed(vectors: np.ndarray) -> np.ndarray:
    """Coefficients of the rows, by butterflies of sums and differences, in order of sign changes."""
    n, dims = vectors.shape
    out, width = vectors, 1
    while width < dims:
        halves = out.reshape(n, dims // (2 * width), 2, width)
        out = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(n, dims)
        width *= 2
    return out[:, coarse_first(dims)]


def coarse_first(dims: int) -> np.ndarray:
    """The coefficients' places in the order of the butterflies, fewest sign changes first."""
    places = np.arange(dims)
    matrix = (-1) ** np.bitwise_count(places[:, None] & places[None, :]).astype(np.int64)
    return np.argsort((np.diff(matrix, axis=1) != 0).sum(axis=1), kind="stable")


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row; integers of 64 bits or Python's."""
    dims, k = vectors.shape[1], len(centroids)
    x, c = transformed(vectors), transformed(centroids)
    far = np.zeros((len(x), k), x.dtype)  # sums of squared differences so far
    alive, whole = np.ones((len(x), k), bool), np.zeros((len(x), k), bool)
    every, done = np.arange(len(x)), 0
    best = np.full(len(x), -1, x.dtype)  # the smallest finished sum, -1 before the first
    for stop in (*[b for b in BLOCKS if b < dims], dims):
        row, centre = np.nonzero(alive & ~whole)
        far[row, centre] += ((x[row, done:stop] - c[centre, done:stop]) ** 2).sum(axis=1)
        done = stop
        if done == dims:
            break
        # finish the centroid that looks best; it stays only as a distance to beat
        look = np.where(alive, far, far.max(initial=0) + 1).argmin(axis=1)
        open_ = ~whole[every, look]
        row, centre = every[open_], look[open_]
        far[row, centre] += ((x[row, done:] - c[centre, done:]) ** 2).sum(axis=1)
        whole[row, centre] = True
        found = far[every, look]
        best = np.where((best < 0) | (found < best), found, best)
        alive &= far <= best[:, None]
    far = np.where(alive, far, far.max(initial=0) + 1)
    cluster = far.argmin(axis=1)
    return cluster, far[every, cluster] // dims


def integers(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): of 64 bits where all are small, else Python's integers."""
    if not len(flat) or np.abs(flat).max() < narrow(flat.shape[-1]) / scale:
        return np.floor(flat * scale).astype(np.int64)
    exact = [floor(x * scale) if abs(x) < 1e300 else floor(Fraction(x) * scale) for x in flat.ravel().tolist()]
    return np.array(exact, object).reshape(flat.shape)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """The kept vectors of a batch; the filter before it leaves only whole ones."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _searched(vectors: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Integers, cluster and distance in lots; rows that need Python's integers apart from the others."""
    for i in range(0, len(vectors), LOT):
        lot = integers(vectors[i : i + LOT])
        small = centroids.dtype != object
        if lot.dtype == object and small:
            low = np.array([max(map(abs, v)) < narrow(lot.shape[1]) for v in lot.tolist()])
            cluster, distance = np.zeros(len(lot), np.int64), np.zeros(len(lot), object)
            for rows, kind in ((low, np.int64), (~low, object)):
                if rows.any():
                    cluster[rows], distance[rows] = nearest(lot[rows].astype(kind), centroids.astype(kind))
        else:
            cluster, distance = nearest(lot if small else lot.astype(object), centroids)
        yield lot, cluster, distance


def _centroids(values: list[list[int]]) -> np.ndarray:
    wide = any(abs(x) >= narrow(len(v)) for v in values for x in v)
    return np.array(values, object if wide else np.int64)


def _sums(batches: Iterator[pa.RecordBatch], values: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """Vectors in; per centroid and component its number of vectors and their sum in limbs out."""
    centroids = _centroids(values)
    k, dims = centroids.shape
    total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
    for batch in batches:
        for lot, cluster, _ in _searched(_vectors(batch.column("v"), dims), centroids):
            for c in np.unique(cluster).tolist():
                total[c] += lot[cluster == c].sum(axis=0)
                count[c] += int((cluster == c).sum())
    full = np.flatnonzero(count)
    mask = (1 << LIMB) - 1
    flat = [int(x) for x in total[full].ravel()]
    limbs = [[x & mask for x in flat], [x >> LIMB & mask for x in flat], [x >> 2 * LIMB for x in flat]]
    place = [np.repeat(full, dims), np.tile(np.arange(dims), len(full)), np.repeat(count[full], dims)]
    columns = [*[pa.array(p, pa.int64()) for p in place], *[pa.array(x, pa.int64()) for x in limbs]]
    yield pa.RecordBatch.from_arrays(columns, names=["c", "d", "n", "s0", "s1", "s2"])


def _moved(vectors: DataFrame, values: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: clusters times dims rows reach the driver."""
    parts = vectors.select("v").mapInArrow(lambda b: _sums(b, values), "c long, d long, n long, s0 long, s1 long, s2 long")
    # limbs of 60 bits from any number of tasks fit decimals of 38 digits
    sums = parts.groupBy("c", "d").agg(*[F.sum(F.col(s).cast("decimal(20,0)")).alias(s) for s in ("n", "s0", "s1", "s2")])
    moved = [list(v) for v in values]
    for r in sums.collect():
        whole = int(r["s0"]) + (int(r["s1"]) << LIMB) + (int(r["s2"]) << 2 * LIMB)
        moved[r["c"]][r["d"]] = whole // int(r["n"])
    return moved


def _assign(batches: Iterator[pa.RecordBatch], values: list[list[int]]) -> Iterator[pa.RecordBatch]:
    centroids = _centroids(values)
    for batch in batches:
        found = [(c, d) for _, c, d in _searched(_vectors(batch.column("v"), centroids.shape[1]), centroids)]
        cluster = np.concatenate([c for c, _ in found]) if found else np.zeros(0, np.int64)
        distance = [min(int(x), MOST) for _, d in found for x in d]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["row", "cluster", "distance"])


def kept_vectors(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """(row, v): the rows whose vector has ``dims`` components, all finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter((F.size(v) == dims) & finite).select(F.struct("*").alias("row"), v.alias("v"))


def _first(vectors: DataFrame, key: str, clusters: int, seed: int) -> list[list[int]]:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"row.{key}").cast("string"), F.lit("")))
    drawn = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return [[int(x) for x in integers(np.array(r["v"], float))] for r in drawn]


def cluster_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    dims: int = 64,
    clusters: int = 16,
    rounds: int = 3,
    seed: int = 1,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``row``, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    ``keep`` names the columns of ``row``, all if None: they are written beside the assignment.
    """
    if dims < 1 or dims & dims - 1:
        raise ValueError("dims must be a power of two")
    vectors = kept_vectors(df, vector, dims)
    values = _first(vectors, key, clusters, seed)
    for _ in range(rounds if values else 0):
        values = _moved(vectors, values)
    given = vectors.select(F.struct(*[F.col(f"row.`{c}`").alias(c) for c in (df.columns if keep is None else keep)]).alias("row"), "v")
    row = given.schema["row"].dataType
    kind = StructType([StructField("row", row), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    if values:
        assigned = stored(given.mapInArrow(lambda b: _assign(b, values), kind))
    else:
        assigned = df.sparkSession.createDataFrame([], kind)
    own = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own"))
    sums = {r["cluster"]: int(r["own"]) for r in own.collect()}
    whole = min(sum(sums.values()), MOST)
    digest = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    rows = [(i, min(sums.get(i, 0), MOST), digest(v)) for i, v in enumerate(values)]
    # one row per centroid, so the broadcast is bounded
    facts = F.broadcast(df.sparkSession.createDataFrame(rows, "_c int, cluster_inertia long, centroid_sha256 string"))
    joined = assigned.join(facts, F.col("cluster") == F.col("_c"))
    return joined.select("row", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")


ship(__name__)
