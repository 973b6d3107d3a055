"""Centroid clustering in whole numbers, with a filter in PCA-rotated coordinates.

Components become whole numbers, ``floor(SCALE * x)``, and all distances that decide are
sums of whole squares, so results are the same on every cluster. The filter in front of them
is a float one: vectors are centred and rotated onto their principal axes, and of each the
``LEADING`` first coordinates and the norm of the rest (its residual) are stored. For a vector
``v`` and a centroid ``c``::

    |v - c|^2  >=  |lead(v) - lead(c)|^2 + (residual(v) - residual(c))^2

since the rotation keeps lengths and the rests differ by no less than their norms do. The
centroid with the least bound is measured first, in whole numbers; another one is measured
only if its bound, less what rounding can have added, is no more than the best distance so
far. Any rotation gives right results; principal axes make the bounds tight.

The stored table is written once to the shared folder and read by every round, so a lost
executor costs the tasks it ran. A round sends the centroids (``k`` rows) to the tasks and
gets back sums and counts per centroid, added up within a task first; nothing that grows with
the table reaches the driver, and a crowded cluster is as many tasks as its vectors fill.

Defined cases: a vector that is null, empty or of another length, or has a null, NaN or
infinite component, is left out, as if its row were not there. Rows that repeat a key are
vectors of their own. A null key hashes as empty text. Fewer vectors than ``k`` give as many
centroids; vectors with equal hashes start in the order of their components. Distance ties go
to the smaller centroid, an empty centroid stays where it is. A component beyond
``LARGEST`` in whole numbers is an error, for squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import local_table, written

from . import rows

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Rotated coordinates that are stored beside the residual's norm.
LEADING = 16
#: Greatest whole component: 64 squares of twice as much stay below 2 ** 62.
LARGEST = 2**27 - 1
#: Vectors measured at once by a task.
BLOCK = 4096
#: Share of squared lengths by which rounding may raise a bound; float64 adds about 1e-13.
SLACK = 1e-9


def whole(vectors: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``key`` and ``v``, the whole components of each vector that is kept."""
    finite = F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    kept = vectors.filter((F.size(vector) == dimensions) & finite)
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    kept = kept.select(F.col(key).alias("key"), scaled.alias("v"))
    within = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    message = f"a vector component is beyond {LARGEST} after scaling by {SCALE}"
    return kept.select(
        "key",
        F.transform("v", lambda x: F.when(within, x).otherwise(F.raise_error(F.lit(message)))).alias("v"),
    )


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors whose keys hash lowest; a top-k, not a sort of the table."""
    hashed = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    least = vectors.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in least], dtype=np.int64)


def principal_axes(vectors: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the axes (columns, by falling variance) of all vectors.

    Tasks add up products of components and send one row per cell, which are added again
    after one shuffle, so that the driver gets the matrix and not one per task.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 1, dimensions + 1))
        for batch in batches:
            v = _matrix(batch.column(0), dimensions).astype(float)
            one = np.hstack([v, np.ones((len(v), 1))])
            total += one.T @ one
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "x"]
            )

    cells = vectors.select("v").mapInArrow(moments, "cell int, x double")
    found = cells.groupBy("cell").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((dimensions + 1) ** 2)
    for r in found:
        total[r.cell] = r.x
    total = total.reshape(dimensions + 1, -1)
    mean = total[-1, :-1] / max(total[-1, -1], 1)
    spread = total[:-1, :-1] / max(total[-1, -1], 1) - np.outer(mean, mean)
    values, axes = np.linalg.eigh((spread + spread.T) / 2)
    return mean, axes[:, np.argsort(values)[::-1]]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column without nulls, all lists of one width, as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), width)


def rotated(v: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates and the norm of the others."""
    turned = (v - mean) @ axes
    return turned[:, :leading], np.sqrt(np.square(turned[:, leading:]).sum(axis=1))


def nearest(
    v: np.ndarray,
    lead: np.ndarray,
    residual: np.ndarray,
    centroids: np.ndarray,
    c_lead: np.ndarray,
    c_residual: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller), its squared distance in whole
    numbers, and how many distances were measured."""
    own = np.square(lead).sum(axis=1) + np.square(residual)
    theirs = np.square(c_lead).sum(axis=1) + np.square(c_residual)
    bound = own[:, None] + theirs[None, :] - 2 * (lead @ c_lead.T + np.outer(residual, c_residual))
    bound -= SLACK * (own[:, None] + theirs[None, :] + 1)
    at = bound.argmin(axis=1)
    best = np.square(v - centroids[at]).sum(axis=1)
    measured = len(v)
    for j in range(len(centroids)):
        near = np.flatnonzero((bound[:, j] <= best) & (at != j))
        if not len(near):
            continue
        measured += len(near)
        distance = np.square(v[near] - centroids[j]).sum(axis=1)
        closer = (distance < best[near]) | ((distance == best[near]) & (j < at[near]))
        at[near[closer]], best[near[closer]] = j, distance[closer]
    return at, best, measured


def _assigned(batches: Iterator[pa.RecordBatch], centroids, mean, axes, leading):
    """Of each block: the batch, its vectors, centroids, distances."""
    c_lead, c_residual = rotated(centroids.astype(float), mean, axes, leading)
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            block = batch.slice(start, BLOCK)
            v = _matrix(block.column("v"), centroids.shape[1]).astype(np.int64)
            lead = _matrix(block.column("lead"), leading)
            residual = np.asarray(block.column("residual"))
            at, best, _ = nearest(v, lead, residual, centroids, c_lead, c_residual)
            yield block, v, at, best


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    leading: int = LEADING,
) -> tuple[DataFrame, np.ndarray]:
    """Per kept vector ``key``, ``cluster`` and ``distance`` (squared), and the centroids."""
    spark = vectors.sparkSession
    rows.ship(spark)
    plain = written(whole(vectors, key, vector, dimensions), "vectors")
    centroids = first_centroids(plain, k)
    none = plain.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    if not len(centroids):
        return none.withColumnRenamed("key", key), centroids
    mean, axes = principal_axes(plain, dimensions)
    leading = min(leading, dimensions)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dimensions)
            lead, residual = rotated(v.astype(float), mean, axes, leading)
            offsets = pa.array(np.arange(0, len(v) + 1, dtype=np.int32) * leading)
            lists = pa.ListArray.from_arrays(offsets, pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("v"), lists, pa.array(residual)],
                names=["key", "v", "lead", "residual"],
            )

    kind = plain.schema["key"].dataType.simpleString()
    stored = plain.mapInArrow(turn, f"key {kind}, v array<bigint>, lead array<double>, residual double")
    stored = written(stored.withColumn("v", F.col("v").cast("array<int>")), "rotated-vectors")

    for _ in range(rounds):
        centroids = _moved(stored, centroids, mean, axes, leading)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, at, best in _assigned(batches, centroids, mean, axes, leading):
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), pa.array(at.astype(np.int32)), pa.array(best)],
                names=["key", "cluster", "distance"],
            )

    found = stored.mapInArrow(last, f"key {kind}, cluster int, distance bigint")
    return written(found, "clusters").withColumnRenamed("key", key), centroids


def _moved(stored: DataFrame, centroids: np.ndarray, mean, axes, leading: int) -> np.ndarray:
    """One round: every vector to its nearest centroid, then the floors of the means."""
    k, dimensions = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, v, at, _ in _assigned(batches, centroids, mean, axes, leading):
            order = np.argsort(at, kind="stable")
            present, first = np.unique(at[order], return_index=True)
            total[present] += np.add.reduceat(v[order], first, axis=0)
            count += np.bincount(at, minlength=k)
        present = np.flatnonzero(count)
        offsets = pa.array(np.arange(0, len(present) + 1, dtype=np.int32) * dimensions)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(present.astype(np.int32)),
                pa.array(count[present]),
                pa.ListArray.from_arrays(offsets, pa.array(total[present].ravel())),
            ],
            names=["cluster", "n", "total"],
        )

    partial = stored.select("v", "lead", "residual").mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    summed = partial.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(dimensions))).alias("total")
    )
    moved = centroids.copy()
    for r in summed.collect():
        moved[r.cluster] = [t // r.n for t in r.total]
    return moved


def centroid_sha256(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def digest(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The clusters with their inertia, that of all, and the hash of the centroid.

    What is joined has one row per centroid."""
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r.cluster_inertia for r in own)
    facts = [(r.cluster, r.cluster_inertia, total, centroid_sha256(centroids[r.cluster])) for r in own]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return found.join(F.broadcast(local_table(found.sparkSession, facts, schema)), "cluster").select(
        *found.columns, "cluster_inertia", "inertia", "centroid_sha256"
    )
