"""Centroid clustering in which only vectors whose bounds expire are looked at again.

Lloyd's rounds over whole numbers.  When a vector is scanned, its distance to the nearest centroid (an upper bound from
then on) and to the second nearest (a lower bound for all others) are known.  Later the first grows by at most the
drift of its own centroid, the second shrinks by at most the largest drift of any other, so the gap between both falls
by at most their sum.  Every cluster adds these sums up.  A vector enters its cluster's heap under ``expires``, its gap
plus what the cluster had added up by then; once the cluster's sum reaches that, the vector is popped and scanned
exactly against all centroids.  All others keep their centroid without a look.

A heap is kept as ordered runs: each scan writes one layer of rows (vector, cluster, expires), sorted by ``expires``
within its files.  As sums only grow, what a round pops from a layer is a range of ``expires``, which is a filter that
the scan of the files takes over; no layer is written twice, and a vector's newest layer tells its cluster.  Sums of
the centroids change by the popped vectors that moved, and are reduced by Spark to one number per component.

Components are floor(64 * x) with x as double, all distances and sums exact: in float64 while everything stays below
2**53, else as whole numbers of any length.  Only centroids (``k`` vectors) come to the driver.

Results for odd input: vectors that are null, of another length than ``dim``, or with components that are null or (as
doubles, times ``scale``) not finite are left out; null ids take part but start no cluster while others can; repeated
ids are rows of their own, and equal hashes start clusters in the order of their components; with fewer than ``k``
vectors there are as many clusters; distances and their sums beyond a long are cut to the largest long; an empty table
gives none.  Columns other than vec_id and embedding are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import materialize

CLUSTERS = 16
ROUNDS = 3
DIM = 64
SCALE = 64.0
SEED = 1
_EXACT = 2.0 ** 53
_LONGEST = 2 ** 63 - 1
_LIMB = 40
_LAYER = "vec_id long, v array<double>, cluster int, was int, expires double"


def quantised(vectors: DataFrame, dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """vec_id, v (whole numbers as doubles) of the vectors that take part."""
    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)

    rows = vectors.filter(F.size("embedding") == dim).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))
    return rows.filter(F.forall("v", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf")))))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    picked = rows.select(turn.alias("turn"), "v").orderBy(F.col("turn").asc_nulls_last(), "v").limit(k).collect()
    return [[int(x) for x in r["v"]] for r in picked]


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def squares(v: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances (vector, centroid): int64 where they fit, else Python integers."""
    most = max([1.0, float(np.abs(v).max(initial=0)), *[float(abs(x)) for c in centroids for x in c]])
    if 4 * v.shape[1] * most * most < _EXACT:
        c = np.array(centroids, dtype=np.float64)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(v), len(centroids)), dtype=object)
    for i, row in enumerate(v):
        whole = [int(x) for x in row]
        out[i] = [sum((a - b) ** 2 for a, b in zip(whole, c, strict=True)) for c in centroids]
    return out


def root(x: np.ndarray) -> np.ndarray:
    """Square roots, of whole numbers of any length too."""
    if x.dtype != object:
        return np.sqrt(x.astype(np.float64))
    return np.array([float(math.isqrt(int(n))) for n in x])


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, a safe lower bound of the gap to the second nearest)."""
    found = squares(v, centroids)
    cluster = np.array([min(range(len(r)), key=r.__getitem__) for r in found], dtype=np.int32) \
        if found.dtype == object else found.argmin(axis=1).astype(np.int32)
    if len(centroids) == 1:
        return cluster, np.full(len(v), np.inf)
    at = np.arange(len(v))
    first, others = found[at, cluster], found.copy()
    others[at, cluster] = found.max() + 1
    near, far = root(first), root(others.min(axis=1))
    return cluster, far - near - 1e-9 * (far + near) - 2 * (found.dtype == object) - 1e-9


def scan(rows: DataFrame, centroids: list[list[int]], added: np.ndarray, dim: int, name: str) -> DataFrame:
    """The layer of ``rows`` (vec_id, v, was): assigned exactly, ordered by when they expire."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, gap = nearest(matrix(batch.column("v"), dim), centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(cluster), batch.column("was"),
                     pa.array(added[cluster] + gap)], names=["vec_id", "v", "cluster", "was", "expires"])

    return materialize(rows.select("vec_id", "v", "was").mapInArrow(run, _LAYER).sortWithinPartitions("expires"), name)


def moved_sums(layer: DataFrame, k: int, dim: int) -> dict[int, tuple[int, list[int]]]:
    """By cluster: change of its count and of its component sums by the layer's vectors that moved."""
    mask = (1 << _LIMB) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), dtype=object)
        for batch in batches:
            v = np.concatenate([matrix(batch.column("v"), dim), np.ones((batch.num_rows, 1))], axis=1)
            kind = np.int64 if np.abs(v).max(initial=0) < 2.0 ** 40 else object
            v = v.astype(np.int64) if kind is np.int64 else np.array([[int(x) for x in r] for r in v], dtype=object)
            for column, sign in (("cluster", 1), ("was", -1)):
                own = batch.column(column).fill_null(-1).to_numpy(zero_copy_only=False)
                for c in np.unique(own[own >= 0]):
                    total[c] += sign * v[own == c].sum(axis=0).astype(object)
        out = [(c, place, limb, (1 if x > 0 else -1) * (abs(int(x)) >> _LIMB * limb & mask))
               for c in range(k) for place, x in enumerate(total[c]) if x
               for limb in range(-(-abs(int(x)).bit_length() // _LIMB))]
        names, kinds = ("cluster", "place", "limb", "value"), (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    moved = layer.filter("was is null or was <> cluster").select("v", "cluster", "was")
    parts = moved.mapInArrow(run, "cluster int, place int, limb int, value long")
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["cluster"], [0] * (dim + 1))[r["place"]] += r["value"] << _LIMB * r["limb"]
    return {c: (sums[dim], sums[:dim]) for c, sums in found.items()}


def drifts(before: list[list[int]], after: list[list[int]]) -> np.ndarray:
    """By how much the gap of each cluster's vectors can fall: its own drift and the largest of any other."""
    own = np.array([math.sqrt(float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))))
                    for x, y in zip(before, after, strict=True)])
    order = np.argsort(-own)
    other = np.full(len(own), own[order[0]])
    other[order[0]] = own[order[1]] if len(own) > 1 else 0.0
    return (own + other) * (1 + 1e-9)


def of_cluster(values: np.ndarray | list) -> Column:
    """The value of a row's cluster."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE,
            seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and scans of every vector that takes part.

    ``scans`` tells in how many of the rounds the vector was last scanned: 0 if its first scan settled it.
    """
    rows = quantised(vectors, dim, scale)
    centroids = first_centroids(rows, k, seed)
    k = len(centroids)
    if not k:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int")
    added = np.zeros(k)
    layers = [scan(rows.withColumn("was", F.lit(None).cast("int")), centroids, added, dim, "layer")]
    counts, sums = [0] * k, [[0] * dim for _ in range(k)]
    for _ in range(rounds):
        for c, (n, moved) in moved_sums(layers[-1], k, dim).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], moved, strict=True)]
        moved_to = [[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(k)]
        due, centroids = added + drifts(centroids, moved_to), moved_to
        # rows that an earlier round popped have a newer layer; the second filter is what the files' order answers
        popped = [layer.filter(of_cluster(due) >= F.col("expires")).filter(F.col("expires") <= float(due.max()))
                  for layer in layers]
        popped = [p if layer is layers[-1] else p.filter(of_cluster(added) < F.col("expires"))
                  for p, layer in zip(popped, layers, strict=True)]
        again = union(popped).select("vec_id", "v", F.col("cluster").alias("was"))
        layers.append(scan(again, centroids, due, dim, "layer"))
        added = due
    current = [layer if layer is layers[-1] else layer.filter(of_cluster(added) < F.col("expires")) for layer in layers]
    current = union([c.select("vec_id", "v", "cluster", F.lit(i).alias("scans")) for i, c in enumerate(current)])
    final = centroids

    def own_distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, at = matrix(batch.column("v"), dim), batch.column("cluster").to_numpy()
            out = np.zeros(len(v), dtype=np.int64)
            for c in np.unique(at):
                far = squares(v[at == c], [final[c]])[:, 0]
                out[at == c] = [min(int(x), _LONGEST) for x in far] if far.dtype == object else far
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(out),
                                              batch.column("scans")], names=["vec_id", "cluster", "distance", "scans"])

    placed = materialize(current.mapInArrow(own_distance, "vec_id long, cluster int, distance long, scans int"), "placed")
    total = [0] * k
    for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect():
        total[r["cluster"]] = int(r["total"])
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return placed.select("vec_id", "cluster", "distance",
                         of_cluster([min(t, _LONGEST) for t in total]).cast("long").alias("cluster_inertia"),
                         F.lit(min(sum(total), _LONGEST)).cast("long").alias("inertia"),
                         of_cluster(names).alias("centroid_sha256"), "scans")
