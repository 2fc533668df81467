"""Centroid clustering of integer vectors, exact to the last bit.

A vector's components x become the integers floor(scale * x).  Distances of a block of vectors to all centroids come from
one matrix product, |x|^2 - 2 x.c + |c|^2 in float64.  With M and C the largest magnitudes in a vector and in the centroids,
every partial sum is an integer of at most dim * (M + C)^2; below 2^53 each is exact, in whatever order BLAS adds.
Vectors beyond that bound are measured by differences in 64-bit integers, and beyond 2^63 in Python's, each vector by its own
bound, so one odd vector does not slow its block.

Vectors are packed once into blocks, a Parquet table in the shared folder; each round reads it, and a task sends the sums
and counts of its vectors, added up by RDD.treeAggregate.  The driver holds k centroids and nothing that grows.  A lost
executor's blocks are read again.  Rounds end early when no centroid moves, as all later ones would leave them too.

Kept are vectors of exactly dim components, none null, NaN or infinite.  Equal distances go to the smaller number.  The
starts are the k kept vectors whose sha256 of "<seed>:<key>" is smallest (equal keys by their components, null keys last);
fewer kept vectors give fewer centroids, none give no rows.  Repeated and null keys are vectors of their own.  Distances and
sums beyond 63 bits are null.  Other columns are left aside, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import remove, saved

#: Vectors a block.
BLOCK = 4096
EXACT = 1 << 53
LONG = (1 << 63) - 1
FOUND = pa.schema([("key", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _usable(x: Column, dim: int) -> Column:
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (F.size(x) == dim) & ~F.coalesce(odd, F.lit(True))


def _blocks(kind: np.dtype, dim: int):
    """Rows (key, x) as rows (keys, x) of up to BLOCK vectors, x the components' bytes."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("key"))
                yield pa.record_batch([keys, pa.array([x.tobytes()], pa.binary())], ["keys", "x"])

    return pack


class Centroids:
    """Distances of blocks to k centroids, given as lists of Python integers."""

    def __init__(self, centroids: list[list[int]], scale: int, kind: np.dtype):
        self.centroids, self.scale, self.kind, self.dim = centroids, scale, kind, len(centroids[0])
        self.top = max(abs(v) for c in centroids for v in c)
        self.floats = np.array(centroids, np.float64) if self.top < EXACT else None

    def vectors(self, block) -> np.ndarray:
        return np.frombuffer(block, self.kind).reshape(-1, self.dim)

    def integers(self, row: np.ndarray) -> np.ndarray:
        """A vector's integers, of any size.  Beyond the doubles' range of scale * x, x is itself an integer."""
        with np.errstate(over="ignore"):
            q = np.floor(row.astype(np.float64) * self.scale)
        return np.array([int(v) if math.isfinite(v) else int(x) * self.scale for v, x in zip(q, row.tolist(), strict=True)], object)

    def nearest(self, block):
        """(cluster, distance, integers, wide) of a block's vectors; of those in wide, by row, the last two are there as
        (distance, integers) in Python's integers."""
        x = self.vectors(block)
        with np.errstate(over="ignore"):
            q = np.floor(x.astype(np.float64) * self.scale)
            # half of each range is left unused, as the bound itself is rounded
            bound = self.dim * (np.abs(q).max(axis=1) + float(self.top)) ** 2 if self.floats is not None else np.full(len(q), np.inf)
        cluster, distance, wide = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), {}
        exact = np.flatnonzero(bound < EXACT // 2)
        if len(exact):
            s = q if len(exact) == len(q) else q[exact]
            d = (s * s).sum(axis=1)[:, None] - 2.0 * (s @ self.floats.T) + (self.floats * self.floats).sum(axis=1)
            cluster[exact], distance[exact] = d.argmin(axis=1), d.min(axis=1)
        middle, c = np.flatnonzero((bound >= EXACT // 2) & (bound < LONG // 2)), None
        for at in range(0, len(middle), 256):
            some = middle[at : at + 256]
            c = self.floats.astype(np.int64) if c is None else c
            d = ((q[some].astype(np.int64)[:, None, :] - c) ** 2).sum(axis=2)
            cluster[some], distance[some] = d.argmin(axis=1), d.min(axis=1)
        for i in np.flatnonzero(~(bound < LONG // 2)).tolist():
            v = self.integers(x[i])
            each = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in self.centroids]
            cluster[i] = min(range(len(each)), key=each.__getitem__)
            wide[i] = each[cluster[i]], v
        return cluster, distance, q, wide

    def add(self, total, row):
        """total with a block's vectors: (counts, sums of components, distances) of the clusters."""
        cluster, distance, q, wide = self.nearest(row.x)
        k, narrow = len(self.centroids), np.ones(len(q), bool)
        narrow[list(wide)] = False
        # at most 2^12 components of at most 2^32 each: the product's sums are exact
        one = np.zeros((k, len(q)))
        one[cluster[narrow], np.flatnonzero(narrow)] = 1.0
        counts = [n + int(m) for n, m in zip(total[0], np.bincount(cluster, minlength=k), strict=True)]
        sums = [[a + int(b) for a, b in zip(old, new, strict=True)] for old, new in zip(total[1], one @ np.where(narrow[:, None], q, 0.0), strict=True)]
        far = list(total[2])
        for c in range(k):
            mine = distance[narrow & (cluster == c)]
            far[c] += (int((mine >> 32).sum()) << 32) + int((mine & 0xFFFFFFFF).sum())
        for i, (d, v) in wide.items():
            far[cluster[i]] += d
            sums[cluster[i]] = [a + int(b) for a, b in zip(sums[cluster[i]], v, strict=True)]
        return counts, sums, far

    def none(self):
        return [0] * len(self.centroids), [[0] * self.dim for _ in self.centroids], [0] * len(self.centroids)

    @staticmethod
    def merge(a, b):
        plus = lambda x, y: [m + n for m, n in zip(x, y, strict=True)]
        return plus(a[0], b[0]), [plus(x, y) for x, y in zip(a[1], b[1], strict=True)], plus(a[2], b[2])

    def totals(self, blocks: DataFrame):
        return blocks.select("x").rdd.treeAggregate(self.none(), self.add, self.merge)

    def moved(self, counts: list[int], sums: list[list[int]]) -> list[list[int]]:
        """The floor of each cluster's mean; empty clusters stay."""
        return [[s // n for s in total] if n else old for n, total, old in zip(counts, sums, self.centroids, strict=True)]


def _assign(model: Centroids):
    def f(batches):
        for batch in batches:
            for keys, x in zip(batch.column("keys"), batch.column("x"), strict=True):
                cluster, distance, _, wide = model.nearest(x.as_buffer())
                d = distance.tolist()
                for i, (exact, _) in wide.items():
                    d[i] = exact if exact <= LONG else None
                yield pa.record_batch([keys.values, pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], schema=FOUND)

    return f


def centroid_clusters(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid) of each kept vector; centroid: its cluster's final
    components, joined by commas."""
    spark = vectors.sparkSession
    single = vectors.schema[column].dataType.simpleString() == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{column}`").cast(f"array<{'float' if single else 'double'}>").alias("x"))
    kept = rows.where(_usable(F.col("x"), dim))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    first = kept.select(name.alias("name"), "x").orderBy(F.asc_nulls_last("name"), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid string")
    blocks = saved(kept.mapInArrow(_blocks(kind, dim), "keys array<bigint>, x binary"), "blocks")
    start = Centroids([[0] * dim], scale, kind)
    model = Centroids([[int(v) for v in start.integers(np.array(r.x, kind))] for r in first], scale, kind)
    for _ in range(rounds):
        counts, sums, far = model.totals(blocks)
        after = Centroids(model.moved(counts, sums), scale, kind)
        if after.centroids == model.centroids:
            break
        model = after
    else:
        _, _, far = model.totals(blocks)
    long = lambda n: n if n <= LONG else None
    each = [(c, long(d), long(sum(far)), ",".join(map(str, model.centroids[c]))) for c, d in enumerate(far)]
    clusters = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid string")  # k rows
    out = saved(blocks.mapInArrow(_assign(model), "key long, cluster int, distance long"), "clusters")
    remove(blocks)
    return out.join(F.broadcast(clusters), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
