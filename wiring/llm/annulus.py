"""Centroid clustering with exact integer arithmetic; the nearest centroid comes from an annulus search.

Centroids are sorted by norm.  A vector knows an upper bound of the distance to its nearest centroid: the
distance to the one that it had before (in the first round: to the one nearest in norm).  A centroid within
that bound has a norm that differs from the vector's by no more than it; binary search gives the centroids
in that annulus, and only these are compared, in integers.  The borders are rounded outwards, so what lies
just on them, ties too, is always compared.

Each round is a pass over a written table, so a lost executor costs its tasks only; the table before is
deleted.  Tasks sum the vectors of each cluster they read; the driver sees a row for each centroid and
component, whatever the number of vectors.

Defined results: vectors that are null, have another number of components, or a component null or not
finite are left out; a null id is ordered last when centroids are chosen and is otherwise a vector like any
other; of equal ids the lesser vector comes first; repeated rows count each; fewer vectors than
``k`` give as many centroids; an empty table gives an empty table; of other columns none is carried along.
A component beyond 2^27 after scaling is an error, as its distances would not fit in a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiring.llm.common import discard, materialise

SCALE, K, ROUNDS, DIM = 256, 40, 5, 64
_LIMIT = 1 << 27
_VECTORS = 4096


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``id, v``: the vectors that take part, as whole numbers."""
    def bad(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    vector = F.col("__v")
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("__v"))
    rows = rows.where((F.size(vector) == dim) & ~F.exists(vector, bad))
    far = F.exists(vector, lambda x: F.abs(x) * scale >= _LIMIT)
    fits = F.when(far, F.raise_error(F.lit("a component is too large for exact distances")).cast("array<double>")).otherwise(vector)
    return rows.select("id", F.transform(fits, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = 2) -> np.ndarray:
    """The ``k`` vectors with the least hashes of their ids."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("v")]
    return np.array([r.v for r in vectors.orderBy(*order).limit(k).collect()], np.int64)


class Annulus:
    """Centroids by norm, and the exact search among them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def _distance(self, x: np.ndarray, which: np.ndarray | int) -> np.ndarray:
        away = x - self.centroids[which]
        return (away * away).sum(1)

    def nearest(self, x: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row the nearest centroid (the smaller number of several), its squared distance; and the number of comparisons."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        if before is None:
            above = np.searchsorted(self.norms, norm).clip(0, len(self.norms) - 1)
            below = (above - 1).clip(0)
            before = self.order[np.where(norm - self.norms[below] < self.norms[above] - norm, below, above)]
        best, least = before.copy(), self._distance(x, before)
        reach = np.sqrt(least.astype(np.float64))
        slack = 1e-9 * (norm + reach) + 1e-6  # more than the roots are off
        low = np.searchsorted(self.norms, norm - reach - slack, "left")
        high = np.searchsorted(self.norms, norm + reach + slack, "right")
        compared = len(x)
        for at, number in enumerate(self.order):
            rows = np.flatnonzero((low <= at) & (at < high) & (before != number))
            if len(rows):
                found = self._distance(x[rows], number)
                compared += len(rows)
                closer = (found < least[rows]) | ((found == least[rows]) & (number < best[rows]))
                best[rows[closer]], least[rows[closer]] = number, found[closer]
        return best, least, compared


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id, v, cluster, distance``; a ``cluster`` that the rows have already gives the bound."""
    dim = centroids.shape[1]
    again = "cluster" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, _VECTORS):
                part = batch.slice(at, _VECTORS)
                before = part.column(2).to_numpy().astype(np.int64) if again else None
                cluster, distance, _ = search.nearest(_matrix(part.column(1), dim), before)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    return vectors.select("id", "v", *["cluster"] * again).mapInArrow(run, "id long, v array<int>, cluster int, distance long")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one without vectors stays."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column(1).to_numpy()
            np.add.at(sums, cluster, _matrix(batch.column(0), dim))
            counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = rows.select("v", "cluster").mapInArrow(run, "cluster int, n long, sums array<bigint>")
    exact = "decimal(38,0)"
    each = parts.select("cluster", F.col("n").cast(exact).alias("n"), F.posexplode("sums").alias("at", "s"))
    new = centroids.copy()
    for r in each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(exact)).alias("s")).collect():
        new[r.cluster, r["at"]] = int(r.s) // int(r.n)
    return new


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``id, v, cluster, distance`` of every vector that takes part, and the centroids."""
    rows = materialise(quantised(df, id_col, vector_col, dim, scale), "vectors")
    centroids = first_centroids(rows, k).reshape(-1, dim)
    if not len(centroids):
        return rows.select("id", "v", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), centroids
    for _ in range(rounds + 1):
        before, rows = rows, materialise(assigned(rows, centroids), "clusters")
        discard(before)
        if _ < rounds:
            centroids = moved(rows, centroids)
    return rows, centroids


def report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **settings: int) -> DataFrame:
    """A row for each vector that takes part, with the sums of its cluster and of all."""
    rows, centroids = cluster(df, id_col, vector_col, **settings)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    digests = df.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(F.broadcast(digests), "cluster")
    # a row for each centroid
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    return rows.join(F.broadcast(sums.crossJoin(total)), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
