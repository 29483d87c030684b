"""k-means by batches: centroids move towards each batch's means, by ever smaller steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.stored import stored


def _assigned(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, the first of equally near ones."""
    out = np.empty(len(v), dtype=np.int64)
    for lo in range(0, len(v), 256):
        out[lo : lo + 256] = ((v[lo : lo + 256, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sums(centroids: np.ndarray):
    """cluster, n and sum of the rows of each batch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                own = _assigned(v, centroids)
                found = np.unique(own)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([int((own == c).sum()) for c in found]), pa.array([v[own == c].sum(axis=0).tolist() for c in found], pa.list_(pa.float64()))], ["cluster", "n", "total"])

    return run


def auto_k(n: int) -> int:
    """The square root of the rows, from 2 to 30, and fewer than the rows."""
    return max(1, min(max(2, min(30, int(n**0.5))), n - 1))


def step(centroids: np.ndarray, counts: np.ndarray, n: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and counts after a batch: a centroid is the mean of all rows that it was given, each once per pass."""
    counts = counts + n
    rate = np.divide(n, counts, out=np.zeros(len(n)), where=counts > 0)[:, None]
    means = np.divide(totals, n[:, None], out=centroids.copy(), where=n[:, None] > 0)
    return centroids + rate * (means - centroids), counts


def fit(vectors: DataFrame, k: int | None = None, passes: int = 5, batches: int = 8) -> np.ndarray:
    """Centroids of vectors (id, v), of one length, that are read in ``passes`` of ``batches`` each.

    A row's batch follows from its id. The first centroids are the rows of the k least hashes of ids; batches of fewer
    than k rows are passed over. Tasks sum up their rows, the driver holds k centroids.
    """
    vectors = stored(vectors.select("id", "v"), "batches")  # read once for each batch
    n = vectors.count()
    k = k or auto_k(n)
    start = vectors.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(k).select("v").collect()  # k rows
    centroids = np.array([r.v for r in start], dtype=np.float64)
    counts = np.zeros(len(centroids))
    number = F.pmod(F.xxhash64("id"), F.lit(batches))
    sizes = dict(vectors.groupBy(number.alias("b")).count().collect())
    for _ in range(passes):
        for b in range(batches):
            if sizes.get(b, 0) < len(centroids):
                continue
            made = vectors.filter(number == b).select("v").mapInArrow(_sums(centroids), "cluster long, n long, total array<double>")
            total = F.array(*(F.sum(F.col("total")[i]) for i in range(centroids.shape[1])))
            got = made.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("total")).collect()
            own, totals = np.zeros(len(centroids)), np.zeros_like(centroids)
            for r in got:
                own[r["cluster"]], totals[r["cluster"]] = r["n"], r["total"]
            centroids, counts = step(centroids, counts, own, totals)
    return centroids


def predict(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and distance to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                own = _assigned(v, centroids)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own), pa.array(np.sqrt(((v - centroids[own]) ** 2).sum(axis=1)))], ["id", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v").mapInArrow(run, f"id {kind}, cluster long, distance double")
