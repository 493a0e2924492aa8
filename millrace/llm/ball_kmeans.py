"""Ball k-means over integer vectors: exact Lloyd rounds that compare each vector with few centroids.

A cluster is a ball: its centroid and the largest distance of a member. A centroid is a neighbour of a ball if it lies within twice
the ball's radius; others can't win a member. A member nearer to its centroid than half the way to the nearest neighbour is
in the stable core and stays. The rest lie in annuli: in the n-th one, only the n nearest neighbours can win, and only
those are compared exactly. Half ways that are met exactly count as outside, so ties go to the smaller number as in a
full comparison.

Vectors never move between tasks: a round is a pass for sums, one for radii and one that assigns, each with one
small row for a cluster and task. Each assignment is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

DIM, SCALE, K, ROUNDS = 64, 64, 16, 3
#: Components are held within +-LIMIT, so that squared distances of DIM components fit into a long.
LIMIT = 1 << 27


def usable(vector: Column, dim: int = DIM) -> Column:
    """Exactly ``dim`` components, none null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def binaries(rows: np.ndarray) -> pa.Array:
    """An Arrow column with the bytes of each row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows)])


def matrix(column: pa.Array, dtype: str, dim: int) -> np.ndarray:
    """The rows of a column of ``binaries``."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2], dtype, len(column) * dim, int(at)).reshape(-1, dim) if len(column) else np.zeros((0, dim), dtype)


def integers(embeddings: DataFrame, key: str = "vec_id", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(key, v): usable vectors as floor(scale * x), 4 bytes a component."""
    kept = embeddings.where(usable(F.col("embedding"), dim)).select(key, F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            v = np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), binaries(v)], [key, "v"])

    return kept.mapInArrow(run, f"`{key}` {dict(embeddings.dtypes)[key]}, v binary")


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from the rows of c, as integers."""
    x, c = x.astype(np.int64), c.astype(np.int64)
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * top * top < 1 << 53:  # every product and sum is exact in a double
        dots = (x.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    else:
        dots = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * dots + (c * c).sum(1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid by a full comparison; ties go to the smaller number."""
    d = squared(x, c)
    best = d.argmin(1)
    return best.astype(np.int32), d[np.arange(len(x)), best]


class Balls:
    """The neighbours of each ball, nearest first, with a quarter of their squared distance, rounded up."""

    def __init__(self, c: np.ndarray, radii: np.ndarray) -> None:
        """radii: the largest squared distance of a member from its centroid; -1 for an empty ball."""
        self.c, between = c, squared(c, c)
        quarter = -(-between // 4)
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(len(c)):
            others = np.flatnonzero((quarter[i] <= radii[i]) & (np.arange(len(c)) != i))
            others = others[np.argsort(quarter[i][others], kind="stable")]
            self.near.append((others, quarter[i][others]))

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid, given the ball that it is in."""
        best, least = cluster.copy(), np.zeros(len(x), np.int64)
        for i in np.unique(cluster):
            own = np.flatnonzero(cluster == i)
            d = squared(x[own], self.c[i : i + 1])[:, 0]
            others, quarter = self.near[i]
            annulus = np.searchsorted(quarter, d, side="right")  # how many neighbours can win; 0: the stable core
            order = np.argsort(-annulus, kind="stable")
            number, low = np.full(len(own), i), d.copy()
            for n, j in enumerate(others):
                some = order[: np.count_nonzero(annulus > n)]
                if not len(some):
                    break
                far = squared(x[own[some]], self.c[j : j + 1])[:, 0]
                wins = (far < low[some]) | ((far == low[some]) & (j < number[some]))
                number[some[wins]], low[some[wins]] = j, far[wins]
            best[own], least[own] = number, low
        return best, least


def assigned(rows: DataFrame, key: str, dim: int, step) -> DataFrame:
    """(key, v, cluster, distance), written; step(vectors, old clusters or None) gives the last two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(2).to_numpy(zero_copy_only=False) if b.num_columns > 2 else None
            cluster, distance = step(matrix(b.column(1), "<i4", dim), old)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], [key, "v", "cluster", "distance"])

    found = rows.select(*[c for c in (key, "v", "cluster") if c in rows.columns])
    return written(found.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, v binary, cluster int, distance long"), "ball-kmeans")


def means(rows: DataFrame, c: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; an empty cluster keeps its centroid."""
    k, dim = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for b in batches:
            x, cluster = matrix(b.column(0), "<i4", dim), b.column(1).to_numpy(zero_copy_only=False)
            for i in np.unique(cluster):
                own = cluster == i
                total[i, :dim] += x[own].sum(0, dtype=np.int64)
                total[i, dim] += int(own.sum())
        i, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(at, pa.int32()), pa.array(total[i, at], pa.int64())], ["cluster", "at", "total"])

    sums = np.zeros((k, dim + 1), object)
    for r in rows.select("v", "cluster").mapInArrow(run, "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect():  # k * (dim + 1) rows at most
        sums[r.cluster, r["at"]] = r.total
    full = sums[:, dim] > 0
    new = c.copy()
    new[full] = (sums[full, :dim] // sums[full, dim:]).astype(np.int64)
    return new


def radii(rows: DataFrame, c: np.ndarray) -> np.ndarray:
    """The largest squared distance of each cluster's members from its centroid."""
    k, dim = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(k, -1, np.int64)
        for b in batches:
            x, cluster = matrix(b.column(0), "<i4", dim), b.column(1).to_numpy(zero_copy_only=False)
            for i in np.unique(cluster):
                far[i] = max(far[i], squared(x[cluster == i], c[i : i + 1]).max())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(far, pa.int64())], ["cluster", "far"])

    out = np.full(k, -1, np.int64)
    for r in rows.select("v", "cluster").mapInArrow(run, "cluster int, far long").groupBy("cluster").agg(F.max("far").alias("far")).collect():  # k rows
        out[r.cluster] = r.far
    return out


def ball_kmeans(embeddings: DataFrame, key: str = "vec_id", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((key, v, cluster, distance), centroids) after ``rounds`` rounds and a last assignment. embeddings: key, embedding, ...

    The first centroids are the k vectors with the smallest sha256 of ``seed:key``; a null key comes last, equal keys in order of their
    vectors. With fewer than k vectors there are as many centroids; with none, no rows. Vectors of another length, null ones and
    those with null, NaN or infinite components are left out. Rows that repeat a key are vectors of their own. Scaled
    components beyond +-2^27 are held there. Other columns are ignored.
    """
    rows = written(integers(embeddings, key, dim, scale), "ball-vectors")
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    start = rows.orderBy(by.asc_nulls_last(), "v").limit(k).select("v").collect()
    c = np.array([np.frombuffer(r.v, "<i4") for r in start], np.int64).reshape(-1, dim)
    if not len(c):
        return rows.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), c
    now = assigned(rows, key, dim, lambda x, _: nearest(x, c))
    for _ in range(rounds):
        c = means(now, c)
        now = assigned(now, key, dim, Balls(c, radii(now, c)).assign)
    return now, c


def clustered(embeddings: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector; see ball_kmeans."""
    rows, c = ball_kmeans(embeddings, "vec_id", **options)
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    sums = {r.cluster: r.n for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row for each centroid
    of = rows.sparkSession.createDataFrame([(i, sums.get(i, 0), sum(sums.values()), name) for i, name in enumerate(names)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids_ball_kmeans(spark, sf_dir):
    return clustered(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = K, rounds: int = ROUNDS) -> str:
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v FROM (SELECT v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(best) AS best FROM (SELECT k.vec_id, k.v, {{'d': CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c.cluster}} AS best FROM kept k CROSS JOIN c{r} c) GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT best.c AS cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{r})")
            parts.append(f"m{r} AS (SELECT cluster, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM s{r} GROUP BY cluster, i) GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster)")
    last = f"SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.best.c = c.cluster"
    return "WITH " + ", ".join(parts) + " " + last


ORACLE_OP13 = _oracle()
