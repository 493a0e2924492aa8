"""Vamana graphs with product-quantized search, stored part by part.

Each part of the vectors is a graph of its own, built in one task in two passes (alpha 1, then alpha above 1) in batches of nodes, and
stored as one blob of adjacency, codes and vectors; equal vectors of a part are one node. A search walks the graphs by the codes' table distances and ranks the best
candidates again by exact distance; queries go to the blobs in bounded blocks, and the blobs stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import walks
from millrace.operators.ann import PART_ROWS, Pq, arrays, nearest, parts_of, query_blocks


@dataclass(frozen=True)
class Config:
    """Degree, list size of building and searching, pruning factor, centroids of a codebook, dimensions of a code."""

    r: int = 32
    l_build: int = 64
    l_search: int = 100
    alpha: float = 1.2
    centroids: int = 256
    code_dims: int = 4
    seed: int = 42


class Vamana:
    """A graph over the rows of x, a row of links for each."""

    def __init__(self, x: np.ndarray, r: int, seed: int = 42) -> None:
        self.x, self.r, self.rng = x, r, np.random.default_rng(seed)
        self.links = np.full((len(x), r), -1, np.int32)
        self.medoid = int(((x - x.mean(0)) ** 2).sum(1).argmin()) if len(x) else -1

    def far(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = self.x[at] - q
        return np.einsum("ij,ij->i", d, d)

    def walk(self, n: int, distance, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the ``size`` nearest nodes that the best-first walks of n queries from the medoid meet; distance(queries, places) gives them."""
        return walks.walk(self.links, np.full((n if self.medoid >= 0 else 0, 1), self.medoid), distance, size)

    def prune(self, node: int, at: np.ndarray, dist: np.ndarray, alpha: float) -> np.ndarray:
        """At most r of the candidates, nearest first; one goes if alpha times its distance to one kept isn't above that to the node."""
        out = walks.prune(self.x, np.array([node]), at[None], self.r, alpha)[0]
        return out[out >= 0]

    def insert(self, nodes: np.ndarray, size: int, alpha: float) -> None:
        """Link the nodes to what their walks meet, and back. They don't see each other's new links."""
        at, _ = self.walk(len(nodes), walks.exact(self.x, self.x[nodes]), size)
        self.links[nodes] = walks.prune(self.x, nodes, np.concatenate([at, self.links[nodes]], 1), self.r, alpha)
        walks.link_back(self.x, self.links, nodes, lambda own, near: walks.prune(self.x, own, near, self.r, alpha))

    def build(self, size: int, alpha: float) -> Vamana:
        """Both passes insert batches of nodes, which in the first pass are never more than the graph already has."""
        for i, a in enumerate((1.0, alpha) if alpha > 1 else (1.0,)):
            order = self.rng.permutation(len(self.x))
            for start, end in walks.batches(len(order), len(order), 1 if i == 0 else walks.BATCH):
                self.insert(order[start:end], size, a)
        return self


def to_blob(ids: np.ndarray, first: np.ndarray, g: Vamana, codes: np.ndarray) -> bytes:
    """ids: those of each node one after another, from first[i] to first[i + 1]."""
    held = g.links >= 0
    offsets = np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int64)
    head = np.array([len(g.x), int(offsets[-1]), g.x.shape[1], codes.shape[1], g.medoid, g.r, len(ids)], np.int64)
    return b"".join(p.tobytes() for p in (head, ids.astype(np.int64), first.astype(np.int64), offsets, g.links[held], codes.astype(np.uint8), g.x.astype(np.float32)))


def from_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, Vamana, np.ndarray]:
    n, n_targets, width, m, medoid, r, n_ids = np.frombuffer(blob, np.int64, 7).tolist()
    at = 56

    def take(kind, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    ids, first, offsets, targets, codes = take(np.int64, n_ids), take(np.int64, n + 1), take(np.int64, n + 1), take(np.int32, n_targets), take(np.uint8, n * m).reshape(n, m)
    g = Vamana(np.zeros((0, width)), r)
    g.x, g.medoid = take(np.float32, n * width).reshape(n, width), medoid
    g.links = np.full((n, r), -1, np.int32)
    g.links[np.arange(r)[None] < np.diff(offsets)[:, None]] = targets
    return ids, first, g, codes


def by_tables(tables: np.ndarray, codes: np.ndarray):
    """distance(queries, places) from the queries' tables: the sum of what a place's codes look up."""
    flat, own = tables.reshape(len(tables), -1), np.arange(codes.shape[1]) * tables.shape[2]

    def distance(row: np.ndarray, place: np.ndarray) -> np.ndarray:
        return flat[row[:, None], codes[place] + own].sum(1)

    return distance


class DiskAnn:
    """Stored Vamana graphs: the parts, and the codebooks beside them."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config()) -> None:
        self.spark, self.path, self.config = spark, path, config

    @staticmethod
    def build(vectors: DataFrame, path: str, config: Config = Config(), part_rows: int = PART_ROWS) -> DiskAnn:
        width = len(vectors.first().vec)
        pq = Pq.train(vectors, max(1, width // config.code_dims), min(config.centroids, 256), config.seed)
        index = DiskAnn(vectors.sparkSession, path, config)
        books = [(i, [float(v) for v in row]) for i, book in enumerate(pq.books) for row in book]
        vectors.sparkSession.createDataFrame(books, "book int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
        index._blobs(parts_of(vectors, part_rows), pq).write.mode("overwrite").parquet(f"{path}/parts")
        return index

    def _blobs(self, parted: DataFrame, pq: Pq) -> DataFrame:
        config = self.config

        def run(f: pd.DataFrame) -> pd.DataFrame:
            x, ids, first = walks.distinct(np.stack(f.vec).astype(np.float32), f.id.to_numpy())
            g = Vamana(x, config.r, config.seed).build(config.l_build, config.alpha)
            return pd.DataFrame({"part": f.part.iloc[:1], "blob": [to_blob(ids, first, g, pq.codes(x.astype(np.float64)))]})

        return parted.groupBy("part").applyInPandas(run, "part int, blob binary")

    def parts(self) -> DataFrame:
        return self.spark.read.schema("part int, blob binary").parquet(f"{self.path}/parts")

    def books(self) -> Pq:
        by: dict[int, list] = {}
        for r in self.spark.read.parquet(f"{self.path}/books").collect():  # at most 256 rows for each part of a code
            by.setdefault(r.book, []).append(r.centroid)
        return Pq([np.array(by[i]) for i in sorted(by)])

    def graph(self) -> DataFrame:
        """(part, id, vec, neighbors). Equal vectors of a part are one node: they have the same neighbors, and of equal neighbors the smallest id stands."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for part, blob in zip(f.part, f.blob):
                    ids, first, g, _ = from_blob(blob)
                    for a in range(0, len(ids), walks.BATCH):
                        own = np.searchsorted(first, np.arange(a, min(len(ids), a + walks.BATCH)), side="right") - 1
                        yield pd.DataFrame({"part": part, "id": ids[a : a + walks.BATCH], "vec": list(g.x[own]), "neighbors": [ids[first[v[v >= 0]]] for v in g.links[own]]})

        return self.parts().mapInPandas(run, "part int, id long, vec array<float>, neighbors array<long>")

    def search(self, queries: DataFrame, k: int, rerank: int | None = None) -> DataFrame:
        """(qid, id, dist, rank): walks by table distance, then the best ``rerank`` (default 4 k) of each part by exact distance."""
        return self._searched(queries, k, rerank or 4 * k, self.books().books)

    def search_exact(self, queries: DataFrame, k: int) -> DataFrame:
        """The same by exact distances all along."""
        return self._searched(queries, k, k, None)

    def _searched(self, queries: DataFrame, k: int, rerank: int, books: list[np.ndarray] | None) -> DataFrame:
        size, found = max(self.config.l_search, rerank), None
        for block in query_blocks(queries):

            def run(frames: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
                qids, asked = arrays(block)
                for f in frames:
                    for blob in f.blob:
                        ids, first, g, codes = from_blob(blob)
                        for a, b in walks.batches(len(qids), len(g.x)):
                            q = asked[a:b]
                            distance = walks.exact(g.x, q.astype(np.float32)) if books is None else by_tables(Pq(books).tables(q), codes)
                            at = g.walk(len(q), distance, size)[0][:, :rerank]
                            d = np.stack([g.far(one, own) for one, own in zip(q, at)]) if len(at) else np.zeros((0, 0))
                            qid, key, dist = walks.found_rows(qids[a:b], at, d, ids, first, k)
                            yield pd.DataFrame({"qid": qid, "id": key, "dist": dist})

            part = self.parts().mapInPandas(run, "qid long, id long, dist double")
            found = part if found is None else found.unionByName(part)
        return nearest(found, k)

    def _copied(self, path: str, parts: DataFrame) -> DiskAnn:
        self.spark.read.parquet(f"{self.path}/books").write.mode("overwrite").parquet(f"{path}/books")
        parts.write.mode("overwrite").parquet(f"{path}/parts")
        return DiskAnn(self.spark, path, self.config)

    def remove(self, ids: DataFrame, path: str) -> DiskAnn:
        """The index at path without the ids (id). Parts that lose vectors are rebuilt, the others copied; ids don't change."""
        rows = self.graph().select("part", "id", "vec")
        hit = rows.join(ids.select("id"), "id", "left_semi").select("part").distinct()
        left = rows.join(hit, "part", "left_semi").join(ids.select("id"), "id", "left_anti").select("id", "vec", "part")
        return self._copied(path, self.parts().join(hit, "part", "left_anti").unionByName(self._blobs(left, self.books())))

    def add(self, vectors: DataFrame, path: str, part_rows: int = PART_ROWS) -> DiskAnn:
        """The index at path with new vectors (id, vec) in parts of their own; the codebooks stay."""
        last = self.parts().agg(F.max("part").alias("p")).first().p
        fresh = parts_of(vectors, part_rows).withColumn("part", F.col("part") + F.lit((last if last is not None else -1) + 1))
        return self._copied(path, self.parts().unionByName(self._blobs(fresh, self.books())))
