"""Approximate search: inverted cells (IVF), product quantization (PQ) with exact reranking, scalar quantization, pruning, stored HNSW.

Fitting uses a bounded sample; every vector is indexed. Centroids and codebooks are a few thousand rows and are sent to
the tasks; the index tables are plain tables, partitioned by cell, so a probe reads only its cells.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.vectors import squared_l2
from millrace.operators import walks

SAMPLE = 20_000


#: Queries that one pass holds, vectors of a graph that one task builds and holds, graphs that every query walks, and vectors of a graph where those are too few.
MAX_QUERIES, PART_ROWS, PARTS, MOST_ROWS = 4096, 10_000, 32, 100_000


def query_blocks(queries: DataFrame) -> Iterator[list[tuple[int, list[float]]]]:
    """The queries (qid, vec) in blocks of bounded size, read one after another; one empty block if there are none."""
    block, some = [], False
    for r in queries.select("qid", "vec").orderBy("qid").toLocalIterator():
        block.append((r.qid, list(r.vec)))
        if len(block) == MAX_QUERIES:
            yield block
            block, some = [], True
    if block or not some:
        yield block


def nearest(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query by (dist, id), with their rank."""
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parts_of(vectors: DataFrame, part_rows: int) -> DataFrame:
    """vectors (id, vec) with their part. A part has about part_rows vectors, and more where there would be over PARTS of them, so that a query's work stays as it is."""
    n = vectors.count()
    n = max(1, min(PARTS, math.ceil(n / part_rows)), math.ceil(n / MOST_ROWS))
    return vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part"))


def _sample(vectors: DataFrame, bound: int, seed: int) -> np.ndarray:
    rows = vectors.select("vec").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(bound).collect()
    return np.array([r.vec for r in rows], np.float64)


def kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 25) -> np.ndarray:
    """Lloyd's iteration from k-means++ seeds; an empty cell keeps its centroid."""
    rng, k = np.random.default_rng(seed), min(k, len(x))
    centers = [x[rng.integers(len(x))]]
    near = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < k:
        p = near / near.sum() if near.sum() > 0 else None
        centers.append(x[rng.choice(len(x), p=p)])
        near = np.minimum(near, ((x - centers[-1]) ** 2).sum(1))
    c, old = np.array(centers), None
    for i in range(rounds):
        own = _closest(x, c)
        if old is not None and i > 3 and (own != old).sum() < len(x) / 1000 + 1:
            break
        old = own
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Nearest:
    """The k nearest of each query among all rows shown so far, by (dist, id). Memory: CHUNK rows times WIDTH queries, and k rows a query.

    Squared distances are screened by a matrix product, with a margin for its rounding, and computed exactly where they may count.
    """

    CHUNK, WIDTH, PAIRS = 1024, 512, 1 << 14

    def __init__(self, qids: np.ndarray, wanted: np.ndarray, k: int, name: str = "l2") -> None:
        self.qids, self.wanted, self.k, self.name = qids, wanted, k, name
        self.squares = (wanted * wanted).sum(1)
        self.worst = np.full(len(qids), np.inf)
        self.q, self.d, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def show(self, x: np.ndarray, ids: np.ndarray, asked: np.ndarray | None = None) -> None:
        """asked: the places of the queries that these rows are for; all by default."""
        asked = np.arange(len(self.qids)) if asked is None else asked
        if not len(asked) or not self.k:
            return
        for at in range(0, len(x), self.CHUNK):
            self._chunk(x[at : at + self.CHUNK], ids[at : at + self.CHUNK], asked)

    def _chunk(self, x: np.ndarray, ids: np.ndarray, asked: np.ndarray) -> None:
        found = [self._screened(x, asked[at : at + self.WIDTH]) for at in range(0, len(asked), self.WIDTH)]
        q, row, dist = (np.concatenate(part) for part in zip(*found))
        if not len(q):
            return
        q, dist, own = np.concatenate([self.q, q]), np.concatenate([self.d, dist]), np.concatenate([self.ids, ids[row]])
        order = np.lexsort((own, dist, q))
        q, dist, own = q[order], dist[order], own[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.d, self.ids = q[keep], dist[keep], own[keep]
        full = rank == self.k - 1
        self.worst[q[full]] = dist[full]

    def _screened(self, x: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row of x, distance) of the pairs that may count."""
        wanted, limit, screened = self.wanted[asked], self.worst[asked], False
        d = wanted @ x.T
        if self.name in ("ip", "inner_product"):
            d = -d
        elif self.name == "cosine":
            norm = np.linalg.norm(wanted, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
            d = np.where(norm > 0, 1 - d / np.where(norm > 0, norm, 1), 3.4028234663852886e38)
        else:
            screened, squares = True, (x * x).sum(1)
            d *= -2
            d += squares[None]
            d += self.squares[asked][:, None]
            margin = 1e-12 * x.shape[1] * (self.squares[asked] + (squares.max() if len(squares) else 0.0))
            limit = limit + margin
        if len(x) > self.k and np.isinf(limit).any():
            near = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
            limit = np.fmin(limit, near + 2 * margin if screened else near)
        q, row = np.nonzero(~(d > limit[:, None]))
        dist = d[q, row]
        if screened:
            dist = np.concatenate([((x[row[i : i + self.PAIRS]] - wanted[q[i : i + self.PAIRS]]) ** 2).sum(1) for i in range(0, len(q), self.PAIRS)] or [dist])
        return asked[q], row, dist

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"qid": self.qids[self.q], "id": self.ids, "dist": self.d})


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def arrays(block: list[tuple[int, list[float]]]) -> tuple[np.ndarray, np.ndarray]:
    """(qids, vectors) of a block of queries; no queries are a matrix without rows."""
    wanted = np.array([v for _, v in block], np.float64) if block else np.zeros((0, 0))
    return np.array([i for i, _ in block], np.int64), wanted


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (((c * c).sum(1)[None] - 2 * x @ c.T)).argmin(1)


@dataclass
class Ivf:
    """Cells of vectors; search probes the nearest cells of each query."""

    centers: np.ndarray
    cells: DataFrame

    @staticmethod
    def build(vectors: DataFrame, n_cells: int | None = None, seed: int = 42, bound: int = SAMPLE) -> Ivf:
        sample = _sample(vectors, bound, seed)
        centers = kmeans(sample, n_cells or max(1, int(math.sqrt(len(sample)))), seed)

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield f.assign(cell=_closest(np.stack(f.vec).astype(np.float64), centers))

        return Ivf(centers, vectors.select("id", "vec").mapInPandas(assign, "id long, vec array<float>, cell int"))

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(qid, id, dist, rank): the k nearest in the probed cells.

        Queries go to the tasks in bounded blocks, each with its cells; a task keeps k candidates for each, so vectors are never shuffled.
        """
        centers, found = self.centers, None
        for block in query_blocks(queries):

            def run(frames: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
                qids, q = arrays(block)
                if not len(qids):
                    return
                near = np.argsort((centers * centers).sum(1)[None] - 2 * q @ centers.T, axis=1, kind="stable")[:, :probes]
                best = Nearest(qids, q, k)
                for f in frames:
                    if len(f):
                        x, ids, cells = matrix(f.vec), f.id.to_numpy(np.int64), f.cell.to_numpy()
                        for cell in np.unique(cells):
                            best.show(x[cells == cell], ids[cells == cell], np.flatnonzero((near == cell).any(1)))
                yield best.frame()

            part = self.cells.mapInPandas(run, "qid long, id long, dist double")
            found = part if found is None else found.unionByName(part)
        return nearest(found, k)


@dataclass
class Pq:
    """Product quantization: each of m parts of a vector is the number of its nearest of k centroids."""

    books: list[np.ndarray]

    @staticmethod
    def train(vectors: DataFrame, m: int, k: int = 256, seed: int = 42, bound: int = SAMPLE) -> Pq:
        x = _sample(vectors, bound, seed)
        return Pq([kmeans(part, k, seed + i) for i, part in enumerate(np.split(x, m, axis=1))])

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_closest(part, book) for part, book in zip(np.split(x, len(self.books), axis=1), self.books)], 1)

    def encode(self, vectors: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield pd.DataFrame({"id": f.id, "codes": list(self.codes(np.stack(f.vec).astype(np.float64)).astype(np.int16))})

        return vectors.select("id", "vec").mapInPandas(run, "id long, codes array<short>")

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, centroids): squared distances of the queries' parts to all centroids; a smaller book is padded with infinity."""
        out = np.full((len(q), len(self.books), max(map(len, self.books))), np.inf)
        for i, (part, book) in enumerate(zip(np.split(q, len(self.books), axis=1), self.books)):
            out[:, i, : len(book)] = ((book[None] - part[:, None]) ** 2).sum(2)
        return out

    def search_batch(self, encoded: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, rerank: int) -> DataFrame:
        """(qid, id, dist, rank): each query's best ``rerank`` by table distance, then the k nearest of them by exact distance.

        Queries go to the tasks in bounded blocks; a task keeps ``rerank`` candidates for each, so codes are never shuffled.
        """
        books = self.books
        rough = None
        for block in query_blocks(queries):

            def run(frames: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
                qids, q = arrays(block)
                best = Nearest(qids, q, rerank)
                for f in frames:
                    if len(f) and len(qids):
                        codes = np.stack(f.codes)
                        # the sum of a code's table distances is the distance to what it stands for
                        best.show(np.hstack([book[codes[:, i]] for i, book in enumerate(books)]), f.id.to_numpy(np.int64))
                yield best.frame().rename(columns={"dist": "rough"})

            part = encoded.select("id", "codes").mapInPandas(run, "qid long, id long, rough double")
            rough = part if rough is None else rough.unionByName(part)
        w = Window.partitionBy("qid").orderBy("rough", "id")
        near = rough.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rerank).select("qid", "id")
        met = near.join(vectors.select("id", "vec"), "id").join(queries.select("qid", F.col("vec").alias("q")), "qid")
        return nearest(met.select("qid", "id", squared_l2(F.col("vec"), F.col("q")).alias("dist")), k)

    def search(self, encoded: DataFrame, vectors: DataFrame, query: list[float], k: int, rerank: int) -> DataFrame:
        """(id, dist): the best ``rerank`` by table distance, then the k nearest of them by exact distance."""
        tables = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in self.tables(np.asarray([query], np.float64))[0]])
        coded = encoded.crossJoin(F.broadcast(encoded.sparkSession.range(1).select(tables.alias("tables"))))
        rough = F.aggregate(F.transform("codes", lambda c, i: F.get(F.get("tables", i), c.cast("int"))), F.lit(0.0), lambda s, v: s + v)
        best = coded.select("id", rough.alias("rough")).orderBy("rough", "id").limit(rerank)
        q = F.array(*[F.lit(float(v)) for v in query])
        return vectors.join(F.broadcast(best.select("id")), "id").select("id", squared_l2(F.col("vec"), q).alias("dist")).orderBy("dist", "id").limit(k)


def scalar_quantized(vectors: DataFrame) -> DataFrame:
    """(id, codes, lo, hi): each number as one of 256 steps between the smallest and largest of the table."""
    ends = F.broadcast(vectors.agg(F.min(F.array_min("vec")).alias("lo"), F.max(F.array_max("vec")).alias("hi")))  # one row
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return vectors.join(ends).select("id", F.transform("vec", lambda x: F.round((x - F.col("lo")) / span * 255).cast("short")).alias("codes"), "lo", "hi")


def centroid(vectors: DataFrame) -> DataFrame:
    """(pos, mean) of each dimension."""
    return vectors.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def medoid(vectors: DataFrame) -> DataFrame:
    """(id, dist): the vector nearest to the mean."""
    mean = centroid(vectors).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("mean"))
    rows = vectors.join(F.broadcast(mean)).select("id", squared_l2(F.col("vec"), F.col("mean")).alias("dist"))  # one row
    return rows.orderBy("dist", "id").limit(1)


def keep_embeddings(degrees: DataFrame, fraction: float, entry: int) -> DataFrame:
    """The ids whose vectors are kept: the entry point and the ceil(n * fraction) of largest degree."""
    n = math.ceil(degrees.count() * fraction)
    return degrees.orderBy(F.desc("degree"), "id").limit(n).select("id").union(degrees.sparkSession.createDataFrame([(entry,)], "id long")).distinct()


class Hnsw:
    """A small-world graph of one partition's vectors: greedy descent through the levels, beam search at the bottom."""

    def __init__(self, m: int = 16, ef: int = 100, seed: int = 42) -> None:
        self.m, self.ef, self.rng = m, ef, np.random.default_rng(seed)
        self.ids: list[int] = []
        self.x: list[np.ndarray | None] = []  # None: pruned, to be fetched
        self.fetch = None
        self.links: list[list[list[int]]] = []
        self.entry = -1

    def _far(self, q: np.ndarray, i: int) -> float:
        x = self.x[i]
        if x is None:
            x = self.fetched.get(i)
            if x is None:
                x = self.fetched[i] = np.asarray(self.fetch(self.ids[i]), np.float64)
        d = x - q
        return float(d @ d)

    def _beam(self, q: np.ndarray, starts: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        seen, found = set(starts), [(-self._far(q, i), i) for i in starts]
        todo = [(-d, i) for d, i in found]
        heapq.heapify(found)
        heapq.heapify(todo)
        while todo:
            d, i = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            for j in self.links[i][level]:
                if j not in seen:
                    seen.add(j)
                    e = self._far(q, j)
                    if len(found) < ef or e < -found[0][0]:
                        heapq.heappush(todo, (e, j))
                        heapq.heappush(found, (-e, j))
                        if len(found) > ef:
                            heapq.heappop(found)
        return sorted((-d, i) for d, i in found)

    def _choose(self, near: list[tuple[float, int]], m: int) -> list[int]:
        """Those nearer to the new vector than to one chosen before; filled up with the nearest of the rest."""
        out: list[int] = []
        for d, i in near:
            if len(out) < m and all(self._far(self.x[i], j) >= d for j in out):
                out.append(i)
        return out + [i for _, i in near if i not in out][: m - len(out)]

    def add(self, key: int, vec: np.ndarray) -> None:
        level = int(-math.log(1 - self.rng.random()) / math.log(self.m))
        me = len(self.ids)
        self.ids.append(key)
        self.x.append(vec)
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = me
            return
        top, starts = len(self.links[self.entry]) - 1, [self.entry]
        for lev in range(top, -1, -1):
            near = self._beam(vec, starts, self.ef if lev <= level else 1, lev)
            if lev <= level:
                most = 2 * self.m if lev == 0 else self.m
                for j in self._choose(near, self.m):
                    self.links[me][lev].append(j)
                    back = self.links[j][lev]
                    back.append(me)
                    if len(back) > most:
                        back.sort(key=lambda o: self._far(self.x[j], o))
                        del back[most:]
            starts = [i for _, i in near]
        if level > top:
            self.entry = me

    @staticmethod
    def built(ids: np.ndarray, x: np.ndarray, m: int = 16, ef: int = 100, seed: int = 42) -> Hnsw:
        """A graph of the rows of x, added in batches that are never larger than the graph; those of a batch don't see each other."""
        g = Hnsw(m, ef, seed)
        level = (-np.log(1 - g.rng.random(len(x))) / math.log(m)).astype(np.int64)
        rows = [np.full((len(x), 2 * m if lev == 0 else m), -1, np.int32) for lev in range(int(level.max(initial=-1)) + 1)]
        x = x.astype(np.float32)
        for a, b in walks.batches(len(x), len(x), 1):
            own = np.arange(a, b)
            if a:
                distance, starts = walks.exact(x, x[own]), np.full((b - a, 1), g.entry)
                for lev in range(int(level[g.entry]), -1, -1):
                    adds = level[own] >= lev
                    near = np.full((b - a, ef), -1)
                    for some, size in ((np.flatnonzero(~adds), 1), (np.flatnonzero(adds), ef)):
                        if len(some):
                            near[some, :size] = walks.walk(rows[lev], starts[some], lambda row, place, some=some: distance(some[row], place), size)[0]
                    if adds.any():
                        new = own[adds]
                        rows[lev][new, :m] = walks.prune(x, new, near[adds], m, 1.0, fill=True)
                        walks.link_back(x, rows[lev], new, lambda nodes, at, r=rows[lev].shape[1]: walks.nearest_places(x, nodes, at, r))
                    starts = near
            top = a + int(level[a:b].argmax())
            if g.entry < 0 or level[top] > level[g.entry]:
                g.entry = top
        g.ids, g.x = ids.tolist(), list(x.astype(np.float64))
        g.links = [[[j for j in rows[lev][i].tolist() if j >= 0] for lev in range(n + 1)] for i, n in enumerate(level.tolist())]
        return g

    def search_batch(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, squared distances), each a row for each query of q, padded with -1; no vector may be pruned."""
        size = max(ef, k)
        if self.entry < 0:
            return np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        exact = np.array(self.x)
        x, top = exact.astype(np.float32), len(self.links[self.entry]) - 1
        rows = []
        for lev in range(top + 1):
            own = [(i, levels[lev]) for i, levels in enumerate(self.links) if len(levels) > lev]
            table = np.full((len(x), max(1, max(len(v) for _, v in own))), -1, np.int32)
            for i, v in own:
                table[i, : len(v)] = v
            rows.append(table)
        places, dists = [], []
        for a, b in walks.batches(len(q), len(x)):
            distance, starts = walks.exact(x, q[a:b].astype(np.float32)), np.full((b - a, 1), self.entry)
            for lev in range(top, 0, -1):
                starts = walks.walk(rows[lev], starts, distance, 1)[0]
            places.append(walks.walk(rows[0], starts, distance, size)[0])
            dists.append(np.stack([np.where(at >= 0, ((exact[at] - one) ** 2).sum(1), np.inf) for at, one in zip(places[-1], q[a:b])]))
        return np.concatenate(places), np.concatenate(dists)

    def search(self, q: np.ndarray, k: int, ef: int, fetch=None) -> list[tuple[float, int]]:
        """fetch(id) gives a pruned vector; what a query fetches is kept till it ends."""
        self.fetch, self.fetched = fetch, {}
        if self.entry < 0:
            return []
        starts = [self.entry]
        for lev in range(len(self.links[self.entry]) - 1, 0, -1):
            starts = [i for _, i in self._beam(q, starts, 1, lev)]
        return [(d, self.ids[i]) for d, i in self._beam(q, starts, max(ef, k), 0)[:k]]

    def to_csr(self, keep: float = 1.0) -> bytes:
        """Ids, levels, one offset for each list and all targets as places, then the vectors; keep: the share of vectors, by degree, that stays."""
        lists = [own for levels in self.links for own in levels]
        targets = np.array([j for own in lists for j in own], np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(own) for own in lists])]).astype(np.int64)
        degree = np.array([len(levels[0]) for levels in self.links], np.int64)
        kept = np.zeros(len(self.ids), bool)
        kept[np.argsort(-degree, kind="stable")[: math.ceil(keep * len(self.ids))]] = True
        if self.entry >= 0:
            kept[self.entry] = True
        x = np.array([v for v, k in zip(self.x, kept) if k], np.float32).reshape(int(kept.sum()), len(self.x[0]) if self.x else 0)
        head = np.array([len(self.ids), len(offsets), len(targets), x.shape[1] if len(x) else 0, self.entry, self.m], np.int64)
        parts = (head, np.array(self.ids, np.int64), np.array([len(v) for v in self.links], np.int32), offsets, targets, kept.astype(np.uint8), x)
        return b"".join(p.tobytes() for p in parts)

    @staticmethod
    def from_csr(blob: bytes) -> Hnsw:
        n, n_offsets, n_targets, width, entry, m = np.frombuffer(blob, np.int64, 6).tolist()
        at = 48

        def take(kind, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        g = Hnsw(m)
        g.ids, levels, offsets, targets, kept = take(np.int64, n).tolist(), take(np.int32, n).tolist(), take(np.int64, n_offsets).tolist(), take(np.int32, n_targets).tolist(), take(np.uint8, n).tolist()
        x = iter(take(np.float32, sum(kept) * width).reshape(-1, max(width, 1)).astype(np.float64))
        g.x, g.entry, i = [next(x) if k else None for k in kept], entry, 0
        for count in levels:
            g.links.append([targets[offsets[i + j] : offsets[i + j + 1]] for j in range(count)])
            i += count
        return g


class StoredHnsw:
    """Small-world graphs in a folder, one for each part of the vectors, each a compressed-sparse-row blob.

    They are built once; a search reads the blobs where they lie and sends the queries to them in bounded blocks. Equal vectors of a part
    are one node, of the smallest id; ids has those of each node one after another, from first[i] to first[i + 1].
    """

    SCHEMA = "part int, csr binary, ids binary, first binary"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @staticmethod
    def build(vectors: DataFrame, path: str, m: int = 16, ef: int = 100, part_rows: int = PART_ROWS, keep: float = 1.0) -> StoredHnsw:
        def run(f: pd.DataFrame) -> pd.DataFrame:
            x, ids, first = walks.distinct(np.stack(f.vec).astype(np.float32), f.id.to_numpy())
            mixed = np.random.default_rng(len(x)).permutation(len(x))  # distinct rows are sorted, and neighbours shouldn't be added together
            g = Hnsw.built(ids[first[:-1]][mixed], x[mixed], m, ef)
            n = np.diff(first)[mixed]
            own = np.repeat(first[:-1][mixed], n) + np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            return pd.DataFrame({"part": f.part.iloc[:1], "csr": [g.to_csr(keep)], "ids": [ids[own].tobytes()], "first": [np.concatenate([[0], np.cumsum(n)]).astype(np.int64).tobytes()]})

        parts_of(vectors, part_rows).groupBy("part").applyInPandas(run, StoredHnsw.SCHEMA).write.mode("overwrite").parquet(path)
        return StoredHnsw(vectors.sparkSession, path)

    def parts(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def search(self, queries: DataFrame, k: int, ef: int = 128, fetch=None) -> DataFrame:
        """(qid, id, dist, rank). fetch(id): the vector of a pruned node, a function that the tasks can run."""
        found = None
        for block in query_blocks(queries):

            def run(frames: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
                qids, asked = arrays(block)
                for f in frames:
                    for blob, ids, first in zip(f.csr, f.ids, f["first"]):
                        if not len(qids):
                            continue
                        g, ids, first = Hnsw.from_csr(blob), np.frombuffer(ids, np.int64), np.frombuffer(first, np.int64)
                        if any(v is None for v in g.x):  # vectors that are fetched come one by one
                            place = {key: i for i, key in enumerate(g.ids)}
                            met = [g.search(q, k, ef, fetch) for q in asked]
                            at, d = np.full((len(met), k), -1), np.full((len(met), k), np.inf)
                            for i, one in enumerate(met):
                                at[i, : len(one)], d[i, : len(one)] = [place[key] for _, key in one], [dist for dist, _ in one]
                        else:
                            at, d = g.search_batch(asked, k, ef)
                        qid, key, dist = walks.found_rows(qids, at, d, ids, first, k)
                        yield pd.DataFrame({"qid": qid, "id": key, "dist": dist})

            part = self.parts().mapInPandas(run, "qid long, id long, dist double")
            found = part if found is None else found.unionByName(part)
        return nearest(found, k)

    def links(self) -> DataFrame:
        """(part, id, level, neighbors). Equal vectors of a part have the same lists, and of equal neighbors the smallest id stands."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for part, blob, ids, first in zip(f.part, f.csr, f.ids, f["first"]):
                    g, ids, first = Hnsw.from_csr(blob), np.frombuffer(ids, np.int64), np.frombuffer(first, np.int64)
                    for a in range(0, len(g.ids), walks.BATCH):
                        rows = [(part, int(i), level, [g.ids[j] for j in own]) for at in range(a, min(len(g.ids), a + walks.BATCH)) for i in ids[first[at] : first[at + 1]] for level, own in enumerate(g.links[at])]
                        yield pd.DataFrame(rows, columns=["part", "id", "level", "neighbors"])

        return self.parts().mapInPandas(run, "part int, id long, level int, neighbors array<long>")

    def stats(self) -> DataFrame:
        """One row: nodes, edges, bytes as offsets and targets, and as lists of ids with a pointer, a length and a capacity each."""
        rows = self.links().agg(F.countDistinct("part", "id").alias("nodes"), F.sum(F.size("neighbors")).alias("edges"), F.count(F.lit(1)).alias("lists"))
        return rows.select("nodes", "edges", (F.col("edges") * 4 + F.col("lists") * 8 + F.col("nodes") * 12).alias("csr_bytes"), (F.col("edges") * 8 + F.col("lists") * 24 + F.col("nodes") * 8).alias("list_bytes"))
