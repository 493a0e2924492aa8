"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative for each group.

Equal vectors of a label are one vector with a weight. Labels of more than CELL_ROWS distinct vectors are cut into cells by
spherical k-means, fitted on at most SAMPLE vectors that a hash chooses; all vectors are assigned. A vector goes to its home
cell and, as a guest, to each cell of a smaller number whose border (the plane half way between both centroids) it lies near
enough to: two unit vectors with a cosine of c differ by sqrt(2 - 2c) at most, so a partner beyond the border can't be
farther from it than that. Two partners thus meet in the home cell of one of them, and no link is lost.

A cell's residents and its guests are cut into blocks of about BLOCK vectors by hash, however many they are. A block of residents
is compared with the other blocks, a pair of blocks a task: one matrix product in double precision. It gives one row for
each linked vector: the weight of its partners, and the least vector that it reaches there. Pairs of vectors are
never listed. The work grows with the square of a cell's distinct vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .jaccard import components

LEAST_COSINE = 0.98
#: Distinct vectors of a label from which it is cut, and about as many for a cell; vectors of a block.
CELL_ROWS, BLOCK = 1024, 512
#: Vectors that the cells are fitted on, and labels that can be cut (the largest). At least SAMPLE_CELL sampled vectors for a cell.
SAMPLE, CUT_LABELS, SAMPLE_CELL = 20_000, 2_000, 8
ROUNDS = 8
#: Up to this many cells, their sizes are broadcast; beyond it, the join shuffles.
MAX_BROADCAST_CELLS = 100_000
NO_ID = 2**63 - 1


def raw_vectors(embeddings: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, label, v, digest): the bytes of each vector as it is stored (4 or 8 a component); v is null for vectors that can't link.

    And numpy's name of a component's type.
    """
    kinds = dict(embeddings.dtypes)
    kind = "float" if kinds["embedding"] == "array<float>" else "double"
    c = F.col("embedding")
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(c, lambda x: x != 0)
    rows = embeddings.select("vec_id", "label", F.when(good, c).cast(f"array<{kind}>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if v is None else v.tobytes() for v in b.column(2).to_pandas()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "v"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary").withColumn("digest", F.md5("v")), "<f4" if kind == "float" else "<f8"


def units(v: bytes, n: int, dtype: str) -> np.ndarray:
    """n vectors of equal length from their bytes, scaled to length 1 in double precision."""
    x = np.frombuffer(v, dtype).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, least_cosine: float, seed: int = 5) -> np.ndarray:
    """At most k unit centroids of the unit vectors x. Centroids nearer than two links to an earlier one are left out, so that no
    border runs through a tight group."""
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    near = x @ c[0]
    while len(c) < k:
        odds = np.maximum(1 - near, 0) ** 2
        if odds.sum() < 1e-12:
            break
        c = np.vstack([c, x[int(rng.choice(len(x), p=odds / odds.sum()))]])
        near = np.maximum(near, x @ c[-1])
    for _ in range(ROUNDS):
        of = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    apart = 2 * math.sqrt(2 - 2 * least_cosine)
    kept: list[int] = []
    for i in range(len(c)):
        if all(np.linalg.norm(c[i] - c[j]) >= apart for j in kept):
            kept.append(i)
    return c[kept]


def fit_cells(distinct: DataFrame, least_cosine: float, dtype: str) -> dict:
    """{label: centroids} of the labels that are cut: at most SAMPLE / SAMPLE_CELL centroids together."""
    sizes = distinct.groupBy("label", F.octet_length("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    big = {(r.label, r["size"]): r.n for r in sizes.where(F.col("n") > CELL_ROWS).orderBy(F.desc("n"), "label", "size").limit(CUT_LABELS).collect()}
    if not big:
        return {}
    spark = distinct.sparkSession
    wanted = spark.createDataFrame([(label, size) for label, size in big], f"label {dict(distinct.dtypes)['label']}, size int")
    sample = distinct.withColumn("size", F.octet_length("v")).join(F.broadcast(wanted), ["label", "size"]).orderBy("digest").limit(SAMPLE).select("label", "size", "v").collect()
    by: dict = {}
    for r in sample:
        by.setdefault((r.label, r["size"]), []).append(r.v)
    cells = {}
    for key, own in by.items():
        k = min(math.ceil(big[key] / CELL_ROWS), len(own) // SAMPLE_CELL)
        if k > 1:
            cells[key] = spherical_kmeans(units(b"".join(own), len(own), dtype), k, least_cosine)
    return cells


def to_cells(distinct: DataFrame, cells: dict, least_cosine: float, dtype: str) -> DataFrame:
    """(label, size, cell, home, rid, weight, v): each vector in its home cell and, as a guest, in those of smaller number whose border is near."""
    reach = math.sqrt(2 - 2 * least_cosine)
    between = {key: np.linalg.norm(c[:, None] - c[None], axis=2) * reach + 1e-9 for key, c in cells.items()}
    kind = dict(distinct.dtypes)["label"]
    schema = f"label {kind}, size int, cell int, home boolean, rid long, weight long, v binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict = {}
            v = b.column(3).to_pylist()
            for i, label in enumerate(b.column(0).to_pylist()):
                by.setdefault((label, len(v[i])), []).append(i)
            at, cell, home = [], [], []
            for key, own in by.items():
                own = np.array(own)
                if key not in cells:
                    at.append(own)
                    cell.append(np.zeros(len(own), np.int32))
                    home.append(np.ones(len(own), bool))
                    continue
                s = units(b"".join(v[i] for i in own), len(own), dtype) @ cells[key].T
                best = s.argmax(1)
                there = s[np.arange(len(own)), best][:, None] - s <= between[key][best]
                there &= np.arange(s.shape[1]) <= best[:, None]
                i, j = np.nonzero(there)
                at.append(own[i])
                cell.append(j.astype(np.int32))
                home.append(best[i] == j)
            if at:
                at = pa.array(np.concatenate(at))
                columns = [b.column(0).take(at), pa.array([len(v[i]) for i in at.to_pylist()], pa.int32()), pa.array(np.concatenate(cell)), pa.array(np.concatenate(home)), b.column(1).take(at), b.column(2).take(at), b.column(3).take(at)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return written(distinct.select("label", "rid", "weight", "v").mapInArrow(run, schema), "near-cells")


def in_blocks(placed: DataFrame) -> DataFrame:
    """(label, size, cell, block, residents, blocks, rids, weights, v): each cell's vectors, packed by block; blocks of residents come first."""
    key = ["label", "size", "cell"]
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    counts = placed.groupBy(key).agg(blocks(F.count_if("home")).alias("residents"), blocks(F.count_if(~F.col("home"))).alias("guests")).where("residents > 0")
    counts = written(counts, "near-counts")
    sizes = F.broadcast(counts) if counts.count() <= MAX_BROADCAST_CELLS else counts
    h = F.xxhash64("rid")
    block = F.when(F.col("home"), F.pmod(h, "residents")).otherwise(F.col("residents") + F.pmod(h, F.greatest("guests", F.lit(1))))
    dealt = placed.join(sizes, key).withColumns({"block": block.cast("int"), "blocks": F.col("residents") + F.col("guests")})
    schema = f"label {dict(placed.dtypes)['label']}, size int, cell int, block int, residents int, blocks int, rids binary, weights binary, v binary"

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rid")
        first = f.iloc[0]
        return pd.DataFrame([(first.label, first["size"], first.cell, first.block, first.residents, first.blocks, f.rid.to_numpy(np.int64).tobytes(), f.weight.to_numpy(np.int64).tobytes(), b"".join(f.v))], columns=[x.split()[0] for x in schema.split(", ")])

    return written(dealt.groupBy(*key, "block").applyInPandas(pack, schema), "near-blocks")


def joined_parts(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each row and column of a link matrix: numbers that agree if a path of links joins them. -1: no link."""
    rows, columns = linked.any(1), linked.any(0)
    none = len(linked)
    a, b = np.where(rows, np.arange(none), none), np.full(linked.shape[1], none)
    while True:
        b = np.where(linked, a[:, None], none).min(0, initial=none)
        new = np.where(rows, np.where(linked, b[None, :], none).min(1, initial=none), none)
        if (new == a).all():
            return np.where(rows, a, -1), np.where(columns, b, -1)
        a = new


def compare(blocks: DataFrame, least_cosine: float, dtype: str) -> DataFrame:
    """(rid, links, to): for each pair of blocks and linked vector the weight of its partners, and a vector it reaches."""
    key = ["label", "size", "cell"]
    left = blocks.where("block < residents").withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1))).withColumnRenamed("block", "one")
    right = blocks.withColumn("one", F.explode(F.sequence(F.lit(0), F.least("block", F.col("residents") - 1)))).withColumnRenamed("block", "other")

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):  # a block that is empty by the hash
            return pd.DataFrame({"rid": [], "links": [], "to": []})
        one, two = l.iloc[0], r.iloc[0]
        (ids, w), (ids2, w2) = ((np.frombuffer(p.rids, np.int64), np.frombuffer(p.weights, np.int64)) for p in (one, two))
        same = one.one == one.other
        linked = units(one.v, len(ids), dtype) @ units(two.v, len(ids2), dtype).T >= least_cosine
        if same:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return pd.DataFrame({"rid": [], "links": [], "to": []})
        a, b = joined_parts(linked)
        least = np.full(len(ids), NO_ID)
        np.minimum.at(least, a[a >= 0], ids[a >= 0])
        np.minimum.at(least, b[b >= 0], ids2[b >= 0])
        out = [(ids, linked @ w2, a)] + ([] if same else [(ids2, w @ linked, b)])
        return pd.concat(pd.DataFrame({"rid": i[p >= 0], "links": n[p >= 0], "to": least[p[p >= 0]]}) for i, n, p in out)

    return written(left.groupBy(*key, "one", "other").cogroup(right.groupBy(*key, "one", "other")).applyInPandas(run, "rid long, links long, to long"), "near-links")


def near_vectors(embeddings: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of embeddings (vec_id, embedding, label, ...).

    Only vectors of one label and one length are compared. A null label, and a vector that is null, empty, zero or has null, NaN or
    infinite components, links with nothing. Rows that repeat a vec_id are vectors of their own: they count each other if
    linked, and share an id as class id. A null vec_id counts as larger than all others; a class of such rows only has a null
    component_id, and all its rows are kept. Other columns are ignored. An empty table gives no rows.
    """
    raw, dtype = raw_vectors(embeddings)
    rows = written(raw, "near-rows")
    one = rows.where("v is not null and label is not null").groupBy("label", "digest", "v").agg(F.count(F.lit(1)).alias("weight"), F.min(F.coalesce("vec_id", F.lit(NO_ID))).alias("least"))
    distinct = written(one.withColumn("rid", F.monotonically_increasing_id()), "near-distinct")
    cells = fit_cells(distinct, least_cosine, dtype)
    found = compare(in_blocks(to_cells(distinct, cells, least_cosine, dtype)), least_cosine, dtype)
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    parts = written(components(found.where("rid <> to").select(F.col("rid").alias("a"), F.col("to").alias("b")).distinct()).withColumnRenamed("rep", "rid"), "near-parts")
    named = distinct.select("rid", "label", "digest", "weight", "least")
    ids = parts.join(named.select("rid", "least"), "rid").groupBy("comp").agg(F.min("least").alias("id"))
    known = named.join(links, "rid", "left").join(parts.join(ids, "comp").select("rid", "id"), "rid", "left")
    known = known.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("id", "least").alias("id"))
    out = rows.select("vec_id", "label", "digest").join(known, ["label", "digest"], "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).when(F.col("id") != NO_ID, F.col("id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def keep_one_vector(embeddings: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """embeddings' rows whose vec_id represents its group: rows that repeat a kept id all stay, and so do rows with a null id that is kept."""
    kept = near_vectors(embeddings, least_cosine).where("kept").select(F.col("vec_id").alias("_kept")).distinct()
    return embeddings.join(kept, F.col("vec_id").eqNullSafe(F.col("_kept")), "left_semi")


def op12_near_vectors_spherical(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_OP12 = """
WITH RECURSIVE u AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.98
), reached AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM reached r JOIN l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS c FROM reached GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id, least(e.vec_id, coalesce(c.c, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
"""
