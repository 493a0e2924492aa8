"""Vector, hybrid and multi-index search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import cut
from millrace.functions.vectors import cosine_similarity, metric
from millrace.operators.ann import Nearest, arrays, matrix, query_blocks
from millrace.operators.bm25 import top_k
from pyspark.sql.window import Window



def knn(vectors: DataFrame, query: list[float], k: int, name: str = "l2") -> DataFrame:
    """The exact k nearest (id, dist) of one query, ties by id. The plan keeps k rows for each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", metric(name)(F.col("vec"), q).alias("dist")).orderBy("dist", "id").limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, name: str = "l2") -> DataFrame:
    """(qid, id, dist, rank) of each query's exact k nearest.

    The queries are sent to the tasks in blocks of bounded size, one read after another; every task keeps k candidates for each query, so
    no pair of vector and query is ever shuffled. queries: (qid, vec).
    """
    out = None
    for block in query_blocks(queries):
        part = vectors.select("id", "vec").mapInPandas(_nearest(block, k, name), "qid long, id long, dist double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, k, "dist", ascending=True)


def _nearest(block: list[tuple[int, list[float]]], k: int, name: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, wanted = arrays(block)
        best = Nearest(qids, wanted, k, name)
        for f in frames:
            if len(f) and len(qids):
                best.show(matrix(f.vec), f.id.to_numpy(np.int64))
        yield best.frame()

    return run


def similarity(candidates: DataFrame, name: str = "l2") -> DataFrame:
    """score: 1 - dist / the largest distance of the query's candidates, 1 where that is none; -dist for inner products."""
    if name in ("ip", "inner_product"):
        return candidates.withColumn("score", -F.col("dist"))
    far = F.max("dist").over(Window.partitionBy("qid"))
    return candidates.withColumn("score", F.when(far > 0, 1 - F.col("dist") / far).otherwise(1.0))


def fuse(candidates: DataFrame, lexical: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Hybrid scores of vector candidates: alpha * vector + (1 - alpha) * lexical over its largest among the candidates."""
    if alpha >= 1:
        return candidates
    rows = candidates.join(lexical.select("qid", "id", F.col("score").alias("lex")), ["qid", "id"], "left").fillna(0.0, ["lex"])
    most = F.max("lex").over(Window.partitionBy("qid"))
    part = F.when(most > 0, F.col("lex") / most).otherwise(0.0)
    return rows.withColumn("score", alpha * F.col("score") + (1 - alpha) * part).drop("lex")


def search(vectors: DataFrame, queries: DataFrame, passages: DataFrame, k: int, lexical: DataFrame | None = None, alpha: float = 0.7, candidates: int | None = None, name: str = "l2", min_score: float | None = None, where: Column | None = None, prefilter: bool = False) -> DataFrame:
    """Candidates, similarity, fusion, least score, top k, passages, metadata filter. With prefilter, the filter comes first."""
    if prefilter and where is not None:
        vectors = vectors.join(passages.where(where).select("id"), "id", "left_semi")
    found = similarity(knn_batch(vectors, queries, candidates or k, name), name).drop("rank")
    found = fuse(found, lexical, alpha) if lexical is not None else found
    found = found.where(F.col("score") >= min_score) if min_score is not None else found
    best = top_k(found, k).join(passages, "id")
    return best.where(where) if where is not None and not prefilter else best


def merge_indexes(results: dict[str, DataFrame], k: int) -> DataFrame:
    """One ranking of several indexes' (qid, id, score), by raw score."""
    out = None
    for name, rows in results.items():
        rows = rows.select(F.lit(name).alias("index"), "qid", "id", "score")
        out = rows if out is None else out.unionByName(rows)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "index", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(results: DataFrame, second: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Scores again by the cosine of a second model's vectors: second (id, vec), queries (qid, vec)."""
    rows = results.select("qid", "id").join(second.select("id", "vec"), "id").join(queries.select("qid", F.col("vec").alias("q")), "qid")
    return top_k(rows.select("qid", "id", cosine_similarity(F.col("vec"), F.col("q")).alias("score")), k)


def compact(results: DataFrame, index: str, text: str = "text", peek: int = 120) -> DataFrame:
    """ref (index:id), score and the first characters."""
    return results.select(F.concat_ws(":", F.lit(index), F.col("id").cast("string")).alias("ref"), "score", cut(F.col(text), peek, "").alias("peek"))


def resolve(refs: DataFrame, passages: DataFrame) -> DataFrame:
    """The passages that refs of the form index:id name."""
    parsed = refs.select("ref", F.regexp_extract("ref", r"^(.*):(\d+)$", 1).alias("index"), F.regexp_extract("ref", r"^(.*):(\d+)$", 2).try_cast("long").alias("id"))
    return parsed.join(passages, "id")


def lookup(passages: DataFrame, ids: DataFrame) -> DataFrame:
    """The passages of the given ids (id); missing ones have no row."""
    return passages.join(ids.select("id").distinct(), "id", "left_semi")


def multi_get(passages: DataFrame, ids: list[int]) -> DataFrame:
    """Passages in the order of ids. Fails if one is missing."""
    asked = passages.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id long")
    found = F.broadcast(asked).join(passages.withColumn("_there", F.lit(True)), "id", "left")
    checked = found.withColumn("_ok", F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no passage "), F.col("id").cast("string")))).otherwise(F.lit(True)))
    return checked.where("_ok").orderBy("pos").drop("_there", "_ok")


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of the exact top k that was found."""
    a = found.groupBy("qid").agg(F.collect_set("id").alias("a"))
    b = exact.groupBy("qid").agg(F.collect_set("id").alias("b"))
    return b.join(a, "qid", "left").select("qid", (F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0)) / k).alias("recall"))
