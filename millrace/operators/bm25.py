"""Okapi BM25 over postings. All statistics are aggregates with partial sums; only query terms are joined."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import is_term, term_rows, tokens
from millrace.session import written
from millrace.sources.slices import slices


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75


def lengths(passages: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, tokens, len) of each passage."""
    return passages.select(F.col(key).alias("id"), tokens(F.col(text)).alias("tokens")).withColumn("len", F.size("tokens"))


def postings(tokenized: DataFrame) -> DataFrame:
    """(term, id, tf, len)."""
    return tokenized.select("id", "len", F.explode("tokens").alias("term")).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))


def counted_terms(passages: DataFrame) -> DataFrame:
    """(id, term, tf) of each passage's words, stop words and short ones among them."""
    key = dict(passages.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words become Python strings one slice at a time; a whole batch of them takes hundreds of MB
        for b in slices(batches):
            own = [Counter(words) for words in b.column("words").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(own)), [len(c) for c in own]))
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array([w for c in own for w in c], pa.string()), pa.array([n for c in own for n in c.values()], pa.int32())], ["id", "term", "tf"])

    return passages.select("id", term_rows(F.col("text")).alias("words")).mapInArrow(run, f"id {key}, term string, tf int")


def statistics(tokenized: DataFrame) -> DataFrame:
    """One row: n passages and their mean length."""
    return tokenized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))


def score(tokenized: DataFrame, queries: DataFrame, params: Bm25 = Bm25()) -> DataFrame:
    """(qid, id, score) of all passages with a query term; each occurrence of a term in a query counts.

    queries: (qid, text). Postings are made for the queries' terms only, so the shuffle carries matches and not the corpus. This
    reads all passages for each call; ``Index`` keeps postings in a table instead.
    """
    asked = asked_terms(queries)
    found = tokenized.select("id", "len", F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    return weighed(found, asked, statistics(tokenized), params)


def asked_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, times)."""
    return queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def weighed(found: DataFrame, asked: DataFrame, stats: DataFrame, params: Bm25, few: bool = False) -> DataFrame:
    """(qid, id, score) from all postings (term, id, len, tf) of the asked terms and one row (n, avgdl).

    few: the asked terms are few, so their frequencies are broadcast, and the postings of a frequent term don't fill one task.
    """
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = found.join(F.broadcast(df) if few else df, "term").join(asked, "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (params.k1 + 1) / (F.col("tf") + params.k1 * (1 - params.b + params.b * F.col("len") / F.col("avgdl")))
    return rows.groupBy("qid", "id").agg(F.sum(part * F.col("times")).alias("score")).where("score > 0")


class Index:
    """Postings in a folder: (term, id, tf) by bucket of the term and sorted in it, and (id, len) of the passages.

    A search reads the buckets of its terms, and in them the row groups whose range of terms fits; passages aren't read. Appending
    writes further files. A bucket's postings lie in several files by passage. Document frequencies come from the postings that are read, so they need no upkeep.
    """

    #: Terms of one search up to which they are sent to the tasks to prune buckets; more are joined by shuffle.
    MAX_TERMS = 100_000

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._buckets = spark, path, 0

    @staticmethod
    def build(passages: DataFrame, path: str, buckets: int = 16) -> Index:
        """An index of passages (id, text); buckets: about one for each GB of postings on a cluster."""
        index = Index(passages.sparkSession, path)
        passages.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/meta")
        index._write(passages, "overwrite", buckets)
        return index

    def _write(self, passages: DataFrame, mode: str, buckets: int) -> None:
        # one shuffle: terms are counted where their passage is read, and meet the rows of the same id in their part
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        salts = max(1, math.ceil(2 * tasks / buckets))
        counted = counted_terms(passages).where(is_term(F.col("term")))
        part = F.pmod(F.xxhash64("term"), F.lit(buckets)) * salts + F.pmod(F.xxhash64("id"), F.lit(salts))
        spread = counted.withColumn("part", part.cast("int")).repartition(tasks, "part").groupBy("part", "id", "term").agg(F.sum("tf").cast("int").alias("tf"))
        spread = spread.select("id", "term", "tf", F.floor(F.col("part") / salts).cast("int").alias("bucket")).sortWithinPartitions("bucket", "term", "id")
        spread.write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/postings")
        passages.select("id", F.size(tokens(F.col("text"))).alias("len")).write.mode(mode).parquet(f"{self.path}/lengths")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("id long, term string, tf int, bucket int").parquet(f"{self.path}/postings")

    def lengths(self) -> DataFrame:
        return self.spark.read.schema("id long, len int").parquet(f"{self.path}/lengths")

    def buckets(self) -> int:
        self._buckets = self._buckets or self.spark.read.parquet(f"{self.path}/meta").first().buckets
        return self._buckets

    def append(self, passages: DataFrame) -> None:
        """Add the passages whose id the index doesn't have yet."""
        new = written(passages.join(self.lengths().select("id"), "id", "left_anti").dropDuplicates(["id"]), "bm25-new")
        self._write(new, "append", self.buckets())

    def statistics(self) -> DataFrame:
        return statistics(self.lengths())

    def score(self, queries: DataFrame, params: Bm25 = Bm25()) -> DataFrame:
        """(qid, id, score), as ``score`` gives."""
        asked = asked_terms(queries)
        wanted = asked.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets())).cast("int"))
        few = wanted.limit(self.MAX_TERMS + 1).count() <= self.MAX_TERMS
        found = self.postings().join(F.broadcast(wanted) if few else wanted, ["bucket", "term"]).join(self.lengths(), "id").select("term", "id", "len", "tf")
        return weighed(found, asked, self.statistics(), params, few)


def top_k(scores: DataFrame, k: int, order: str = "score", ascending: bool = False) -> DataFrame:
    """The best k of each query, ties by id, with their rank."""
    w = Window.partitionBy("qid").orderBy(F.col(order).asc() if ascending else F.col(order).desc(), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def score_ids(tokenized: DataFrame, query: DataFrame, ids: DataFrame, params: Bm25 = Bm25()) -> DataFrame:
    """Scores of given (id); 0 for passages without a query term."""
    return scores_of(score(tokenized, query, params), ids)


def scores_of(scores: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(scores.select("id", "score"), "id", "left").fillna(0.0, ["score"])


def normalized(scores: DataFrame) -> DataFrame:
    """score over the largest of its query."""
    return scores.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("qid")))
