"""Incremental maintenance: anti-joins, upserts and keyed merges over plain tables. Ids are stable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalars import text_hash


def uncached(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Rows of texts (text) without a fingerprint (text_hash, model) in the cache."""
    known = cache.where(F.col("model") == model).select("text_hash")
    return texts.withColumn("text_hash", text_hash(F.col("text"))).join(known, "text_hash", "left_anti")


def with_cache(texts: DataFrame, cache: DataFrame, compute) -> DataFrame:
    """vec from the cache where it is there, else from compute (a Column function of the text)."""
    keyed = texts.withColumn("text_hash", text_hash(F.col("text")))
    hit = keyed.join(cache.select("text_hash", F.col("vec").alias("_vec")), "text_hash", "left")
    return hit.withColumn("vec", F.coalesce("_vec", compute(F.col("text")))).drop("_vec")


def memo_stats(memo: DataFrame) -> DataFrame:
    """Counts by model, by source and in all."""
    sets = memo.cube("model", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return sets.where("g in (1, 2, 3)").drop("g")


def orphans(passages: DataFrame, files: DataFrame) -> DataFrame:
    """Sources of passages (source) that no file (path) has."""
    return passages.select("source").distinct().join(files.select(F.col("path").alias("source")), "source", "left_anti")


def reconcile(passages: DataFrame, files: DataFrame) -> DataFrame:
    """passages whose source file is still there."""
    return passages.join(files.select(F.col("path").alias("source")), "source", "left_semi")


def delete_sources(passages: DataFrame, sources: DataFrame) -> DataFrame:
    return passages.join(sources.select("source"), "source", "left_anti")


def upsert_sources(passages: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """passages without those of removed or renewed sources, and the new ones."""
    gone = removed.select("source").union(new.select("source")).distinct()
    return delete_sources(passages, gone).unionByName(new, allowMissingColumns=True)


def with_ids(new: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """new rows with dense ids from start: a range sort by the order columns, then counts of partitions; no task holds all rows."""
    spread = new.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = spread.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    counts = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(F.broadcast(base), "_p").withColumn("id", F.lit(start) + F.col("_base") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_n", "_first", "_base")


def merge_entities(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of each key with the largest version."""
    rows = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """old edges and those new ones whose ends are both nodes, each (src, dst, type) once; a missing weight is 1."""
    ids = nodes.select("id")
    good = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    good = good.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return insert_missing(old, good, ["src", "dst", "type"])


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the given ids and what hangs on them."""
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["src", "dst", "type"], "left_anti")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def model_changed_purge(cache: DataFrame, model: str) -> DataFrame:
    return cache.where(F.col("model") == model)


def changed(tracked: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed, by content hash."""
    both = tracked.select("path", F.col("hash").alias("old")).join(scanned.select("path", F.col("hash").alias("new")), "path", "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.withColumn("change", kind).where("change is not null").select("path", "change")


def memo_record(memo: DataFrame, batch: DataFrame) -> DataFrame:
    """memo (text_hash, model, source, ...) with the batch's fingerprints; those it has are kept."""
    return insert_missing(memo, batch, ["text_hash", "model"])


def memo_without(memo: DataFrame, sources: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """memo without the fingerprints of some sources, or of a model."""
    rows = delete_sources(memo, sources) if sources is not None else memo
    return rows.where(F.col("model") != model) if model else rows


def tasks_left(tasks: DataFrame, now, days: float) -> DataFrame:
    """tasks (status, updated_at) without the finished ones older than ``days``."""
    finished = F.col("status").isin("COMPLETED", "FAILED", "CANCELLED")
    return tasks.where(~(finished & (F.unix_timestamp("updated_at") < F.unix_timestamp(now) - days * 86400)))


def index_of_paths(changes: DataFrame, roots: DataFrame) -> DataFrame:
    """changes (path) with the index whose root (index, root) the path begins with; of several, the longest root. At most 10,000 roots."""
    if roots.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 index roots")
    rows = changes.join(F.broadcast(roots), F.startswith(F.col("path"), F.col("root")))
    return rows.groupBy(*changes.columns).agg(F.max_by("index", F.length("root")).alias("index"))
