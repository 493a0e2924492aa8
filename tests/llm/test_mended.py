"""Repeated and null ids, and texts beside others: cases that once gave wrong results."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam, media, mixing, sharding


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i % 40])
def test_mixture_of_repeated_ids_meets_targets(spark, ids):
    rows = [(ids(i), "a b c d", "a") for i in range(1000)] + [(ids(i), "a b c d" if i % 2 else "x", "b") for i in range(1000)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(rows)
    by = out.assign(taken=out._size * out._copies).groupby("source").agg(target=("_target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 4).all(), by
    assert sorted(mixing.mix(docs).toPandas()._copies) == sorted(out._copies)
    assert mixing.mix(docs).columns == [*docs.columns, "_size", "_source_size", "_target", "_copies"]


def test_media_of_equal_texts_is_equal_beside_others(spark):
    long = "ง" * 700_000  # 2,100,000 bytes
    rows = [(1, "short"), (2, long), (3, long), (None, "é" * 600_000), (5, "é" * 600_000), (6, "short")]
    together = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    alone = [media.store(spark.createDataFrame([r], "doc_id long, text string")).drop("doc_id").collect()[0] for r in rows]
    got = media.store(together).collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert [r[1:] for r in got] == [tuple(r) for r in alone]


def test_items_that_repeat_are_reported_once(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words[:20])), (1, " ".join(words[:30])), (None, " ".join(words[30:45])), (None, " ".join(words[30:50])), (2, " ".join(words[:20]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(5, " ".join(words)), (5, " ".join(words)), (6, "clean")], "doc_id long, text string")
    got = sorted(map(repr, decontam.contaminated(docs, benchmark).select("doc_id", "item_id", "n_tokens").collect()))
    assert got == sorted(f"Row(doc_id=5, item_id={i}, n_tokens={n})" for i, n in [(1, 30), (2, 20), (None, 20)] for _ in range(2))


def test_blocks_keep_an_item_together(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 20)
    rows = [(i // 3, "ab cd ef gh") for i in range(12)] + [(9, "ab " * 10)] * 4
    found = list(decontam.blocks(spark.createDataFrame(rows, "item_id long, text string")))
    assert sum(map(len, found)) == len(rows) and len(found) > 3
    assert all(sum(i in {r[0] for r in b} for b in found) == 1 for i in range(4))


def test_shards_of_equal_rows_fill_no_bucket(spark):
    docs = spark.range(30_000).select(F.when(F.col("id") >= 20_000, F.col("id") % 10_100).alias("doc_id"), F.lit("same").alias("text"))
    counted = sharding.numbered(docs, "nth").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("nth").alias("last"), F.countDistinct("nth").alias("d"))
    assert counted.where("n != d or n != last + 1").count() == 0 and counted.agg(F.sum("n")).first()[0] == 30_000
    rows = sharding.shard_documents(docs).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("d"), F.count("doc_id").alias("known")).collect()
    assert [(r.n, r.last, r.d) for r in rows] == [(3750, 3749, 3750)] * 8
    assert all(1000 < r.known < 1500 for r in rows)
