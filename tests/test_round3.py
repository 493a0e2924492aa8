"""Ties, recall and bounded plans on larger or repetitive tables: cases that once failed."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from millrace.operators import ann, bm25, graph
from millrace.operators.links import Links


def test_symbol_search_breaks_ties_by_id(spark):
    rows = spark.range(400, 0, -1, 4).select("id", F.concat(F.lit("b.bolt"), (F.col("id") % 2).cast("string")).alias("fqn"), F.lit("bolt").alias("name"))
    got = [r.id for r in graph.symbol_search(rows, "bolt", 30).collect()]
    assert got == list(range(2, 62, 2))


@pytest.mark.parametrize("name", ["l2", "cosine", "ip"])
def test_nearest_in_chunks_is_exact(name):
    """Chunks, ties between copies and far-off vectors give what a sort of all distances gives, in less memory than all pairs."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(1500, 8)).round(2), 3, axis=0)
    x += 1e4 if name == "l2" else 0
    ids, q = rng.permutation(len(x)).astype(np.int64), x[rng.integers(len(x), size=300)] + 0.01
    best = ann.Nearest(np.arange(300), q, 20, name)
    tracemalloc.start()
    for at in range(0, len(x), 2000):
        best.show(x[at : at + 2000], ids[at : at + 2000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 300 * 2 * ann.Nearest.CHUNK * 4
    got = best.frame()
    for i in range(0, 300, 7):
        d = {"l2": ((x - q[i]) ** 2).sum(1), "cosine": 1 - x @ q[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(q[i]), "ip": -(x @ q[i])}[name]
        own = got[got.qid == i]
        if name == "l2":
            order = np.lexsort((ids, d))[:20]
            assert own.id.tolist() == ids[order].tolist() and own.dist.tolist() == d[order].tolist()
        else:
            assert own.dist.to_numpy() == pytest.approx(np.sort(d)[:20], abs=1e-12)


def test_blast_in_wide_rows_with_hubs(spark, monkeypatch):
    """Masks of several words, sources of several blocks, hubs sent apart: the shares are those of brute force."""
    monkeypatch.setattr(graph, "BLOCK", 128)
    monkeypatch.setattr(graph, "HUBS", 3)
    monkeypatch.setattr(graph, "HUB_EDGES", 12)
    n, rng = 300, np.random.default_rng(8)
    a, b = rng.integers(n, size=380), np.where(rng.random(380) < 0.15, rng.integers(4, size=380), rng.integers(n, size=380))
    rank = rng.random(n)
    near = np.eye(n, dtype=bool)
    near[a, b] = near[b, a] = True
    seen = np.linalg.matrix_power(near.astype(np.int64), 3) > 0
    want = (seen @ rank - rank) / rank.sum()
    e = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "src long, dst long")
    ranks = spark.createDataFrame([(i, float(r)) for i, r in enumerate(rank)], "id long, rank double")
    got = [r.blast for r in graph.blast_shares(e, ranks, 3, sources=256).orderBy("id").collect()]
    assert got == pytest.approx(want.tolist(), abs=1e-12)


def test_index_build_shuffles_once(spark, tmp_path, monkeypatch):
    """Postings of repeated ids add up, and a build's plan has one exchange; before, words were shuffled by passage and again by bucket."""
    plans = []
    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())), real(self, path, *a, **k))[1])
    rows = [(1, "red Red blue the x"), (1, "red"), (2, None), (None, "blue blue"), (3, "green red " * 300)]
    index = bm25.Index.build(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "i"), 4)
    plan = next(p for path, p in plans if path.endswith("postings"))
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.id, r.term): r.tf for r in index.postings().collect()}
    assert got == {(1, "red"): 3, (1, "blue"): 1, (None, "blue"): 2, (3, "green"): 300, (3, "red"): 300}


def test_pagerank_round_collects_no_table(spark):
    """Small or large, ranks and sums meet by sorted buckets; only the one row of loose rank is broadcast."""
    e = spark.createDataFrame([(i, i * 7 % 50) for i in range(60)], "src long, dst long")
    ranks = graph.cut_lineage(spark.range(60).select("id", F.lit(1).cast("long").alias("outs"), F.lit(1 / 60).alias("rank")))
    with Links(e) as links:
        plan = graph.pagerank_round(links, ranks, 0.85, 60)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("BroadcastExchange") == 1
