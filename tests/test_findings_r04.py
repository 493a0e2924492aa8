"""Findings of round 4: cases that failed or grew too fast before."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.llm import chaining
from millrace.operators import ann, cover, graph, links, search
from millrace.session import dropped, written


def test_no_queries_have_no_neighbours(spark):
    """without queries the vectors asked for were no matrix, and a task failed when it took its rows' squares."""
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, vec array<float>").repartition(3)
    none = vectors.where("id < 0").select(F.col("id").alias("qid"), "vec")
    for name in ("l2", "cosine", "ip"):
        found = search.knn_batch(vectors, none, 10, name)
        assert found.columns == ["qid", "id", "dist", "rank"] and found.collect() == []
    assert search.similarity(search.knn_batch(vectors, none, 10)).collect() == []
    assert ann.Ivf.build(vectors, 4).search(none, 10, 2).collect() == []
    qids, wanted = ann.arrays([])
    assert qids.shape == (0,) and wanted.ndim == 2 and ann.Nearest(qids, wanted, 10).frame().empty


def test_blast_over_a_cover(spark, monkeypatch):
    """where few nodes are an end of every edge, sums over these equal brute force, in several blocks, with leaves that share their hubs, without
    rank, without edges, and chains of hubs; before, every walk's state was stored for all nodes."""
    monkeypatch.setattr(cover, "SOURCE_ROWS", 37)
    monkeypatch.setattr(cover, "TARGET_ROWS", 50)
    monkeypatch.setattr(cover, "ROWS", 8)
    monkeypatch.setattr(cover, "TILE", 2)
    rng = np.random.default_rng(5)
    hubs, n = 130, 700
    leaf = rng.integers(hubs, n - 30, size=900)
    pairs = [*zip(leaf.tolist(), rng.integers(hubs, size=900).tolist()), *((i, i + 1) for i in range(100, hubs - 1)), *((hubs + i, hubs - 1 - i % 3) for i in range(40)), (3, 3), (n - 1, n - 1)]
    rank = np.where(rng.random(n) < 0.05, 0.0, rng.random(n))
    near = np.eye(n, dtype=bool)
    for a, b in pairs:
        near[a, b] = near[b, a] = True
    e = spark.createDataFrame([(a * 7, b * 7) for a, b in pairs] + [(None, 7), (7, None)], "src long, dst long")
    ranks = spark.createDataFrame([(i * 7, float(r)) for i, r in enumerate(rank) if i % 11], "id long, rank double")
    rank[::11] = 0
    monkeypatch.setattr(graph, "walked", None)
    for depth in (2, 3, 4):
        seen = np.linalg.matrix_power(near.astype(np.int64), depth) > 0
        want = (seen @ rank - rank) / rank.sum()
        got = {r.id // 7: r.blast for r in graph.blast_shares(e, ranks, depth).collect()}
        assert sorted(got) == [i for i in range(n) if i % 11]
        assert [got[i] for i in sorted(got)] == pytest.approx([want[i] for i in sorted(got)], abs=1e-12)


def test_walks_keep_no_old_states(spark, monkeypatch, tmp_path):
    """what a round wrote goes when the next one is written; before, all rounds of all passes stayed until the driver ended."""
    monkeypatch.setattr(graph, "HUBS", 3)
    monkeypatch.setattr(graph, "BLOCK", 64)
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(links, "shared_dir", lambda spark: f"file://{tmp_path}")
    e = spark.createDataFrame([(i, i * 7 % 300) for i in range(300)] + [(i, i % 3) for i in range(300)], "src long, dst long")
    ranks = spark.range(300).select("id", (1.0 / (F.col("id") + 1)).alias("rank"))
    assert graph.blast_shares(e, ranks, 3, sources=64).count() == 300
    assert len(list(tmp_path.iterdir())) == 1
    monkeypatch.setattr(graph, "HUBS", 300)
    assert graph.blast_shares(e, ranks, 3).count() == 300
    assert len(list(tmp_path.iterdir())) == 2
    assert graph.pagerank(spark.range(300), e, rounds=4).count() == 300
    assert len(list(tmp_path.iterdir())) == 3


def test_only_written_tables_are_dropped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/own")
    kept = spark.read.parquet(f"{tmp_path}/own")
    made = written(kept, "x")
    dropped(kept)
    dropped(made)
    assert kept.count() == 3 and not any(p.exists() for p in map(pathlib.Path, (f.removeprefix("file://") for f in made.inputFiles())))


def near_copies(n_groups=6, size=7, words=400, seed=3):
    """Groups of texts that differ in one word of 25, each with a passage of the next group behind it."""
    rng = np.random.default_rng(seed)
    base = [[f"g{g}w{i}" for i in rng.integers(10**6, size=words)] for g in range(n_groups)]
    out = []
    for g in range(n_groups):
        for k in range(size):
            own = [w if rng.random() > 0.04 else f"x{g}y{k}z{i}" for i, w in enumerate(base[g])]
            out.append((g + n_groups * k, " ".join(own + base[(g + 1) % n_groups][50 + k : 120])))
    return [*out, (900, out[5][1]), (None, out[7][1]), (901, None), (902, "")]


def test_words_of_a_document_travel_once_to_a_bucket(spark, monkeypatch):
    """a document's words went out once for each of its chains, so the disk grew with the square of a group of near copies."""
    monkeypatch.setattr(chaining, "MATCH_BYTES", 0)  # one pass
    asked, real = [], chaining.aligned
    monkeypatch.setattr(chaining, "aligned", lambda rows, df: (asked.append(df), real(rows, df))[1])
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string")
    pairs = {(r.doc_id, r.other_id) for r in chaining.shared_passages(docs).collect()}
    assert len(pairs) > 6 * 21
    rows = asked[0].where("words is not null").selectExpr("doc", "length(words) / 4 as words", "length(others) / 8 as chains").collect()
    assert len(rows) == len({r.doc for r in rows}) and all(r.words <= 470 for r in rows)
    assert sum(r.chains for r in rows) >= len(pairs) - 2


def test_passes_find_the_same_passages(spark, monkeypatch):
    """what is asked is bounded by passes, each of which is written and has its shuffle files removed; the rows are those of one pass."""
    monkeypatch.setattr(chaining, "BUCKET_BYTES", 1 << 14)
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string").cache()
    monkeypatch.setattr(chaining, "MATCH_BYTES", 0)
    want = sorted(map(str, chaining.shared_passages(docs).collect()))
    monkeypatch.setattr(chaining, "MATCH_BYTES", 28)
    calls, real = [], chaining.aligned
    monkeypatch.setattr(chaining, "aligned", lambda rows, df: (calls.append(1), real(rows, df))[1])
    assert sorted(map(str, chaining.shared_passages(docs).collect())) == want and len(want) > 100
    assert len(calls) > 2
