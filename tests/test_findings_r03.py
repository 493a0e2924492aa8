"""Findings of round 3: cases that failed or grew too fast before."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import chunking
from millrace.llm import chaining
from millrace.operators import ann, chunks, diskann, search, walks
from millrace.sources import readers, slices


def vectors_with_copies(spark, seed=7):
    """600 random vectors and 150 copies of each of 4 of them, in mixed order; 20 queries."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:4], 150, axis=0)])[rng.permutation(1200)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>").repartition(3)
    return table, table.where("id % 60 = 0").select(F.col("id").alias("qid"), "vec"), x


def recall(found, exact):
    return search.recall(found, exact, 10).agg(F.avg("recall")).first()[0]


def test_vamana_finds_copies_in_order(spark, tmp_path):
    """Equal vectors are one node that brings its smallest ids; before, copies pruned each other's links and most were never met."""
    table, asked, x = vectors_with_copies(spark)
    index = diskann.DiskAnn.build(table, f"{tmp_path}/d", diskann.Config(r=8, l_build=32), part_rows=500)
    exact = search.knn_batch(table, asked, 10)
    assert index.parts().count() == 3 and recall(index.search_exact(asked, 10), exact) >= 0.98 and recall(index.search(asked, 10), exact) >= 0.9
    rows = index.graph().collect()
    assert sorted(r.id for r in rows) == list(range(1200)) and all(len(r.neighbors) <= 8 and r.id not in r.neighbors for r in rows)
    assert all(np.array_equal(np.array(r.vec, np.float32), x[r.id]) for r in rows)
    left = index.remove(table.where("id % 3 = 0").select("id"), f"{tmp_path}/e")
    assert left.graph().select("id").collect() and sorted(r.id for r in left.graph().collect()) == [i for i in range(1200) if i % 3]


def test_a_query_walks_a_bounded_number_of_graphs(spark):
    rows = spark.range(700_000).select("id", F.array(F.lit(0.0)).alias("vec"))
    assert ann.parts_of(rows, 10_000).agg(F.countDistinct("part")).first()[0] == ann.PARTS


def test_walks_in_batches_are_walks_one_by_one():
    """What a query finds doesn't depend on the queries beside it, and a walk as long as the graph finds every node in order."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    g = diskann.Vamana(x, 12).build(40, 1.2)
    q = rng.normal(size=(50, 6)).astype(np.float32)
    at, dist = g.walk(50, walks.exact(x, q), 20)
    for i in range(0, 50, 7):
        one, d = g.walk(1, walks.exact(x, q[i : i + 1]), 20)
        assert one[0].tolist() == at[i].tolist() and d[0].tolist() == dist[i].tolist()
    every, d = g.walk(50, walks.exact(x, q), 300)
    want = ((x[None] - q[:, None]) ** 2).sum(2)
    assert (np.sort(every, 1) == np.arange(300)).all() and np.allclose(d, np.sort(want, 1), atol=1e-5)


def test_hnsw_in_batches(spark, tmp_path):
    """Nodes and queries go through the levels in batches; equal vectors are one node that brings its smallest ids."""
    table, asked, _ = vectors_with_copies(spark)
    index = ann.StoredHnsw.build(table, f"{tmp_path}/h", 8, 60, part_rows=500)
    exact = search.knn_batch(table, asked, 10)
    assert index.parts().count() == 3 and recall(index.search(asked, 10), exact) >= 0.98
    rows = index.links().collect()
    assert sorted(r.id for r in rows if r.level == 0) == list(range(1200)) and max(r.level for r in rows) > 0
    part = {r.id: r.part for r in rows}
    assert all(len(r.neighbors) <= (16 if r.level == 0 else 8) and r.id not in r.neighbors and all(part[i] == r.part for i in r.neighbors) for r in rows)
    g = ann.Hnsw.built(np.arange(5), np.eye(5), 4, 20)
    at, dist = g.search_batch(np.eye(5), 3, 20)
    assert at[:, 0].tolist() == g.ids == list(range(5)) and np.allclose(np.sort(dist, 1)[:, :3], [0, 2, 2])
    assert ann.Hnsw.built(np.zeros(0, np.int64), np.zeros((0, 3))).search_batch(np.eye(3), 2, 5)[0].shape == (3, 0)


def test_slices_bound_rows_and_bytes():
    small, wide = pa.record_batch({"t": ["x"] * 10_000}), pa.record_batch({"t": ["x" * 3_000_000] * 5})
    assert [b.num_rows for b in slices.slices(iter([small]))] == [256] * 39 + [16]
    assert [b.num_rows for b in slices.slices(iter([wide]))] == [1] * 5
    assert list(slices.slices(iter([small.slice(0, 0)]))) == []


def test_chunks_in_slices(spark):
    """Other columns, nulls and blank pages come through; each page's chunks are those of the plain function."""
    html = "<h1>A</h1><p>one two</p><h2>B</h2><p>three</p>"
    rows = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else html.replace("one", f"w{i} " * (i % 900)), {"k": str(i)}) for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, html string, m map<string,string>").coalesce(1)
    made = readers.html_pages(pages)
    assert made.columns == ["page_id", "html", "m", "markdown"] and readers.html_pages(made).columns == made.columns
    got = {}
    for r in chunks.markdown_chunks(made, "markdown").collect():
        assert r.m == {"k": str(r.page_id)}
        got.setdefault(r.page_id, []).append((r.chunk_index, r.total_chunks, r.chunk.section, r.chunk.text))
    for i, h, _ in rows:
        want = chunking.markdown_chunks(readers.read_html(h))
        assert got.get(i, []) == [(n, len(want), a, b) for n, (a, b) in enumerate(want)]


def test_nearest_holds_few_pairs_at_a_time():
    """4,096 queries with 50 neighbours: before, one step held 131,072 pairs of vectors and all queries' distances, 209 MB."""
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(2048, 64)), rng.normal(size=(4096, 64))
    best = ann.Nearest(np.arange(4096), q, 50)
    tracemalloc.start()
    best.show(x, np.arange(2048))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    want = np.sort(((x - q[5]) ** 2).sum(1))[:50]
    assert np.array_equal(best.frame().query("qid == 5").dist.to_numpy(), want)


def test_passages_of_two_frequent_lines(spark):
    """Both lines of a passage lie in 40 other documents, and its middle word differs: before, its seeds met only the first document and the one before."""
    rng = np.random.default_rng(21)
    pick = lambda n: [f"w{i}" for i in rng.integers(0, 50_000, n)]
    rows, wanted = [], set()
    for g in range(12):
        one, two = pick(20), pick(20)
        rows += [(200 * g + k, pick(30) + (one, two)[k % 2] + pick(30)) for k in range(80) if k not in (20, 50)]
        rows += [(200 * g + k, pick(30) + one + pick(1) + two + pick(30)) for k in (20, 50)]
        wanted.add((200 * g + 50, 200 * g + 20))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(8)
    assert wanted == {(r.doc_id, r.other_id) for r in chaining.shared_passages(docs).collect()}


def test_weak_chains_are_cut(spark):
    """Two passages joined by words that differ are reported one by one; before, the chain over both failed as a whole."""
    rng = np.random.default_rng(22)
    pick = lambda n: [f"w{i}" for i in rng.integers(0, 50_000, n)]
    one, two = pick(60), pick(60)
    texts = [(1, one + pick(50) + two), (2, one + pick(50) + two)]
    rows = chaining.shared_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")).collect()
    assert sorted((r.start, r.end, r.n_equal) for r in rows) == [(0, 60, 60), (110, 170, 60)]


def test_marks_travel_once(spark):
    """Two marks near each other take few bytes, as those of one mark share its place and hash; before, each two took 18."""
    rng = np.random.default_rng(23)
    pick = lambda n: [f"w{i}" for i in rng.integers(0, 50_000, n)]
    line = pick(120)
    rows = spark.createDataFrame([(i, " ".join(pick(30) + line + pick(30)), 0) for i in range(40)], "doc_id long, text string, q int")
    found = chaining.matches(chaining.pack_seeds(rows, chaining.whole_copies(rows).select(F.col("q").alias("q"), "copy", "digest"), 1), 1)
    packed = chaining.pack_marks(found.where("keys is not null").select("q", "ids", "at", "keys"), 2)
    size = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in packed.dtypes if kind == "binary")
    got = packed.agg(F.sum(F.octet_length("far")).alias("n"), F.sum(size).alias("size")).first()
    assert got.n > 40 * 200 and got.size < 7 * got.n


def test_marks_of_several_texts_at_once():
    """Texts that are searched together have the marks that each has alone, wherever they lie."""
    rng = np.random.default_rng(24)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60, n)).encode() for n in (0, 3, 4, 5, 9, 39, 40, 41, 300)] + [b" \t", b"same " * 200, b"SAME\n" * 200]
    text, key, at = chaining.marks_of(texts)
    each = [sorted(zip(key[text == k].tolist(), at[text == k].tolist())) for k in range(len(texts))]
    for raw, got in zip(texts, each):
        _, key, at = chaining.marks_of([raw])
        assert sorted(zip(key.tolist(), at.tolist())) == got
    assert each[-1] == each[-2] != [] and [len(x) > 0 for x in each[:4]] == [False, False, False, True]
    long = b"ab cd " * (chaining.STEP // 3)
    assert len(chaining.word_hashes(long)) == len(long.split()) and len(set(chaining.word_hashes(long).tolist())) == 2
