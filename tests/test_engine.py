import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import chunking, scalars, text, vectors
from millrace.operators import ann, bm25, chunks, conversations, diskann, graph, incremental, memory, recall, search
from millrace.operators.filters import Filter, condition, filter_rows, parse_filters
from millrace.operators.links import Links
from millrace.sources import readers, sinks
from millrace.streaming import pipelines


def value(spark, column, row=None):
    base = spark.createDataFrame([row], list(row)) if row else spark.range(1)
    return base.select(column.alias("v")).first().v


FILTERS = [
    ("eq", "go", True), ("eq", "py", False), ("ne", "py", True), ("ne", "go", False), ("in", ["go", "rust"], True), ("in", "go", False), ("nin", ["rust"], True), ("contains", "g", True), ("startswith", "g", True), ("endswith", "x", False), ("exists", True, True), ("exists", False, False),
]


@pytest.mark.parametrize("op,wanted,expected", FILTERS)
def test_filter_operators(spark, op, wanted, expected):
    rows = spark.createDataFrame([({"lang": "go"},)], "metadata map<string,string>")
    assert bool(filter_rows(rows, [Filter("lang", op, wanted)]).count()) is expected


def test_filter_numbers_and_missing(spark):
    rows = spark.createDataFrame([({"n": "12ab"},), (None,)], "metadata map<string,string>")
    n = lambda *f, **k: filter_rows(rows, list(f), **k).count()
    assert n(Filter("n", "gt", 11)) == 1 and n(Filter("n", "lt", 12)) == 0 and n(Filter("n", "gte", "12")) == 1
    assert n(Filter("x", "ne", 1)) == 0 and n(Filter("x", "nin", ["a"])) == 0 and n(Filter("x", "exists", False)) == 2
    assert n() == 2 and n(Filter("x", "eq", 1), Filter("n", "gt", 1), logic="or") == 1
    assert rows.where(condition([Filter("n", "unknown", 1)], F.col("metadata"))).count() == 0
    assert parse_filters('[{"field": "a", "operator": "eq", "value": 1}, {"field": "b"}, 3]') == [Filter("a", "eq", 1)] and parse_filters("no") == []


def test_bm25_small(spark):
    docs = spark.createDataFrame([(0, "The quick brown fox jumps"), (1, "A lazy dog sleeps"), (2, "brown bears eat fish, foxes and the fox")], "id long, text string")
    q = spark.createDataFrame([(0, "brown fox")], "qid long, text string")
    found = {r.id: r.score for r in bm25.score(bm25.lengths(docs), q).collect()}
    assert set(found) == {0, 2} and found[0] > found[2] > 0
    assert [r.tokens for r in bm25.lengths(docs).where("id = 0").collect()] == [["quick", "brown", "fox", "jumps"]]
    assert bm25.score(bm25.lengths(docs), spark.createDataFrame([(0, "the of")], "qid long, text string")).count() == 0


def clustered(n=600, d=32, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 5, (12, d))
    return (centers[rng.integers(0, 12, n)] + rng.normal(0, 0.5, (n, d))).astype(np.float32)


@pytest.fixture(scope="module")
def vec_table(spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered())], "id long, vec array<float>").repartition(4)


def test_exact_search(spark, vec_table):
    x = clustered()
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "qid long, vec array<float>")
    for name in ("l2", "cosine", "ip"):
        batch = search.knn_batch(vec_table, asked, 7, name)
        for i in range(5):
            one = [r.id for r in search.knn(vec_table, x[i].tolist(), 7, name).collect()]
            assert one == [r.id for r in batch.where(F.col("qid") == i).orderBy("rank").collect()]


def test_approximate_recall(spark, vec_table, tmp_path):
    x = clustered()
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "qid long, vec array<float>")
    exact = search.knn_batch(vec_table, asked, 10)
    mean = lambda found: search.recall(found, exact, 10).agg(F.avg("recall")).first()[0]
    assert mean(ann.Ivf.build(vec_table, 12).search(asked, 10, 4)) >= 0.95
    stored = ann.StoredHnsw.build(vec_table, f"{tmp_path}/hnsw", part_rows=300)
    assert stored.parts().count() > 1 and mean(stored.search(asked, 10)) >= 0.95
    pruned = ann.StoredHnsw.build(vec_table, f"{tmp_path}/pruned", part_rows=300, keep=0.2)
    assert mean(pruned.search(asked, 10, fetch=lambda i: x[i])) >= 0.95
    built = diskann.DiskAnn.build(vec_table, f"{tmp_path}/diskann", diskann.Config(r=16, l_build=40), part_rows=300)
    assert mean(built.search_exact(asked, 10)) >= 0.95 and mean(built.search(asked, 10)) >= 0.9
    fewer = built.remove(vec_table.where("id < 50").select("id"), f"{tmp_path}/fewer")
    assert fewer.search_exact(asked, 10).where("id < 50").count() == 0
    assert mean(fewer.add(vec_table.where("id < 50"), f"{tmp_path}/again").search_exact(asked, 10)) >= 0.95
    pq = ann.Pq.train(vec_table, 8, 32)
    found = [r.id for r in pq.search(pq.encode(vec_table), vec_table, x[0].tolist(), 10, 100).collect()]
    assert len(set(found) & {r.id for r in exact.where("qid = 0").collect()}) >= 8


def test_search_options(spark, vec_table):
    x = clustered()
    asked = spark.createDataFrame([(0, x[0].tolist())], "qid long, vec array<float>")
    passages = vec_table.select("id", (F.col("id") % 2).alias("odd"))
    after = search.search(vec_table, asked, passages, 10, where=F.col("odd") == 1)
    before = search.search(vec_table, asked, passages, 10, where=F.col("odd") == 1, prefilter=True)
    assert after.count() <= 10 and before.count() == 10 and before.where("odd = 0").count() == 0
    with pytest.raises(Exception, match="no passage"):
        search.multi_get(passages, [3, 10**6]).collect()


def test_distances_of_bad_vectors(spark):
    row = spark.createDataFrame([([1.0], [1.0, 2.0], [0.0], [])], "a array<double>, b array<double>, z array<double>, e array<double>")
    got = row.select(vectors.squared_l2(F.col("a"), F.col("b")), vectors.cosine_distance(F.col("a"), F.col("z")), vectors.cosine_similarity(F.col("a"), F.col("z")), vectors.inner_product(F.col("e"), F.col("e"))).first()
    assert list(got) == [vectors.FAR, vectors.FAR, 0.0, vectors.FAR]


def edge_table(spark, *pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")


def node_table(spark, n):
    return spark.createDataFrame([(i, f"n{i}") for i in range(n)], "id long, name string")


def test_pagerank(spark):
    chain = {r.id: r["rank"] for r in graph.pagerank(node_table(spark, 3), edge_table(spark, (0, 1), (1, 2))).collect()}
    assert chain[2] > chain[1] > chain[0] and sum(chain.values()) == pytest.approx(1)
    cycle = [r["rank"] for r in graph.pagerank(node_table(spark, 3), edge_table(spark, (0, 1), (1, 2), (2, 0))).collect()]
    assert cycle == pytest.approx([1 / 3] * 3)


def test_walks(spark):
    e = edge_table(spark, (0, 1), (1, 2), (2, 3), (3, 4), (0, 3))
    assert {(r.id, r.depth) for r in graph.impact(e, 3, 2).collect()} == {(2, 1), (0, 1), (1, 2)}
    path = graph.shortest_path(e, 0, 4, both_ways=False).first()
    assert path.path == [0, 3, 4] and path.steps == 2
    assert graph.shortest_path(e, 4, 0, both_ways=False).count() == 0 and graph.shortest_path(e, 2, 2).first().steps == 0
    nodes, inner = graph.subgraph(e, 2, 1)
    assert {r.id for r in nodes.collect()} == {2, 3} and inner.count() == 1
    ranks = graph.pagerank(node_table(spark, 6), e)
    assert graph.blast_radius(e, 2, ranks, 1).first().nodes == 2 and graph.blast_radius(e, 5, ranks).first().nodes == 0


def test_hnsw_csr():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    g = ann.Hnsw(8)
    for i, v in enumerate(x):
        g.add(1000 + i, v)
    back = ann.Hnsw.from_csr(g.to_csr())
    assert back.ids == g.ids and [[list(a) for a in v] for v in back.links] == g.links
    for q in x[:20]:
        assert [i for _, i in back.search(q, 5, 50)] == [i for _, i in g.search(q, 5, 50)]
    assert ann.Hnsw.from_csr(ann.Hnsw(8).to_csr()).search(x[0], 5, 50) == []


def test_robust_prune():
    x = np.array([[0.0, 0], [1, 0], [2, 0], [0, 3], [0, 0]])
    g = diskann.Vamana(x, 3)
    at = np.array([0, 1, 2, 3, 1])
    assert g.prune(4, at, g.far(x[4], at), 1.0).tolist() == [0]
    assert diskann.Vamana(x[:4], 3).prune(0, np.array([1, 2, 3]), np.array([1.0, 4, 9]), 1.0).tolist() == [1, 3]


def random_graph(seed, n, m):
    rng = np.random.default_rng(seed)
    return sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b})


def test_pagerank_and_blast_by_brute_force(spark):
    """Ends that aren't nodes, nodes without edges, several passes of walks and hub edges apart from the buckets."""
    pairs, n = random_graph(5, 150, 260), 140
    e, nodes = edge_table(spark, *pairs), node_table(spark, n)
    rank, outs = np.full(n, 1 / n), np.bincount([a for a, _ in pairs], minlength=200)
    for _ in range(6):
        given = np.zeros(n)
        for a, b in pairs:
            if a < n and b < n:
                given[b] += rank[a] / outs[a]
        rank = 0.15 / n + 0.85 * (given + rank[outs[:n] == 0].sum() / n)
    ranks = graph.cut_lineage(graph.pagerank(nodes, e, rounds=6))
    assert [r["rank"] for r in ranks.orderBy("id").collect()] == pytest.approx(rank.tolist(), abs=1e-12)
    near = {i: set() for i in range(150)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = []
    for i in range(n):
        seen = {i}
        for _ in range(3):
            seen |= {y for x in seen for y in near[x]}
        want.append(sum(rank[x] for x in seen - {i} if x < n) / rank.sum())
    got = [r.blast for r in graph.blast_shares(e, ranks, 3, sources=64).orderBy("id").collect()]
    assert got == pytest.approx(want, abs=1e-12)
    assert graph.blast_shares(e.limit(0), ranks.limit(0)).count() == 0 and graph.pagerank(nodes.limit(0), e.limit(0)).count() == 0


def test_links_keep_edges_in_place(spark):
    """A round's plan shuffles no edges; hubs are read apart and lose none."""
    e = edge_table(spark, *[(0, i) for i in range(1, 60)], *[(i, i + 1) for i in range(1, 60)], (None, 3), (4, None))
    ranks = graph.cut_lineage(spark.range(61).select("id", F.lit(2).cast("long").alias("outs"), F.lit(0.1).alias("rank")))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Links(e.select("src", "dst"), heavy=10) as links:
            assert links.has_hubs and {r.id for r in links.hubs.collect()} == {0}
            got = sorted((r.src, r.dst) for r in links.meet(ranks).collect())
            assert got == sorted((r.src, r.dst) for r in e.where("src is not null and dst is not null").collect())
        with Links(e.select("src", "dst")) as links:
            plan = graph.pagerank_round(links, ranks, 0.85, 61)._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
            depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
            above = lines[at]
            for line in reversed(lines[:at]):
                if depth(line) < depth(above):
                    above = line
                    if "Join" in line:
                        break
                    assert "Exchange" not in line
            assert "SortMergeJoin" in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_reach_plan_is_bounded(spark):
    e = edge_table(spark, *((i, i + 1) for i in range(12)))
    found = graph.reach(e, spark.createDataFrame([(0,)], "id long"), 10)
    assert found.count() == 11 and found._jdf.queryExecution().executedPlan().toString().count("Scan") <= 2


def test_louvain(spark):
    e = edge_table(spark, (0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)).union(spark.createDataFrame([(2, 3, 0.1)], "src long, dst long, weight double"))
    found = graph.louvain(node_table(spark, 7), e)
    by = {r.id: r.community for r in found.collect()}
    assert by == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6} and graph.improvable(e, found).count() == 0
    assert graph.improvable(e, found.withColumn("community", F.col("id"))).count() > 0


def sequential_modularity(pairs, n):
    """Local moving one node after another, in order of id."""
    near = [[] for _ in range(n)]
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    comm, total, m2 = list(range(n)), [len(x) for x in near], 2 * len(pairs)
    moved = True
    while moved:
        moved = False
        for i in range(n):
            k, own = len(near[i]), comm[i]
            total[own] -= k
            gain = {c: sum(comm[j] == c for j in near[i]) - total[c] * k / m2 for c in {own} | {comm[j] for j in near[i]}}
            best = min(gain, key=lambda c: (-gain[c], c))
            if gain[best] > gain[own] + 1e-9:
                comm[i], moved = best, True
            total[comm[i]] += k
    return sum((comm[a] == comm[b]) for a, b in pairs) / len(pairs) - sum((t / m2) ** 2 for t in total)


def test_louvain_against_sequential_moving(spark):
    rng = np.random.default_rng(11)
    pairs = {(min(a, b), max(a, b)) for g in range(8) for a, b in (rng.integers(0, 25, (110, 2)) + 25 * g).tolist() if a != b}
    pairs |= {(min(a, b), max(a, b)) for a, b in rng.integers(0, 200, (150, 2)).tolist() if a != b}
    e, nodes = edge_table(spark, *sorted(pairs)), node_table(spark, 200)
    found = graph.louvain(nodes, e)
    assert found.count() == 200 and graph.improvable(e, found).count() == 0
    assert graph.modularity(e, found).first().modularity >= sequential_modularity(pairs, 200) - 0.01
    assert found.groupBy("community").agg(F.min("id").alias("m")).where("m <> community").count() == 0
    assert graph.louvain(nodes, e.limit(0)).where("id <> community").count() == 0


def test_communities(spark):
    e = edge_table(spark, (0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)).union(spark.createDataFrame([(2, 3, 0.1)], "src long, dst long, weight double"))
    found = graph.communities(node_table(spark, 6), e)
    by = {r.id: r.community for r in found.collect()}
    assert len({by[0], by[1], by[2]}) == 1 and len({by[3], by[4], by[5]}) == 1 and by[0] != by[3]
    assert graph.modularity(e, found).first().modularity > 0.3
    assert {r.cohesion for r in graph.cohesion(e, found).collect()} == {0.5}
    assert graph.surprising_edges(e, found).first().weight == 0.1


def test_validity(spark):
    v = lambda c, x, d, a: value(spark, scalars.validity(F.lit(c), F.lit(x), F.lit(d), F.lit(a)))
    assert v(0, 0, 0.0, 0) == 0.5 and v(10, 0, 0.0, 0) >= 0.8 and v(0, 10, 0.0, 0) <= 0.2 and v(0, 0, 365.0, 0) < 0.1


@pytest.mark.parametrize("old,new,expected", [("should use Docker here", "should not use Docker", True), ("Enable logging always", "Disable logging", True), ("likes green tea", "likes green coffee", False), ("can use it", "cannot use it", False), ("deprecated library", "recommended library", True), ("I do like coffee", "I don't like coffee", True)])
def test_contradictions(spark, old, new, expected):
    assert value(spark, memory.contradicts(F.lit(old), F.lit(new))) is expected


def test_scalars(spark):
    assert value(spark, scalars.seconds(F.lit("1h30m"))) == 5400 and value(spark, scalars.seconds(F.lit("2w"))) == 1209600 and value(spark, scalars.seconds(F.lit("x"))) is None
    assert value(spark, scalars.to_number(F.lit("12abc"))) == 12 and value(spark, scalars.to_number(F.lit("abc"))) == 0
    assert value(spark, scalars.model_changed(F.lit("A "), F.lit("a"))) is False and value(spark, scalars.model_changed(F.lit("a"), F.lit("b"))) is True
    at = F.to_timestamp(F.lit("2024-01-02"))
    assert str(value(spark, scalars.time_or_ago(F.lit("1d"), at))) == "2024-01-01 00:00:00" and str(value(spark, scalars.time_or_ago(F.lit("2023-05-06"), at))) == "2023-05-06 00:00:00"
    assert value(spark, text.clean_heading(F.lit("Title ## {#a}"))) == "Title" and value(spark, text.numbered_lines(F.lit("a\nb"), 9)) == " 9|a\n10|b"
    assert value(spark, text.overlap_tail(F.lit("a b c"), 2)) == "b c" and value(spark, text.media_type(F.lit("x/Y.MP3"))) == "audio"


def test_text_chunks():
    body = "One two three. Four five six! Seven eight nine?\n\nTen eleven. " + "word " * 30
    made = chunking.split_text(body, 8, 3)
    assert all(body[c.start : c.end] == c.text for c in made) and made[1].text.startswith("Four five six!")
    assert chunking.split_text("", 8, 3) == [] and chunking.split_text("  \n ", 8, 3) == []


def test_sections():
    doc = "---\na: b\n---\n# Top\nintro\n## Sub A ##\ntext\n```\n# not\n```\n### Deep {#x}\nmore\n## Sub B\nUnder\n=====\nend"
    found = [(s.id, s.heading, s.parent) for s in chunking.sections(doc)]
    assert found == [("s0", "Top", None), ("s0.0", "Sub A", "s0"), ("s0.0.0", "Deep", "s0.0"), ("s0.1", "Sub B", "s0"), ("s1", "Under", None)]
    assert chunking.markdown_chunks(doc)[2][1].startswith("# Top > ## Sub A > ### Deep")
    nodes, edges = chunking.document_graph(doc, "a.md")
    assert nodes[0]["title"] == "Top" and {e["type"] for e in edges} == {"HAS_SECTION", "HAS_SUBSECTION"} and len(edges) == 5


def test_code(spark):
    source = "import os\n\ndef first(a):\n    # WHY: because\n    return second(a)\n\nclass Box:\n    def second(self):\n        return len(self)\n"
    found = chunking.code_chunks(source, "python")
    assert [(c.kind, c.name) for c in found] == [("preamble", "preamble"), ("function", "first"), ("class", "Box"), ("function", "second")]
    assert chunking.rationale(source) == [(4, "WHY", "because")]
    files = spark.createDataFrame([("pkg/a.py", "python", source)], "path string, language string, text string")
    symbols = chunks.symbols(files)
    assert {(r.src, r.dst) for r in chunks.call_edges(symbols).collect()} == {("pkg.first", "pkg.second")}


def test_faithfulness_and_tables():
    doc = "# Title\nAlpha costs 42.5 dollars. Beta follows."
    assert chunking.faithfulness(doc, doc) == 100 and chunking.faithfulness(doc, "Gamma is new.") < 50
    assert chunking.parse_tables("| a | b |\n|---|---|\n| 1 | 2 |\n\ntext") == [[["a", "b"], ["1", "2"]]]
    assert chunking.parse_step("Thought: t\nAction: find\nAction Input: x")["action_input"] == "x"


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), data)
    return out.getvalue()


def test_office_readers():
    w = 'xmlns:w="http://w"'
    docx = archive(word__document_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert readers.read_docx(docx, "d").split("\n\n")[1:] == ["## Head", "Body", "| x |\n| --- |"]
    xlsx = archive(xl__workbook_xml='<w><sheets><sheet name="S"/></sheets></w>', xl__sharedStrings_xml="<s><si><t>hi</t></si></s>", xl__worksheets__sheet1_xml='<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></w>')
    assert "## S\n\n| hi |  | 3 |" in readers.read_xlsx(xlsx, "x")
    pptx = archive(ppt__slides__slide10_xml="<p><t>ten</t></p>", ppt__slides__slide2_xml="<p><t>two</t></p>")
    assert readers.read_pptx(pptx, "p").split("\n\n")[1:] == ["## Slide 2", "two", "## Slide 10", "ten"]
    assert readers.read_csv(b"a,b\n1\n1,2,3\n", "c") == "# c\n\n| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |"
    assert readers.read_html("<h1>T</h1><p>a <b>b</b><br>c<ul><li>d</ul>") == "## T\n\na b\n\nc\n\n- d"


def test_directory(spark, tmp_path):
    for name, body in {"a.md": "# A", "b.csv": "x,y\n1,2", ".hidden": "no", "node_modules/m.js": "no", "sub/c.txt": "c", "sub/skip.log": "no", "keep.log": "yes", "bad.docx": "broken", "lib.so": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    found = readers.files(spark, str(tmp_path), ["# comment", "*.log", "!keep.log"])
    texts = {r.path: r.text for r in readers.extracted(found).collect()}
    assert set(texts) == {"a.md", "b.csv", "sub/c.txt", "keep.log", "bad.docx"} and texts["bad.docx"] is None and "| 1 | 2 |" in texts["b.csv"]
    only = spark.createDataFrame([("a.md",)], "path string")
    assert [r.path for r in readers.files(spark, str(tmp_path), only=only).collect()] == ["a.md"]


def test_pack(spark):
    items = readers.pack(spark, {"id": "p"}, ['{"items": [{"slug": "one", "text": "Alpha"}, {"slug": "two", "text": "Beta"}]}', '{"key": "three"}'])
    assert items.count() == 3 and [r.slug for r in readers.pack_search(items, "alpha").collect()] == ["one"]


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "source string, text string")
    numbered = incremental.with_ids(rows, ["source", "text"])
    assert sorted(r.id for r in numbered.collect()) == [0, 1, 2]
    sinks.write_index(numbered, f"{tmp_path}/docs", {"backend": "ivf"})
    assert [(r.name, r.num_passages) for r in sinks.catalog(spark, str(tmp_path)).collect()] == [("docs", 3)]


def test_writers(spark):
    n, e = node_table(spark, 3), edge_table(spark, (0, 1), (1, 2))
    lines = [r.line for r in sinks.graphml(n, e).collect()]
    assert lines[0].startswith("<?xml") and lines[-1] == "</graph></graphml>" and len(lines) == 8
    assert '"size": 12' in sinks.html_graph(n, e, graph.degrees(e)) and sinks.signature("k", b"x").startswith("sha256=")
    assert "## Hubs" in sinks.report(spark.createDataFrame([(0, 3)], "community long, n long"), graph.god_nodes(e, 2), e, 0.5)


def test_upserts(spark):
    nodes = node_table(spark, 3).select("id")
    old = spark.createDataFrame([(0, 1, "calls", 2.0)], "src long, dst long, type string, weight double")
    new = spark.createDataFrame([(0, 1, "calls", None), (1, 2, "calls", None), (1, 9, "calls", 1.0)], "src long, dst long, type string, weight double")
    merged = {(r.src, r.dst): r.weight for r in incremental.merge_edges(old, new, nodes).collect()}
    assert merged == {(0, 1): 2.0, (1, 2): 1.0} and incremental.merge_edges(incremental.merge_edges(old, new, nodes), new, nodes).count() == 2
    kept = incremental.delete_nodes(nodes, old, spark.createDataFrame([(1,)], "id long"))
    assert kept[0].count() == 2 and kept[1].count() == 0


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u" * 60), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert conversations.titles(turns).first().title == "u" * 57 + "..." and conversations.transcripts(turns).first().transcript.count("\n") == 1
    found = spark.createDataFrame([("abc", "One", 1), ("abd", "two", 2)], "id string, title string, updated_at int")
    assert conversations.find(found, "abc").first().id == "abc" and conversations.find(found, "ab").first().id == "abd" and conversations.find(found, "TWO").first().id == "abd"


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/in")


def test_streaming_upsert(spark, tmp_path):
    schema = "source string, text string"
    for batch, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "2")])):
        changes = stream(spark, tmp_path, rows, schema)
        pipelines.upsert_stream(changes, f"{tmp_path}/table", f"{tmp_path}/checkpoint", lambda b: b).awaitTermination()
        got = {(r.source, r.text) for r in spark.read.parquet(f"{tmp_path}/table/v={batch}").collect()}
    assert got == {("a", "2"), ("b", "1")}


def test_streaming_rate_limit(spark, tmp_path):
    from datetime import datetime

    rows = [("k", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 0, 0, 10)]
    changes = stream(spark, tmp_path, rows, "key string, ts timestamp")
    q = pipelines.rate_limited(changes, 0.1, 2.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.allowed for r in spark.table("limited").collect()) == [False, True, True, True]


def test_streaming_windows(spark, tmp_path):
    from datetime import datetime

    rows = [("k", "p", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 6)] + [("k", "p", datetime(2024, 1, 2))]
    changes = stream(spark, tmp_path, rows, "key string, path string, ts timestamp")
    q = pipelines.change_windows(changes).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 2]


def test_unified_recall(spark):
    assert recall.layers(None) == {"blocks", "graph", "vector"} and recall.layers(["graph", "x"]) == {"graph"}
    at = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    facts = recall.ingested_facts(spark.createDataFrame([("pref", "likes tea", ["t"])], "label string, content string, tags array<string>"), at, "p")
    ends, ties = recall.ingested_relations(spark.createDataFrame([("a", "b", "KNOWS", 0.0), ("a", "b", "KNOWS", None)], "src string, dst string, type string, weight double"))
    assert sorted(r.id for r in ends.collect()) == ["a", "b"] and [(r.src, r.weight) for r in ties.collect()] == [("a", 1.0)]
    hits = spark.createDataFrame([("doc.md", "some text", 0.5)], "source string, content string, score double")
    text = recall.render(recall.recall(facts, ties, hits))
    assert text.split("\n") == ["<memory_context>", "<facts>", "- [long] (2024-01-02) likes tea", "</facts>", "<relationships>", "- a -[KNOWS]-> b", "</relationships>", "<relevant_documents>", "--- Document 1 (score: 0.50, source: doc.md) ---", "some text", "</relevant_documents>", "</memory_context>"]
    assert recall.recall(facts, ties, hits, ["vector"]).count() == 1


def test_memory_upkeep(spark):
    at = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    summaries = spark.createDataFrame([("k", "c0", "old")], "key string, conv_id string, text string").withColumn("created_at", F.to_timestamp(F.lit("2023-01-01 00:00:00")))
    more = memory.with_summary(summaries, "c1", "new", at)
    assert sorted(r.key for r in more.collect()) == ["20240102_030405_c1", "k"]
    assert [r.conv_id for r in memory.older_gone(more, at, 30).collect()] == ["c1"]
    blocks = spark.createDataFrame([("1", "long", "b"), ("1", "short", "a"), ("2", "long", "c")], "id string, tier string, content string")
    assert memory.lookup(blocks, "1").first().content == "a" and memory.clear_tier(blocks).count() == 0 and memory.lookup(blocks, "9").count() == 0


def test_event_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "topic string, v string").select("topic", F.struct("v").alias("payload"))
    pipelines.published(rows, f"{tmp_path}/topics")
    out = []
    q = pipelines.subscribed(spark, f"{tmp_path}/topics", "a").writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.payload for r in out] == [{"v": "x"}]


def test_watched_files(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one")
    out = []
    q = pipelines.watched(spark, f"{tmp_path}/in").writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.hash for r in out] == [hashlib.sha256(b"one").hexdigest()]
