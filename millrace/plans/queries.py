"""Registered queries over the standard tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import scalars, text, vectors
from millrace.operators import bm25, conversations, filters, graph, incremental, memory, search
from millrace.operators.filters import Filter
from millrace.session import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"
STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of (spark, table) under its name; table(name) reads one."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(column) -> F.Column:
    return F.round(column, 6)


# --- shared inputs ---------------------------------------------------------------------------------------------------

META = "map('lang', lang, 'source', source, 'n_chars', cast(n_chars as string))"


def passages(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), "text", F.expr(META).alias("metadata"))


def vecs(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def edges(t) -> DataFrame:
    return t("orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1500 + 1).alias("dst"))


def weighted(t) -> DataFrame:
    return edges(t).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def nodes(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))


def labels(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("community"))


def blocks(t) -> DataFrame:
    e, ts = t("events"), F.col("ts").cast("timestamp")
    tier = F.element_at(F.array(F.lit("short"), F.lit("medium"), F.lit("long")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), tier.alias("tier"), F.col("event_type").alias("label"), F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "should use").otherwise("should not use"), "event_type").alias("content"),
        F.array(F.concat(F.lit("Tag"), (F.col("event_id") % 3).cast("string")), "event_type").alias("tags"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string"))).alias("scope"),
        ts.alias("created_at"), ts.alias("updated_at"), F.when(F.col("event_id") % 5 == 0, F.timestamp_seconds(F.unix_timestamp(ts) + 864000)).alias("expires_at"), F.lit(None).cast("timestamp").alias("last_accessed_at"),
        (F.col("event_id") % 7).cast("int").alias("confirms"), (F.col("event_id") % 5).cast("int").alias("conflicts"), (F.col("event_id") % 11).cast("int").alias("accesses"),
    )


def now():
    return F.to_timestamp(F.lit(NOW))


C_BLOCKS = f"""b AS (SELECT event_id AS id, ['short','medium','long'][user_id % 3 + 1] AS tier, event_type AS label,
 'user ' || user_id || ' ' || (CASE WHEN event_id % 2 = 0 THEN 'should use' ELSE 'should not use' END) || ' ' || event_type AS content,
 ['Tag' || (event_id % 3), event_type] AS tags, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'p' || (event_id % 4) END AS scope, ts,
 floor(epoch(ts)) AS sec, CASE WHEN event_id % 5 = 0 THEN floor(epoch(ts)) + 864000 END AS exp, event_id % 7 AS confirms, event_id % 5 AS conflicts, event_id % 11 AS accesses,
 epoch(TIMESTAMP '{NOW}') AS now FROM events)"""
C_EDGES = "e AS (SELECT o_custkey AS src, o_orderkey % 1500 + 1 AS dst FROM orders), d AS (SELECT DISTINCT src, dst FROM e), w AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM e GROUP BY ALL)"
C_UNDIR = C_EDGES + ", u AS (SELECT a, b, sum(weight) AS weight FROM (SELECT src AS a, dst AS b, weight FROM w UNION ALL SELECT dst, src, weight FROM w) GROUP BY ALL)"
C_LABELS = "l AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS community FROM customer)"
C_TOKENS = rf"""t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{Nd}}]+'), lambda x: strlen(x) > 1 AND x NOT IN ({STOP})) AS tokens FROM documents),
 q AS (SELECT item_id * 100 AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{Nd}}]+'), lambda x: strlen(x) > 1 AND x NOT IN ({STOP}))) AS term FROM benchmark),
 p AS (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM t), tf AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
 st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t), qt AS (SELECT qid, term, count(*) AS times FROM q GROUP BY ALL),
 s AS (SELECT qid, id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL)"""
C_VEC = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings)"
L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def lexical(t) -> DataFrame:
    """All benchmark items as text queries; item i has the qid 100 i, that of the vector query it is fused with."""
    return t("benchmark").select((F.col("item_id") * 100).alias("qid"), "text")


def asked(t) -> DataFrame:
    """The query set: every vector whose id is divisible by 100."""
    return vecs(t).where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), "vec")


_INDEXES: dict = {}


def stamp(*tables: DataFrame) -> tuple:
    """What tells apart the states of tables: a number for each, from their files' paths, sizes and times. No column is read."""
    files = [t.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct() for t in tables]
    return tuple(str(f.agg(F.sum(F.col("f").cast("decimal(38,0)")).alias("f")).first().f) for f in files)


def stored(spark, t, name: str, build, tables: tuple[str, ...] = ("documents",)):
    """What build(path) wrote for this session and this state of the tables; it is built once, then read, and removed when the driver ends."""
    key = (spark.sparkContext.applicationId, name, stamp(*(t(x) for x in tables)))
    if key not in _INDEXES:
        path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
        _INDEXES[key] = build(path)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return _INDEXES[key]


def index(spark, t) -> bm25.Index:
    return stored(spark, t, "bm25", lambda path: bm25.Index.build(passages(t), path))


# --- filters ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en' AND n_chars > 1000 AND source LIKE 'src1%'")
def filter_and(spark, t):
    return filters.filter_rows(passages(t), [Filter("lang", "eq", "en"), Filter("n_chars", "gt", 1000), Filter("source", "startswith", "src1")]).select("id")


@query("SELECT doc_id AS id FROM documents WHERE lang IN ('de', 'fr') OR n_chars <= 100 OR source LIKE '%7'")
def filter_or(spark, t):
    return filters.filter_rows(passages(t), [Filter("lang", "in", ["de", "fr"]), Filter("n_chars", "lte", 100), Filter("source", "endswith", "7")], "or").select("id")


@query("SELECT doc_id AS id FROM documents WHERE false")
def filter_missing_ne(spark, t):
    return filters.filter_rows(passages(t), [Filter("absent", "ne", "x")]).select("id")


@query("SELECT doc_id AS id FROM documents WHERE lang NOT IN ('en') AND source LIKE '%rc%' AND n_chars >= 10 AND n_chars < 5000")
def filter_nin_contains(spark, t):
    return filters.filter_rows(passages(t), [Filter("lang", "nin", ["en"]), Filter("source", "contains", "rc"), Filter("n_chars", "gte", 10), Filter("n_chars", "lt", "5000x"), Filter("lang", "exists", True), Filter("absent", "exists", False)]).select("id")


# --- lexical ---------------------------------------------------------------------------------------------------------


@query(f"WITH {C_TOKENS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term")
def bm25_index_stats(spark, t):
    posted = index(spark, t).postings()
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {C_TOKENS} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def bm25_corpus_stats(spark, t):
    return index(spark, t).statistics().select("n", r6("avgdl").alias("avgdl"))


@query(f"WITH {C_TOKENS} SELECT id, round(score, 6) AS score FROM s WHERE qid = 0 ORDER BY round(score, 6) DESC, id LIMIT 10")
def bm25_topk(spark, t):
    s = index(spark, t).score(lexical(t).where("qid = 0"))
    return s.select("id", r6("score").alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"WITH {C_TOKENS} SELECT qid, id, score, rank FROM (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s) WHERE rank <= 10")
def bm25_batch_topk(spark, t):
    s = index(spark, t).score(lexical(t)).withColumn("score", r6("score"))
    return bm25.top_k(s, 10)


@query(f"WITH {C_TOKENS} SELECT qid, id, round(score / max(score) OVER (PARTITION BY qid), 6) AS score FROM s")
def bm25_normalized(spark, t):
    return bm25.normalized(index(spark, t).score(lexical(t))).select("qid", "id", r6("score").alias("score"))


@query(f"WITH {C_TOKENS} SELECT doc_id AS id, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN (SELECT * FROM s WHERE qid = 100) s ON s.id = doc_id WHERE doc_id % 100 = 0")
def bm25_score_ids(spark, t):
    ids = t("documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("id"))
    return bm25.scores_of(index(spark, t).score(lexical(t).where("qid = 100")), ids).select("id", r6("score").alias("score"))


# --- vectors ---------------------------------------------------------------------------------------------------------


def _knn_sql(dist: str) -> str:
    return f"WITH {C_VEC}, k AS (SELECT q.id AS qid, v.id, {dist} AS dist FROM v, v q WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 6), id) AS rank FROM k) SELECT qid, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 10"


def _knn(t, name):
    found = search.knn_batch(vecs(t), asked(t), 12, name).withColumn("dist", r6("dist"))
    return bm25.top_k(found, 10, "dist", ascending=True).select("qid", "id", "dist", "rank")


@query(_knn_sql(L2.format(a="v.vec", b="q.vec")))
def knn_l2(spark, t):
    return _knn(t, "l2")


@query(_knn_sql("1 - list_cosine_similarity(v.vec, q.vec)"))
def knn_cosine(spark, t):
    return _knn(t, "cosine")


@query(_knn_sql("-" + DOT.format(a="v.vec", b="q.vec")))
def knn_ip(spark, t):
    return _knn(t, "ip")


C_KNN = f"{C_VEC}, k AS (SELECT q.id AS qid, v.id, {L2.format(a='v.vec', b='q.vec')} AS dist FROM v, v q WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM k)"


@query(f"WITH {C_KNN} SELECT qid, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 10")
def knn_batch(spark, t):
    return search.knn_batch(vecs(t), asked(t), 10).select("qid", "id", r6("dist").alias("dist"), "rank")


@query(f"WITH {C_KNN} SELECT qid, id, round(CASE WHEN max(dist) OVER (PARTITION BY qid) > 0 THEN 1 - dist / max(dist) OVER (PARTITION BY qid) ELSE 1 END, 6) AS score FROM r WHERE rank <= 10")
def distance_normalize(spark, t):
    return search.similarity(search.knn_batch(vecs(t), asked(t), 10)).select("qid", "id", r6("score").alias("score"))


C_FUSE = (
    f"{C_KNN}, {C_TOKENS}, c AS (SELECT qid, id, 1 - dist / max(dist) OVER (PARTITION BY qid) AS sim FROM r WHERE rank <= 50), "
    "j AS (SELECT c.qid, c.id, sim, coalesce(s.score, 0) AS lex FROM c LEFT JOIN s ON s.qid = c.qid AND s.id = c.id), "
    "f AS (SELECT qid, id, round(0.7::DOUBLE * sim + 0.3::DOUBLE * CASE WHEN max(lex) OVER (PARTITION BY qid) > 0 THEN lex / max(lex) OVER (PARTITION BY qid) ELSE 0 END, 6) AS score FROM j)"
)


def _fused(spark, t):
    found = search.similarity(search.knn_batch(vecs(t), asked(t), 50)).drop("rank", "dist")
    return search.fuse(found, index(spark, t).score(lexical(t))).withColumn("score", r6("score"))


@query(f"WITH {C_FUSE} SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10")
def hybrid_fuse(spark, t):
    return bm25.top_k(_fused(spark, t), 10)


@query(f"WITH {C_FUSE} SELECT f.qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f WHERE score >= 0.3) f JOIN documents ON doc_id = id WHERE rank <= 20 AND lang = 'en'")
def hybrid_filtered(spark, t):
    best = bm25.top_k(_fused(spark, t).where("score >= 0.3"), 20).join(passages(t), "id")
    return best.where(filters.condition([Filter("lang", "eq", "en")], F.col("metadata"))).select("qid", "id", "score")


@query(f"WITH {C_KNN}, a AS (SELECT 'even' AS index, qid, id, -dist AS score, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS k FROM k WHERE id % 2 = 0 UNION ALL SELECT 'odd', qid, id, -dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) FROM k WHERE id % 2 = 1) SELECT index, qid, id, round(score, 6) + 0.0::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, index, id) AS rank FROM a WHERE k <= 5) WHERE rank <= 5")
def multi_index_topk(spark, t):
    parts = {}
    for name, rest in (("even", 0), ("odd", 1)):
        parts[name] = search.knn_batch(vecs(t).where(F.col("id") % 2 == rest), asked(t), 5).withColumn("score", -F.col("dist"))
    return search.merge_indexes(parts, 5).withColumn("score", r6("score") + 0.0)


@query(f"WITH {C_KNN}, c AS (SELECT r.qid, r.id, list_cosine_similarity(list_reverse(v.vec), list_reverse(q.vec)) AS score FROM r JOIN v ON v.id = r.id JOIN v q ON q.id = r.qid WHERE rank <= 50) SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM c) WHERE rank <= 5")
def rerank_cosine(spark, t):
    second = vecs(t).select("id", F.reverse("vec").alias("vec"))
    return search.rerank(search.knn_batch(vecs(t), asked(t), 50), second, second.where("id % 100 = 0").select(F.col("id").alias("qid"), "vec"), 5).withColumn("score", r6("score"))


@query("SELECT 'docs:' || doc_id AS ref, CAST(n_chars AS DOUBLE) AS score, left(text, 120) AS peek FROM documents")
def compact_projection(spark, t):
    return search.compact(t("documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), "text"), "docs")


@query("SELECT 'docs:' || doc_id AS ref, 'docs' AS index, doc_id AS id, lang FROM documents WHERE doc_id % 100 = 0")
def citation_resolve(spark, t):
    refs = t("documents").where("doc_id % 100 = 0").select(F.concat(F.lit("docs:"), F.col("doc_id").cast("string")).alias("ref"))
    return search.resolve(refs, t("documents").select(F.col("doc_id").alias("id"), "lang"))


@query("SELECT row_number() OVER (ORDER BY p.o) - 1 AS pos, doc_id AS id, n_chars FROM (VALUES (7, 0), (3, 1), (11, 2), (3, 3)) p(i, o) JOIN documents ON doc_id = p.i")
def passage_multi_get(spark, t):
    return search.multi_get(t("documents").select(F.col("doc_id").alias("id"), "n_chars"), [7, 3, 11, 3])


@query(f"WITH {C_KNN}, n AS (SELECT q.id AS qid, v.id, 1 - list_cosine_similarity(v.vec, q.vec) AS dist FROM v, v q WHERE q.id % 100 = 0), m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM n) SELECT r.qid, count(m.id) / 10.0::DOUBLE AS recall FROM (SELECT * FROM r WHERE rank <= 10) r LEFT JOIN (SELECT * FROM m WHERE rank <= 10) m ON m.qid = r.qid AND m.id = r.id GROUP BY r.qid")
def recall_at_k(spark, t):
    return search.recall(search.knn_batch(vecs(t), asked(t), 10, "cosine"), search.knn_batch(vecs(t), asked(t), 10), 10)


@query("SELECT qid, id, round(dist, 6) AS dist FROM (SELECT NULL::BIGINT AS qid, NULL::BIGINT AS id, NULL::DOUBLE AS dist) WHERE false")
def knn_empty_query_set(spark, t):
    return search.knn_batch(vecs(t), asked(t).limit(0), 10).select("qid", "id", r6("dist").alias("dist"))


@query(f"WITH {C_VEC} SELECT a.id, round({L2.format(a='a.vec', b='b.vec')}, 6) AS l2, round(1 - list_cosine_similarity(a.vec, b.vec), 6) AS cosine, round(-{DOT.format(a='a.vec', b='b.vec')}, 6) AS ip FROM v a JOIN v b ON b.id = a.id + 1")
def vector_distances(spark, t):
    a, b = vecs(t), vecs(t).select((F.col("id") - 1).alias("id"), F.col("vec").alias("w"))
    return a.join(b, "id").select("id", *[r6(vectors.metric(m)(F.col("vec"), F.col("w"))).alias(m) for m in ("l2", "cosine", "ip")])


# --- graph -----------------------------------------------------------------------------------------------------------


@query(f"WITH {C_EDGES} SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id")
def graph_degree(spark, t):
    return graph.degrees(edges(t))


@query(f"WITH {C_EDGES} SELECT DISTINCT dst AS id, c_name AS name, c_mktsegment AS kind FROM d JOIN customer ON c_custkey = dst WHERE src = 7")
def graph_callees(spark, t):
    return graph.callees(edges(t), nodes(t), 7)


@query(f"WITH {C_EDGES} SELECT DISTINCT src AS id, c_name AS name, c_mktsegment AS kind FROM d JOIN customer ON c_custkey = src WHERE dst = 7")
def graph_callers(spark, t):
    return graph.callers(edges(t), nodes(t), 7)


@query("SELECT 'node:' || c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'edge:' || o_orderpriority, count(*) FROM orders GROUP BY ALL")
def graph_stats(spark, t):
    return graph.counts(nodes(t), t("orders").select(F.col("o_orderpriority").alias("kind")))


@query(f"WITH RECURSIVE {C_EDGES}, r(id, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN d ON src = id WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def graph_khop(spark, t):
    return graph.reach(edges(t), spark.createDataFrame([(7,)], "id long"), 2)


@query(f"WITH RECURSIVE {C_EDGES}, r(id, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT CASE WHEN src = id THEN dst ELSE src END, depth + 1 FROM r JOIN d ON src = id OR dst = id WHERE depth < 2), n AS (SELECT DISTINCT id FROM r) SELECT src, dst FROM d WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def graph_neighborhood(spark, t):
    near = graph.reach(edges(t), spark.createDataFrame([(7,)], "id long"), 2, both_ways=True)
    return graph.induced(edges(t), near)


@query(f"WITH RECURSIVE {C_EDGES}, r(id, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT src, depth + 1 FROM r JOIN d ON dst = id WHERE depth < 5) SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0")
def graph_impact(spark, t):
    return graph.impact(edges(t), 7)


@query(f"WITH RECURSIVE {C_EDGES}, r(id, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT src, depth + 1 FROM r JOIN d ON dst = id WHERE depth < 5) SELECT DISTINCT c_mktsegment AS path FROM customer WHERE c_custkey IN (SELECT id FROM r GROUP BY id HAVING min(depth) > 0)")
def affected_files(spark, t):
    return graph.affected_files(nodes(t).select(F.col("kind").alias("path"), "id"), graph.impact(edges(t), 7))


@query(f"WITH RECURSIVE {C_EDGES}, s AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d), r(id, path, n) AS (SELECT 7::BIGINT, [7::BIGINT], 0 UNION ALL SELECT dst, list_append(path, dst), n + 1 FROM r JOIN s ON src = id WHERE n < 3 AND NOT list_contains(path, dst) AND NOT list_contains(path, 1234::BIGINT)) SELECT CAST(r.path AS VARCHAR) AS path, n AS steps FROM r WHERE id = 1234 ORDER BY n, r.path LIMIT 1")
def graph_shortest_path(spark, t):
    found = graph.shortest_path(edges(t), 7, 1234, 3)
    return found.select(F.concat(F.lit("["), F.array_join("path", ", "), F.lit("]")).alias("path"), "steps")


def _pagerank_sql(rounds: int) -> str:
    out = f"WITH {C_EDGES}, n AS (SELECT c_custkey AS id FROM customer), z AS (SELECT count(*) AS n FROM n), o AS (SELECT src, count(*) AS outs FROM d GROUP BY src), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / z.n AS rank FROM n, z)"
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        out += f", g{i} AS (SELECT dst AS id, sum(rank / outs) AS g FROM d JOIN o USING (src) JOIN {p} ON {p}.id = d.src GROUP BY dst), x{i} AS (SELECT coalesce(sum(rank), 0) AS loose FROM {p} WHERE id NOT IN (SELECT src FROM o)), r{i} AS MATERIALIZED (SELECT n.id, 0.15::DOUBLE / z.n + 0.85::DOUBLE * (coalesce(g, 0) + loose / z.n) AS rank FROM n LEFT JOIN g{i} ON g{i}.id = n.id, z, x{i})"
    return out


def _ranks(spark, t):
    """The ranks of this state of the tables, computed once for all queries over them."""

    def build(path: str) -> DataFrame:
        graph.pagerank(nodes(t), edges(t).distinct()).write.parquet(path)
        return spark.read.parquet(path)

    return stored(spark, t, "ranks", build, ("customer", "orders"))


@query(_pagerank_sql(30) + " SELECT id, round(rank, 9) AS rank FROM r30")
def graph_pagerank(spark, t):
    return _ranks(spark, t).select("id", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql(30) + " SELECT id, round(rank, 9) AS rank FROM r30 ORDER BY round(rank, 9) DESC, id LIMIT 20")
def graph_pagerank_topk(spark, t):
    return graph.top(_ranks(spark, t).select("id", F.round("rank", 9).alias("rank")), 20, "rank")


@query(_pagerank_sql(30).replace("WITH ", "WITH RECURSIVE ", 1) + ", s AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d), b(id, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT dst, depth + 1 FROM b JOIN s ON src = id WHERE depth < 3) SELECT count(*) AS nodes, round(sum(rank) / (SELECT sum(rank) FROM r30), 6) AS share FROM r30 WHERE id IN (SELECT id FROM b) AND id <> 7")
def graph_blast_radius(spark, t):
    return graph.blast_radius(edges(t), 7, _ranks(spark, t)).select("nodes", r6("share").alias("share"))


@query(_pagerank_sql(30) + ", s AS (SELECT src, dst FROM d WHERE src <> dst UNION SELECT dst, src FROM d WHERE src <> dst), s2 AS (SELECT DISTINCT a.src, b.dst FROM s a JOIN s b ON a.dst = b.src), s3 AS (SELECT DISTINCT a.src, b.dst FROM s2 a JOIN s b ON a.dst = b.src), al AS (SELECT src, dst FROM s UNION SELECT src, dst FROM s2 UNION SELECT src, dst FROM s3), bl AS (SELECT src AS id, sum(rank) / (SELECT sum(rank) FROM r30) AS blast FROM al JOIN r30 ON r30.id = dst WHERE src <> dst GROUP BY src), deg AS (SELECT id, sum(o) AS o, sum(i) AS i FROM (SELECT src AS id, 1 AS o, 0 AS i FROM d UNION ALL SELECT dst, 0, 1 FROM d) GROUP BY id), j AS (SELECT r30.id, rank, coalesce(o, 0) * coalesce(i, 0) AS c, coalesce(blast, 0) AS blast FROM r30 LEFT JOIN deg USING (id) LEFT JOIN bl USING (id)), k AS (SELECT id, round(least(1.0::DOUBLE, 0.35::DOUBLE * rank / max(rank) OVER () + 0.30::DOUBLE * c / max(c) OVER () + 0.35::DOUBLE * blast), 6) AS score FROM j) SELECT id, score, CASE WHEN score >= 0.75 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS level FROM k")
def graph_risk(spark, t):
    links = edges(t).distinct()
    ranks = _ranks(spark, t)
    scored = graph.risk(ranks, links, graph.blast_shares(links, ranks))
    return scored.select("id", r6("score").alias("score")).withColumn("level", scalars.risk_level(F.col("score")))


@query(f"WITH {C_EDGES} SELECT id, count(*) FILTER (o = 1) AS out_degree, count(*) FILTER (o = 0) AS in_degree, count(*) AS degree FROM (SELECT src AS id, 1 AS o FROM e UNION ALL SELECT dst, 0 FROM e) GROUP BY id HAVING count(*) >= 5 ORDER BY degree DESC, id LIMIT 20")
def graph_god_nodes(spark, t):
    return graph.god_nodes(edges(t))


@query(f"WITH {C_EDGES}, {C_LABELS} SELECT src, dst, weight, a.community AS src_community, b.community AS dst_community FROM w JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE a.community <> b.community ORDER BY weight DESC, src, dst LIMIT 20")
def graph_surprising_edges(spark, t):
    return graph.surprising_edges(weighted(t), labels(t))


@query(f"WITH {C_UNDIR}, {C_LABELS}, m AS (SELECT sum(weight) AS m2 FROM u), k AS (SELECT a, sum(weight) AS k FROM u GROUP BY a) SELECT round((SELECT sum(weight) FROM u JOIN l x ON x.id = a JOIN l y ON y.id = b WHERE x.community = y.community) / m2 - (SELECT sum(kk * kk) FROM (SELECT sum(k) AS kk FROM k JOIN l ON l.id = a GROUP BY community)) / (m2 * m2), 6) AS modularity FROM m")
def graph_modularity(spark, t):
    return graph.modularity(weighted(t), labels(t)).select(r6("modularity").alias("modularity"))


@query(f"WITH {C_UNDIR}, {C_LABELS}, m AS (SELECT sum(weight) AS m2 FROM u), k AS (SELECT a, sum(weight) AS k FROM u GROUP BY a) SELECT round(sum((weight - p.k * q.k / m2) / m2), 6) AS modularity FROM u JOIN l x ON x.id = u.a JOIN l y ON y.id = u.b JOIN k p ON p.a = u.a JOIN k q ON q.a = u.b, m WHERE x.community = y.community")
def graph_modularity_adjacent(spark, t):
    return graph.modularity(weighted(t), labels(t), adjacent_only=True).select(r6("modularity").alias("modularity"))


@query(f"WITH {C_UNDIR}, {C_LABELS}, i AS (SELECT x.community, sum(weight) AS w FROM u JOIN l x ON x.id = a JOIN l y ON y.id = b WHERE x.community = y.community AND a <> b GROUP BY ALL), s AS (SELECT community, count(*) AS n FROM l GROUP BY ALL) SELECT s.community, n, round(CASE WHEN n <= 1 THEN 1 ELSE least(1.0::DOUBLE, coalesce(w, 0) / 2 / (n * (n - 1))) END, 6) AS cohesion FROM s LEFT JOIN i USING (community)")
def graph_cohesion(spark, t):
    return graph.cohesion(weighted(t), labels(t)).select("community", "n", r6("cohesion").alias("cohesion"))


@query(f"WITH {C_LABELS}, s AS (SELECT community, count(*) AS n, min(id) AS least FROM l GROUP BY ALL), o AS (SELECT community, row_number() OVER (ORDER BY n DESC, least) - 1 AS rank FROM s) SELECT community, id, rank FROM l JOIN o USING (community)")
def graph_community_ranks(spark, t):
    return graph.renumbered(labels(t))


@query("SELECT community, label FROM (SELECT c_nationkey::BIGINT AS community, c_mktsegment AS label, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE r = 1")
def graph_community_labels(spark, t):
    return graph.community_labels(labels(t).join(nodes(t), "id").select("community", F.col("kind").alias("name")))


@query()
def graph_communities(spark, t):
    return graph.communities(nodes(t), weighted(t))


@query("SELECT (SELECT count(*) FROM customer) AS nodes, 0::BIGINT AS improvable")
def graph_louvain(spark, t):
    """Local moving ends where no node gains by a move; checked by another plan over the result."""
    found = graph.cut_lineage(graph.louvain(nodes(t), weighted(t)))
    known = weighted(t).join(nodes(t).select(F.col("id").alias("src")), "src", "left_semi").join(nodes(t).select(F.col("id").alias("dst")), "dst", "left_semi")
    return found.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(graph.improvable(known, found).agg(F.count(F.lit(1)).alias("improvable")))  # one row each


@query("SELECT p_partkey AS id, p_brand || '.' || p_name AS fqn, p_name AS name FROM part WHERE p_name LIKE '%bolt%' OR lower(p_brand || '.' || p_name) LIKE '%bolt%' ORDER BY fqn, id LIMIT 50")
def symbol_search(spark, t):
    symbols = t("part").select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_brand", "p_name").alias("fqn"), F.col("p_name").alias("name"))
    return graph.symbol_search(symbols, "bolt")


@query("WITH s AS (SELECT p_brand AS file, sum(p_retailprice) AS score, sum(length(p_name) + 1) AS chars, count(*) AS symbols FROM part GROUP BY ALL), c AS (SELECT *, sum((chars + length(file)) / 4.0::DOUBLE) OVER (ORDER BY round(score, 2) DESC, file ROWS UNBOUNDED PRECEDING) AS tokens FROM s) SELECT file, symbols, round(tokens, 4) AS tokens FROM c WHERE tokens <= 2000")
def repo_map(spark, t):
    p = t("part")
    found = graph.repo_map(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file")), p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")))
    return found.select("file", "symbols", F.round("tokens", 4).alias("tokens"))


@query("SELECT file, id, score FROM (SELECT p_brand AS file, p_partkey AS id, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def file_risk(spark, t):
    return graph.file_risk(t("part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")))


@query("WITH s AS (SELECT p_brand AS file, p_partkey AS name, p_size AS start_line, p_size + p_partkey % 20 AS end_line FROM part), c AS (SELECT DISTINCT p_brand AS file, p_size + 5 AS line FROM part) SELECT file, line, symbol FROM (SELECT file, line, name AS symbol, row_number() OVER (PARTITION BY file, line ORDER BY start_line, name) AS r FROM c JOIN s USING (file) WHERE line BETWEEN start_line AND end_line) WHERE r = 1")
def call_site_enclosing(spark, t):
    p = t("part")
    symbols = p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("name"), F.col("p_size").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 20).alias("end_line"))
    return graph.enclosing(p.select(F.col("p_brand").alias("file"), (F.col("p_size") + 5).alias("line")).distinct(), symbols)


@query("WITH s AS (SELECT p_brand AS file, p_partkey AS name, p_size AS start_line, p_size + 2 AS end_line FROM part WHERE p_partkey % 20 = 0), c AS (SELECT DISTINCT p_brand AS file, p_size AS line, 'NOTE ' || p_size AS note FROM part) SELECT file, name, string_agg(note, '; ' ORDER BY line, note) AS notes FROM c JOIN s USING (file) WHERE line BETWEEN start_line - 3 AND end_line GROUP BY file, name")
def rationale_join(spark, t):
    p = t("part")
    symbols = p.where("p_partkey % 20 = 0").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("name"), F.col("p_size").alias("start_line"), (F.col("p_size") + 2).alias("end_line"))
    return graph.rationale(p.select(F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.concat(F.lit("NOTE "), F.col("p_size").cast("string")).alias("note")).distinct(), symbols)


# --- memory ----------------------------------------------------------------------------------------------------------


@query(f"WITH {C_BLOCKS} SELECT id, round(least(1.0::DOUBLE, (1 + confirms)::DOUBLE / (2 + confirms + conflicts) * pow(0.5::DOUBLE, (now - sec) / 86400.0::DOUBLE / 90) * (1 + 0.1::DOUBLE * ln(1 + accesses))), 6) AS validity FROM b")
def memory_validity(spark, t):
    return memory.scored(blocks(t), now()).select("id", r6("validity").alias("validity"))


@query(f"WITH {C_BLOCKS}, v AS (SELECT round(least(1.0::DOUBLE, (1 + confirms)::DOUBLE / (2 + confirms + conflicts) * pow(0.5::DOUBLE, (now - sec) / 86400.0::DOUBLE / 90) * (1 + 0.1::DOUBLE * ln(1 + accesses))), 6) AS s FROM b) SELECT CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' WHEN s >= 0.2 THEN 'low' ELSE 'unreliable' END AS label, count(*) AS n FROM v GROUP BY ALL")
def memory_validity_labels(spark, t):
    return memory.scored(blocks(t), now()).groupBy(scalars.validity_label(r6("validity")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {C_BLOCKS} SELECT id, tier FROM b WHERE now - sec > CASE tier WHEN 'short' THEN 1 WHEN 'medium' THEN 30 WHEN 'long' THEN 180 ELSE 90 END * 86400")
def memory_stale(spark, t):
    return memory.stale_blocks(blocks(t), now()).select("id", "tier")


@query(f"WITH {C_BLOCKS} SELECT id, scope FROM b WHERE (lower(content) LIKE '%click%' OR lower(label) LIKE '%click%' OR len(list_filter(tags, lambda x: lower(x) LIKE '%click%')) > 0) AND scope IN ('', 'p1')")
def memory_search_scoped(spark, t):
    return memory.search(blocks(t), "CLICK", "p1").select("id", "scope")


@query(f"WITH {C_BLOCKS} SELECT id FROM b WHERE list_contains(list_transform(tags, lambda x: lower(x)), 'tag1') AND list_contains(tags, 'view')")
def memory_tags(spark, t):
    return memory.with_tags(blocks(t), ["TAG1", "View"]).select("id")


@query(f"WITH {C_BLOCKS}, v AS (SELECT * FROM b WHERE exp IS NULL OR now <= exp) SELECT tier, count(*) AS n FROM v GROUP BY tier UNION ALL SELECT 'all', count(*) FROM v")
def memory_tier_stats(spark, t):
    return memory.stats(blocks(t), now())


def _clash(new: str) -> str:
    literal = "is not=is,should not=should,does not=does,cannot=can,never=always,disable=enable,false=true,deprecated=recommended,removed=added,don't=do"
    pairs = []
    for a, b in (pair.split("=") for pair in literal.split(",")):
        x, y = a.replace("'", "''"), b.replace("'", "''")
        pairs.append(f"(contains(lower(content), '{x}') AND {b in new}) OR (contains(lower(content), '{y}') AND {a in new})")
    long = ", ".join(f"'{w}'" for w in new.split() if len(w) > 4)
    return f"({' OR '.join(pairs)}) AND len(list_intersect(list_filter(string_split(lower(content), ' '), lambda x: strlen(x) > 4), [{long}])) > 0"


@query(f"WITH {C_BLOCKS} SELECT id FROM b WHERE tier = 'long' AND {_clash('nobody should not use click')}")
def memory_contradictions(spark, t):
    return memory.contradictions(blocks(t), "nobody should not use click").select("id")


@query(f"WITH {C_BLOCKS} SELECT id, CASE WHEN tier = 'medium' AND now - sec > 10 * 86400 THEN 'long' ELSE tier END AS tier FROM b WHERE exp IS NULL OR now <= exp")
def memory_maintenance(spark, t):
    return memory.maintain(blocks(t), now(), 10).select("id", "tier")


@query(f"WITH {C_BLOCKS} SELECT id, CASE WHEN tier = 'short' THEN 'medium' ELSE tier END AS tier FROM b WHERE exp IS NULL OR now <= exp")
def memory_end_session(spark, t):
    return memory.end_session(blocks(t), now()).select("id", "tier")


@query(f"WITH {C_BLOCKS} SELECT id FROM b WHERE (exp IS NULL OR now <= exp) AND tier = 'medium' AND list_contains(list_transform(tags, lambda x: lower(x)), 'tag2') AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, id LIMIT 25")
def memory_recall(spark, t):
    return memory.recall(blocks(t), 25, now(), "medium", ["tag2"], F.to_timestamp(F.lit("2024-01-10")), F.to_timestamp(F.lit("2024-01-20"))).select("id")


@query(f"WITH {C_BLOCKS} SELECT id FROM b WHERE NOT (tier = 'medium' AND sec < now - 20 * 86400)")
def memory_delete_older(spark, t):
    return memory.delete_older(blocks(t), "medium", now(), 20).select("id")


@query(f"WITH {C_BLOCKS} SELECT b.id, accesses + coalesce(n, 0) AS accesses FROM b LEFT JOIN (SELECT event_id % 100 AS id, count(*) AS n FROM events GROUP BY ALL) l USING (id)")
def memory_record_access(spark, t):
    return memory.record_access(blocks(t), t("events").select((F.col("event_id") % 100).alias("id"), F.col("ts").cast("timestamp").alias("ts"))).select("id", F.col("accesses").cast("long").alias("accesses"))


# --- conversations ---------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def conversation_window(spark, t):
    return conversations.history(t("conversations"), 2).select("conv_id", "turn")


@query("SELECT conv_id, CASE WHEN length(x) > 57 THEN left(x, 57) || '...' ELSE x END AS title FROM (SELECT conv_id, arg_min(text, turn) AS x FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def conversation_titles(spark, t):
    return conversations.titles(t("conversations"))


@query("SELECT conv_id, CASE WHEN length(x) > 197 THEN left(x, 197) || '...' ELSE x END AS summary FROM (SELECT conv_id, arg_min(text, turn) AS x FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def conversation_summary_fallback(spark, t):
    return conversations.summaries_fallback(t("conversations"))


@query("SELECT conv_id, string_agg(role || ': ' || left(text, 500), chr(10) ORDER BY turn, role || ': ' || left(text, 500)) AS transcript FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def transcript(spark, t):
    return conversations.transcripts(t("conversations"))


@query("SELECT conv_id, turn, role, left(text, 200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role <> 'system') WHERE r <= 4")
def conversation_previews(spark, t):
    return conversations.previews(t("conversations"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS messages FROM conversations GROUP BY conv_id")
def conversation_message_counts(spark, t):
    return conversations.message_counts(t("conversations"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def conversation_last_user(spark, t):
    return conversations.last_user(t("conversations"))


# --- incremental -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def cache_uncached(spark, t):
    d = t("documents").select("doc_id", "text")
    cache = d.where("doc_id % 3 = 0").select(scalars.text_hash(F.col("text")).alias("text_hash"), F.lit("m").alias("model"))
    return incremental.uncached(d, cache, "m").select("doc_id")


@query("SELECT lang AS model, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def chunk_memo_stats(spark, t):
    return incremental.memo_stats(t("documents").select(F.col("lang").alias("model"), "source"))


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'src3')")
def reconcile_orphans(spark, t):
    return incremental.orphans(t("documents"), spark.createDataFrame([(f"src{i}",) for i in range(4)], "path string"))


@query("SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')")
def reconcile(spark, t):
    return incremental.reconcile(t("documents"), spark.createDataFrame([(f"src{i}",) for i in range(4)], "path string")).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src5', 'src6') UNION ALL SELECT doc_id + 1000000, source FROM documents WHERE source = 'src6'")
def upsert_by_source(spark, t):
    d = t("documents").select("doc_id", "source")
    new = d.where("source = 'src6'").withColumn("doc_id", F.col("doc_id") + 1000000)
    return incremental.upsert_sources(d, new, d.where("source = 'src5'").select("source").distinct())


@query("SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS content, max(o_orderkey) AS version FROM orders GROUP BY o_custkey")
def entity_merge(spark, t):
    rows = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("content"), F.col("o_orderkey").alias("version"))
    return incremental.merge_entities(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["id"], "version")


@query(f"WITH {C_EDGES}, n AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0) SELECT DISTINCT src, dst, 'calls' AS type, 1.0::DOUBLE AS weight FROM d WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def edge_endpoint_validation(spark, t):
    new = edges(t).select("src", "dst", F.lit("calls").alias("type"), F.lit(None).cast("double").alias("weight"))
    return incremental.merge_edges(new.limit(0), new, nodes(t).where("id % 3 <> 0"))


@query(f"WITH {C_EDGES} SELECT src, dst FROM d WHERE src % 10 <> 0 AND dst % 10 <> 0")
def entity_delete_cascade(spark, t):
    gone = nodes(t).where("id % 10 = 0").select("id")
    ids = edges(t).select(F.col("src").alias("id")).union(edges(t).select("dst")).distinct().where("id % 10 = 0").union(gone).distinct()
    return incremental.delete_nodes(nodes(t), edges(t).distinct(), ids)[1]


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def dedup_first_wins(spark, t):
    return incremental.first_wins(t("lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 + 100 AS id FROM documents")
def dense_ids(spark, t):
    return incremental.with_ids(t("documents").select("source", "doc_id"), ["source", "doc_id"], 100).select("doc_id", "id")


@query("SELECT doc_id AS path, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'removed' WHEN doc_id % 3 = 0 AND doc_id % 2 <> 0 THEN 'added' ELSE 'modified' END AS change FROM documents WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND NOT (doc_id % 6 = 0 AND doc_id % 5 <> 0)")
def change_tracking(spark, t):
    d = t("documents").select(F.col("doc_id").alias("path"), scalars.text_hash(F.col("text")).alias("hash"))
    later = d.where("path % 3 = 0").withColumn("hash", F.when(F.col("path") % 5 == 0, "x").otherwise(F.col("hash")))
    return incremental.changed(d.where("path % 2 = 0"), later)


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS hash, left(sha256(lower(trim(source))), 16) AS fingerprint, '\"' || left(sha256(lang || source), 12) || '\"' AS etag FROM documents")
def text_hash(spark, t):
    return t("documents").select("doc_id", scalars.text_hash(F.col("text")).alias("hash"), scalars.model_fingerprint(F.col("source")).alias("fingerprint"), scalars.etag(F.col("lang"), F.col("source")).alias("etag"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents")
def word_count(spark, t):
    return t("documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("words"))


@query(r"SELECT doc_id, len(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')) AS paragraphs FROM documents")
def paragraph_split(spark, t):
    return t("documents").select("doc_id", F.size(text.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).cast("long").alias("paragraphs"))


@query(r"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.?!])(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')) AS sentences FROM documents")
def sentence_split(spark, t):
    return t("documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(f"WITH {C_TOKENS} SELECT id, len(tokens) AS n, sha256(array_to_string(tokens, ' ')) AS digest FROM t")
def tokenizer(spark, t):
    tok = text.tokens(F.col("text"))
    return t("documents").select(F.col("doc_id").alias("id"), F.size(tok).cast("long").alias("n"), F.sha2(F.array_join(tok, " "), 256).alias("digest"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 320 THEN regexp_replace(left(text, 320), ' [^ ]*$', '') ELSE text END AS head FROM documents")
def truncate_to_tokens(spark, t):
    return t("documents").select("doc_id", text.truncate_to_tokens(F.col("text"), 150).alias("head"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 85) || '... [truncated]' ELSE text END AS content FROM documents")
def char_limit(spark, t):
    return t("documents").select("doc_id", text.limited(F.col("text"), F.lit(100)).alias("content"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_attributes(spark, t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT p_partkey, '# ' || p_brand || ' > ## ' || p_type || ' > ### ' || p_name AS header FROM part")
def breadcrumb(spark, t):
    return t("part").select("p_partkey", text.breadcrumb(F.array("p_brand", "p_type", "p_name")).alias("header"))


@query("SELECT page_id, split_part(regexp_extract(url, '^https?://([^/?#]+)', 1), ':', 1) AS host, CASE WHEN html LIKE '%<h1>%' THEN 1 ELSE 0 END AS has_h1, len(regexp_extract_all(html, '<h[1-3][ >]')) AS headings FROM pages")
def html_headings(spark, t):
    return t("pages").select("page_id", F.split_part(F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.lit(":"), F.lit(1)).alias("host"), F.contains("html", F.lit("<h1>")).cast("int").alias("has_h1"), F.regexp_count("html", F.lit("<h[1-3][ >]")).cast("long").alias("headings"))


# --- order-dependent and event queries -------------------------------------------------------------------------------


@query("WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions FROM g GROUP BY user_id")
def session_counts(spark, t):
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").withColumn("fresh", F.when(gap <= 1_800_000_000, 0).otherwise(1)).groupBy("user_id").agg(F.sum("fresh").alias("sessions"))


@query("SELECT event_type, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, count(*) AS n, count(DISTINCT user_id) AS paths FROM events GROUP BY ALL")
def tumbling_change_counts(spark, t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("paths")).select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "paths")


@query("SELECT conv_id, turn FROM (SELECT *, sum(length(text) / 4.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 200")
def token_budget_prefix(spark, t):
    used = F.sum(F.length("text") / 4).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return t("conversations").withColumn("used", used).where("used <= 200").select("conv_id", "turn")


@query("SELECT doc_id, pos - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)")
def chunk_ordinals(spark, t):
    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("total_chunks"), "line")


@query("SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) AS n FROM documents GROUP BY source")
def resource_by_source(spark, t):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return t("documents").groupBy("source").agg(ids.alias("ids"), F.count(F.lit(1)).alias("n"))


@query("SELECT lang, round(avg(hit) * 100, 6) AS rate FROM (SELECT lang, CASE WHEN doc_id % 4 = 0 THEN 1.0::DOUBLE ELSE 0 END AS hit FROM documents) GROUP BY lang")
def cache_hit_rate(spark, t):
    return t("documents").groupBy("lang").agg(r6(F.avg((F.col("doc_id") % 4 == 0).cast("double")) * 100).alias("rate"))


@query("SELECT source, CAST(sum(strlen(text)) // 4 AS BIGINT) AS tokens, count(*) AS files FROM documents GROUP BY source")
def corpus_tokens(spark, t):
    return t("documents").groupBy("source").agg(F.floor(F.sum(F.octet_length("text")) / 4).alias("tokens"), F.count(F.lit(1)).alias("files"))
