"""Registered queries over approximate search, chunking, extraction, exports and continuous operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import scalars, text
from millrace.operators import ann, chunks, diskann, graph, memory, search
from millrace.plans.queries import C_BLOCKS, C_EDGES, C_VEC, L2, _clash, asked, blocks, edges, nodes, now, query, r6, stored, vecs, weighted
from millrace.session import shared_dir
from millrace.sources import readers, sinks
from millrace.streaming import pipelines


@query(f"WITH {C_VEC}, m AS (SELECT list(mean ORDER BY pos) AS vec FROM (SELECT pos, avg(x) AS mean FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM v) GROUP BY pos)) SELECT v.id, round({L2.format(a='v.vec', b='m.vec')}, 6) AS dist FROM v, m ORDER BY dist, v.id LIMIT 1")
def vector_medoid(spark, t):
    return ann.medoid(vecs(t)).select("id", r6("dist").alias("dist"))


@query(f"WITH {C_VEC} SELECT pos - 1 AS pos, round(avg(x), 6) AS mean FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM v) GROUP BY pos")
def vector_centroid(spark, t):
    return ann.centroid(vecs(t)).select(F.col("pos").cast("long").alias("pos"), r6("mean").alias("mean"))


#: Recall is measured over every vector whose id is divisible by 100, against exact search.
ASKED = "SELECT count(*) AS asked, true AS good FROM embeddings WHERE vec_id % 100 = 0"


def _good(found, t, k=10, least=0.9):
    rows = search.recall(found, search.knn_batch(vecs(t), asked(t), k), k)
    return rows.agg(F.count(F.lit(1)).alias("asked"), (F.avg("recall") >= least).alias("good"))


@query()
def ivf_probe(spark, t):
    return ann.Ivf.build(vecs(t), 16).search(asked(t), 10, 12)


@query(ASKED)
def ivf_recall(spark, t):
    return _good(ann.Ivf.build(vecs(t), 16).search(asked(t), 10, 12), t)


@query(ASKED)
def pq_adc_rerank(spark, t):
    pq = ann.Pq.train(vecs(t), 32, 256)
    return _good(pq.search_batch(pq.encode(vecs(t)), vecs(t), asked(t), 10, 100), t)


@query()
def sq8_codes(spark, t):
    return ann.scalar_quantized(vecs(t))


def hnsw(spark, t) -> ann.StoredHnsw:
    return stored(spark, t, "hnsw", lambda path: ann.StoredHnsw.build(vecs(t), path), ("embeddings",))


@query()
def hnsw_partitioned(spark, t):
    return hnsw(spark, t).search(asked(t), 10)


@query(ASKED)
def hnsw_recall(spark, t):
    return _good(hnsw(spark, t).search(asked(t), 10), t)


@query("SELECT count(*) AS nodes, 0::BIGINT AS wrong, true AS compact FROM embeddings")
def csr_round_trip(spark, t):
    """Every vector is a node of the stored graph, links lead to nodes of the same part, and the lists of a level have at most 2 m links."""
    rows = hnsw(spark, t).links()
    ids = rows.select("part", "id").distinct()
    gone = rows.select("part", F.explode("neighbors").alias("id")).join(ids, ["part", "id"], "left_anti").count()
    wide = rows.where(F.size("neighbors") > F.when(F.col("level") == 0, 32).otherwise(16)).count()
    size = hnsw(spark, t).stats()
    return ids.agg(F.count(F.lit(1)).alias("nodes"), F.lit(gone + wide).cast("long").alias("wrong")).crossJoin(size.select((F.col("csr_bytes") < F.col("list_bytes")).alias("compact")))  # one row each


def vamana(spark, t) -> diskann.DiskAnn:
    return stored(spark, t, "diskann", lambda path: diskann.DiskAnn.build(vecs(t), path), ("embeddings",))


@query("SELECT count(*) AS nodes, 0::BIGINT AS wrong FROM embeddings")
def vamana_build(spark, t):
    """Every vector is a node with at most r links, none to itself, all within its part."""
    rows = vamana(spark, t).graph()
    links = rows.select("part", F.col("id").alias("src"), F.explode("neighbors").alias("id"))
    lost = links.join(rows.select("part", "id"), ["part", "id"], "left_anti").count() + links.where("src = id").count()
    return rows.agg(F.count(F.lit(1)).alias("nodes"), (F.count_if(F.size("neighbors") > vamana(spark, t).config.r) + lost).alias("wrong"))


@query()
def vamana_search(spark, t):
    return vamana(spark, t).search_exact(asked(t), 10)


@query(ASKED)
def vamana_recall(spark, t):
    return _good(vamana(spark, t).search_exact(asked(t), 10), t)


@query(ASKED)
def diskann_search(spark, t):
    return _good(vamana(spark, t).search(asked(t), 10), t)


@query("SELECT count(*) AS vectors, 0::BIGINT AS left_over FROM embeddings WHERE vec_id % 3 <> 0")
def diskann_remove(spark, t):
    """Removing vectors rebuilds their parts only; ids stay."""
    path = f"{shared_dir(spark)}/millrace-diskann-{uuid.uuid4().hex}"
    kept = vamana(spark, t).remove(vecs(t).where("id % 3 = 0").select("id"), path).graph()
    return kept.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("id") % 3 == 0).alias("left_over"))


@query(f"WITH {C_EDGES}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), k AS (SELECT id FROM g ORDER BY degree DESC, id LIMIT (SELECT CAST(ceil(count(*) * 0.1::DOUBLE) AS BIGINT) FROM g)) SELECT id FROM k UNION SELECT 7::BIGINT")
def embedding_pruning(spark, t):
    return ann.keep_embeddings(graph.degrees(edges(t)).select("id", "degree"), 0.1, 7)


@query()
def text_chunks(spark, t):
    rows = chunks.text_chunks(t("documents").select("doc_id", "text"), size=128, overlap=16)
    return rows.select("doc_id", "chunk_index", "total_chunks", F.col("chunk.start").alias("start"), F.col("chunk.end").alias("end"), F.col("chunk.start_line").alias("line"))


@query("SELECT count(*) AS docs, 0::BIGINT AS wrong FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0")
def chunk_provenance(spark, t):
    """Each chunk is its text's span; every document with text has a chunk."""
    rows = chunks.text_chunks(t("documents").select("doc_id", "text"), size=128, overlap=16)
    wrong = F.substring("text", F.col("chunk.start") + 1, F.col("chunk.end") - F.col("chunk.start")) != F.col("chunk.text")
    return rows.agg(F.countDistinct("doc_id").alias("docs"), F.count_if(wrong).alias("wrong"))


@query()
def html_to_markdown(spark, t):
    return readers.html_pages(t("pages").select("page_id", "html")).select("page_id", "markdown")


@query()
def html_sections(spark, t):
    return chunks.sections(readers.html_pages(t("pages").select("page_id", "html")).select("page_id", F.col("markdown").alias("text")), "page_id")


@query()
def markdown_chunks(spark, t):
    rows = chunks.markdown_chunks(readers.html_pages(t("pages").select("page_id", "html")).select("page_id", F.col("markdown").alias("text")))
    return rows.select("page_id", "chunk_index", F.col("chunk.section").alias("section"), F.length("chunk.text").alias("length"))


@query()
def extractive_summary(spark, t):
    return chunks.with_summary(t("documents").select("doc_id", "text")).select("doc_id", "summary")


@query(f"WITH {C_EDGES} SELECT 'MERGE (n:Node {{id: ''' || c_custkey || '''}}) SET n.name = ''' || c_name || ''';' AS line FROM customer UNION ALL SELECT 'MATCH (a:Node {{id: ''' || src || '''}}), (b:Node {{id: ''' || dst || '''}}) MERGE (a)-[:LINKS]->(b);' FROM d")
def export_cypher(spark, t):
    return sinks.cypher(nodes(t), edges(t).distinct())


@query(f"""WITH {C_EDGES} SELECT '<node id="' || c_custkey || '"><data key="name">' || c_name || '</data></node>' AS line FROM customer UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"/>' FROM d UNION ALL SELECT unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">', '</graph></graphml>'])""")
def export_graphml(spark, t):
    return sinks.graphml(nodes(t), edges(t).distinct())


@query("SELECT DISTINCT url, event_type AS event, props AS payload FROM events JOIN (VALUES ('http://a', 'click'), ('http://b', '*'), ('http://a', 'view')) h(url, wanted) ON wanted = event_type OR wanted = '*'")
def webhook_fanout(spark, t):
    rows = t("events").select(F.col("event_type").alias("event"), F.col("props").alias("payload"))
    return sinks.webhooks(rows, [{"url": "http://a", "events": ["click", "view"]}, {"url": "http://b", "events": ["*"]}])


@query("SELECT event_type || '_total ' || count(*) AS line FROM events GROUP BY event_type UNION ALL SELECT event_type || '_avg_ms ' || printf('%.3f', sum(round(value * 100)) / 100.0::DOUBLE / count(*)) FROM events GROUP BY event_type")
def metrics_text(spark, t):
    return sinks.metrics(t("events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("value") * 100)) / 100).alias("total_ms")))


@query("""WITH g AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT key, CAST(round(epoch_us(min(ts)) / 1000.0::DOUBLE) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY key, n""")
def session_windows(spark, t):
    rows = t("events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return pipelines.sessions(rows).select("key", F.round(F.unix_micros("start") / 1000).cast("long").alias("start"), "n")


@query()
def rate_limiter(spark, t):
    rows = t("events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return pipelines.rate_limited_batch(rows, 1 / 3600, 2.0)


@query("SELECT user_id AS path, arg_max(event_type, ts) AS hash, epoch_us(max(ts)) AS at FROM events GROUP BY user_id")
def change_tracker(spark, t):
    rows = t("events").select(F.col("user_id").alias("path"), F.col("event_type").alias("hash"), F.col("ts").cast("timestamp").alias("ts"))
    return pipelines.tracked(rows).select("path", "hash", F.unix_micros("ts").alias("at"))


@query("""WITH l AS (SELECT user_id AS task, event_id AS seq, ['QUEUED','RUNNING','COMPLETED','FAILED'][event_id % 4 + 1] AS status FROM events), b AS (SELECT *, lag(status) OVER (PARTITION BY task ORDER BY seq) AS before FROM l)
 SELECT task, seq, status, before FROM b WHERE NOT ((before IS NULL AND status = 'QUEUED') OR coalesce(before = 'QUEUED' AND status IN ('RUNNING', 'CANCELLED'), false) OR coalesce(before = 'RUNNING' AND status IN ('COMPLETED', 'FAILED', 'CANCELLED'), false))""")
def task_transitions(spark, t):
    status = F.element_at(F.array(*[F.lit(s) for s in ("QUEUED", "RUNNING", "COMPLETED", "FAILED")]), (F.col("event_id") % 4 + 1).cast("int"))
    return pipelines.invalid_transitions(t("events").select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), status.alias("status")))


@query("SELECT user_id, event_id % 7 || 'd' || event_id % 5 || 'h' AS duration, CAST(event_id % 7 * 86400 + event_id % 5 * 3600 AS DOUBLE) AS seconds FROM events")
def duration_parse(spark, t):
    d = F.concat((F.col("event_id") % 7).cast("string"), F.lit("d"), (F.col("event_id") % 5).cast("string"), F.lit("h"))
    return t("events").select("user_id", d.alias("duration"), scalars.seconds(d).alias("seconds"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS z FROM part")
def numeric_coercion(spark, t):
    return t("part").select("p_partkey", scalars.to_number(F.concat(F.col("p_size").cast("string"), F.lit("ab"))).alias("n"), scalars.to_number(F.lit("x1")).alias("z"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' WHEN 2 THEN 'long' END AS tier FROM events")
def tier_parse(spark, t):
    name = F.element_at(F.array(*[F.lit(x) for x in ("Short", "medium-term", "LONG_term", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    return t("events").select("event_id", scalars.tier(name).alias("tier"))


@query("SELECT p_partkey, ['go','python','unknown','rust'][p_partkey % 4 + 1] AS language, p_partkey % 4 = 2 AS markdown FROM part")
def language_by_extension(spark, t):
    e = F.element_at(F.array(*[F.lit(x) for x in (".go", ".py", ".md", ".RS")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), e)
    return t("part").select("p_partkey", text.language(path).alias("language"), text.is_markdown(path).alias("markdown"))


@query("SELECT p_partkey, p_name AS package FROM part")
def package_of_symbol(spark, t):
    return t("part").select("p_partkey", text.package_of(F.concat(F.lit("mod/"), F.col("p_name"), F.lit(".Call"))).alias("package"))


@query("SELECT p_partkey, p_name || ';' || p_brand AS cells FROM part")
def table_row_split(spark, t):
    return t("part").select("p_partkey", F.array_join(text.table_cells(F.concat(F.lit("| "), F.col("p_name"), F.lit(" |  "), F.col("p_brand"), F.lit(" |"))), ";").alias("cells"))


@query(f"WITH {C_EDGES}, n AS (SELECT c_custkey AS id, c_nationkey AS pk, c_nationkey AS com FROM customer) SELECT src, dst, round(weight * (CASE WHEN a.pk <> b.pk THEN 1.5::DOUBLE ELSE 1 END) * (CASE WHEN abs(a.com - b.com) > 3 THEN 1.2::DOUBLE ELSE 1 END), 6) AS surprise FROM w JOIN n a ON a.id = src JOIN n b ON b.id = dst")
def surprise_scores(spark, t):
    n = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))
    rows = weighted(t).join(n.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
    return rows.select("src", "dst", r6(graph.surprise(F.col("weight"), F.col("a"), F.col("b"), F.col("a"), F.col("b"))).alias("surprise"))


@query(f"WITH {C_BLOCKS} SELECT id, tier FROM b WHERE NOT (lower(content) LIKE '%signup%' OR lower(label) LIKE '%signup%' OR len(list_filter(tags, lambda x: lower(x) LIKE '%signup%')) > 0)")
def memory_forget(spark, t):
    return memory.forget(blocks(t).withColumn("id", F.col("id").cast("string")), "signup").select(F.col("id").cast("long").alias("id"), "tier")


@query(f"WITH {C_BLOCKS} SELECT id, CAST(conflicts + CASE WHEN tier = 'long' AND {_clash('one should not use click')} THEN 1 ELSE 0 END AS INTEGER) AS conflicts FROM b")
def memory_remember_conflicts(spark, t):
    rows = memory.remember(blocks(t).withColumn("id", F.col("id").cast("string")), "one should not use click", "rule", now())
    return rows.where("label <> 'rule'").select(F.expr("try_cast(id AS BIGINT)").alias("id"), "conflicts")


@query(f"WITH {C_BLOCKS} SELECT id, CASE WHEN id % 3 = 0 THEN 'long' ELSE tier END AS tier FROM b")
def memory_promote(spark, t):
    return memory.promote(blocks(t), blocks(t).where("id % 3 = 0").select("id"), "long", now()).select("id", "tier")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 5 = 0")
def passage_point_lookup(spark, t):
    return search.lookup(nodes(t), t("customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"))).select("id", "name")


@query("SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(DISTINCT source) FROM documents) AS sources")
def passage_counts(spark, t):
    return t("documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@query("SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE r = n")
def conversation_latest_turn(spark, t):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t("conversations").withColumn("r", F.row_number().over(w)).where("r = 1").select("conv_id", "role", "text")
