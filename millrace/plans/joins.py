"""Registered queries over document joins, unified recall, conversations, memory upkeep and graph exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import bm25, conversations, documents, incremental, memory, recall
from millrace.plans.queries import C_BLOCKS, C_EDGES, C_TOKENS, blocks, edges, index, lexical, nodes, now, passages, query, weighted
from millrace.session import shared_dir
from millrace.sources import sinks
from millrace.streaming import pipelines


def symbols(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("function", "method", "class", "import")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t("part").select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_brand", F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("fqn"), kind.alias("kind"))


def declares(t):
    return t("part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("id"))


def calls(t):
    return t("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


C_SYMBOLS = "s AS (SELECT p_partkey AS id, p_brand || '.' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS fqn, ['function','method','class','import'][p_partkey % 4 + 1] AS kind, p_brand AS path FROM part), c AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"


@query(f"WITH {C_SYMBOLS} SELECT path, id, fqn, kind FROM s WHERE path LIKE '%1'")
def symbols_in_files(spark, t):
    return documents.symbols_in_files(declares(t), symbols(t), declares(t).where("path LIKE '%1'"))


@query(f"WITH {C_SYMBOLS} SELECT id, fqn, kind FROM s WHERE kind IN ('function', 'method')")
def symbol_types(spark, t):
    return documents.of_types(symbols(t), "functions")


@query(f"WITH {C_SYMBOLS} SELECT DISTINCT n_name AS document, s.id, fqn, kind FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN s ON s.id = l_partkey")
def document_symbols(spark, t):
    sections = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("document"), F.col("c_custkey").alias("section"))
    chunks = t("orders").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("chunk"))
    return documents.document_symbols(sections, chunks, t("lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("id")), symbols(t))


def _documents(t):
    return t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("vpath"), F.upper("n_name").alias("title"), F.when(F.col("n_regionkey") < 3, F.col("n_regionkey")).alias("folder_id"))


def _folders(t):
    return t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


@query("SELECT n_nationkey AS id, n_name AS vpath, coalesce(r_name, '') AS folder FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND n_regionkey < 3")
def document_context(spark, t):
    return documents.document_context(_documents(t), _folders(t)).select("id", "vpath", "folder")


@query("SELECT o_custkey AS document, string_agg(o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey")
def full_documents(spark, t):
    return documents.full_documents(t("orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderpriority").alias("content")))


@query(f"""WITH {C_SYMBOLS}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY fqn) AS r FROM s) WHERE r <= 5),
 o AS (SELECT p.id, list(DISTINCT x.fqn ORDER BY x.fqn) AS l FROM p JOIN c ON c.src = p.id JOIN s x ON x.id = c.dst GROUP BY p.id),
 i AS (SELECT p.id, list(DISTINCT x.fqn ORDER BY x.fqn) AS l FROM p JOIN c ON c.dst = p.id JOIN s x ON x.id = c.src GROUP BY p.id),
 k AS (SELECT path, p.fqn || '|' || coalesce(array_to_string(o.l, ','), '') || '|' || coalesce(array_to_string(i.l, ','), '') AS line FROM p LEFT JOIN o USING (id) LEFT JOIN i USING (id) WHERE o.l IS NOT NULL OR i.l IS NOT NULL)
 SELECT p_partkey AS id, p_brand AS source, (SELECT string_agg(line, ';' ORDER BY line) FROM k WHERE k.path = p_brand) AS symbols, CAST(NULL AS VARCHAR) AS folder FROM part
 UNION ALL SELECT -n_nationkey - 1, n_name, NULL, CASE WHEN n_regionkey < 3 THEN r_name ELSE '' END FROM nation JOIN region ON r_regionkey = n_regionkey""")
def graph_context(spark, t):
    results = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source")).unionByName(t("nation").select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.col("n_name").alias("source")))
    found = documents.with_graph_context(results, _documents(t), _folders(t), declares(t), symbols(t), calls(t))
    lines = F.transform("symbols", lambda s: F.concat_ws("|", s["fqn"], F.array_join(s["callees"], ","), F.array_join(s["callers"], ",")))
    return found.select("id", "source", F.array_join(F.array_sort(lines), ";").alias("symbols"), F.col("document.folder").alias("folder"))


@query(f"""WITH {C_SYMBOLS}, p AS (SELECT * FROM s WHERE lower(fqn) LIKE '%0001%' ORDER BY fqn, id LIMIT 5)
 SELECT id, fqn, coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT x.fqn AS f FROM c JOIN s x ON x.id = c.dst WHERE c.src = p.id ORDER BY f LIMIT 10)), '') AS callees,
 coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT x.fqn AS f FROM c JOIN s x ON x.id = c.src WHERE c.dst = p.id ORDER BY f LIMIT 10)), '') AS callers FROM p""")
def symbol_navigation(spark, t):
    return documents.navigate(symbols(t), calls(t), "0001").select("id", "fqn", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey >= 5 THEN n_nationkey % 5 END AS parent_id FROM nation")
def section_parents(spark, t):
    ties = t("nation").where("n_nationkey >= 5").select((F.col("n_nationkey") % 5).alias("src"), F.col("n_nationkey").alias("dst"), F.lit("HAS_SUBSECTION").alias("type"))
    other = ties.select((F.col("src") + 1).alias("src"), "dst", F.lit("HAS_SECTION").alias("type"))
    return documents.with_parents(t("nation").select(F.col("n_nationkey").alias("id")), ties.unionByName(other))


@query("SELECT c_custkey AS id, n_name AS vpath FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1")
def document_delete(spark, t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("vpath"))
    return documents.without_document(rows, t("nation").where("n_regionkey = 1").select(F.col("n_name").alias("vpath")))


@query(f"WITH {C_EDGES} SELECT src, dst, 1.0::DOUBLE AS weight FROM d UNION ALL SELECT c_custkey, CAST(c_nationkey AS BIGINT), 0.3::DOUBLE FROM customer UNION ALL SELECT dst, src, 0.8::DOUBLE FROM d WHERE src < 10")
def relation_weights(spark, t):
    d = edges(t).distinct()
    own = t("customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return documents.weighted_relations(d, own, d.where("src < 10").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("SELECT doc_id AS id, lang, source, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'page ' || doc_id END, 'none') AS page FROM documents")
def provenance_merge(spark, t):
    rows = documents.with_provenance(passages(t), {"page": F.when(F.col("id") % 2 == 0, F.concat(F.lit("page "), F.col("id").cast("string"))), "lang": F.lit("")})
    return rows.select("id", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"), F.coalesce(F.col("metadata")["page"], F.lit("none")).alias("page"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'example.org/' || n_name ELSE n_name END AS module FROM nation")
def module_names(spark, t):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("// a\nmodule example.org/"), F.col("n_name"), F.lit("\n\ngo 1.22\n"))).otherwise(F.lit("go 1.22\n"))
    return t("nation").select(F.col("n_nationkey").alias("id"), documents.module_of(text, F.concat(F.lit("/src/"), F.col("n_name"), F.lit("/"))).alias("module"))


# --- one recall over all layers --------------------------------------------------------------------------------------


@query(f"""WITH {C_BLOCKS}, {C_EDGES}, {C_TOKENS}, h AS (SELECT id, round(score, 6) AS score FROM s WHERE qid = 0 ORDER BY round(score, 6) DESC, id LIMIT 10)
 SELECT 'blocks' AS layer, CAST(id AS VARCHAR) AS key, CAST(NULL AS DOUBLE) AS score, content AS text FROM b WHERE contains(content, 'not use click')
 UNION ALL SELECT 'graph', src || '>' || dst, NULL, src || ' -[LINKS]-> ' || dst FROM d WHERE src = 7 UNION ALL SELECT 'vector', CAST(id AS VARCHAR), score, NULL FROM h""")
def unified_recall(spark, t):
    hits = index(spark, t).score(lexical(t).where("qid = 0")).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(10)
    hits = hits.select(F.col("id").cast("string").alias("source"), F.lit(None).cast("string").alias("content"), "score")
    found = recall.recall(memory.search(blocks(t), "not use click"), edges(t).distinct().where("src = 7").withColumn("type", F.lit("LINKS")), hits)
    return found.select("layer", "key", "score", "text")


@query(f"WITH {C_EDGES} SELECT id, CAST(NULL AS BIGINT) AS dst, CAST(NULL AS DOUBLE) AS weight FROM (SELECT src AS id FROM w UNION SELECT dst FROM w) UNION ALL SELECT src, dst, CASE WHEN src % 3 = 0 THEN 1 ELSE weight END FROM w")
def relation_ingest(spark, t):
    rows = weighted(t).withColumn("type", F.lit("LINKS")).withColumn("weight", F.when(F.col("src") % 3 == 0, F.when(F.col("src") % 2 == 0, 0.0)).otherwise(F.col("weight")))
    entities, ties = recall.ingested_relations(rows)
    return entities.select("id", F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("weight")).unionByName(ties.select(F.col("src").alias("id"), "dst", "weight"))


@query("SELECT p_partkey AS id, 'p1' AS scope, 'long' AS tier, p_name AS content FROM part")
def fact_ingest(spark, t):
    facts = t("part").select(F.col("p_brand").alias("label"), F.concat_ws("#", F.col("p_partkey").cast("string"), "p_name").alias("content"), F.array("p_type").alias("tags"))
    rows = recall.ingested_facts(facts, now(), "p1")
    return rows.select(F.split("content", "#")[0].cast("long").alias("id"), "scope", "tier", F.split("content", "#")[1].alias("content"))


@query("SELECT event_id, ['code-analysis', 'memory-management', 'semantic-search', 'ask-rag', 'semantic-search', 'ask-rag'][event_id % 6 + 1] AS skill FROM events")
def skill_routing(spark, t):
    asked = F.element_at(F.array(*[F.lit(x) for x in ("Who calls this function", "please remember the date", "Find all of it", "Explain it", "a seaside town", "xyz")]), (F.col("event_id") % 6 + 1).cast("int"))
    return t("events").select("event_id", recall.route(asked).alias("skill"))


# --- conversations and memory ----------------------------------------------------------------------------------------


@query("""SELECT conv_id, count(*) AS messages, CASE WHEN strlen(first(text ORDER BY CASE WHEN role = 'user' THEN turn END NULLS LAST)) >= 0 THEN true END AS known FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0""")
def conversation_save(spark, t):
    ties = t("conversations").select("conv_id").distinct().withColumn("indexes", F.array(F.lit("docs"), F.lit("code")))
    rows = conversations.saved(t("conversations"), ties, now()).where("title is not null")
    counted = F.size(F.from_json("messages", "array<struct<role:string,content:string>>")).cast("long")
    return rows.select("conv_id", counted.alias("messages"), (F.length("id") == 40).alias("known"))


@query("SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id <> (SELECT min(conv_id) FROM conversations)")
def conversation_delete(spark, t):
    rows = t("conversations").select("conv_id").distinct().select("conv_id", F.lpad(F.col("conv_id").cast("string"), 9, "0").alias("id"), F.lit("t").alias("title"), now().alias("updated_at"))
    least = rows.agg(F.min("id").alias("i")).first().i
    return conversations.deleted(rows, least).select("conv_id")


@query(f"WITH {C_BLOCKS} SELECT id, tier FROM b WHERE tier <> 'short'")
def memory_clear_tier(spark, t):
    return memory.clear_tier(blocks(t), "short").select("id", "tier")


@query(f"WITH {C_BLOCKS} SELECT id FROM b WHERE sec >= now - 20 * 86400")
def summaries_older_gone(spark, t):
    return memory.older_gone(blocks(t), now(), 20).select("id")


@query(f"WITH {C_BLOCKS} SELECT id, left(content, CASE WHEN id % 2 = 0 THEN 8 ELSE 20 END) AS content FROM b")
def memory_char_limits(spark, t):
    return memory.limited(blocks(t).withColumn("char_limit", F.when(F.col("id") % 2 == 0, 8)), 20).select("id", "content")


@query("SELECT DISTINCT user_id, event_type FROM events")
def memo_record(spark, t):
    rows = t("events").select(F.col("user_id").cast("string").alias("text_hash"), F.col("event_type").alias("model"), F.lit("s").alias("source"))
    half = rows.where("model IN ('click', 'view')").distinct()
    return incremental.memo_record(half, rows).select(F.col("text_hash").cast("long").alias("user_id"), F.col("model").alias("event_type"))


@query("SELECT event_id AS id FROM events WHERE NOT (event_id % 3 = 0 AND floor(epoch(ts)) < epoch(TIMESTAMP '2024-02-01 00:00:00') - 20 * 86400)")
def task_cleanup(spark, t):
    rows = t("events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "COMPLETED").otherwise("RUNNING").alias("status"), F.col("ts").cast("timestamp").alias("updated_at"))
    return incremental.tasks_left(rows, now(), 20).select("id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'deep' ELSE 'top' END AS index FROM documents WHERE doc_id % 3 < 2")
def change_index_mapping(spark, t):
    path = F.concat(F.element_at(F.array(F.lit("/a/b/"), F.lit("/a/"), F.lit("/z/")), (F.col("doc_id") % 3 + 1).cast("int")), F.col("doc_id").cast("string"))
    roots = spark.createDataFrame([("top", "/a/"), ("deep", "/a/b/")], "index string, root string")
    return incremental.index_of_paths(t("documents").select("doc_id", path.alias("path")), roots).select("doc_id", "index")


@query("SELECT user_id AS index, floor(epoch(ts) / 5) * 5 AS start, count(DISTINCT event_type) AS files FROM events GROUP BY ALL")
def pending_changes(spark, t):
    rows = t("events").select(F.col("user_id").alias("index"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return pipelines.pending(rows).select("index", F.unix_timestamp("start").cast("double").alias("start"), "files")


@query("SELECT event_type AS topic, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events WHERE event_type = 'click' GROUP BY ALL")
def event_bus(spark, t):
    path = f"{shared_dir(spark)}/millrace-topics-{uuid.uuid4().hex}"
    pipelines.published(t("events").select(F.col("event_type").alias("topic"), F.struct("user_id", "event_id").alias("payload")), path)
    got = spark.read.parquet(path).where("topic = 'click'").select("topic", F.from_json("payload", "map<string,string>").alias("payload"))
    return got.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("payload")["user_id"].cast("long")).alias("users"))


# --- exports and indexes ---------------------------------------------------------------------------------------------


@query(f"WITH {C_EDGES} SELECT 'nodes' AS name, count(*) AS n FROM customer UNION ALL SELECT 'edges', count(*) FROM d")
def graph_csv_export(spark, t):
    """What the CSV folders hold when read back."""
    path = f"{shared_dir(spark)}/millrace-csv-{uuid.uuid4().hex}"
    sinks.graph_csv({"nodes": nodes(t), "edges": edges(t).distinct()}, path)
    back = [spark.read.option("header", True).csv(f"{path}/{name}").select(F.lit(name).alias("name")) for name in ("nodes", "edges")]
    return back[0].unionByName(back[1]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {C_EDGES}, l AS (SELECT c_custkey AS id, c_nationkey AS community FROM customer), o AS (SELECT a.community, count(*) AS o FROM d JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE a.community <> b.community GROUP BY ALL) SELECT community, '# Community ' || community || chr(10) || chr(10) || count(*) || ' members, ' || coalesce(max(o), 0) || ' edges to others' || chr(10) || chr(10) || array_to_string(list_transform(list_slice(list_sort(list(DISTINCT c_name)), 1, 10), lambda x: '- ' || x), chr(10)) AS article FROM customer JOIN l ON id = c_custkey LEFT JOIN o USING (community) GROUP BY community")
def wiki_articles(spark, t):
    members = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("community"))
    return sinks.wiki(members, edges(t).distinct())


@query(f"WITH {C_EDGES}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT 'What depends on ' || c_name || ', and why do ' || degree || ' edges meet there?' AS question FROM g JOIN customer ON c_custkey = id ORDER BY degree DESC, c_name LIMIT 3")
def suggested_questions(spark, t):
    from millrace.operators import graph

    return documents.suggested_questions(graph.degrees(edges(t)).join(nodes(t), "id").select("name", "degree"))


@query(f"WITH {C_TOKENS} SELECT qid, id, score, rank FROM (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s) WHERE rank <= 3")
def bm25_append(spark, t):
    """An index built from half the passages and appended the rest, twice, gives what one built from all gives."""
    path = f"{shared_dir(spark)}/millrace-bm25-{uuid.uuid4().hex}"
    built = bm25.Index.build(passages(t).where("id % 2 = 0"), path, 4)
    built.append(passages(t))
    built.append(passages(t).where("id % 3 = 0"))
    return bm25.top_k(built.score(lexical(t)).withColumn("score", F.round("score", 6)), 3)


@query("SELECT true AS dropped, false AS again")
def index_drop(spark, t):
    root = f"{shared_dir(spark)}/millrace-drop-{uuid.uuid4().hex}"
    sinks.write_index(passages(t).select("id", "text"), f"{root}/one", {"name": "one"})
    first, again = sinks.drop_index(spark, root, "one"), sinks.drop_index(spark, root, "one")
    return spark.range(1).select(F.lit(first).alias("dropped"), F.lit(again).alias("again"))
