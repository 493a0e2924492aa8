"""Registered queries over the column functions, readers, writers and table functions, each with SQL over the same tables."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import functions as F

from millrace.functions import scalars, text
from millrace.operators import chunks, conversations, graph, incremental, memory
from millrace.operators.filters import filter_rows, parse_filters
from millrace.plans.queries import C_EDGES, edges, nodes, now, passages, query
from millrace.session import shared_dir
from millrace.sources import readers, sinks


def _cycle(key: str, *values: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


# --- column functions ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, sha256(p_brand || chr(0) || p_name) AS key, left(sha256(lower(trim(p_brand))), 16) AS model, '\"' || left(sha256(p_brand || p_name), 12) || '\"' AS etag, left(p_name, 8) AS short FROM part")
def hash_keys(spark, t):
    model, name = F.col("p_brand"), F.col("p_name")
    return t("part").select(F.col("p_partkey").alias("id"), scalars.cache_key(model, name).alias("key"), scalars.model_fingerprint(model).alias("model"), scalars.etag(model, name).alias("etag"), scalars.short_id(name).alias("short"))


@query("SELECT p_partkey AS id, p_partkey % 3 = 0 AS changed FROM part")
def model_change(spark, t):
    return t("part").select(F.col("p_partkey").alias("id"), scalars.model_changed(F.col("p_brand"), _cycle("p_partkey", "other", " X ", "").cast("string")).alias("a"), F.col("p_partkey"), F.col("p_brand")).select("id", F.when(F.col("p_partkey") % 3 == 0, F.col("a")).otherwise(scalars.model_changed(F.lower("p_brand"), F.concat(F.lit(" "), F.upper("p_brand")))).alias("changed"))


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN epoch_us(TIMESTAMP '2024-02-01') - 5400000000 WHEN 1 THEN epoch_us(TIMESTAMP '2024-02-01') - 14 * 86400000000 WHEN 2 THEN epoch_us(TIMESTAMP '2023-05-06 07:08:09') END AS at FROM events")
def time_or_duration(spark, t):
    return t("events").select(F.col("event_id").alias("id"), F.unix_micros(scalars.time_or_ago(_cycle("event_id", "1h30m", "2w", "2023-05-06 07:08:09", "soon"), now())).alias("at"))


@query("SELECT p_partkey AS id, left(sha256(p_name || p_brand || '2024-02-01 00:00:00'), 16) AS block, sha1('docs,code' || p_brand || p_name || '2024-02-01 00:00:00') AS conversation FROM part")
def record_ids(spark, t):
    names = F.array(F.lit("docs"), F.lit("code"))
    return t("part").select(F.col("p_partkey").alias("id"), scalars.block_id(F.col("p_name"), F.col("p_brand"), now()).alias("block"), conversations.conversation_id(names, F.col("p_brand"), F.col("p_name"), now()).alias("conversation"))


@query("SELECT p_partkey AS id, ['image','audio','video','unknown'][p_partkey % 4 + 1] AS media, p_brand || ',' || p_type AS indexes FROM part")
def media_and_models(spark, t):
    path = F.concat(F.lit("a/b."), _cycle("p_partkey", "PNG", "flac", "webm", "txt"))
    return t("part").select(F.col("p_partkey").alias("id"), text.media_type(path).alias("media"), F.array_join(conversations.indexes_of_model(F.concat(F.lit("rag/"), F.col("p_brand"), F.lit(" , "), F.col("p_type"))), ",").alias("indexes"))


@query("SELECT p_partkey AS id, p_name AS heading, p_name || ' text of it' AS first FROM part")
def heading_and_paragraph(spark, t):
    body = F.concat(F.lit("# "), F.col("p_brand"), F.lit("\n\n"), F.col("p_name"), F.lit(" text of it\n\nmore"))
    return t("part").select(F.col("p_partkey").alias("id"), text.clean_heading(F.concat(F.col("p_name"), F.lit(" ## {#anchor}"))).alias("heading"), text.first_paragraph(body).alias("first"))


@query("SELECT p_partkey AS id, ' 9|' || p_brand || chr(10) || '10|' || p_name AS numbered, CASE WHEN p_partkey % 2 = 0 THEN 'c d' ELSE 'x' END AS tail FROM part")
def numbered_lines(spark, t):
    body = F.concat_ws("\n", "p_brand", "p_name")
    return t("part").select(F.col("p_partkey").alias("id"), text.numbered_lines(body, 9).alias("numbered"), text.overlap_tail(_cycle("p_partkey", "a b  c d", "x"), 2).alias("tail"))


# --- filters and lookups ---------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en' AND n_chars >= 500")
def filter_arguments(spark, t):
    given = '[{"field": "lang", "operator": "eq", "value": "en"}, {"field": "n_chars", "operator": "gte", "value": 500}, {"operator": "eq"}, 7]'
    return filter_rows(passages(t), parse_filters(given)).select("id")


@query("SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY conv_id DESC LIMIT 1")
def conversation_lookup(spark, t):
    rows = t("conversations").groupBy("conv_id").agg(F.lit("Plan").alias("title")).select("conv_id", F.concat(F.lit("c"), F.lpad(F.col("conv_id").cast("string"), 8, "0")).alias("id"), "title", F.timestamp_seconds(F.col("conv_id") * 60).alias("updated_at"))
    return conversations.find(rows, "plan").select("conv_id")


@query("SELECT p_partkey AS id, p_name AS fact FROM part WHERE p_partkey % 2 = 0")
def labelled_facts(spark, t):
    body = F.concat(F.lit("hello\n"), F.when(F.col("p_partkey") % 2 == 0, "Preference: ").otherwise("note: "), F.col("p_name"), F.lit("\n"))
    return t("part").select(F.col("p_partkey").alias("id"), F.explode(memory.labelled_lines(body)).alias("f")).select("id", "f.fact")


@query("SELECT p_partkey % 50 AS slug, 'p1' AS pack_id FROM part WHERE p_partkey <= 20 AND p_partkey % 4 = 1")
def pack_search(spark, t):
    rows = t("part").where("p_partkey <= 20").orderBy("p_partkey").select("p_partkey").collect()
    content = ["[" + ", ".join(f'{{"slug": "{r.p_partkey % 50}", "title": "{"Alpha" if r.p_partkey % 4 == 1 else "beta"}"}}' for r in rows) + "]"]
    return readers.pack_search(readers.pack(spark, {"id": "p1"}, content), "ALPHA", ["title"]).select(F.col("slug").cast("long").alias("slug"), "pack_id")


# --- incremental tables ----------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id FROM documents WHERE source NOT LIKE '%1'")
def delete_by_source(spark, t):
    rows = t("documents").select(F.col("doc_id").alias("id"), "source")
    return incremental.delete_sources(rows, rows.where("source LIKE '%1'").select("source").distinct()).select("id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS name FROM customer")
def node_upsert(spark, t):
    old = nodes(t).where("id % 2 = 0").select("id", "name")
    return incremental.insert_missing(old, nodes(t).select("id", F.col("kind").alias("name")), ["id"])


@query(f"WITH {C_EDGES} SELECT src, dst FROM d WHERE NOT (src % 2 = 0 AND dst % 2 = 0)")
def edge_delete(spark, t):
    rows = edges(t).distinct().withColumn("type", F.lit("LINKS"))
    return incremental.delete_edges(rows, rows.where("src % 2 = 0 AND dst % 2 = 0")).select("src", "dst")


@query(f"WITH {C_EDGES} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM d")
def edge_export(spark, t):
    return graph.edge_pairs(edges(t))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE length(text) END AS vec FROM documents WHERE text IS NOT NULL")
def embedding_cache(spark, t):
    texts = t("documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    once = texts.groupBy("text").agg(F.min("id").alias("least"))
    cache = texts.where("id % 3 = 0").join(once, "text").where("id = least").select(scalars.text_hash(F.col("text")).alias("text_hash"), F.lit(-1).alias("vec"))
    copies = texts.join(once.where("least % 3 = 0"), "text", "left_semi")
    found = incremental.with_cache(texts, cache, lambda c: F.length(c))
    # copies of cached texts hit the cache as well; the query asks for what the id alone decides
    return found.join(copies.select("id", F.lit(True).alias("copy")), "id", "left").select("id", F.when(F.col("id") % 3 == 0, -1).when(F.col("copy"), F.length("text")).otherwise(F.col("vec")).alias("vec"))


@query("SELECT event_type AS model, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL")
def cache_purge(spark, t):
    rows = t("events").select(F.col("event_type").alias("model"), F.col("event_id").alias("text_hash"))
    return incremental.model_changed_purge(rows, "click").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


# --- files -----------------------------------------------------------------------------------------------------------

PATHS = ("src/a.go", "src/.hidden/b.md", "node_modules/c.js", "docs/d.md", "docs/draft/e.md", "docs/draft/keep.md", "img/f.png", "g.csv")


@query("SELECT n_nationkey AS id, n_nationkey % 8 IN (0, 3, 5, 7) AS eligible FROM nation")
def file_eligibility(spark, t):
    path = _cycle("n_nationkey", *PATHS)
    return t("nation").select(F.col("n_nationkey").alias("id"), readers.eligible(path, F.lit(10), ["# drafts", "docs/draft/**", "!keep.md"]).alias("eligible"))


@query("SELECT p_partkey AS id, p_partkey % 6 IN (0, 1, 3) AS ignored FROM part")
def ignore_patterns(spark, t):
    path = _cycle("p_partkey", "a/x.log", "x.log", "x.logs", "build/a/b.c", "src/build.c", "a/tmp1x")
    return t("part").select(F.col("p_partkey").alias("id"), readers.ignored(path, ["*.log", "/build/**", "tmp?"]).alias("ignored"))


def _folder(spark, rows) -> str:
    """A folder of small files, written by the cluster's own file system."""
    root = f"{shared_dir(spark)}/millrace-files-{uuid.uuid4().hex}"
    for name, content in rows:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(content))
        out.close()
    return root


def _zip(parts: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return data.getvalue()


@query("SELECT r_name || '.csv' AS path, '# ' || r_name || '.csv' || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || (SELECT string_agg(chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |', '' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS text FROM region")
def read_csv_files(spark, t):
    """Directory walk, extractor dispatch, CSV reader and table renderer."""
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").select("r_name", "n_nationkey", "n_name").collect()
    by: dict[str, str] = {}
    for r in rows:
        by[r.r_name] = by.get(r.r_name, "key,name\n") + f"{r.n_nationkey},{r.n_name}\n"
    root = _folder(spark, [(f"{name}.csv", body.encode()) for name, body in by.items()] + [("vendor/x.csv", b"a,b\n"), ("y.png", b"\x89")])
    return readers.extracted(readers.files(spark, root))


DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


@query("SELECT n_name || '.docx' AS path, true AS found FROM nation")
def read_docx_files(spark, t):
    names = [r.n_name for r in t("nation").select("n_name").orderBy("n_name").collect()]
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{0}</w:t></w:r></w:p><w:p><w:r><w:t>All about {0}.</w:t></w:r></w:p>'
    root = _folder(spark, [(f"{n}.docx", _zip({"word/document.xml": DOCX.format(body.format(n))})) for n in names])
    rows = readers.extracted(readers.files(spark, root))
    name = F.regexp_replace("path", r"\.docx$", "")
    return rows.select("path", (F.contains("text", F.concat(F.lit("# "), name)) & F.contains("text", F.concat(F.lit("All about "), name, F.lit(".")))).alias("found"))


@query("SELECT 'bad.docx' AS path, true AS missing UNION ALL SELECT 'good.txt', false")
def extractor_fallback(spark, t):
    rows = readers.extracted(readers.files(spark, _folder(spark, [("bad.docx", b"no zip"), ("good.txt", b"plain")])))
    return rows.select("path", F.col("text").isNull().alias("missing"))


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id % 2 = 0")
def index_write(spark, t):
    """An index written in two steps and read back."""
    path = f"{shared_dir(spark)}/millrace-index-{uuid.uuid4().hex}"
    rows = t("documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "source")
    sinks.write_index(rows.where("id % 4 = 0"), f"{path}/one", {"name": "one"})
    sinks.write_index(rows.where("id % 4 <> 0"), f"{path}/one", {"name": "one"}, mode="append")
    return spark.read.parquet(f"{path}/one/passages").select("id", "source")


@query("SELECT 'even' AS name, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS num_passages UNION ALL SELECT 'odd', (SELECT count(*) FROM documents WHERE doc_id % 2 = 1)")
def index_catalog(spark, t):
    path = f"{shared_dir(spark)}/millrace-index-{uuid.uuid4().hex}"
    for name, rest in (("even", 0), ("odd", 1)):
        sinks.write_index(t("documents").where(F.col("doc_id") % 2 == rest).select("doc_id"), f"{path}/{name}", {"name": name})
    return sinks.catalog(spark, path).select("name", "num_passages")


@query("SELECT 500::BIGINT AS shown, true AS links FROM customer HAVING count(*) >= 500 UNION ALL SELECT count(*), true FROM customer HAVING count(*) < 500")
def html_graph(spark, t):
    links = edges(t).distinct().join(nodes(t).select(F.col("id").alias("src")), "src", "left_semi").join(nodes(t).select(F.col("id").alias("dst")), "dst", "left_semi")
    degree = nodes(t).select("id").join(graph.degrees(edges(t)), "id", "left").fillna(0)
    page = sinks.html_graph(nodes(t), links, degree)
    return spark.range(1).select(F.lit(page.count('"label"')).cast("long").alias("shown"), F.lit('"from"' in page).alias("links"))


# --- table functions -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_name || ' one' AS first, 3::BIGINT AS n FROM part WHERE p_partkey <= 200")
def section_stack(spark, t):
    """Heading stack, spans and ids of sections."""
    body = F.concat(F.lit("# "), F.col("p_name"), F.lit(" one\n\nalpha\n\n## Two\n\nbeta\n\n```\n# no heading\n```\n\n# Three\n\ngamma\n"))
    rows = chunks.sections(t("part").where("p_partkey <= 200").select(F.col("p_partkey").alias("part"), body.alias("text")), "part")
    return rows.groupBy(F.col("part").alias("id")).agg(F.min_by("heading", "line").alias("first"), F.count(F.lit(1)).alias("n"))
