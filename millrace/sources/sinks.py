"""Writers: index tables, graph files and reports."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(passages: DataFrame, path: str, meta: dict, mode: str = "overwrite") -> None:
    """passages as Parquet with a one-row catalog table beside it."""
    passages.write.mode(mode).parquet(f"{path}/passages")
    spark = passages.sparkSession
    row = meta | {"num_passages": spark.read.parquet(f"{path}/passages").count()}
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row for each index below root: name, num_passages and the rest of its meta data."""
    rows = spark.read.text(f"{root}/*/meta").select(F.regexp_extract(F.input_file_name(), r"([^/]+)/meta/", 1).alias("name"), "value")
    return rows.select("name", F.get_json_object("value", "$.num_passages").cast("long").alias("num_passages"), F.col("value").alias("meta"))


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a GraphML file (line), nodes before edges, each sorted; write them with one sorted output."""
    spark = nodes.sparkSession
    fixed = [(0, "", '<?xml version="1.0" encoding="UTF-8"?>'), (1, "", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (9, "", "</graph></graphml>")]
    n = nodes.select(F.lit(2).alias("part"), F.lpad(F.col("id").cast("string"), 20, "0").alias("key"), F.format_string('<node id="%s"><data key="name">%s</data></node>', F.col("id").cast("string"), _xml(F.col("name"))).alias("line"))
    e = edges.select(F.lit(3).alias("part"), F.concat(F.lpad(F.col("src").cast("string"), 20, "0"), F.lpad(F.col("dst").cast("string"), 20, "0")).alias("key"), F.format_string('<edge source="%s" target="%s"/>', F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))
    return spark.createDataFrame(fixed, "part int, key string, line string").unionByName(n).unionByName(e).orderBy("part", "key").select("line")


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MERGE statements (line), nodes before edges."""
    quoted = F.replace(F.replace("name", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    n = nodes.select(F.lit(0).alias("part"), F.format_string("MERGE (n:Node {id: '%s'}) SET n.name = '%s';", F.col("id").cast("string"), quoted).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.format_string("MATCH (a:Node {id: '%s'}), (b:Node {id: '%s'}) MERGE (a)-[:LINKS]->(b);", F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))
    return n.unionByName(e).orderBy("part", "line").select("line")


def html_graph(nodes: DataFrame, edges: DataFrame, degrees: DataFrame, limit: int = 500) -> str:
    """A page with the ``limit`` nodes of largest degree and the edges among them; sizes are min(8 + 2 * degree, 40)."""
    best = nodes.join(degrees.select("id", "degree"), "id").orderBy(F.desc("degree"), "id").limit(limit)
    shown = [{"id": r.id, "label": r.name, "size": min(8 + 2 * r.degree, 40)} for r in best.collect()]
    ids = best.select("id")
    inner = edges.join(F.broadcast(ids.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "dst")), "dst", "left_semi").distinct()
    links = [{"from": r.src, "to": r.dst} for r in inner.select("src", "dst").orderBy("src", "dst").collect()]
    data = json.dumps({"nodes": shown, "edges": links}).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>Graph</title><div id="graph"></div><script>const graph = {data};</script>'


def report(sizes: DataFrame, hubs: DataFrame, surprising: DataFrame, modularity: float) -> str:
    """A markdown summary of hubs, communities and edges between them, with questions they suggest. All inputs are top-k tables."""
    out = ["# Graph report", f"Modularity: {modularity:.4f}", "## Hubs"]
    hub = hubs.collect()
    out += [f"- {r.id}: degree {r.degree}" for r in hub]
    out.append("## Communities")
    out += [f"- {r.community}: {r.n} nodes" for r in sizes.orderBy(F.desc("n"), "community").limit(20).collect()]
    out.append("## Edges between communities")
    far = surprising.collect()
    out += [f"- {r.src} -> {r.dst} ({r.weight:g})" for r in far]
    out.append("## Questions")
    out += [f"- What depends on {r.id}, and what would a change there affect?" for r in hub[:3]]
    out += [f"- Why does {r.src} depend on {r.dst} in another community?" for r in far[:3]]
    return "\n".join(out)


def signature(secret: str, payload: bytes) -> str:
    return "sha256=" + hmac.new(secret.encode(), payload, hashlib.sha256).hexdigest()


def webhooks(events: DataFrame, hooks: list[dict]) -> DataFrame:
    """(url, event, payload) for each event (event, payload) and hook ({url, events}) that names it or '*'."""
    known = events.sparkSession.createDataFrame([(h["url"], e) for h in hooks for e in h["events"]], "url string, wanted string")
    return events.join(F.broadcast(known), (F.col("wanted") == F.col("event")) | (F.col("wanted") == "*")).select("url", "event", "payload").distinct()


def metrics(counters: DataFrame) -> DataFrame:
    """Lines of the text exposition format from (name, n, total_ms)."""
    return counters.select(F.explode(F.array(F.format_string("%s_total %d", "name", "n"), F.format_string("%s_avg_ms %.3f", "name", F.when(F.col("n") > 0, F.col("total_ms") / F.col("n")).otherwise(0.0)))).alias("line"))


def drop_index(spark: SparkSession, root: str, name: str) -> bool:
    """Remove the folder of an index below root, with what belongs to it; False if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def graph_csv(tables: dict[str, DataFrame], path: str) -> None:
    """Nodes and edges as CSV folders with headers, one for each name (files, symbols, declares, calls, folders, documents, headings)."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def wiki(members: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(community, article): markdown of each community of members (id, name, community): its size, first names and edges to others."""
    a, b = members.select(F.col("id").alias("src"), F.col("community")), members.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    out = edges.join(a, "src").join(b, "dst").where("community <> other").groupBy("community").agg(F.count(F.lit(1)).alias("outward"))
    names = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("name")), 1, most).alias("names"))
    rows = names.join(out, "community", "left")
    article = F.concat(F.format_string("# Community %d\n\n%d members, %d edges to others\n\n", "community", "n", F.coalesce("outward", F.lit(0))), F.array_join(F.transform("names", lambda x: F.concat(F.lit("- "), x)), "\n"))
    return rows.select("community", article.alias("article"))
