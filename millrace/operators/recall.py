"""One recall over memory blocks, the graph and the passages, and one ingest into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import block_id

LAYERS = ("blocks", "graph", "vector")

#: Words that send a question to a skill, the most specific skill first.
SKILLS = {
    "code-analysis": ["callers", "callees", "impact", "dependency", "graph", "bağımlılık", "who calls", "call graph", "depends on", "references", "symbol"],
    "memory-management": ["remember", "forget", "recall", "hatırla", "unut", "bellek", "store this", "note this", "save this", "block"],
    "semantic-search": ["search", "find", "ara", "bul", "look for", "grep", "locate", "where is", "similar to"],
    "ask-rag": ["ask", "explain", "how", "why", "what", "describe", "sor", "anlat", "nasıl", "neden", "tell me", "summarize", "özetle"],
}


def layers(wanted: list[str] | None) -> set[str]:
    """The layers asked for; all of them where none is named."""
    return set(wanted) & set(LAYERS) if wanted else set(LAYERS)


def recall(blocks: DataFrame, edges: DataFrame, hits: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(layer, key, text, score, tier, created_at): found blocks (id, tier, content, created_at), edges (src, type, dst) and hits (source, content, score)."""
    none = lambda kind: F.lit(None).cast(kind)
    parts = {
        "blocks": blocks.select(F.lit("blocks").alias("layer"), F.col("id").cast("string").alias("key"), F.col("content").alias("text"), none("double").alias("score"), "tier", F.col("created_at").cast("timestamp").alias("created_at")),
        "graph": edges.select(F.lit("graph").alias("layer"), F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("key"), F.format_string("%s -[%s]-> %s", F.col("src").cast("string"), "type", F.col("dst").cast("string")).alias("text"), none("double").alias("score"), none("string").alias("tier"), none("timestamp").alias("created_at")),
        "vector": hits.select(F.lit("vector").alias("layer"), F.col("source").alias("key"), F.col("content").alias("text"), F.col("score").cast("double").alias("score"), none("string").alias("tier"), none("timestamp").alias("created_at")),
    }
    out = None
    for name in LAYERS:
        if name in layers(wanted):
            out = parts[name] if out is None else out.unionByName(parts[name])
    return out


def render(found: DataFrame) -> str:
    """The text of a recall for a prompt: facts, relationships, documents. The caller has limited it, so it is small."""
    by = {name: found.where(F.col("layer") == name) for name in LAYERS}
    out = ["<memory_context>"]
    facts = by["blocks"].orderBy(F.desc("created_at"), "key").select(F.format_string("- [%s] (%s) %s", "tier", F.date_format("created_at", "yyyy-MM-dd"), "text")).collect()
    ties = by["graph"].orderBy("text").select(F.concat(F.lit("- "), "text")).collect()
    documents = by["vector"].orderBy(F.desc("score"), "key").collect()
    out += ["<facts>", *(r[0] for r in facts), "</facts>"] if facts else []
    out += ["<relationships>", *(r[0] for r in ties), "</relationships>"] if ties else []
    if documents:
        out.append("<relevant_documents>")
        out += [f"--- Document {i} (score: {r.score:.2f}, source: {r.key}) ---\n{r.text}" for i, r in enumerate(documents, 1)]
        out.append("</relevant_documents>")
    return "\n".join([*out, "</memory_context>"])


def ingested_facts(facts: DataFrame, at: Column, project: str = "") -> DataFrame:
    """Long-term blocks (id, tier, label, content, tags, scope, created_at) of facts (label, content, tags); the project is their scope."""
    return facts.select(block_id(F.col("content"), F.col("label"), at).alias("id"), F.lit("long").alias("tier"), "label", "content", "tags", F.lit(project).alias("scope"), at.alias("created_at"))


def ingested_relations(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id) and edges (src, dst, type, weight) of relations (src, dst, type, weight); a missing or zero weight is 1."""
    ends = relations.select(F.col("src").alias("id")).union(relations.select("dst")).where("id is not null").distinct()
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    return ends, relations.groupBy("src", "dst", "type").agg(F.max(weight).alias("weight"))


def _heads_in(keys: list[str]):
    heads = F.array(*[F.lit(k[:3]) for k in keys])
    return lambda n, w: n + F.size(F.filter(heads, lambda h: F.contains(w, h)))


def route(question: Column) -> Column:
    """The skill that a question goes to: the first with a keyword in it, else the one with most words that hold the first three letters of a keyword, else ask-rag."""
    q = F.lower(question)
    words = F.filter(F.split(q, r"\s+"), lambda w: F.octet_length(w) >= 3)
    direct, scored = F.lit(None).cast("string"), []
    for name, keys in SKILLS.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | q.contains(k)
        direct = F.coalesce(direct, F.when(hit, name))
        scored.append((name, F.aggregate(words, F.lit(0), _heads_in(keys))))
    best = F.greatest(*[t for _, t in scored])
    fallback = F.lit("ask-rag")
    for name, total in reversed(scored):
        fallback = F.when((total == best) & (best > 0), name).otherwise(fallback)
    return F.coalesce(direct, fallback)
