"""Tiered memory records: id, tier, label, content, tags, scope, created_at, updated_at, last_accessed_at, expires_at, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalars import block_id, expired, stale, validity

#: Pairs of phrases that negate each other.
NEGATIONS = [("is not", "is"), ("should not", "should"), ("does not", "does"), ("cannot", "can"), ("never", "always"), ("disable", "enable"), ("false", "true"), ("deprecated", "recommended"), ("removed", "added"), ("don't", "do")]


def live(blocks: DataFrame, now: Column) -> DataFrame:
    return blocks.where(~expired(F.col("expires_at"), now))


def in_scope(scope: str) -> Column:
    return F.lit(True) if not scope else F.coalesce(F.col("scope"), F.lit("")).isin("", scope)


def search(blocks: DataFrame, query: str, scope: str = "") -> DataFrame:
    """Blocks with the whole query in content, label or a tag, in any case."""
    q = query.lower()
    hit = F.lower("content").contains(q) | F.lower("label").contains(q) | F.exists("tags", lambda t: F.lower(t).contains(q))
    return blocks.where(F.coalesce(hit, F.lit(False)) & in_scope(scope))


def with_tags(blocks: DataFrame, tags: list[str]) -> DataFrame:
    wanted = F.array(*[F.lit(t.lower()) for t in tags]) if tags else F.array().cast("array<string>")
    return blocks.where(F.size(F.array_except(wanted, F.transform("tags", F.lower))) == 0)


def recall(blocks: DataFrame, k: int, now: Column, tier: str | None = None, tags: list[str] | None = None, after=None, before=None) -> DataFrame:
    rows = live(blocks, now)
    rows = rows.where(F.col("tier") == tier) if tier else rows
    rows = with_tags(rows, tags) if tags else rows
    rows = rows.where(F.col("created_at") >= after) if after is not None else rows
    rows = rows.where(F.col("created_at") <= before) if before is not None else rows
    return rows.orderBy(F.desc("created_at"), "id").limit(k)


def contradicts(old: Column, new: Column) -> Column:
    """A pair of negating phrases, one in each, and a common word of more than four bytes. Phrases are found anywhere in the text."""
    o, n = F.lower(old), F.lower(new)
    clash = F.lit(False)
    for a, b in NEGATIONS:
        clash = clash | (o.contains(a) & n.contains(b)) | (o.contains(b) & n.contains(a))
    long = lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.octet_length(w) > 4)
    return clash & F.arrays_overlap(long(o), long(n))


def contradictions(blocks: DataFrame, content: str) -> DataFrame:
    """Long-term blocks that the new content contradicts."""
    return blocks.where((F.col("tier") == "long") & contradicts(F.col("content"), F.lit(content)))


def remember(blocks: DataFrame, content: str, label: str, at: Column, tags: list[str] = ()) -> DataFrame:
    """blocks with the new long-term block, and one more conflict for each block that it contradicts."""
    hit = (F.col("tier") == "long") & contradicts(F.col("content"), F.lit(content))
    marked = blocks.withColumn("conflicts", F.col("conflicts") + F.coalesce(hit, F.lit(False)).cast("int"))
    new = {"id": block_id(F.lit(content), F.lit(label), at), "tier": F.lit("long"), "label": F.lit(label), "content": F.lit(content), "tags": F.array(*[F.lit(t) for t in tags]).cast("array<string>"), "created_at": at, "updated_at": at, "conflicts": F.lit(0)}
    row = blocks.sparkSession.range(1).select(*[new[c].alias(c) for c in new if c in blocks.columns])
    return marked.unionByName(row, allowMissingColumns=True)


def forget(blocks: DataFrame, what: str) -> DataFrame:
    """blocks without the one of that id, or else without those that the text finds."""
    if blocks.where(F.col("id") == what).limit(1).count():
        return blocks.where(F.col("id") != what)
    return blocks.join(search(blocks, what).select("id"), "id", "left_anti")


def stats(blocks: DataFrame, now: Column) -> DataFrame:
    """(tier, n) of live blocks, and their total as tier 'all'."""
    counted = live(blocks, now).rollup("tier").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.coalesce("tier", F.lit("all")).alias("tier"), "n")


def scored(blocks: DataFrame, now: Column) -> DataFrame:
    """blocks with their validity: age runs from the last update or access."""
    last = F.greatest("updated_at", F.coalesce("last_accessed_at", "updated_at"))
    age = (F.unix_timestamp(now) - F.unix_timestamp(last)) / 86400.0
    return blocks.withColumn("validity", validity(F.col("confirms"), F.col("conflicts"), age, F.col("accesses")))


def stale_blocks(blocks: DataFrame, now: Column) -> DataFrame:
    return blocks.where(stale(F.col("tier"), F.greatest("updated_at", F.coalesce("last_accessed_at", "updated_at")), now))


def end_session(blocks: DataFrame, now: Column) -> DataFrame:
    """Live short-term blocks become medium; expired ones go."""
    return live(blocks, now).withColumn("tier", F.when(F.col("tier") == "short", "medium").otherwise(F.col("tier")))


def maintain(blocks: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Expired blocks go; medium blocks older than ``days`` become long."""
    old = F.unix_timestamp(now) - F.unix_timestamp("created_at") > days * 86400
    return live(blocks, now).withColumn("tier", F.when((F.col("tier") == "medium") & old, "long").otherwise(F.col("tier")))


def promote(blocks: DataFrame, ids: DataFrame, tier: str, now: Column) -> DataFrame:
    hit = blocks.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    touched = F.coalesce("_hit", F.lit(False))
    return hit.withColumn("tier", F.when(touched, tier).otherwise(F.col("tier"))).withColumn("updated_at", F.when(touched, now).otherwise(F.col("updated_at"))).drop("_hit")


def delete_older(blocks: DataFrame, tier: str, now: Column, days: float) -> DataFrame:
    return blocks.where(~((F.col("tier") == tier) & (F.unix_timestamp("created_at") < F.unix_timestamp(now) - days * 86400)))


def record_access(blocks: DataFrame, log: DataFrame) -> DataFrame:
    """blocks with accesses and last_accessed_at from a log (id, ts)."""
    seen = log.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_ts"))
    rows = blocks.join(seen, "id", "left")
    return rows.withColumn("accesses", F.col("accesses") + F.coalesce("_n", F.lit(0))).withColumn("last_accessed_at", F.greatest("last_accessed_at", "_ts")).drop("_n", "_ts")


def context(blocks: DataFrame, summaries: DataFrame, now: Column) -> str:
    """The text of all live blocks by tier, long first, with the five newest summaries. For a context window, so small by use."""
    out = []
    rows = live(blocks, now).orderBy("created_at", "id").select("tier", "label", "content").collect()
    for tier in ("long", "medium", "short"):
        if tier == "short":
            out += [f"<summary>{r.text}</summary>" for r in summaries.orderBy(F.desc("created_at")).limit(5).collect()]
        out += [f'<memory tier="{tier}" label="{r.label}">{r.content}</memory>' for r in rows if r.tier == tier]
    return "\n".join(out)


def labelled_lines(text: Column) -> Column:
    """(label, fact) of lines like 'preference: likes tea'."""
    lines = F.split(text, "\n")
    pattern = r"(?i)^\s*(preference|fact|decision|project|relationship)\s*:\s*(.+?)\s*$"
    hit = F.filter(lines, lambda x: x.rlike(pattern))
    return F.transform(hit, lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)).alias("label"), F.regexp_extract(x, pattern, 2).alias("fact")))


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def clear_tier(blocks: DataFrame, tier: str | None = None) -> DataFrame:
    """blocks without a tier, or none at all."""
    return blocks.where(F.col("tier") != tier) if tier else blocks.limit(0)


def older_gone(rows: DataFrame, now: Column, days: float, at: str = "created_at") -> DataFrame:
    """Summaries or conversations without those of an age beyond ``days``."""
    return rows.where(F.unix_timestamp(at) >= F.unix_timestamp(now) - days * 86400)


def lookup(blocks: DataFrame, block: str) -> DataFrame:
    """The block of that id; a short-term one goes before a stored one."""
    return blocks.where(F.col("id") == block).orderBy(F.when(F.col("tier") == "short", 0).otherwise(1)).limit(1)


def with_summary(summaries: DataFrame, conversation: str, text: str, at: Column) -> DataFrame:
    """summaries (key, conv_id, text, created_at) with one more; its key is the time and the conversation."""
    row = summaries.sparkSession.range(1).select(F.concat_ws("_", F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(conversation)).alias("key"), F.lit(conversation).alias("conv_id"), F.lit(text).alias("text"), at.alias("created_at"))
    return summaries.unionByName(row)


def limited(blocks: DataFrame, limit: int, enforce: bool = True) -> DataFrame:
    """blocks with char_limit where it is missing; content beyond it is cut if enforced."""
    bound = F.when(F.coalesce("char_limit", F.lit(0)) > 0, F.col("char_limit")).otherwise(F.lit(limit))
    rows = blocks.withColumn("char_limit", bound.cast("int"))
    return rows.withColumn("content", F.expr("left(content, char_limit)")) if enforce else rows
