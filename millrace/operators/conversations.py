"""Conversations as rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import cut


def history(turns: DataFrame, keep: int = 20) -> DataFrame:
    """The last ``keep`` turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def titles(turns: DataFrame, limit: int = 57) -> DataFrame:
    """(conv_id, title): the first user turn, cut."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(cut(F.min_by("text", "turn"), limit).alias("title"))


def summaries_fallback(turns: DataFrame) -> DataFrame:
    return titles(turns, 197).withColumnRenamed("title", "summary")


def transcripts(turns: DataFrame, limit: int = 500) -> DataFrame:
    """(conv_id, transcript): 'role: text' of the turns that aren't the system's, in order, each cut."""
    lines = turns.where("role <> 'system'").select("conv_id", "turn", F.concat_ws(": ", "role", F.substring("text", 1, limit)).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy("conv_id").agg(joined.alias("transcript"))


def previews(turns: DataFrame, n: int = 4, limit: int = 200) -> DataFrame:
    """The first n turns that aren't the system's, each cut."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.where("role <> 'system'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("conv_id", "turn", "role", F.substring("text", 1, limit).alias("text"))


def message_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("messages"))


def last_user(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def find(conversations: DataFrame, name: str) -> DataFrame:
    """The one of that id, else of an id with that prefix, else of that title in any case; the newest of several."""
    rank = F.when(F.col("id") == name, 0).when(F.startswith("id", F.lit(name)), 1).when(F.lower("title") == name.lower(), 2)
    return conversations.withColumn("_m", rank).where("_m is not null").orderBy("_m", F.desc("updated_at"), "id").limit(1).drop("_m")


def conversation_id(indexes: Column, title: Column, messages: Column, at: Column) -> Column:
    return F.sha1(F.concat_ws("", F.array_join(indexes, ","), title, messages, at.cast("string")).cast("binary"))


def indexes_of_model(model: Column) -> Column:
    """The index names in a model string of the form prefix/a,b."""
    return F.transform(F.split(F.regexp_extract(model, r"^[^/]*/(.*)$", 1), ","), lambda x: F.trim(x))


def saved(turns: DataFrame, indexes: DataFrame, at: Column) -> DataFrame:
    """(id, conv_id, title, indexes, messages, updated_at), one row a conversation, ready for write.json; indexes (conv_id, indexes)."""
    messages = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))))
    rows = turns.groupBy("conv_id").agg(messages.alias("messages")).join(titles(turns), "conv_id", "left").join(indexes, "conv_id", "left")
    key = conversation_id(F.coalesce("indexes", F.array().cast("array<string>")), F.coalesce("title", F.lit("")), F.col("messages"), at)
    return rows.select(key.alias("id"), "conv_id", "title", "indexes", "messages", at.alias("updated_at"))


def deleted(conversations: DataFrame, name: str) -> DataFrame:
    """conversations without the one that ``find`` gives for the name."""
    return conversations.join(find(conversations, name).select("id"), "id", "left_anti")


def index_label(indexes: Column) -> Column:
    return F.array_join(indexes, ",")
