"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly, by a seeded hash, into buckets that fit in memory. Pass two runs a
Fisher-Yates shuffle in each bucket. Bucket after bucket, the shuffled records form one global order, dealt out
to the shards in turn, so the shards' counts are at most one apart (law ``rows``).

Everything is a DataFrame expression. The only shuffle by key is that of pass one; positions come from bucket
counts through two windows whose sizes are bounded (coarse buckets, and fine ones inside a coarse one).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

COARSE = 1024
#: Rows of a group of equal rows that one task numbers at a time.
PIECE = 4096


def fisher_yates(n: Column, seed: int, salt: Column) -> Column:
    """A permutation of 0..n-1 by the inside-out Fisher-Yates shuffle; draws come from a seeded hash, so task retries agree."""

    def step(a, i):
        j = F.pmod(F.xxhash64(F.lit(seed), salt, i), (i + 1).cast("long")).cast("int")
        put = F.concat(F.slice(a, F.lit(1), j), F.array(i), F.slice(a, j + 2, i), F.array(F.get(a, j)))
        return F.when(j == i, F.concat(a, F.array(i))).otherwise(put)

    return F.when(n <= 1, F.array(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.array(F.lit(0)), step))


def two_pass_shuffle(df: DataFrame, n_shards: int = 8, seed: int = 17, key: list[str] | None = None, bucket_rows: int = 128, bucket_bytes: int = 16 << 20, bytes_column: str | None = None) -> DataFrame:
    """df's columns with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    key: the columns whose hash scatters a row (default: all). Rows that are equal in them meet in one bucket, so a key
    that repeats without bound must not be chosen. Nulls hash like a value. Equal rows take neighbouring places in the
    order before the shuffle and can't be told apart after it. An empty table gives no rows. Columns of df named
    ``shard`` or ``slot`` are replaced. bytes_column: a text or binary column whose mean length also bounds a bucket.
    """
    rows = df.drop("shard", "slot")
    key = key or rows.columns
    wanted = [F.count(F.lit(1)).alias("n"), (F.sum(F.octet_length(bytes_column)) if bytes_column else F.lit(0)).alias("b")]
    got = rows.agg(*wanted).first()
    n_buckets = max(1, math.ceil(got.n / bucket_rows), math.ceil((got.b or 0) / bucket_bytes))
    n_coarse = min(n_buckets, COARSE)
    spread = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in key])
    scattered = rows.select(F.struct(*rows.columns).alias("row"), spread.alias("h"), F.pmod(spread, F.lit(n_buckets)).alias("bucket"))

    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("coarse", F.pmod("bucket", F.lit(n_coarse)))
    inner = Window.partitionBy("coarse").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("coarse").agg(F.sum("n").alias("all")).select("coarse", F.coalesce(F.sum("all").over(outer), F.lit(0)).alias("base"))
    offsets = counts.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(totals, "coarse").select("bucket", (F.col("base") + F.col("within")).alias("offset"))

    full = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("h", "row"))).alias("rows"))
    order = fisher_yates(F.size("rows"), seed, F.col("bucket"))
    dealt = (
        full.join(offsets, "bucket")
        .withColumn("order", order)
        .select("offset", "rows", F.posexplode("order").alias("pos", "at"))
        .select((F.col("offset") + F.col("pos")).alias("place"), F.get("rows", F.col("at")).getField("row").alias("row"))
    )
    return dealt.select("row.*", F.pmod("place", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("place") / n_shards).cast("long").alias("slot"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df's rows with their number among equal rows, from 0, as a long column ``name``.

    Equal rows are counted before the shuffle and made again from the count, in pieces that are dealt out, so no task meets a
    whole group. Nulls are equal here. Meant for narrow rows: they are the key of an aggregation.
    """
    count, first, step = f"{name}_count", f"{name}_first", F.lit(PIECE).cast("long")
    pieces = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count)).withColumn(first, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, step)))
    dealt = pieces.repartition(*df.columns, first)
    return dealt.select(*df.columns, F.explode(F.sequence(F.col(first), F.least(F.col(first) + step, F.col(count)) - 1)).alias(name))


def write_shards(sharded: DataFrame, path: str, n_files: int) -> None:
    """Write each shard's rows in slot order, to a folder for each shard."""
    sharded.repartitionByRange(n_files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(documents: DataFrame, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """The digest of op4: where each document goes. A null text has 1 byte of size and the crc32 of no bytes, 0.

    Rows that repeat a doc_id, or have none, scatter by their text and their number among equal ones, so they fill no bucket.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = two_pass_shuffle(numbered(digest, "nth"), n_shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_shard_two_pass(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))
