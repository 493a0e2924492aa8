"""Mix sources to target weights by Pareto order sampling.

Each source has a target number of words. A document is first taken in as many whole copies as target / source size
has; the remaining share p of the source is a fixed-size sample in Pareto order: documents are ranked by
random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the words reach
what is left of the target (the document at the border counts if its middle lies inside).

The border is found by sums over 1,024 cells of the order, then over 1,024 cells of the border cell, and only
the rows of that last cell are sorted. No task ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, table, written

CELLS = 1024
#: Up to this many sources, their table (a few numbers a row) is broadcast; beyond it, joins shuffle.
MAX_BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that only the key and the seed decide; a null key counts as the text 'null'."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, limit: int = 3) -> DataFrame:
    """From (source, source_size): weight 1, 2, 3, 1, ... in code point order, null last, and each source's target.

    All sizes together are shared by weight; no target exceeds ``limit`` times its source, and the excess goes to the
    others by weight until none is above. With c the share of a unit of weight, a source is held at its limit if
    limit * size / weight <= c. In the order of that ratio, c is what the sources from one on share after those before it
    took their limits, at the first source that this share doesn't bring above its own limit.
    """
    every = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", (F.col("nth") - 1) % 3 + 1)
    totals = numbered.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    ordered = (
        numbered.withColumn("cap", F.lit(limit) * F.col("source_size"))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("caps", F.coalesce(F.sum("cap").over(every), F.lit(0)))
        .withColumn("weights", F.coalesce(F.sum("weight").over(every), F.lit(0)))
        .join(F.broadcast(totals))
        .withColumn("unit", (F.col("all_size") - F.col("caps")).cast("double") / (F.col("all_weight") - F.col("weights")))
    )
    unit = ordered.where(F.col("unit") <= F.col("ratio")).agg(F.min_by("unit", F.struct("ratio", "nth")).alias("c"))
    target = F.when(F.col("c").isNull() | (F.col("ratio") <= F.col("c")), F.col("cap").cast("double")).otherwise(F.col("c") * F.col("weight"))
    return ordered.join(F.broadcast(unit)).select("source", "source_size", target.alias("target"))


def plan_mix(sized: DataFrame, seed: int, limit: int) -> tuple[DataFrame, bool]:
    """For each source: whole copies, the inclusion odds and the last (order, doc_id) taken. sized: doc_id, source, size."""
    shares = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), limit)
    shares = shares.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    shares = written(shares.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-shares")
    small = shares.count() <= MAX_BROADCAST_SOURCES
    placed = ordered(sized, shares, seed, small).where(F.col("rest") > 0)

    def border(rows: DataFrame, cell: str, before: str) -> DataFrame:
        """The cell of each source whose words pass the rest, and the words before it."""
        w = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = rows.groupBy("source", cell).agg(F.sum("size").alias("s"), F.first("rest").alias("rest"), F.first(before).alias("b") if before else F.lit(0).alias("b"))
        sums = sums.withColumn("end", F.col("b") + F.sum("s").over(w)).withColumn("start", F.col("end") - F.col("s"))
        return sums.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("end"))).select("source", F.col(cell).alias("at"), F.col("start").alias(before or "start1"))

    first = border(placed, "cell1", "")
    found = F.broadcast(first) if small else first
    in_first = placed.alias("r").join(found.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.cell1") == F.col("f.at"))).select("r.*", "f.start1")
    second = border(in_first, "cell2", "start1").withColumnRenamed("start1", "start2")
    joined = F.broadcast(second) if small else second
    last = in_first.alias("r").join(joined.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.cell2") == F.col("f.at"))).select("r.source", "v", "doc_id", "size", "rest", "start2")
    w = Window.partitionBy("source").orderBy("v", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("start2") + F.sum("size").over(w) - F.col("size") / 2
    taken = last.withColumn("middle", middle).where(F.col("middle") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("v", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"))).alias("cut"))
    cuts = first.select("source", F.col("at").alias("cell1_cut")).alias("a").join(second.select("source", F.col("at").alias("cell2_cut")).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "cell2_cut")
    plan = shares.alias("s").join(cuts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").join(taken.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
    return written(plan.select("s.*", "cell1_cut", "cell2_cut", "cut"), "mix-plan"), small


def ordered(sized: DataFrame, shares: DataFrame, seed: int, small: bool) -> DataFrame:
    """sized with its source's share and its place v in Pareto order, in (0, 1), with v's cells."""
    shares = F.broadcast(shares) if small else shares
    p = F.col("rest") / F.col("source_size")
    u = uniform(F.col("doc_id"), seed)
    q = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
    keep = [F.col(f"d.{c}") for c in sized.columns] + [F.col(f"s.{c}") for c in shares.columns if c != "source"]
    rows = sized.alias("d").join(shares.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(*keep)
    rows = rows.withColumn("v", F.when(F.col("rest") > 0, q / (F.lit(1.0) + q)))
    return rows.withColumn("cell1", F.floor(F.col("v") * CELLS)).withColumn("cell2", F.floor(F.col("v") * CELLS * CELLS))


def mix(documents: DataFrame, seed: int = 29, limit: int = 3) -> DataFrame:
    """documents' columns with _size, _source_size, _target and _copies (how often the mix takes the row).

    A null source is a source of its own; a null or blank text has size 0 and is in all whole copies but none of the
    words. Each row has a draw of its own: from its doc_id, or, in a table where a doc_id (null included) repeats, from its number in
    the table, which is written once more with it. Tables without any word have targets 0. Columns of
    documents that begin with ``_`` and clash are replaced.
    """
    documents = documents.drop("_size", "_source_size", "_target", "_copies", "_mix_row")
    row, key = F.struct(*documents.columns).alias("_row"), "doc_id"

    def sizes() -> DataFrame:
        return written(documents.select(F.col(key).alias("doc_id"), "source", words(F.col("text")).alias("size")), "mix-sizes")

    sized = sizes()
    if sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        documents, key = written(documents.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-rows"), "_mix_row"
        sized = sizes()
    plan, small = plan_mix(sized, seed, limit)
    rows = documents.select(row, F.col(key).alias("doc_id"), "source", words(F.col("text")).alias("size"))
    placed = ordered(rows, plan, seed, small)
    upto = F.struct("v", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d")) <= F.col("cut")
    in_cell = F.when(F.col("cell2") < F.col("cell2_cut"), True).when(F.col("cell2") > F.col("cell2_cut"), False).otherwise(F.coalesce(upto, F.lit(False)))
    chosen = F.col("v").isNotNull() & (F.col("cell1_cut").isNull() | in_cell)
    return placed.select(
        "_row.*", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), (F.col("copies") + chosen.cast("long")).alias("_copies")
    )


def mixed(documents: DataFrame, seed: int = 29, limit: int = 3) -> DataFrame:
    """The mixture itself: each row as often as it is taken, with the columns of documents only."""
    rows = mix(documents, seed, limit).where(F.col("_copies") > 0)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*documents.columns)


def op6_mix_pareto(spark, sf_dir):
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


ORACLE_OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS nth FROM s
), o AS (
  SELECT source, source_size, nth, nth % 3 + 1 AS weight, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / (nth % 3 + 1) AS ratio FROM w
), p AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS all_size, CAST(sum(weight) OVER () AS DOUBLE) AS all_weight,
    CAST(coalesce(sum(cap) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS caps,
    CAST(coalesce(sum(weight) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS weights FROM o
), c AS (
  SELECT (SELECT (all_size - caps) / (all_weight - weights) FROM p WHERE (all_size - caps) / (all_weight - weights) <= ratio ORDER BY ratio, nth LIMIT 1) AS unit
), t AS (
  SELECT source, source_size, CASE WHEN unit IS NULL OR ratio <= unit THEN CAST(cap AS DOUBLE) ELSE unit * weight END AS target FROM p, c
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t
), q AS (
  SELECT *, target - copies * source_size AS rest, (target - copies * source_size) / source_size AS p FROM r
), u AS (
  SELECT d.doc_id, d.size, q.source, source_size, target, copies, rest, p,
    (CAST(CAST('0x' || substr(md5('29:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), v AS (
  SELECT *, (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) AS odds FROM u
), m AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1.0::DOUBLE + odds), doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle FROM v
)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""
