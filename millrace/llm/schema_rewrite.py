"""Rewrite Parquet files of drifted schemas to one evolved schema, matching columns by field id.

Spark's own reader, with field-id matching on, scans all files under the evolved schema: renamed, reordered and narrower columns come
out right by themselves, and a column that a file lacks comes out null. Whether a null was missing is what the files'
footers say: a map of file and missing ids, one row a file, is joined by file name and puts the defaults in. The rows of a
file are brought back in order by ``_metadata.row_index`` and written as one file.

The drifted files themselves are made from a table by a range sort and ranks by zipWithIndex: row r goes to a file by its rank.

Drivers only see file names and footers (without row groups), and there are at most 1,000 files whatever the table's size.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, table

FIELD_ID = "parquet.field.id"
BY_ID = "spark.sql.parquet.fieldId.read.enabled"
#: Columns of the evolved schema, in order of their field ids from 1 on, with what stands in for a missing column.
COLUMNS = ("client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance")
DEFAULTS = {"nation_id": -1, "city": "none"}
#: Drift by version bit.
SWAPPED, REVERSED, SHORT, NARROW = 1, 2, 4, 8
FILES, VERSIONS = 1000, 24
DATA = re.compile(r"part-(\d+)(-evolved)?\.parquet$")


def evolved_schema(clients: DataFrame) -> T.StructType:
    kinds = {f.name: f.dataType for f in clients.schema} | {"nation_id": T.LongType()}
    return T.StructType([T.StructField(c, kinds[c], True, {FIELD_ID: i}) for i, c in enumerate(COLUMNS, 1)])


def version_of(file_no: int) -> int:
    v = zlib.crc32(b"7:%d" % file_no) % VERSIONS
    return v if v <= 15 else 0


def version(file_no: Column) -> Column:
    v = F.pmod(F.crc32(F.concat(F.lit("7:"), file_no.cast("string")).cast("binary")), F.lit(VERSIONS))
    return F.when(v > 15, 0).otherwise(v).cast("int")


def drifted(schema: T.StructType, v: int) -> list[Column]:
    """The evolved columns as a file of version v has them: names, order, types and field ids."""
    out = []
    for f in schema:
        name, kind = f.name, f.dataType
        if v & SHORT and name in DEFAULTS:
            continue
        if v & NARROW:
            kind = {"balance": T.FloatType(), "nation_id": T.IntegerType()}.get(name, kind)
        if v & SWAPPED:
            name = {"name": "email", "email": "name"}.get(name, name)
        out.append(F.col(f.name).cast(kind).alias(name, metadata=f.metadata))
    return [out[0], *out[:0:-1]] if v & REVERSED else out


@contextmanager
def matching_by_id(spark: SparkSession):
    old = spark.conf.get(BY_ID)
    spark.conf.set(BY_ID, "true")
    try:
        yield
    finally:
        spark.conf.set(BY_ID, old)


class Files:
    """The files of a folder, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.jvm, self.folder = spark, spark._jvm, folder
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def data(self) -> dict[int, list[str]]:
        """The data files' names by number, written ones after starting ones."""
        found: dict[int, list[str]] = {}
        for s in self.fs.listStatus(self.path(self.folder)):
            name = s.getPath().getName()
            if m := DATA.match(name):
                found.setdefault(int(m[1]), []).append(name)
        return {k: sorted(v, key=len) for k, v in sorted(found.items())}

    def take(self, staged: str, ending: str) -> list[int]:
        """Move the one file of each folder file_no=N below ``staged`` here, as part-N; the numbers moved."""
        moved = []
        found = self.fs.listFiles(self.path(staged), True)
        while found.hasNext():
            p = found.next().getPath()
            if m := re.search(r"/file_no=(\d+)/[^/]*\.parquet$", p.toString()):
                n = int(m[1])
                if not self.fs.rename(p, self.path(f"{self.folder}/part-{n:05d}{ending}.parquet")):
                    raise OSError(f"{p.toString()} can't be moved")
                moved.append(n)
        return moved

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.folder}/{name}"), True)

    def footers(self, names: list[str]) -> dict[str, list[tuple[str, int | None, str]]]:
        """(column, field id, Parquet type) of each file, in order, from footers without row groups."""
        reader, skip = self.jvm.org.apache.parquet.hadoop.ParquetFileReader, self.jvm.org.apache.parquet.format.converter.ParquetMetadataConverter.SKIP_ROW_GROUPS

        def read(name: str):
            fields = reader.readFooter(self.conf, self.path(f"{self.folder}/{name}"), skip).getFileMetaData().getSchema().toString()
            return [(m[2], int(m[4]) if m[4] else None, m[1] + (m[3] or "")) for m in re.finditer(r"^  (\w+ \S+) (\S+?)( \(.*\))?(?: = (\d+))?;$", fields, re.M)]

        with ThreadPoolExecutor(8) as pool:
            return dict(zip(names, pool.map(read, names)))


def ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """(rows with rank and file_no, number of rows): sorted by unsigned crc32 of the decimal client_id, then client_id; null ids come last.

    Rows that repeat an id are ordered by a hash of their columns, so that reruns agree; equal rows can't be told apart.
    """
    n = rows.count()
    text = F.col("client_id").cast("string")
    order = [F.crc32(text.cast("binary")).asc_nulls_last(), F.col("client_id").asc_nulls_last(), F.xxhash64(*rows.columns)]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema] + [T.StructField("rank", T.LongType())])
    pairs = rows.orderBy(*order).rdd.zipWithIndex().map(lambda p: (*p[0], p[1]))
    numbered = rows.sparkSession.createDataFrame(pairs, schema, verifySchema=False)
    return numbered.withColumn("file_no", F.floor(F.col("rank") / (1 + n // FILES)).cast("int")), n


def one_file_each(rows: DataFrame, order: str, columns: list[Column], path: str) -> None:
    """A file for each file_no below path, its rows in order."""
    sorted_rows = rows.repartition("file_no").sortWithinPartitions("file_no", order)
    sorted_rows.select("file_no", *columns).write.option("maxRecordsPerFile", 0).partitionBy("file_no").parquet(path)


def start(clients: DataFrame, root: str) -> T.StructType:
    """Write the starting files of a table with the columns COLUMNS to root/data; the evolved schema. Other columns are left out."""
    spark, schema = clients.sparkSession, evolved_schema(clients)
    rows, _ = ranked(clients.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]))
    rows.withColumn("version", version(F.col("file_no"))).write.partitionBy("version").parquet(f"{root}/ranked")
    files = Files(spark, f"{root}/data")
    files.fs.mkdirs(files.path(files.folder))
    there = {int(m[1]) for s in files.fs.listStatus(files.path(f"{root}/ranked")) if (m := re.search(r"version=(\d+)$", s.getPath().toString()))}

    def write(v: int) -> None:
        one_file_each(spark.read.parquet(f"{root}/ranked/version={v}"), "rank", drifted(schema, v), f"{root}/starting/version={v}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, sorted(there)))
    for v in sorted(there):
        files.take(f"{root}/starting/version={v}", "")
    for name in ("ranked", "starting"):
        files.fs.delete(files.path(f"{root}/{name}"), True)
    return schema


def rewrite(spark: SparkSession, folder: str, schema: T.StructType, defaults: dict) -> dict[int, list[tuple[str, int | None, str]]]:
    """Rewrite the files part-N.parquet of a folder whose columns differ from the schema (fields with ids), one by one; their old columns.

    A file is untouched if its footer has the columns, field ids and types of an empty file of the schema, in order. A column
    missing from a file becomes its default (null if there is none); null values stay null. A new file is in place before
    the old one goes, so that a driver that is lost between the two leaves both, and running it again mends that.
    """
    files = Files(spark, folder)
    found = files.data()
    for names in found.values():  # an earlier run had put the new file in place
        for name in names[:-1]:
            files.remove(name)
    names = {n: v[-1] for n, v in found.items()}
    before = files.footers(list(names.values()))
    wanted = footer_of(files, schema)
    drift = {n: name for n, name in names.items() if before[name] != wanted}
    if drift:
        missing = [(n, name, [f.name for f in schema if f.metadata[FIELD_ID] not in {i for _, i, _ in before[name]}]) for n, name in drift.items()]
        footers = F.broadcast(spark.createDataFrame(missing, "file_no int, _file string, _missing array<string>"))  # one row a file
        with matching_by_id(spark):
            scan = spark.read.schema(schema).parquet(*[f"{folder}/{name}" for name in drift.values()])
            rows = scan.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")).join(footers, "_file")
            filled = [(F.when(F.array_contains("_missing", f.name), F.lit(defaults[f.name]).cast(f.dataType)).otherwise(F.col(f.name)) if f.name in defaults else F.col(f.name)).alias(f.name, metadata=f.metadata) for f in schema]
            staged = f"{folder}/_rewritten-{uuid.uuid4().hex}"
            one_file_each(rows, "_row", filled, staged)
        moved = files.take(staged, "-evolved")
        files.fs.delete(files.path(staged), True)
        for n in moved:
            files.remove(drift[n])
    return {n: before[name] for n, name in names.items()}


def footer_of(files: Files, schema: T.StructType) -> list[tuple[str, int | None, str]]:
    """What the footer of a file of this schema says."""
    empty = Files(files.spark, f"{files.folder}/_empty-{uuid.uuid4().hex}")
    files.spark.createDataFrame([], schema).coalesce(1).write.parquet(empty.folder)
    names = [s.getPath().getName() for s in empty.fs.listStatus(empty.path(empty.folder))]
    [footer] = empty.footers([n for n in names if n.endswith(".parquet")]).values()
    empty.fs.delete(empty.path(empty.folder), True)
    return footer


def field_text(f: T.StructField) -> Column:
    c = F.col(f.name)
    if f.name == "updated_at":
        micros = F.unix_micros(c) if isinstance(f.dataType, T.TimestampType) else F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {f.name})")
        c = micros
    if f.name == "balance":
        c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), c.cast("string")).otherwise(F.floor(F.lit(1048576.0) * c).cast("string"))
    return F.coalesce(c.cast("string"), F.lit("?"))


def digests(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """(file_no, n_rows, n_nulls, ids_sha256, rows_sha256) of the files of a folder; each file's rows stream through one task in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, nulls, ids, lines = None, 0, 0, hashlib.sha256(), hashlib.sha256()
        for f in frames:
            for n, own in f.groupby("file_no", sort=True):
                if n != now:
                    if now is not None:
                        yield result(now, rows, nulls, ids, lines)
                    now, rows, nulls, ids, lines = n, 0, 0, hashlib.sha256(), hashlib.sha256()
                ids.update(("," * (rows > 0) + ",".join(own.id)).encode())
                lines.update(("\n" * (rows > 0) + "\n".join(own.line)).encode())
                rows, nulls = rows + len(own), nulls + int(own.nulls.sum())
        if now is not None:
            yield result(now, rows, nulls, ids, lines)

    def result(now, rows, nulls, ids, lines) -> pd.DataFrame:
        return pd.DataFrame({"file_no": [now], "n_rows": [rows], "n_nulls": [nulls], "ids_sha256": [ids.hexdigest()], "rows_sha256": [lines.hexdigest()]})

    with matching_by_id(spark):
        rows = spark.read.schema(schema).parquet(folder)
        number = F.regexp_extract("_metadata.file_name", DATA.pattern, 1).cast("int").alias("file_no")
        nulls = sum((F.col(f.name).isNull().cast("int") for f in schema), F.lit(0))
        lines = rows.select(number, F.col("_metadata.row_index").alias("row"), F.coalesce(F.col("client_id").cast("string"), F.lit("?")).alias("id"), nulls.alias("nulls"), F.concat_ws("|", *[field_text(f) for f in schema]).alias("line"))
        # the scan reads its settings when it is planned, so it is planned and run here; the result has a row a file
        found = lines.repartition("file_no").sortWithinPartitions("file_no", "row").drop("row").mapInPandas(run, "file_no int, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string").collect()
    return spark.createDataFrame(found, "file_no int, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string")


def rewritten_clients(clients: DataFrame) -> DataFrame:
    """The digest of op11, a row for each final file; files stay in a new folder below spark.checkpoint.dir. An empty table has no files."""
    spark = clients.sparkSession
    root = f"{shared_dir(spark)}/op11-{uuid.uuid4().hex}"
    schema = start(clients, root)
    folder = f"{root}/data"
    before = rewrite(spark, folder, schema, DEFAULTS)
    files = Files(spark, folder)
    names = {n: v[-1] for n, v in files.data().items()}
    kinds = "file_no int, version int, start_columns string, columns string, path string, rewritten boolean"
    after = files.footers(list(names.values()))
    about = [(n, version_of(n), ",".join(c for c, *_ in before[n]), ",".join(c for c, *_ in after[name]), f"{folder}/{name}", "-evolved" in name) for n, name in names.items()]
    if not about:
        return spark.createDataFrame([], "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean")
    rows = digests(spark, folder, schema).join(F.broadcast(spark.createDataFrame(about, kinds)), "file_no")  # at most 1,000 rows
    return rows.select(F.col("file_no").cast("long").alias("file_no"), F.col("version").cast("long").alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")


def op11_rewrite_field_ids(spark, sf_dir):
    return rewritten_clients(table(spark, sf_dir, "clients"))
