"""Pieces the training-data operators share: table access and written intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run of bytes outside space and \t\n\v\f\r. ``bytes.split()`` cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where none is named and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and the rows survive lost executors.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; -1 for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def training_sample(labels: DataFrame, label: str, modulus: int, held_out: int, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` labelled ids outside the held-out fold, chosen by seeded hash.

    Fitting uses this bounded sample; the result has at most ``bound`` rows of two numbers, so it may be broadcast.
    An id that is labelled more than once takes its largest label; rows with a null id or label are left out.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id")
        .limit(bound)
    )


def release() -> None:
    """Give memory that this Python worker has freed back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: nothing to give back
        return
