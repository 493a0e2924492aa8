"""Session builder with the settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: RocksDB keeps keyed streaming state outside the heap; it is needed by transformWithState.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "millrace", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session to every function instead."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where all runs in one process may it be a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and the rows survive lost executors.

    The table is removed when the driver ends.
    """
    path = f"{shared_dir(df.sparkSession)}/millrace-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(target)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that ``written`` wrote, once nothing reads it any more. Other tables stay."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("millrace-"):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
