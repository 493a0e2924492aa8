"""Edges stored once in buckets of their source, for algorithms that push values along all edges in every round."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import shared_dir

#: Edges from which a source can be heavy.
HEAVY = 10_000


class Links:
    """Edges (src, dst, ...) bucketed and sorted by src: a join on src shuffles the pushed rows, never the edges.

    A source with more edges than an average bucket (and than HEAVY) would fill a task. There are fewer such sources than
    buckets, so their edges are stored without an order, and the rows pushed from them are broadcast. Null ends are left out.
    With by="dst", the buckets are those of the target, for rows that are broadcast to ``even``; hubs aren't kept apart then.
    Use it in a ``with``: the tables go when it ends, so what is read from it must have been written by then.
    """

    def __init__(self, edges: DataFrame, heavy: int = HEAVY, by: str = "src"):
        self.spark = edges.sparkSession
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"millrace_links_{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/millrace-links-{uuid.uuid4().hex}"
        edges = edges.where("src is not null and dst is not null")
        if by != "src":
            self.has_hubs = False
            self._store(edges, by)
            return
        sizes = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        mean = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n / self.buckets
        hubs = sizes.where(F.col("n") > max(mean, heavy)).select("src")
        self.has_hubs = bool(hubs.limit(1).count())
        even = edges
        if self.has_hubs:
            hubs.write.parquet(f"{self.path}/hubs")
            self.hubs = self.spark.read.parquet(f"{self.path}/hubs").withColumnRenamed("src", "id")
            marked = F.broadcast(self.hubs.withColumnRenamed("id", "src"))
            edges.join(marked, "src", "left_semi").repartition(self.buckets, "src", "dst").write.parquet(f"{self.path}/heavy")
            self.heavy = self.spark.read.parquet(f"{self.path}/heavy")
            even = edges.join(marked, "src", "left_anti")
        self._store(even, "src")

    def _store(self, edges: DataFrame, by: str) -> None:
        edges.repartition(self.buckets, by).write.bucketBy(self.buckets, by).sortBy(by).option("path", f"{self.path}/even").saveAsTable(self.name)
        self.even = self.spark.table(self.name)

    def meet(self, rows: DataFrame) -> DataFrame:
        """rows (id, ...) joined to the edges that leave id; id is dropped, src stays."""
        rows = rows.withColumnRenamed("id", "src")
        met = self.even.join(rows.hint("merge"), "src")  # never collected to be broadcast
        if not self.has_hubs:
            return met
        few = rows.join(F.broadcast(self.hubs.withColumnRenamed("id", "src")), "src", "left_semi")
        return met.unionByName(self.heavy.join(F.broadcast(few), "src"))

    def __enter__(self) -> Links:
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
