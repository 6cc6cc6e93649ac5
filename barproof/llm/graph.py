"""Tables of an iteration, and connected components of links."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(df: DataFrame) -> str:
    """A folder that driver and executors share: the cluster names it in spark.checkpoint.dir.

    Only where it is unset and everything runs in one process, as in tests, a temporary one is made."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_LEFT: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    """Tables behind results that were handed out go when the driver ends."""
    while _LEFT:
        try:
            delete(*_LEFT.pop())
        except Exception:  # noqa: BLE001  the session's JVM is gone already
            return


def new_folder(df: DataFrame) -> str:
    """A path in the shared folder for what stays until the driver ends."""
    path = f"{shared_folder(df)}/tables-{uuid.uuid4().hex}"
    _LEFT.append((df.sparkSession, path))
    return path


def left_over(df: DataFrame) -> DataFrame:
    """The rows as a table that stays until the driver ends: what is handed out lazily reads it."""
    path = new_folder(df)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables, as Parquet in the shared folder: they cut lineage, outlive executors and go when the work is done.

    Shuffle files behind a table go as soon as it is written.
    """

    def __init__(self, df: DataFrame, parts: int | None = None):
        """``parts``: how many tasks suffice for a table of a few bytes for each text."""
        self.spark, self.folder, self.kept, self.parts = df.sparkSession, f"{shared_folder(df)}/tables-{uuid.uuid4().hex}", {}, parts

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.kept)}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept[path] = out
        return out

    def small(self, df: DataFrame) -> DataFrame:
        """A table of links or labels: written by fewer tasks."""
        return self.keep(df.coalesce(max(8, self.parts)) if self.parts else df)

    def result(self, df: DataFrame) -> DataFrame:
        """A table that outlives the work (see ``left_over``)."""
        out = self.keep(df)
        path = next(p for p, t in self.kept.items() if t is out)
        self.kept[path] = None
        _LEFT.append((self.spark, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.kept.items() if any(t is x for x in tables)]:
            delete(self.spark, path)
            self.kept[path] = None

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*(t for t in self.kept.values() if t is not None))


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node that each node reaches.

    Alternates large-star and small-star steps: every node links its larger
    neighbours to the smallest one it sees.  No node's neighbours are gathered;
    the least of them is an aggregate with partial sums, and links of a node with
    very many neighbours are spread by the join.  Ends when no link changes.
    """
    said = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = tables.small(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct())
    before = said(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        old, edges = edges, tables.small(small.distinct())
        tables.drop(old)
        now = said(edges)
        if now == before:
            break
        before = now
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.union(centres)
