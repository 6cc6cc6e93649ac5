"""A store of bars by month, of which an update rewrites the touched months only.

    <store>/data/<epoch>/month=<m>/..   files of one update
    <store>/commits/<epoch>             which epoch has each month, from this update on

An update reads the months it touches, merges, writes them to a folder of its own and
commits by one small record that is renamed into place.  A reader opens the folders of
the last commit only, so it sees all of an update or nothing; an epoch that has its
record already changes nothing when it comes again, and one without is written anew.
The record has an entry for each month of the calendar, whatever the number of bars.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = 31 * 86_400_000
KEYS = ("sym", "t")


class MonthStore:
    """``schema``: of the rows, with sym, t and seq (the newest version of a bar is that of the largest seq)."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self._jvm = spark._jvm
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def commits(self) -> list[int]:
        folder = self._at(f"{self.path}/commits")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(folder) if x.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    def months(self) -> dict[str, int]:
        """Month -> the epoch that wrote it last."""
        done = self.commits()
        if not done:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/commits/{done[-1]}", wholetext=True).first()[0])

    def _commit(self, epoch: int, months: dict[str, int]) -> None:
        draft, final = self._at(f"{self.path}/commits/_{epoch}"), self._at(f"{self.path}/commits/{epoch}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(months).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"epoch {epoch} has been committed by another writer")

    def _read(self, months: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/data/{e}/month={m}" for m, e in months.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The newest version of every bar."""
        return self._read(self.months())

    def merge(self, rows: DataFrame, epoch: int) -> list[str]:
        """Takes versions of bars, in any order and repeated, and gives the months that were rewritten."""
        if epoch in self.commits():
            return []
        months = self.months()
        rows = rows.withColumn("month", F.floor(F.col("t") / MONTH).cast("string"))
        touched = sorted(r[0] for r in rows.select("month").distinct().collect())  # of the calendar, not of the bars
        old = self._read({m: e for m, e in months.items() if m in touched})
        rest = [c for c in old.columns if c not in (*KEYS, "seq")]
        both = old.unionByName(rows.drop("month"))
        best = both.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct("seq", *rest)).alias("_v"), F.max("seq").alias("seq"))
        best = best.select(*KEYS, "_v.*", "seq").withColumn("month", F.floor(F.col("t") / MONTH).cast("string"))
        best.repartition("month", F.pmod(F.xxhash64("sym"), F.lit(8))).write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/data/{epoch}")
        self._commit(epoch, months | dict.fromkeys(touched, epoch))
        return touched

    def vacuum(self) -> None:
        """Deletes what no reader of the last commit opens."""
        months, done = self.months(), self.commits()
        for e in done:
            for x in self._fs.listStatus(self._at(f"{self.path}/data/{e}")) if self._fs.exists(self._at(f"{self.path}/data/{e}")) else []:
                name = x.getPath().getName()
                if name.startswith("month=") and months.get(name.removeprefix("month=")) != e:
                    self._fs.delete(x.getPath(), True)
        for e in done[:-1]:
            if e not in months.values():
                self._fs.delete(self._at(f"{self.path}/data/{e}"), True)
