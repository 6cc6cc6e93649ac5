"""Exact ranks within keys, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barproof.sources import readers as rd


def ranked(rows: DataFrame, keys: list[str], order: list[str], rank: str = "rank", size: str = "n") -> DataFrame:
    """Adds each row's place from 0 in its key by ``order``, and the key's number of rows.

    Rows are range-sorted by key and order, so that a busy key is many ranges; each range
    counts its rows of each key, and the counts (a row a range and key) are summed along
    the ranges.  No task sorts a whole key.  Rows that tie in all of ``order`` get
    different ranks in no particular order.
    """
    by = [*keys, *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = rd.stored(placed.withColumn("_range", F.shiftright("_at", 33)), "ranked")
    sizes = placed.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_many"))
    along = Window.partitionBy(*keys)
    sizes = sizes.withColumn("_base", F.sum("_many").over(along.orderBy("_range")) - F.col("_many")).withColumn(size, F.sum("_many").over(along))
    return placed.join(sizes, [*keys, "_range"]).withColumn(rank, F.col("_at") - F.col("_first") + F.col("_base")).drop("_at", "_range", "_first", "_many", "_base")


def at_share(share: float) -> Column:
    """The rank, of ``n`` rows, that stands for a share of them (nearest, half up)."""
    return F.floor(share * (F.col("n") - 1) + 0.5)


def least_k(rows: DataFrame, keys: list[str], value: str, tie: str, k: str, bins: int = 1024) -> DataFrame:
    """Of each key the ``k`` rows (a column, one value a key) of the least ``value``, ties by ``tie``; adds nothing.

    A histogram of the values finds the bin in which the k-th lies.  Rows of lower bins are
    chosen, rows of higher ones aren't, and only those of that bin are ranked.
    """
    rows = rd.stored(rows, "choice")
    span = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    binned = rows.join(span, keys).withColumn("_bin", F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)).drop("_lo", "_hi")
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_m"), F.first(k).alias("_k"))
    below = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_m")  # at most ``bins`` rows a key
    counts = counts.withColumn("_below", below).where(F.col("_below") < F.col("_k")).select(*keys, "_bin", (F.col("_k") - F.col("_below")).alias("_want"), (F.col("_below") + F.col("_m") <= F.col("_k")).alias("_all"))
    near = binned.join(counts, [*keys, "_bin"])
    cut = ranked(near.where(~F.col("_all")), keys, [value, tie], "_rank", "_n").where(F.col("_rank") < F.col("_want"))
    return near.where("_all").select(rows.columns).unionByName(cut.select(rows.columns))
