"""What several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barproof.jobs import sql as q
from barproof.operators import metrics as mt
from barproof.operators import plans as pl
from barproof.operators import replay as rp
from barproof.operators import walk
from barproof.sources import fixtures as fx
from barproof.sources import readers as rd

DAY, HOUR = fx.DAY, fx.HOUR


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def feats(spark: SparkSession, d: str) -> DataFrame:
    """Bars with all rule features, as a table: plans, anchors and replay all read it."""
    return rd.stored(walk.features_for(fx.bars_1d(spark, d), 1), "feats")


def anchors(bars: DataFrame) -> DataFrame:
    return walk.anchors(bars, q.WARMUP)


def cand(spark: SparkSession, d: str, names=q.BOOK, f: DataFrame | None = None) -> DataFrame:
    f = feats(spark, d) if f is None else f
    perp = any(walk.RULES[n].perp for n in names)
    return walk.candidates(list(names), f, anchors(f), 1, DAY, fx.funding(spark, d) if perp else None)


def book(spark: SparkSession, d: str, names=q.BOOK, f: DataFrame | None = None) -> DataFrame:
    return walk.admit(cand(spark, d, names, f))


def runs(spark: SparkSession, d: str, names=q.BOOK) -> DataFrame:
    f = feats(spark, d)
    return rp.run(book(spark, d, names, f), f)


def two_sided(plans: DataFrame, bars: DataFrame, own_tp1: bool = False, bucket_ms: int = DAY) -> DataFrame:
    """Real (_m = 0) and mirrored (_m = 1) plans, replayed in one pass."""
    both = plans.withColumn("_m", F.lit(0)).unionByName(pl.mirror(plans, own_tp1).withColumn("_m", F.lit(1)))
    out = rp.run(both.withColumn("plan_id", F.concat_ws("#", "plan_id", F.col("_m").cast("string"))), bars, bucket_ms=bucket_ms)
    return out.withColumn("plan_id", F.regexp_replace("plan_id", "#[01]$", ""))


def sides(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two-sided runs, as a table, since several aggregates read both sides."""
    out = rd.stored(runs, "runs")
    return out.where("_m = 0").drop("_m"), out.where("_m = 1").drop("_m")


def both_runs(spark: SparkSession, d: str, names=q.BOOK) -> tuple[DataFrame, DataFrame]:
    f = feats(spark, d)
    return sides(two_sided(rd.stored(book(spark, d, names, f), "book"), f))


def perp_runs(spark: SparkSession, d: str, names=q.STRATS) -> tuple[DataFrame, DataFrame]:
    """As both_runs, with realised funding for the strategies that hold perpetuals."""
    f = feats(spark, d)
    out = mt.add_funding(two_sided(rd.stored(book(spark, d, names, f), "book"), f), fx.funding(spark, d))
    perp = F.col("strat").isin([n for n in names if walk.RULES[n].perp])
    return sides(out.withColumn("r", F.when(perp, F.col("r")).otherwise(F.col("r") - F.col("fund_r"))).withColumn("fund_r", F.when(perp, F.col("fund_r")).otherwise(0.0)))
