"""First-touch replay of plans against later bars, by a bucketed range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barproof.operators import plans as pl

DAY = 86_400_000


def range_join(plans: DataFrame, bars: DataFrame, bucket_ms: int = DAY) -> DataFrame:
    """Each plan with its bars t0 < t <= t_end.

    Plans are spread over the buckets of their life and meet bars by (sym,
    bucket): an equi-join, so a busy symbol is split by time (and further by
    adaptive skew handling), and only plans of that symbol and time meet.
    """
    p = plans.where("t_end > t0").withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("t0") + 1) / bucket_ms), F.floor(F.col("t_end") / bucket_ms))))
    b = bars.select(F.col("sym").alias("_sym"), "t", "h", "l", "c", F.floor(F.col("t") / bucket_ms).alias("_b"))
    return p.join(b, (F.col("sym") == F.col("_sym")) & (F.col("_bucket") == F.col("_b")) & (F.col("t") > F.col("t0")) & (F.col("t") <= F.col("t_end"))).drop("_bucket", "_b", "_sym")


def replay(plans: DataFrame, bars: DataFrame, bucket_ms: int = DAY) -> DataFrame:
    """plan_id -> plan columns with state, at, px, r, half, n.

    Order inside a bar: stop by the adverse extreme, first target (half closes,
    stop to entry), second target.  One exchange by plan after the join: the
    first pass is a window over the plan, the second an aggregate on the same
    partitioning.
    """
    key = ["plan_id", "side", "entry", "sl", "tp1", "tp2", "rm", "d_stop", "t0", "t_end"]
    j = range_join(plans.select("sym", *key), bars, bucket_ms)
    up = F.col("side") > 0
    adv, fav = F.when(up, F.col("l")).otherwise(F.col("h")), F.when(up, F.col("h")).otherwise(F.col("l"))
    near = lambda c: F.round(c, 9)  # noqa: E731  a price that touches a level touches it whatever the last bit
    hit = lambda level: F.when(up, near(fav) >= near(level)).otherwise(near(fav) <= near(level))
    stopped = lambda level: F.when(up, near(adv) <= near(level)).otherwise(near(adv) >= near(level))
    j = j.select("plan_id", "entry", "t", "c", stopped(F.col("sl")).alias("x_sl"), stopped(F.col("entry")).alias("x_be"),
                 (hit(F.col("tp1")) & (F.col("tp1") != 0)).alias("x_1"), hit(F.col("tp2")).alias("x_2"))
    w = Window.partitionBy("plan_id")
    first = lambda c: F.min(F.when(c, F.col("t"))).over(w)
    j = j.withColumns({"t_sl": first(F.col("x_sl")), "t_1": first(F.col("x_1")), "t_2": first(F.col("x_2")), "t_last": F.max("t").over(w)})
    j = j.withColumns({"t_2h": first(F.col("x_2") & (F.col("t") >= F.col("t_1"))), "t_be": first(F.col("x_be") & (F.col("t") > F.col("t_1")))})
    times = ("t_sl", "t_1", "t_2", "t_2h", "t_be", "t_last")
    # bars up to each time that can end the plan
    g = j.groupBy("plan_id").agg(*[F.first(t).alias(t) for t in times], F.max_by("c", "t").alias("c_last"), *[F.count(F.when(F.col("t") <= F.col(t), 1)).alias(f"n{t[1:]}") for t in times if t != "t_1"])
    out = plans.join(g, "plan_id", "left")
    far = F.lit(2**62)
    c = lambda n: F.coalesce(n, far)
    t_sl, t_1, t_2, t_2h, t_be = (F.col(n) for n in ("t_sl", "t_1", "t_2", "t_2h", "t_be"))
    stop = t_sl.isNotNull() & (t_sl <= c(t_1)) & (t_sl <= c(t_2))
    full = t_2.isNotNull() & (t_2 < c(t_1))
    half = t_1.isNotNull()
    be = t_be.isNotNull() & (t_be <= c(t_2h))
    tp2h = t_2h.isNotNull()
    open_r = F.col("side") * F.ln(F.col("c_last") / F.col("entry")) / F.col("d_stop")
    tail = F.when(F.col("t_last") >= F.col("t_end"), "expired").otherwise("open")
    kind = F.when(F.col("t_last").isNull(), "wait").when(stop, "stop").when(full, "tp2").when(half & be, "be").when(half & tp2h, "tp2").otherwise(tail)
    at = F.when(F.col("t_last").isNull(), F.lit(None)).when(stop, t_sl).when(full, t_2).when(half & be, t_be).when(half & tp2h, t_2h).otherwise(F.col("t_last"))
    px = F.when(F.col("t_last").isNull(), F.lit(None)).when(stop, F.col("sl")).when(full, F.col("tp2")).when(half & be, F.col("entry")).when(half & tp2h, F.col("tp2")).otherwise(F.col("c_last"))
    r = F.when(F.col("t_last").isNull(), 0.0).when(stop, -1.0).when(full, F.col("rm")).when(half & be, 0.5).when(half & tp2h, 0.5 + 0.5 * F.col("rm")).when(half, 0.5 + 0.5 * open_r).otherwise(open_r)
    is_half = F.coalesce(F.col("t_last").isNotNull() & ~stop & ~full & half, F.lit(False))
    out = out.withColumns({"state": kind, "at": at.cast("long"), "px": px, "r": r, "half": is_half})
    n = F.when(stop, F.col("n_sl")).when(full, F.col("n_2")).when(half & be, F.col("n_be")).when(half & tp2h, F.col("n_2h")).otherwise(F.col("n_last"))
    return out.withColumn("n", F.when(F.col("t_last").isNull(), 0).otherwise(n).cast("long")).drop(*times, "c_last", *[f"n{t[1:]}" for t in times])


def run(plans: DataFrame, bars: DataFrame, f8: float | None = None, bucket_ms: int = DAY) -> DataFrame:
    """Replay with net R; a symbol without bars gives ``no-data`` and R 0."""
    out = replay(plans, bars, bucket_ms).withColumn("r", pl.net_r(F.col("r"), f8))
    known = bars.select("sym").distinct().withColumn("_known", F.lit(True))
    out = out.join(known, "sym", "left")
    gone = F.col("_known").isNull()
    return out.withColumns({"state": F.when(gone, "no-data").otherwise(F.col("state")), "r": F.when(gone, 0.0).otherwise(F.col("r"))}).drop("_known")


def progress(plans: DataFrame, bars: DataFrame, bucket_ms: int = DAY) -> DataFrame:
    """Where each plan stands at its last bar: R now, share of the way, trend against some bars back, speed and bars to go."""
    j = range_join(plans.select("plan_id", "sym", "side", "entry", "rm", "d_stop", "t0", "t_end"), bars, bucket_ms)
    w = Window.partitionBy("plan_id")
    j = j.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("t"))) - 1)
    k = F.greatest(F.lit(2), F.floor(F.col("n") / 3))
    r = F.col("side") * F.ln(F.col("c") / F.col("entry")) / F.col("d_stop")
    g = j.withColumn("_r", r).groupBy("plan_id").agg(
        F.first("n").alias("n"), F.first("rm").alias("rm"), F.max(F.when(F.col("back") == 0, F.col("c"))).alias("cur"), F.max(F.when(F.col("back") == 0, F.col("_r"))).alias("r_now"),
        F.max(F.when(F.col("back") == k, F.col("_r"))).alias("_old"))
    enough = F.col("n") >= 4
    d = F.col("r_now") - F.col("_old")
    speed = F.when(enough, d / F.greatest(F.lit(2), F.floor(F.col("n") / 3)))
    return g.select(
        "plan_id", "cur", "r_now", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r_now") / F.col("rm"))).alias("path"),
        F.when(enough, F.when(d > 0.03, "nearing").when(d < -0.03, "receding").otherwise("flat")).alias("trend"), speed.alias("speed"),
        F.when(speed > 0.002, (F.col("rm") - F.col("r_now")) / speed).alias("eta_bars"))
