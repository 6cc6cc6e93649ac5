"""Event, interval and external-list joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barproof.functions import text as tx
from barproof.operators import plans as pl
from barproof.operators import walk
from barproof.sources import readers as rd

DAY = 86_400_000


def plans_from_list(raw: DataFrame, feats: DataFrame, tf_ms: int, hz: int = 24, rm: float = 1.5, label: str = "list") -> tuple[DataFrame, DataFrame]:
    """External rows -> (plans, rows with the reason they were skipped: sym, bar or vol).

    A row's bar is found by an equi-join on (sym, floored time).  Unknown side
    words drop silently, as the reference has it.
    """
    r = raw.withColumn("sym", tx.clean_symbol(F.col("sym"))).withColumn("t0", (F.floor(rd.iso_millis(F.col("t0")) / tf_ms) * tf_ms).cast("long"))
    r = r.withColumns({"side": tx.side_word(F.col("side")), "hz": F.greatest(F.lit(1), F.round(F.coalesce(F.nullif(F.col("hz").try_cast("double"), F.lit(0.0)), F.lit(float(hz)))).cast("int")),
                       "rm": F.coalesce(F.nullif(F.col("rm").try_cast("double"), F.lit(0.0)), F.lit(rm)), "_sl": F.col("sl").try_cast("double"), "_tp": F.col("tp").try_cast("double")}).drop("sl", "tp")
    known = feats.select("sym").distinct().withColumn("_known", F.lit(True))
    r = r.join(known, "sym", "left").join(feats.select("sym", F.col("t").alias("t0"), F.col("c").alias("entry"), "vol", F.lit(True).alias("_bar")), ["sym", "t0"], "left")
    own = (F.col("_sl") > 0) & (F.col("_tp") > 0)
    to_sl, to_tp = F.ln(F.col("_sl") / F.col("entry")), F.ln(F.col("_tp") / F.col("entry"))
    wrong = (to_sl == 0) | (to_tp == 0) | (F.signum(to_sl) == F.col("side")) | (F.signum(to_tp) != F.col("side"))
    reason = (F.when(F.col("_known").isNull(), "sym").when(F.col("_bar").isNull(), "bar").when(F.col("side").isNull(), "side")
              .when(F.coalesce(own, F.lit(False)), F.when(wrong, "vol")).when(~F.coalesce(F.col("vol") > 0, F.lit(False)), "vol"))
    r = r.withColumns({"_own": F.coalesce(own, F.lit(False)), "reason": reason, "tf_ms": F.lit(tf_ms).cast("long"), "strat": F.lit(label)})
    ok = r.where("reason IS NULL")
    ok = ok.withColumn("rm", F.when(F.col("_own"), F.abs(to_tp) / F.abs(to_sl)).otherwise(F.col("rm")))
    p = pl.levels(ok, F.when(F.col("_own"), F.abs(to_sl)).otherwise(F.greatest(F.lit(1e-4), F.col("vol") * F.sqrt("hz"))))
    return p.select("strat", "sym", "side", "entry", "sl", "tp1", "tp2", "rm", "d_stop", "hz", "t0", "t_end"), r.where("reason IN ('sym', 'bar', 'vol')").select("sym", "t0", "reason")


def as_of_message(messages: DataFrame, bars: DataFrame) -> DataFrame:
    """Each message with the bar before the first bar after it; no-data (null) where no later bar exists or it is the first."""
    last = bars.groupBy("sym").agg(F.max("t").alias("_last"))
    out = walk.as_of(messages, bars.select("sym", "t", "c"), ["sym"], "t", "t", ["c"], "bar_t").join(last, "sym", "left")
    ok = F.col("_last") > F.col("t")
    return out.withColumns({"bar_t": F.when(ok, F.col("bar_t")), "px": F.when(ok, F.col("c"))}).drop("c", "_last")


def fill(plans: DataFrame, bars: DataFrame, within_ms: int = 3 * DAY, life_ms: int = 30 * DAY, bucket_ms: int = DAY) -> DataFrame:
    """Plans that the market really fills: the first later bar within three days that touches the entry, unless target
    or stop is hit on an earlier bar.  The plan then starts there, lives ``life_ms`` and has no first target."""
    from barproof.operators.replay import range_join

    j = range_join(plans.select("plan_id", "sym", "side", "entry", "sl", "tp2", "t0").withColumn("t_end", F.col("t0") + within_ms), bars, bucket_ms)
    touch = (F.col("l") <= F.col("entry")) & (F.col("h") >= F.col("entry"))
    up = F.col("side") > 0
    over = F.when(up, F.col("h") >= F.col("tp2")).otherwise(F.col("l") <= F.col("tp2")) | F.when(up, F.col("l") <= F.col("sl")).otherwise(F.col("h") >= F.col("sl"))
    g = j.groupBy("plan_id").agg(F.min(F.when(touch, F.col("t"))).alias("_touch"), F.min(F.when(over & ~touch, F.col("t"))).alias("_over"))
    g = g.where(F.col("_touch").isNotNull() & (F.col("_over").isNull() | (F.col("_touch") < F.col("_over")))).select("plan_id", F.col("_touch").alias("_t"))
    out = plans.join(g, "plan_id")
    return out.withColumns({"t0": F.col("_t"), "t_end": F.col("_t") + life_ms, "tp1": F.lit(None).cast("double")}).drop("_t")


def event_bars(events: DataFrame, bars: DataFrame, columns: list[str]) -> DataFrame:
    """Events by bars of every symbol (equi-join on the bar's time)."""
    return bars.select(F.col("t").alias("bar"), "sym", *columns).join(events, "bar")


def free_days(bars: DataFrame, events: DataFrame, lead_ms: int, tail_ms: int, before: int = 2, after: int = 3) -> DataFrame:
    """Days ``d`` (UTC midnights) far from every event: d not in [bar - before days, bar + after days).

    Each event names the few days it forbids, so the range anti-join is an equi-join.
    """
    span = bars.groupBy("sym").agg(F.min("t").alias("a"), F.max("t").alias("b")).agg(F.min("a").alias("a"), F.min("b").alias("b"))
    days = span.select(F.explode(F.sequence(F.floor((F.col("a") + lead_ms) / DAY), F.floor((F.col("b") - tail_ms - 1) / DAY))).alias("d")).select((F.col("d") * DAY).alias("day"))
    banned = events.select(F.explode(F.sequence(F.ceil((F.col("bar") - before * DAY) / DAY), F.ceil((F.col("bar") + after * DAY) / DAY) - 1)).alias("d")).select((F.col("d") * DAY).alias("day")).distinct()
    return days.join(banned, "day", "left_anti")
