"""Walk-forward: anchors, as-of rows, strategies and admission."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barproof.operators import features as ft
from barproof.operators import plans as pl
from barproof.sources import readers as rd


def anchors(bars: DataFrame, warmup: int = 0, step: int = 1, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Every ``step``-th of all distinct bar times, from index ``warmup``.

    The distinct times of the calendar (one row per bar time, not per bar) are
    numbered in two levels, by day and within the day, so that no single task
    sorts them all: counts per day are summed and offset the rank within a day.
    """
    times = bars.select("t").distinct().withColumn("_day", F.floor(F.col("t") / 86_400_000))
    per_day = times.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    month = F.floor(F.col("_day") / 32)
    by_month = per_day.withColumn("_m", month).groupBy("_m").agg(F.sum("_n").alias("_nm"))
    base = by_month.withColumn("_base", F.sum("_nm").over(Window.orderBy("_m")) - F.col("_nm"))  # one row a month
    per_day = per_day.withColumn("_m", month).join(F.broadcast(base), "_m")
    per_day = per_day.withColumn("_first", F.col("_base") + F.sum("_n").over(Window.partitionBy("_m").orderBy("_day")) - F.col("_n"))
    i = F.col("_first") + F.row_number().over(Window.partitionBy("_day").orderBy("t")) - 1
    out = times.join(per_day.select("_day", "_first"), "_day").withColumn("_i", i)
    out = out.where((F.col("_i") >= warmup) & ((F.col("_i") - warmup) % step == 0))
    if start is not None:
        out = out.where(F.col("t") >= start)
    if stop is not None:
        out = out.where(F.col("t") <= stop)
    return out.select(F.col("t").alias("anchor"))


#: Length of the spans that an as-of join is split into, in milliseconds.
SPAN = 512 * 86_400_000


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, values: list[str], found: str = "found_t", span_ms: int = SPAN) -> DataFrame:
    """Backward, inclusive as-of join: the last right row with right_t <= left_t, by union and windows (no range join).

    A key's rows are split by spans of time, so a key that holds most rows is
    spread: each span is one window of its own, and what holds when a span begins
    is carried in from one row for each key and span before it.
    """
    r = right.select(*keys, F.col(right_t).alias("_t"), F.lit(0).alias("_k"), F.struct(F.col(right_t).alias("_rt"), *values).alias("_v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    l = left.select(*keys, F.col(left_t).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct(*[left[c] for c in left.columns]).alias("_l"))
    span = F.floor(F.col("_t") / span_ms).alias("_s")
    ends = r.groupBy(*keys, span).agg(F.max_by("_v", "_t").alias("_c"))
    w = Window.partitionBy(*keys, "_s").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l).withColumn("_s", F.floor(F.col("_t") / span_ms)).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_k = 1")
    # the carry: spans that have left rows, each as-of in the ends (few rows a key)
    asked = l.select(*keys, span).distinct().withColumn("_c", F.lit(None).cast(r.schema["_v"].dataType)).withColumn("_q", F.lit(0))
    line = ends.select(*keys, "_s", "_c").withColumn("_q", F.lit(1)).unionByName(asked)
    carried = line.withColumn("_c", F.last("_c", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_s", "_q").rowsBetween(Window.unboundedPreceding, -1))).where("_q = 0").drop("_q")
    both = both.join(carried, [*keys, "_s"], "left").withColumn("_v", F.coalesce("_v", "_c"))
    return both.select("_l.*", F.col("_v._rt").alias(found), *[F.col(f"_v.{v}").alias(v) for v in values])


def symbols_at(anchor_rows: DataFrame, bars: DataFrame, values: list[str], least_i: int = 1, day_ms: int = 86_400_000) -> DataFrame:
    """(anchor, sym) with each symbol's last bar at or before the anchor, for symbols that have two bars by then.

    Most anchors are a bar's own time: they are an equi-join.  The others lie in a gap of
    the symbol, between a bar and the next one; gaps meet the anchors of their days.
    """
    w = ft.by_block()
    held = ft.framed(bars.select("sym", "t", *values), 0, 1, known="i" in values).withColumn("_next", F.lead("t").over(w))
    held = ft.unframed(held).where(F.col("i") >= least_i)
    at = anchor_rows.select("anchor").distinct()
    on = held.join(at, F.col("t") == F.col("anchor")).select("anchor", "sym", F.col("t").alias("found_t"), *values)
    last = at.agg(F.max("anchor").alias("_last"))
    gap = held.join(F.broadcast(last), F.coalesce("_next", F.col("_last") + 1) > F.col("t") + 1)  # one row
    gap = gap.withColumn("_until", F.coalesce("_next", F.col("_last") + 1))
    gap = gap.withColumn("_day", F.explode(F.sequence(F.floor((F.col("t") + 1) / day_ms), F.floor((F.col("_until") - 1) / day_ms))))
    days = at.withColumn("_day", F.floor(F.col("anchor") / day_ms))
    off = gap.join(days, "_day").where((F.col("anchor") > F.col("t")) & (F.col("anchor") < F.col("_until")))
    return on.unionByName(off.select("anchor", "sym", F.col("t").alias("found_t"), *values))


class Rule:
    """A strategy: holding time in days, ratio, whether it pays funding, and its pick (rows of (anchor, sym) -> side)."""

    def __init__(self, name: str, hold_days: int, rm: float, side: Callable[[int], Column], perp: bool = False):
        self.name, self.hold_days, self.rm, self.side, self.perp = name, hold_days, rm, side, perp


def _sign(days: int) -> Callable[[int], Column]:
    return lambda per_day: F.coalesce(F.signum(F.col(f"ret{days}d")).cast("int"), F.lit(0))


def _revert(per_day: int) -> Column:
    z = F.col("ret3d") / (F.col("vol") * F.sqrt(F.lit(float(3 * per_day))))
    return F.when((F.col("vol") > 0) & (z < -2), 1).when((F.col("vol") > 0) & (z > 2), -1).otherwise(0)


RULES = {r.name: r for r in (
    Rule("tsmom20", 5, 2.0, _sign(20)), Rule("tsmom60", 5, 2.0, _sign(60)),
    Rule("donch20", 5, 2.0, lambda d: F.col("donch20d")), Rule("donch55", 5, 2.0, lambda d: F.col("donch55d")),
    Rule("revert3", 1, 1.5, _revert),
    Rule("fund_pct", 3, 1.5, lambda d: F.when(F.col("pct") >= 0.9, -1).when(F.col("pct") <= 0.1, 1).otherwise(0), True),
    Rule("fund_abs", 3, 1.5, lambda d: F.when(F.col("avg_n") >= 0.0003, -1).when(F.col("avg_n") <= -0.0003, 1).otherwise(0), True),
    Rule("xsmom30", 5, 2.0, lambda d: F.when(F.col("_n") < 6, 0).when(F.col("_hi") <= 3, 1).when(F.col("_lo") <= 3, -1).otherwise(0)),
)}


RETURNS, CHANNELS = (3, 20, 30, 60), (20, 55)


def features_for(bars: DataFrame, per_day: int, wanted: set[str] | None = None) -> DataFrame:
    """The rule features (all, or those ``wanted``) on each bar, by blocks."""
    returns = {f"ret{d}d": d * per_day for d in RETURNS if wanted is None or f"ret{d}d" in wanted}
    channels = {f"donch{d}d": d * per_day for d in CHANNELS if wanted is None or f"donch{d}d" in wanted}
    b = ft.with_ewma_vol(bars)
    if returns or channels:
        b = ft.framed(b, max([*returns.values(), *(k + 1 for k in channels.values())]), known=True)
        b = ft.unframed(b.withColumns({**{n: ft.log_return(k) for n, k in returns.items()}, **{n: ft.donchian(k) for n, k in channels.items()}}))
    return b


FEATURES = ["i", "c", "vol", "ret3d", "ret20d", "ret30d", "ret60d", "donch20d", "donch55d"]


def candidates(names: list[str], feats: DataFrame, anchor_rows: DataFrame, per_day: int, tf_ms: int, funding: DataFrame | None = None) -> DataFrame:
    """Plans that the rules would open at each anchor, before admission."""
    rows = symbols_at(anchor_rows, feats, FEATURES)
    if any(RULES[n].perp for n in names):
        f = ft.with_funding_pct(funding)
        rows = as_of(rows, f, ["sym"], "anchor", "t", ["avg_n", "pct"], "fund_t")
    if "xsmom30" in names:
        ranked = F.round("ret30d", 9)
        by = Window.partitionBy("anchor")
        rows = rows.withColumns({
            "_hi": F.when(F.col("ret30d").isNotNull(), F.row_number().over(by.orderBy(ranked.desc_nulls_last(), "sym"))),
            "_n": F.count("ret30d").over(by),
        }).withColumn("_lo", F.col("_n") - F.col("_hi") + 1)
    options = [F.struct(F.lit(n).alias("strat"), F.lit(RULES[n].hold_days * per_day).alias("hz"), F.lit(RULES[n].rm).alias("rm"), RULES[n].side(per_day).cast("int").alias("side")) for n in names]
    p = rows.where("vol > 0").withColumn("_o", F.explode(F.array(*options))).select("_o.*", "sym", F.col("c").alias("entry"), "vol", F.col("anchor").alias("t0")).where("side <> 0")
    p = p.withColumn("tf_ms", F.lit(tf_ms).cast("long")).withColumn("plan_id", F.concat_ws("|", "strat", "sym", F.col("t0").cast("string")))
    return pl.levels(p)


def next_after(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, values: list[str], found: str) -> DataFrame:
    """Forward, inclusive as-of join: the first right row with right_t >= left_t."""
    back = lambda df, t: df.withColumn("_back", -F.col(t))
    out = as_of(back(left, left_t), back(right, right_t), keys, "_back", "_back", values, "_found").drop("_back")
    return out.withColumn(found, -F.col("_found")).drop("_found")


#: Bars in a span of admission.
SPAN_BARS = 4096


def admit(cand: DataFrame, span_ms: int | None = None) -> DataFrame:
    """Keeps a plan unless one of its symbol and side is open; an open opposite plan is cut at the new plan's time.

    Shadow plans (``shadow``, where there is such a column) have a ledger of their own, in
    which nothing is cut.

    What is admitted after an admitted plan follows from that plan alone: the first later
    candidate of the other side, or of its own side once it has ended (with shadow plans,
    of its own side only).  So a key's candidates are a forest of pointers to later ones,
    and the chain from the first one is what is admitted.  A key is cut into spans of time
    (SPAN_BARS bars, or ``span_ms``): within a span, each candidate learns the last one of
    its chain there; where chains go on from these few last ones, as-of joins over spans
    say, and pointers between spans double until the chain from the first candidate is
    known; then each span follows it from where it enters.
    """
    by = ["strat", "sym"] + ["shadow"] * ("shadow" in cand.columns)
    both = "shadow" not in by
    key = [*by, "_apart"]
    names = [*key, "_s"]
    size = F.lit(span_ms) if span_ms else SPAN_BARS * F.coalesce(F.col("tf_ms") if "tf_ms" in cand.columns else F.lit(None).cast("long"), F.lit(86_400_000))
    rows = cand.withColumn("_apart", F.lit(0) if both else F.when(F.col("shadow"), F.col("side")).otherwise(0)).withColumn("_size", size.cast("long"))
    # candidates in order of (time, side); of equal ones the first is all that can be admitted
    rows = rows.select(*key, "_size", F.floor(F.col("t0") / F.col("_size")).alias("_s"), (F.col("t0") * 2 + (F.col("side") > 0).cast("long")).alias("o"), "plan_id", "t0", "side", "t_end")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        """A span's candidates: the next one of each one's chain in the span, and the last one with its side and end; and which are on the chain of the first."""
        pdf = pdf.sort_values(["o", "plan_id"]).drop_duplicates("o")
        n, side, t0, end, o = len(pdf), pdf["side"].to_numpy(), pdf["t0"].to_numpy(), pdf["t_end"].to_numpy(), pdf["o"].to_numpy()
        nxt, apart = np.full(n, n), bool(pdf["_apart"].iloc[0])
        for x in (1, -1):
            own, other = np.flatnonzero(side == x), np.flatnonzero(side != x)
            ended = np.maximum(np.searchsorted(t0[own], end[own]), np.arange(len(own)) + 1)  # a later one, even of a plan without length
            nxt[own] = np.append(own, n)[ended]
            if not apart:
                nxt[own] = np.minimum(nxt[own], np.append(other, n)[np.searchsorted(other, own)])
        last, first = np.arange(n), np.zeros(n + 1, bool)
        for k in range(n - 1, -1, -1):
            if nxt[k] < n:
                last[k] = last[nxt[k]]
        first[0] = True
        for k in range(n):
            first[nxt[k]] |= first[k]
        return pd.DataFrame({**{c: pdf[c] for c in (*names, "_size", "plan_id", "o", "side", "t_end")}, "nxt": np.append(o, -1)[nxt], "last": o[last], "last_side": side[last], "last_end": end[last], "first": first[:n]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    key_sql = ", ".join(f"{c} {kinds[c]}" for c in names)
    chained = rd.stored(rows.groupBy(*names).applyInPandas(within, f"{key_sql}, _size long, plan_id {kinds['plan_id']}, o long, side int, t_end long, nxt long, last long, last_side int, last_end long, first boolean"), "chains")
    ends = chained.groupBy(*key).agg(F.min("_s").alias("_begin"), F.max("_s").alias("_end"))
    lasts = chained.where("o = last").join(ends, key).where("_s < _end").select(*key, "last", "last_side", "last_end", ((F.col("_s") + 1) * F.col("_size")).alias("_later"))
    lasts = rd.stored(lasts, "lasts")
    kept = chained.join(ends, key).where("first AND _s = _begin").select(*key, "plan_id", "o", "side", "t_end", "nxt")
    if not lasts.isEmpty():
        kept = _in_all_spans(chained, lasts, ends, key, key_sql)
    # an admitted plan is cut by the next one admitted, if that is of the other side
    at, other = F.floor(F.col("nxt") / 2), F.when(F.col("nxt") % 2 == 1, 1).otherwise(-1)
    cut = (F.col("nxt") >= 0) & (other != F.col("side")) & (at < F.col("t_end")) & (F.col("_apart") == 0)
    flips = kept.select("plan_id", F.when(cut, at).alias("_flip"))
    return cand.join(flips, "plan_id").withColumns({"flipped": F.col("_flip").isNotNull(), "t_end": F.coalesce("_flip", "t_end")}).drop("_flip")


def _in_all_spans(chained: DataFrame, lasts: DataFrame, ends: DataFrame, key: list[str], key_sql: str) -> DataFrame:
    """What is admitted, over spans; of a span's last plan ``nxt`` is what its chain enters next."""
    nodes = chained.select(*key, "side", F.floor(F.col("o") / 2).alias("_t"), F.col("o").alias("_o"))
    own = next_after(lasts.withColumn("side", F.col("last_side")).withColumn("_at", F.greatest("last_end", "_later")), nodes, [*key, "side"], "_at", "_t", ["_o"], "_found_t").withColumnRenamed("_o", "_own").drop("_found_t", "_at")
    apart = F.col("_apart") != 0
    other = next_after(own.withColumn("side", -F.col("last_side")), nodes, [*key, "side"], "_later", "_t", ["_o"], "_found_t")
    goes = rd.stored(other.select(*key, "last", F.when(apart, F.col("_own")).otherwise(F.least("_own", "_o")).alias("enters")).where("enters IS NOT NULL"), "goes")
    hops = chained.select(*key, "o", "last").join(goes, [*key, "last"]).select(*key, "o", F.col("enters").alias("to"))
    heads = chained.join(ends, key).where("_s = _begin").groupBy(*key).agg(F.min("o").alias("o"))
    # only candidates at which a chain enters a span are places to come from
    places = goes.select(*key, F.col("enters").alias("o")).unionByName(heads).distinct()
    jumps = [rd.stored(hops.join(places, [*key, "o"], "left_semi"), "hops")]
    while not jumps[-1].isEmpty():  # each jump goes twice as many spans on; a key has few
        far = jumps[-1].select(*key, F.col("o").alias("to"), F.col("to").alias("_far"))
        jumps.append(rd.stored(jumps[-1].join(far, [*key, "to"]).select(*key, "o", F.col("_far").alias("to")), "hops"))
    entered = heads
    for jump in jumps[-2::-1]:
        entered = entered.unionByName(entered.join(jump, [*key, "o"]).select(*key, F.col("to").alias("o")))
    entered = entered.withColumnRenamed("o", "enters").join(chained.select(*key, "_s", F.col("o").alias("enters")), [*key, "enters"])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        nxt, at, keep = dict(zip(pdf["o"], pdf["nxt"])), int(pdf["enters"].iloc[0]), []
        while at >= 0:
            keep.append(at)
            at = nxt[at]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(keep) for c in (*key, "_s")}, "o": keep})

    on = chained.select(*key, "_s", "o", "nxt").join(entered, [*key, "_s"]).groupBy(*key, "_s").applyInPandas(follow, key_sql + ", o long")
    kept = chained.join(on.drop("_s"), [*key, "o"], "left_semi").select(*key, "plan_id", "o", "side", "t_end", "nxt")
    return kept.join(goes.withColumnRenamed("last", "o"), [*key, "o"], "left").withColumn("nxt", F.when(F.col("nxt") < 0, F.coalesce("enters", "nxt")).otherwise(F.col("nxt"))).drop("enters")
