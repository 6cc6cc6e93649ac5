"""Queries on bars, funding, events and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barproof.functions import text as tx
from barproof.jobs import base as b
from barproof.jobs import sql as q
from barproof.jobs.registry import register
from barproof.operators import features as ft
from barproof.operators import joins as jn
from barproof.operators import metrics as mt
from barproof.operators import plans as pl
from barproof.operators import plugins
from barproof.operators import replay as rp
from barproof.operators import walk
from barproof.sources import fixtures as fx
from barproof.sources import readers as rd
from barproof.sources.store import MonthStore

R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
LEVELS = ("entry", "sl", "tp1", "tp2", "rm", "d_stop")
PLAN = f"strat, sym, side, t0, t_end, hz, {R(*LEVELS)}"


def plan_cols(df):
    return b.r6(df, *LEVELS).select("strat", "sym", "side", "t0", "t_end", "hz", *LEVELS)


# ---- sources ----


@register("src_bars", q.query(f"SELECT sym, '1d' AS tf, format, t, {R(*'ohlc')}, v FROM bars, (VALUES ('lines'), ('array'), ('csv')) f(format)"))
def src_bars(spark, d):
    """The same bars as JSON lines, as files of one JSON array each, and as CSV."""
    path, bars = rd.scratch(spark, "bars"), fx.bars_1d(spark, d)
    out = None
    for form, (write, read) in rd.BAR_FORMATS.items():
        write(bars, f"{path}/{form}", "1d")
        back = read(spark, f"{path}/{form}").withColumn("format", F.lit(form))
        out = back if out is None else out.unionByName(back)
    return b.r6(out, *"ohlc").select("sym", "tf", "format", "t", *"ohlcv")


@register("src_bars_merge", q.query("SELECT sym, t, round(CASE WHEN i % 10 = 0 THEN c * 1.01 ELSE c END, 6) AS c, v FROM b0"))
def src_bars_merge(spark, d):
    """A first load, then an update that brings some bars again: only the months it touches are rewritten."""
    schema = "sym string, t long, c double, v double, seq long"
    bars = ft.with_index(fx.bars_1d(spark, d))
    again = bars.where("i % 10 = 0").withColumn("c", F.col("c") * 1.01)
    version = lambda df, k: df.select("sym", "t", "c", "v", F.lit(k).cast("long").alias("seq"))
    store = MonthStore(spark, rd.scratch(spark, "bars"), schema)
    store.merge(version(bars, 0), 0)
    store.merge(version(again, 1), 1)
    return b.r6(store.read(), "c").select("sym", "t", "c", "v")


@register("src_bars_trim", q.query("SELECT sym, t, round(c, 6) AS c FROM bars QUALIFY row_number() OVER (PARTITION BY sym ORDER BY t DESC) <= 1000"))
def src_bars_trim(spark, d):
    return b.r6(rd.newest(fx.bars_1d(spark, d), 1000), "c").select("sym", "t", "c")


@register("src_gaps", q.query("SELECT sym, CAST(sum(greatest(dt // 3600000 - 1, 0)) AS BIGINT) AS missing, count(*) AS bars FROM (SELECT sym, t - lag(t) OVER (PARTITION BY sym ORDER BY t) AS dt FROM hbars) GROUP BY sym"))
def src_gaps(spark, d):
    return rd.gaps(fx.bars_1h(spark, d), b.HOUR)


@register("src_funding", q.query("SELECT sym, t, round(CASE WHEN i % 7 = 0 THEN -r ELSE r END, 8) AS r FROM f0"))
def src_funding(spark, d):
    f = ft.with_index(fx.funding(spark, d))
    again = f.where("i % 7 = 0").withColumn("r", -F.col("r")).withColumn("seq", F.lit(1))
    return rd.latest(f.withColumn("seq", F.lit(0)).unionByName(again).drop("i"), ["sym", "t"]).select("sym", "t", F.round("r", 8).alias("r"))


@register("src_calendar", q.query("SELECT tarih, saat_utc, tur, '' AS note, bar AS t, bar FROM calendar"))
def src_calendar(spark, d):
    path = rd.scratch(spark, "calendar")
    fx.calendar(spark, d).write.option("header", "true").csv(path)
    return rd.calendar(spark.read.option("header", "true").csv(path), b.DAY)


LIST_SQL = f"""SELECT *, CASE WHEN i % 35 = 0 THEN 'ZZ' ELSE sym END AS xsym, CASE WHEN i % 45 = 0 THEN t + 400000 * CAST({b.DAY} AS BIGINT) ELSE t END AS xt, (i // 5) % 7 AS w, CASE WHEN i % 10 = 0 THEN 24 ELSE 5 END AS xhz, CASE WHEN i % 20 = 0 THEN 2.0 ELSE 1.5 END AS xrm,
  CASE WHEN (i // 5) % 7 < 3 THEN 1 WHEN (i // 5) % 7 < 6 THEN -1 END AS xside, CASE WHEN i % 30 = 0 THEN round(c * 0.95, 2) END AS xsl, CASE WHEN i % 30 = 0 THEN round(c * 1.1, 2) END AS xtp FROM feats"""
LIST_TABLES = dict(
    xl=LIST_SQL,
    xr="SELECT x.*, CASE WHEN xsym = 'ZZ' THEN 'sym' WHEN xt <> t THEN 'bar' WHEN xside IS NULL THEN 'side' WHEN xsl > 0 AND (xside = -1 OR xsl >= c OR xtp <= c) THEN 'vol' WHEN xsl IS NULL AND NOT coalesce(vol > 0, false) THEN 'vol' END AS reason FROM xl x",
    xp=f"SELECT 'list' AS strat, sym, xside AS side, c AS entry, CASE WHEN xsl > 0 THEN abs(ln(xtp / c)) / abs(ln(xsl / c)) ELSE xrm END AS rm, CASE WHEN xsl > 0 THEN abs(ln(xsl / c)) ELSE greatest(1e-4, vol * sqrt(xhz)) END AS d_stop, xhz AS hz, t AS t0, t + xhz * {b.DAY} AS t_end FROM xr WHERE reason IS NULL",
)


def plan_list(spark, d):
    """An external list rendered from bars: mixed times, symbols and side words, some rows wrong."""
    f = b.feats(spark, d)
    words = F.array(*[F.lit(w) for w in ("1", "long", "BUY", "-1", "short", "Sell", "??")])
    t = F.when(F.col("i") % 45 == 0, F.col("t") + 400_000 * b.DAY).otherwise(F.col("t"))
    iso = F.date_format(F.timestamp_add("MILLISECOND", t, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")), "yyyy-MM-dd")
    sl = F.when(F.col("i") % 30 == 0, F.round(F.col("c") * 0.95, 2))
    return f.select(
        F.when((F.col("i") % 2 == 0) & (F.col("i") % 45 != 0), iso).otherwise(t.cast("string")).alias("t0"),
        F.when(F.col("i") % 35 == 0, "zz").otherwise(F.lower(F.concat(F.substring("sym", 1, 1), F.lit("-"), F.substring("sym", 2, 1)))).alias("sym"),
        F.element_at(words, (F.floor(F.col("i") / 5) % 7 + 1).cast("int")).alias("side"), F.when(F.col("i") % 10 != 0, "5").alias("hz"), F.when(F.col("i") % 20 == 0, "2").alias("rm"),
        sl.cast("string").alias("sl"), F.when(F.col("i") % 30 == 0, F.round(F.col("c") * 1.1, 2)).cast("string").alias("tp"))


@register("src_plans_csv", q.query("SELECT xsym AS sym, xt AS t0, xside AS side, CASE WHEN xhz = 24 THEN NULL ELSE xhz END AS hz, CASE WHEN xrm = 2 THEN xrm END AS rm, xsl AS sl, xtp AS tp FROM xl", **LIST_TABLES))
def src_plans_csv(spark, d):
    path = rd.scratch(spark, "plans")
    plan_list(spark, d).write.option("header", "true").csv(path)
    raw = rd.read_plans_csv(spark, path)
    return raw.select(tx.clean_symbol(F.col("sym")).alias("sym"), rd.iso_millis(F.col("t0")).alias("t0"), tx.side_word(F.col("side")).alias("side"), F.col("hz").cast("int").alias("hz"), *[F.col(c).cast("double").alias(c) for c in ("rm", "sl", "tp")])


# ---- plans ----


@register("prj_mkplan", q.query(f"SELECT {PLAN} FROM cand WHERE strat IN ('tsmom20', 'revert3')"))
def prj_mkplan(spark, d):
    return plan_cols(b.cand(spark, d, ("tsmom20", "revert3")))


@register("prj_planlevels", q.query("SELECT plan_id, round(entry * exp(-side * d_stop), 6) AS sl, round(CASE WHEN rm > 1 THEN entry * exp(side * d_stop) END, 6) AS tp1, round(entry * exp(side * d_stop * rm), 6) AS tp2, round((1 - exp(-d_stop)) * 100, 6) AS stop_pct, hz / 2.0 AS d_med, hz / 1.0 AS d_max, round(0.01 / (1 - exp(-d_stop)) * 100, 6) AS pos_pct FROM book"))
def prj_planlevels(spark, d):
    p = pl.plan_levels(b.book(spark, d).withColumn("t_med", F.col("hz") / 2), 1)
    return b.r6(p, "sl", "tp1", "tp2", "stop_pct", "pos_pct").select("plan_id", "sl", "tp1", "tp2", "stop_pct", "d_med", "d_max", "pos_pct")


@register("prj_csv_plan", q.query(f"SELECT 'plan' AS kind, sym, t0, side, {R('entry', 'rm', 'd_stop')}, round(entry * exp(-side * d_stop), 6) AS sl, round(entry * exp(side * rm * d_stop), 6) AS tp2, 1 AS n FROM xp UNION ALL SELECT reason, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM xr WHERE reason IN ('sym', 'bar', 'vol') GROUP BY reason", **LIST_TABLES))
def prj_csv_plan(spark, d):
    p, skipped = jn.plans_from_list(plan_list(spark, d), b.feats(spark, d), b.DAY)
    p = b.r6(p, "entry", "rm", "d_stop", "sl", "tp2").select(F.lit("plan").alias("kind"), "sym", "t0", "side", "entry", "rm", "d_stop", "sl", "tp2", F.lit(1).cast("long").alias("n"))
    return p.unionByName(skipped.groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True)


@register("prj_flip", q.query(f"SELECT {PLAN} FROM ({q.mirrored('book')})"))
def prj_flip(spark, d):
    return plan_cols(pl.mirror(b.book(spark, d)))


@register("prj_netr", q.query(f'''SELECT plan_id, round(raw_r - {q.COST} / d_stop - CASE WHEN "at" IS NOT NULL THEN side * 0.0001 * (greatest(0, "at" - t0) / 3.6e6 / 8) / d_stop ELSE 0 END, 6) AS r FROM runs'''))
def prj_netr(spark, d):
    raw = rp.replay(b.book(spark, d), fx.bars_1d(spark, d))
    return raw.select("plan_id", F.round(pl.net_r(F.col("r"), 0.0001), 6).alias("r"))


@register("prj_filter_closed", q.query(f"SELECT plan_id, state FROM runs WHERE state IN {q.CLOSED}"))
def prj_filter_closed(spark, d):
    return pl.closed(b.runs(spark, d)).select("plan_id", "state")


@register("prj_risk_size", q.query("""SELECT plan_id, round(1000 * 0.01 / sp, 6) AS pos, round(1000 * 0.01 / sp / 100, 6) AS leverage, round(CASE WHEN side > 0 THEN entry * (1 - 1 / lev + 0.005) ELSE entry * (1 + 1 / lev - 0.005) END, 6) AS liquidation,
  round(abs(CASE WHEN side > 0 THEN -1 / lev + 0.005 ELSE 1 / lev - 0.005 END) / sp, 6) AS liq_to_stop, round(1 - pow(1 - 0.01, 10), 6) AS loss_run_10 FROM (SELECT *, 1 - exp(-d_stop) AS sp, greatest(1000 * 0.01 / (1 - exp(-d_stop)) / 100, 1) AS lev FROM book)"""))
def prj_risk_size(spark, d):
    sp = 1 - F.exp(-F.col("d_stop"))
    pos = 1000 * 0.01 / sp
    lev = F.greatest(pos / 100, F.lit(1.0))
    move = F.when(F.col("side") > 0, -1 / lev + 0.005).otherwise(1 / lev - 0.005)
    return b.book(spark, d).select("plan_id", F.round(pos, 6).alias("pos"), F.round(pos / 100, 6).alias("leverage"), F.round(F.col("entry") * (1 + move), 6).alias("liquidation"), F.round(F.abs(move) / sp, 6).alias("liq_to_stop"), F.round(1 - F.pow(F.lit(0.99), 10), 6).alias("loss_run_10"))


@register("prj_breakeven", q.query(f"""SELECT plan_id, round((1 - exp(-d_stop)) * 100, 6) AS stop_pct, round((exp(rm * d_stop) - 1) * 100, 6) AS tgt_pct, round((1 + {q.COST} / d_stop) / (1 + rm), 6) AS breakeven, round(liq, 6) AS liq, CASE WHEN side > 0 THEN liq > sl ELSE liq < sl END AS liq_before_stop
  FROM (SELECT *, entry * exp(-side * ln(1 + 1.0 / 20 * 0.995)) AS liq FROM book)"""))
def prj_breakeven(spark, d):
    liq = F.col("entry") * F.exp(-F.col("side") * F.ln(F.lit(1 + 1 / 20 * 0.995)))
    before = F.when(F.col("side") > 0, liq > F.col("sl")).otherwise(liq < F.col("sl"))
    return b.book(spark, d).select("plan_id", F.round((1 - F.exp(-F.col("d_stop"))) * 100, 6).alias("stop_pct"), F.round((F.exp(F.col("rm") * F.col("d_stop")) - 1) * 100, 6).alias("tgt_pct"), F.round((1 + pl.COST / F.col("d_stop")) / (1 + F.col("rm")), 6).alias("breakeven"), F.round(liq, 6).alias("liq"), before.alias("liq_before_stop"))


# ---- joins ----


@register("jn_replay_range", q.query("SELECT p.plan_id, count(*) AS n, min(b.t) AS first_t, max(b.t) AS last_t, round(max(b.h), 6) AS hi, round(min(b.l), 6) AS lo FROM book p JOIN bars b ON p.sym = b.sym AND b.t > p.t0 AND b.t <= p.t_end GROUP BY p.plan_id"))
def jn_replay_range(spark, d):
    j = rp.range_join(b.book(spark, d).select("plan_id", "sym", "t0", "t_end"), fx.bars_1d(spark, d))
    return j.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.round(F.max("h"), 6).alias("hi"), F.round(F.min("l"), 6).alias("lo"))


@register("jn_asof_bar", q.query("SELECT anchor, sym, t AS found_t, i, round(c, 6) AS c, round(vol, 9) AS vol FROM arows"))
def jn_asof_bar(spark, d):
    f = b.feats(spark, d)
    rows = walk.symbols_at(b.anchors(f), f, walk.FEATURES)
    return rows.select("anchor", "sym", "found_t", "i", F.round("c", 6).alias("c"), F.round("vol", 9).alias("vol"))


@register("jn_asof_funding", q.query("SELECT p.anchor, p.sym, f.t AS found_t, round(f.r, 8) AS r FROM (SELECT anchor + 1 AS anchor, sym FROM anchors CROSS JOIN syms) p ASOF JOIN funding f ON p.sym = f.sym AND p.anchor >= f.t"))
def jn_asof_funding(spark, d):
    f = fx.funding(spark, d)
    at = b.anchors(fx.bars_1d(spark, d)).withColumn("anchor", F.col("anchor") + 1)
    return walk.symbols_at(at, f, ["r"], least_i=0).withColumn("r", F.round("r", 8))


@register("jn_funding_interval", q.query("SELECT p.plan_id, round(coalesce(sum(f.r), 0), 8) AS paid FROM book p LEFT JOIN funding f ON p.sym = f.sym AND f.t > p.t0 AND f.t <= p.t_end GROUP BY p.plan_id"))
def jn_funding_interval(spark, d):
    unit = b.book(spark, d).select("plan_id", "sym", "t0", "t_end", F.lit("stop").alias("state"), F.lit(None).cast("long").alias("at"), F.lit(-1).alias("side"), F.lit(1.0).alias("d_stop"), F.lit(0.0).alias("r"))
    return mt.add_funding(unit, fx.funding(spark, d)).select("plan_id", F.round("fund_r", 8).alias("paid"))


FWD = f"""SELECT sym, t, CASE WHEN ok THEN abs(ln(fc / pc)) END AS fwd_abs, CASE WHEN ok THEN list_position(st, list_max(st)) - 1 END AS peak FROM
 (SELECT sym, t, lag(c) OVER w AS pc, lead(c, 23) OVER w AS fc, lag(c) OVER w IS NOT NULL AND lead(c, 23) OVER w IS NOT NULL AS ok, [{', '.join(f'round(abs(ln(lead(c, {k}) OVER w / lead(c, {k - 1}) OVER w)), 9)' for k in range(24))}] AS st FROM bars WINDOW w AS (PARTITION BY sym ORDER BY t))"""
q.TABLES["fwd"] = FWD
q.TABLES["evrows"] = "SELECT c.tur, c.bar, f.sym, f.fwd_abs, f.peak FROM calendar c JOIN fwd f ON f.t = c.bar WHERE f.fwd_abs IS NOT NULL"


def fwd(spark, d):
    return ft.with_forward_abs(fx.bars_1d(spark, d)).select("sym", "t", "fwd_abs", "peak")


def events(spark, d):
    return rd.calendar(fx.calendar(spark, d), b.DAY)


def ev_rows(spark, d):
    return jn.event_bars(events(spark, d).select("tur", "bar"), fwd(spark, d), ["fwd_abs", "peak"]).where("fwd_abs IS NOT NULL")


@register("jn_event_bar", q.query("SELECT tur, bar, sym, round(fwd_abs, 6) AS fwd_abs, peak FROM evrows"))
def jn_event_bar(spark, d):
    return b.r6(ev_rows(spark, d), "fwd_abs").select("tur", "bar", "sym", "fwd_abs", "peak")


def _days(lead: int, tail: int) -> str:
    return f"""SELECT day FROM (SELECT unnest(range((a + {lead}) // {b.DAY}, (z - {tail} - 1) // {b.DAY} + 1)) * {b.DAY} AS day FROM (SELECT min(a) AS a, min(z) AS z FROM (SELECT sym, min(t) AS a, max(t) AS z FROM bars GROUP BY sym)))
 WHERE NOT EXISTS (SELECT 1 FROM calendar c WHERE day >= c.bar - 2 * {b.DAY} AND day < c.bar + 3 * {b.DAY})"""


H1_LEAD, H1_TAIL = 2 * b.DAY, 26 * b.DAY
q.TABLES["freedays"] = _days(H1_LEAD, H1_TAIL)


@register("jn_event_antizone", q.query("SELECT day FROM freedays"))
def jn_event_antizone(spark, d):
    return jn.free_days(fx.bars_1d(spark, d), events(spark, d), H1_LEAD, H1_TAIL)


# ---- replay ----

def run_cols(df):
    return b.r6(df, "px", "r").select("plan_id", "state", "at", "px", "r", "half", "n")


@register("rp_replay", q.query('SELECT plan_id, state, "at", round(px, 6) AS px, round(raw_r, 6) AS r, half, n FROM runs'))
def rp_replay(spark, d):
    return run_cols(rp.replay(b.book(spark, d), fx.bars_1d(spark, d)))


@register("rp_run", q.query("SELECT plan_id, CASE WHEN sym = 'AF' THEN 'no-data' ELSE state END AS state, round(CASE WHEN sym = 'AF' THEN 0 ELSE r END, 6) AS r FROM runs"))
def rp_run(spark, d):
    out = rp.run(b.book(spark, d), fx.bars_1d(spark, d).where("sym <> 'AF'"))
    return b.r6(out, "r").select("plan_id", "state", "r")


@register("rp_progress", q.query(f"""SELECT plan_id, round(cur, 6) AS cur, round(r_now, 6) AS r_now, round(greatest(0, least(1, r_now / rm)), 6) AS path, CASE WHEN n >= 4 THEN CASE WHEN r_now - r_old > 0.03 THEN 'nearing' WHEN r_now - r_old < -0.03 THEN 'receding' ELSE 'flat' END END AS trend,
  round(CASE WHEN n >= 4 THEN (r_now - r_old) / k END, 6) AS speed, round(CASE WHEN n >= 4 AND (r_now - r_old) / k > 0.002 THEN (rm - r_now) / ((r_now - r_old) / k) END, 4) AS eta_bars FROM
  (SELECT plan_id, any_value(rm) AS rm, any_value(n) AS n, any_value(greatest(2, n // 3)) AS k, max(c) FILTER (back = 0) AS cur, max(rr) FILTER (back = 0) AS r_now, max(rr) FILTER (back = greatest(2, n // 3)) AS r_old FROM
   (SELECT p.plan_id, p.rm, b.c, p.side * ln(b.c / p.entry) / p.d_stop AS rr, count(*) OVER (PARTITION BY p.plan_id) AS n, row_number() OVER (PARTITION BY p.plan_id ORDER BY b.t DESC) - 1 AS back FROM book p JOIN bars b ON p.sym = b.sym AND b.t > p.t0 AND b.t <= p.t_end) GROUP BY plan_id)"""))
def rp_progress(spark, d):
    return b.r6(rp.progress(b.book(spark, d), fx.bars_1d(spark, d)), "cur", "r_now", "path", "speed").withColumn("eta_bars", F.round("eta_bars", 4)).drop("n")


@register("rp_anchors", q.query("SELECT t AS anchor FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS ix FROM (SELECT DISTINCT t FROM bars)) WHERE ix >= 60 AND (ix - 60) % 7 = 0 AND t >= 800000000000 AND t <= 900000000000"))
def rp_anchors(spark, d):
    return walk.anchors(fx.bars_1d(spark, d), 60, 7, 800_000_000_000, 900_000_000_000)


# ---- aggregates ----


@register("ag_metrics", q.query(q.metrics("runs")))
def ag_metrics(spark, d):
    return mt.metrics(b.runs(spark, d))


@register("ag_drawdown", q.query(q.drawdown("runs")))
def ag_drawdown(spark, d):
    return mt.drawdown(b.runs(spark, d))


@register("ag_tstat", q.query(q.t_stats("runs")))
def ag_tstat(spark, d):
    return mt.t_stats(b.runs(spark, d))


@register("ag_halves", q.query(q.halves("runs")))
def ag_halves(spark, d):
    return mt.halves(b.runs(spark, d))


@register("ag_chance", q.query(q.chance("runs", "fruns")))
def ag_chance(spark, d):
    return mt.chance(*b.both_runs(spark, d))


@register("ag_funding_r", q.query(f"SELECT strat, count(*) FILTER (state IN {q.CLOSED}) AS n, round(sum(r) FILTER (state IN {q.CLOSED}), 6) AS total_r, round(sum(fund_r), 6) AS fund_r, round(sum(r - fund_r) FILTER (state IN {q.CLOSED}), 6) AS price_r FROM pruns WHERE strat LIKE 'fund%' GROUP BY strat"))
def ag_funding_r(spark, d):
    real, _ = b.perp_runs(spark, d, ("fund_pct", "fund_abs"))
    done = pl.closed(real)
    return done.groupBy("strat").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 6).alias("total_r"), F.round(F.sum("fund_r"), 6).alias("fund_r"), F.round(F.sum(F.col("r") - F.col("fund_r")), 6).alias("price_r"))


COMPARE_TABLES = dict(cm=q.metrics("pruns"), cd=q.drawdown("pruns"), ct=q.t_stats("pruns"), ch=q.halves("pruns"), cc=f"SELECT * FROM ({q.chance('pruns', 'pfruns')})")
COMPARE = """SELECT strat, cm.n, total_r, avg_r, t, win_rate, profit_factor, max_drawdown, h1, h2, control_mean, p, CASE WHEN cm.n >= 30 AND t >= 2.5 AND h1 > 0 AND h2 > 0 AND p <= 0.02 THEN 'pass' ELSE 'fail' END AS decision
 FROM cm JOIN cd USING (strat) JOIN ct USING (strat) JOIN ch USING (strat) JOIN cc USING (strat)"""


def compare(real, flipped):
    m = mt.metrics(real).join(mt.drawdown(real), "strat").join(mt.t_stats(real).drop("n"), "strat").join(mt.halves(real), "strat").join(mt.chance(real, flipped), "strat")
    return m.withColumn("decision", pl.decision(F.col("n"), F.col("t"), F.col("h1"), F.col("h2"), F.col("p"))).select("strat", "n", "total_r", "avg_r", "t", "win_rate", "profit_factor", "max_drawdown", "h1", "h2", "control_mean", "p", "decision")


@register("ag_compare", q.query(COMPARE, **COMPARE_TABLES))
def ag_compare(spark, d):
    return compare(*b.perp_runs(spark, d))


@register("prj_decision", q.query("SELECT strat, decision FROM (" + COMPARE + ")", **COMPARE_TABLES))
def prj_decision(spark, d):
    return compare(*b.perp_runs(spark, d)).select("strat", "decision")


# ---- windows ----


@register("wn_ret", q.query("SELECT sym, t, round(r1, 9) AS r1, round(ret20d, 9) AS ret20d FROM feats"))
def wn_ret(spark, d):
    return ft.with_returns(fx.bars_1d(spark, d), {"r1": 1, "ret20d": 20}).select("sym", "t", F.round("r1", 9).alias("r1"), F.round("ret20d", 9).alias("ret20d"))


@register("wn_excursion", q.query(f"SELECT sym, t, round(ln(greatest(h, c) / lag(c) OVER {q.W}), 9) AS ex_hi, round(ln(least(l, c) / lag(c) OVER {q.W}), 9) AS ex_lo FROM bars"))
def wn_excursion(spark, d):
    return ft.with_excursion(fx.bars_1d(spark, d)).select("sym", "t", F.round("ex_hi", 9).alias("ex_hi"), F.round("ex_lo", 9).alias("ex_lo"))


@register("wn_ewma_vol", q.query("SELECT sym, t, round(CASE WHEN i >= 50 THEN sqrt(v) END, 9) AS vol FROM rec",
    rec="SELECT sym, t, i, CAST(0 AS DOUBLE) AS v FROM b0 WHERE i = 0 UNION ALL SELECT n.sym, n.t, n.i, CASE WHEN n.i = 1 THEN n.r1 * n.r1 ELSE 0.97 * p.v + (1 - 0.97) * n.r1 * n.r1 END FROM rec p JOIN b0 n ON n.sym = p.sym AND n.i = p.i + 1"))
def wn_ewma_vol(spark, d):
    return ft.with_ewma_vol(fx.bars_1d(spark, d)).select("sym", "t", F.round("vol", 9).alias("vol"))


@register("wn_donch", q.query("SELECT sym, t, donch20d, donch55d FROM feats"))
def wn_donch(spark, d):
    return ft.with_donchian(fx.bars_1d(spark, d), {"donch20d": 20, "donch55d": 55}).select("sym", "t", "donch20d", "donch55d")


@register("wn_fund_avg", q.query("SELECT sym, t, round(avg_n, 9) AS avg_n FROM favg"))
def wn_fund_avg(spark, d):
    return ft.with_funding_avg(fx.funding(spark, d)).select("sym", "t", F.round("avg_n", 9).alias("avg_n"))


@register("wn_fund_pct", q.query("SELECT sym, t, round(pct, 6) AS pct FROM fpct"))
def wn_fund_pct(spark, d):
    return ft.with_funding_pct(fx.funding(spark, d)).select("sym", "t", F.round("pct", 6).alias("pct"))


q.TABLES["fpos"] = "SELECT sym, t, CASE WHEN i + 1 >= 135 AND len(ref) >= 30 AND avg_n IS NOT NULL THEN len(list_filter(ref, lambda x: x < avg_n)) / CAST(len(ref) AS DOUBLE) END AS pos_pct FROM (SELECT *, list(avg_n) FILTER (avg_n IS NOT NULL) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN 269 PRECEDING AND 1 PRECEDING) AS ref FROM favg)"


@register("wn_pos_pct", q.query("SELECT sym, t, round(pos_pct, 6) AS pos_pct FROM fpos"))
def wn_pos_pct(spark, d):
    return ft.with_position_pct(fx.funding(spark, d)).select("sym", "t", F.round("pos_pct", 6).alias("pos_pct"))


def _lab(bars: str) -> dict[str, str]:
    c8 = lambda e: f"least(greatest({e}, -8), 8)"
    return dict(
        l0=f"SELECT *, row_number() OVER {q.W} - 1 AS i, ln(c / lag(c) OVER {q.W}) AS r1, ln(nullif(v, 0)) AS lv, count(v) OVER (PARTITION BY sym) AS nv, min(t) OVER (PARTITION BY sym) AS t_min FROM {bars}",
        l1=f"SELECT *, CASE WHEN i >= 1 THEN sqrt(pow(0.97, i) * sum(CASE WHEN i = 0 THEN 0 WHEN i = 1 THEN r1 * r1 ELSE 0.03 * r1 * r1 END * pow(0.97, -i)) OVER {q.W}) END AS vol FROM l0",
        l2=f"SELECT *, nullif(lag(vol) OVER {q.W}, 0) AS vp, ln(c / lag(c, 6) OVER {q.W}) AS q6, ln(c / lag(c, 24) OVER {q.W}) AS q24, ln(c / lag(c, 120) OVER {q.W}) AS q120, avg(lv) OVER x AS ma, stddev_samp(lv) OVER x AS ms, count(lv) OVER x AS mn FROM l1 WINDOW x AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)",
        lab=f"""SELECT sym, t, r1, vol, {c8('r1 / vp')} AS y, {', '.join(f'{c8(f"q{n} / (vp * sqrt({n}.0))")} AS z{n}' for n in (6, 24, 120))}, (h - l) / c AS aralik,
          least(greatest(coalesce(CASE WHEN mn >= 48 AND nv > 200 THEN (lv - ma) / nullif(ms, 0) END, 0), -5), 5) AS hacimz, CAST((t // 3600000) % 24 AS INTEGER) AS saat, CAST((t // 86400000 + 3) % 7 AS INTEGER) AS gun, (t - t_min) // 3600000 AS time_idx
          FROM l2 WHERE r1 / vp IS NOT NULL AND vol IS NOT NULL AND q120 / vp IS NOT NULL""",
    )


LAB = ("r1", "vol", "y", "z6", "z24", "z120", "aralik")


@register("wn_feat", q.query(f"SELECT sym, t, {R(*LAB)}, saat, gun, time_idx FROM lab", **_lab("hbars")))
def wn_feat(spark, d):
    return b.r6(ft.lab_features(fx.bars_1h(spark, d)), *LAB).select("sym", "t", *LAB, "saat", "gun", "time_idx")


@register("wn_volz", q.query("SELECT sym, t, round(hacimz, 6) AS hacimz FROM lab", **_lab("hbars")))
def wn_volz(spark, d):
    return b.r6(ft.lab_features(fx.bars_1h(spark, d)), "hacimz").select("sym", "t", "hacimz")


HOW = "CAST((isodow(ny) - 1) * 24 + hour(ny) AS INTEGER)"


@register("wn_how", q.query(f"SELECT sym, t, {HOW} AS how FROM (SELECT sym, t, timezone('America/New_York', to_timestamp(t / 1000.0)) AS ny FROM hbars)"))
def wn_how(spark, d):
    return fx.bars_1h(spark, d).select("sym", "t", ft.ny_hour_of_week(F.col("t")).alias("how"))


@register("wn_fwd_abs", q.query("SELECT sym, t, round(fwd_abs, 6) AS fwd_abs, peak FROM fwd"))
def wn_fwd_abs(spark, d):
    return b.r6(fwd(spark, d), "fwd_abs")


# ---- strategies ----


def _strategy(name: str):
    @register(f"st_{name}", q.query(f"SELECT {PLAN} FROM plans WHERE strat = '{name}'"))
    def run(spark, d):
        return plan_cols(b.book(spark, d, (name,)))


for _name in q.STRATS:
    _strategy(_name)

STREAK = "SELECT 'streak' AS strat, sym, t AS t0, CASE WHEN up3 = 3 THEN 1 WHEN down3 = 3 THEN -1 END AS side, c AS entry, vol, 5 AS hz, 2.0 AS rm, 'streak|' || sym || '|' || t AS plan_id FROM (SELECT *, sum(CASE WHEN r1 > 0 THEN 1 ELSE 0 END) OVER w AS up3, sum(CASE WHEN r1 < 0 THEN 1 ELSE 0 END) OVER w AS down3 FROM feats WINDOW w AS (PARTITION BY sym ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"


def streak(bars):
    """A strategy as a user writes one: three rises in a row are bought, three falls sold."""
    w = ft.by_block().rowsBetween(-2, 0)
    r1 = F.round(ft.log_return(), 12)
    many = ft.framed(bars, 3).withColumn("r1", r1).withColumns({"up": F.sum((F.col("r1") > 0).cast("int")).over(w), "down": F.sum((F.col("r1") < 0).cast("int")).over(w)})
    return ft.unframed(many).select("sym", "t", F.when(F.col("up") == 3, 1).when(F.col("down") == 3, -1).otherwise(0).alias("side"), F.lit(5).alias("hz"), F.lit(2.0).alias("rm"))


@register("st_plugin", q.query("SELECT plan_id, sym, t0, side, t0 + hz * " + str(b.DAY) + f" AS t_end, {R('entry', 'sl', 'tp2', 'd_stop')} FROM (" + q.plan_levels("SELECT * FROM (" + STREAK + ") WHERE side IN (1, -1) AND vol > 0") + ")"))
def st_plugin(spark, d):
    """The user's strategy passes the guard against looking ahead and gives plans."""
    own = plugins.Registry()
    own.register("streak")(streak)
    p = own.candidates(fx.bars_1d(spark, d), b.DAY)
    return b.r6(p, "entry", "sl", "tp2", "d_stop").select("plan_id", "sym", "t0", "side", "t_end", "entry", "sl", "tp2", "d_stop")


H2 = f"SELECT 'event' AS strat, c.bar - {b.DAY} AS t0, b.sym, CASE WHEN p.pos_pct >= 0.9 THEN -1 WHEN p.pos_pct <= 0.1 THEN 1 END AS side, b.c AS entry, b.vol, 24 AS hz, 1.5 AS rm, p.pos_pct FROM {{events}} c JOIN feats b ON b.t = c.bar - {b.DAY} ASOF JOIN fpos p ON p.sym = b.sym AND p.t < c.bar"
CONTROL = f"SELECT day AS bar FROM ({_days(100 * b.DAY, 48 * b.DAY)}) WHERE substr(md5(CAST(day AS VARCHAR)), 1, 1) < '4'"


def h2_sql(events_sql: str) -> str:
    return f"SELECT sym, t0, side, round(pos_pct, 6) AS poz, {R('entry', 'sl', 'tp2', 'd_stop')} FROM (" + q.plan_levels("SELECT *, sym || '|' || t0 AS plan_id FROM (" + H2.format(events=events_sql) + ") WHERE side IN (1, -1) AND vol > 0") + ")"


def h2_plans(spark, d, ev):
    """One bar before each event: side by the rank of funding known before it."""
    pos = ft.with_position_pct(fx.funding(spark, d)).withColumn("t", F.col("t") + 1)  # strictly before the event
    rows = jn.event_bars(ev.select((F.col("bar") - b.DAY).alias("bar")), b.feats(spark, d), ["c", "vol"])
    rows = rows.withColumn("event", F.col("bar") + b.DAY)
    rows = walk.as_of(rows, pos, ["sym"], "event", "t", ["pos_pct"])
    side = F.when(F.col("pos_pct") >= 0.9, -1).when(F.col("pos_pct") <= 0.1, 1)
    p = rows.select("sym", F.col("bar").alias("t0"), side.alias("side"), F.col("c").alias("entry"), "vol", F.lit(24).alias("hz"), F.lit(1.5).alias("rm"), F.lit(b.DAY).alias("tf_ms"), F.col("pos_pct").alias("poz")).where("side IS NOT NULL AND vol > 0")
    return b.r6(pl.levels(p), "poz", "entry", "sl", "tp2", "d_stop").select("sym", "t0", "side", "poz", "entry", "sl", "tp2", "d_stop")


@register("st_event_h2", q.query(h2_sql("calendar")))
def st_event_h2(spark, d):
    return h2_plans(spark, d, events(spark, d))


@register("st_event_control", q.query(h2_sql("ctl"), ctl=CONTROL))
def st_event_control(spark, d):
    days = jn.free_days(fx.bars_1d(spark, d), events(spark, d), 100 * b.DAY, 48 * b.DAY)
    ev = days.where(F.substring(F.md5(F.col("day").cast("string")), 1, 1) < "4").select(F.col("day").alias("bar"))
    return h2_plans(spark, d, ev)


#: Draws of the placebo, made for each type of event and for the pool.
DRAWS = 2000
q.TABLES["evgroups"] = "SELECT tur, bar FROM calendar UNION ALL SELECT 'FOMC+CPI' AS tur, bar FROM calendar"
q.TABLES["dayno"] = "SELECT day, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS nd FROM freedays"
q.TABLES["placebo"] = f"""SELECT p.tur, p.draw, avg(f.fwd_abs) AS m FROM (SELECT e.tur, x.draw, CAST(('0x' || substr(md5(e.tur || '|' || x.draw || '|' || e.bar), 1, 7)) AS BIGINT) % (SELECT any_value(nd) FROM dayno) AS k FROM evgroups e, range({DRAWS}) x(draw)) p JOIN dayno USING (k) JOIN fwd f ON f.t = dayno.day WHERE f.fwd_abs IS NOT NULL GROUP BY p.tur, p.draw"""


@register("ag_event_h1", q.query("""SELECT tur, events, windows, round(real, 6) AS real, round(placebo, 6) AS placebo, round(real / placebo, 6) AS ratio, round(p, 6) AS p, peak_median, peak_q75, CASE WHEN p <= 0.01 AND real / placebo >= 1.3 THEN 'pass' ELSE 'fail' END AS decision FROM
 (SELECT g.tur, any_value(g.events) AS events, any_value(g.windows) AS windows, any_value(g.real) AS real, avg(p.m) AS placebo, avg(CAST(p.m >= g.real AS INTEGER)) AS p, any_value(g.peak_median) AS peak_median, any_value(g.peak_q75) AS peak_q75 FROM
  (SELECT e.tur, count(DISTINCT e.bar) AS events, count(*) AS windows, avg(r.fwd_abs) AS real, quantile_cont(r.peak, 0.5) AS peak_median, quantile_cont(r.peak, 0.75) AS peak_q75 FROM evgroups e JOIN (SELECT bar, sym, fwd_abs, peak FROM evrows) r USING (bar) GROUP BY e.tur) g JOIN placebo p USING (tur) GROUP BY g.tur)"""))
def ag_event_h1(spark, d):
    ev, f = events(spark, d).select("tur", "bar"), fwd(spark, d).where("fwd_abs IS NOT NULL")
    pooled = ev.unionByName(ev.withColumn("tur", F.lit("FOMC+CPI")))
    real = jn.event_bars(pooled, f.select("sym", "t", "fwd_abs", "peak"), ["fwd_abs", "peak"]).groupBy("tur").agg(
        F.countDistinct("bar").alias("events"), F.count(F.lit(1)).alias("windows"), F.avg("fwd_abs").alias("real"), F.percentile("peak", 0.5).alias("peak_median"), F.percentile("peak", 0.75).alias("peak_q75"))
    days = jn.free_days(fx.bars_1d(spark, d), events(spark, d), H1_LEAD, H1_TAIL)
    # free days are few (one a day of history); number them within a year, then across years
    numbered = days.withColumn("_y", F.floor(F.col("day") / (366 * b.DAY)))
    years = numbered.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
    years = years.withColumn("_base", F.sum("_n").over(Window.orderBy("_y")) - F.col("_n"))
    numbered = numbered.join(years.select("_y", "_base"), "_y").withColumn("k", F.col("_base") + F.row_number().over(Window.partitionBy("_y").orderBy("day")) - 1)
    total = years.agg(F.sum("_n").alias("nd"))
    draws = pooled.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).crossJoin(total)
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "tur", F.col("draw").cast("string"), F.col("bar").cast("string"))), 1, 7), 16, 10).cast("long")
    placed = draws.withColumn("k", h % F.col("nd")).join(numbered.select("k", "day"), "k")
    m = placed.join(f.select(F.col("t").alias("day"), "fwd_abs"), "day").groupBy("tur", "draw").agg(F.avg("fwd_abs").alias("m"))
    out = m.join(real, "tur").groupBy("tur").agg(
        *[F.first(c).alias(c) for c in ("events", "windows", "real", "peak_median", "peak_q75")], F.avg("m").alias("placebo"), F.avg((F.col("m") >= F.col("real")).cast("double")).alias("p"))
    ratio = F.col("real") / F.col("placebo")
    return out.select("tur", "events", "windows", F.round("real", 6).alias("real"), F.round("placebo", 6).alias("placebo"), F.round(ratio, 6).alias("ratio"), F.round("p", 6).alias("p"), "peak_median", "peak_q75", F.when((F.col("p") <= 0.01) & (ratio >= 1.3), "pass").otherwise("fail").alias("decision"))


# ---- folds ----

FOLD_DAYS, WARM_DAYS, TRAIN_DAYS, H = 60, 365, 540, 24
FOLD_TABLES = _lab("bars") | dict(
    span=f"SELECT min(t) AS a, max(t) AS z FROM lab",
    folds=f"SELECT row_number() OVER (ORDER BY cut) AS fold, cut, z FROM (SELECT unnest(range(a + {WARM_DAYS} * CAST({b.DAY} AS BIGINT), z - {H} * CAST({b.DAY} AS BIGINT), {FOLD_DAYS} * CAST({b.DAY} AS BIGINT))) AS cut, z FROM span)",
    decided=f"SELECT f.fold, l.sym, l.t, l.z120 / 2 AS score FROM folds f JOIN lab l ON l.t > f.cut AND l.t <= least(f.cut + {FOLD_DAYS} * CAST({b.DAY} AS BIGINT), f.z) WHERE l.t % {b.DAY} = 0",
)


def folds_of(rows, day: int = b.DAY):
    """Walk-forward cuts: one row per fold, from the span of the data."""
    span = rows.agg(F.min("t").alias("a"), F.max("t").alias("z"))
    first, step = WARM_DAYS * day, FOLD_DAYS * day
    cuts = span.where(F.col("a") + first < F.col("z") - H * day).select("z", F.posexplode(F.sequence(F.col("a") + first, F.col("z") - H * day - 1, F.lit(step))).alias("k", "cut"))
    return cuts.select((F.col("k") + 1).alias("fold"), "cut", F.least(F.col("cut") + step, F.col("z")).alias("until"), (F.col("cut") - TRAIN_DAYS * day).alias("train_from"))


def fold_of(rows, folds, day: int = b.DAY):
    """The fold whose window (cut, cut + step] a row lies in: windows don't overlap, so an as-of join finds it."""
    f = folds.select(F.lit(1).alias("_one"), (F.col("cut") + 1).alias("_from"), "fold", "cut", "until")
    by_step = f.withColumn("_g", F.floor(F.col("_from") / (FOLD_DAYS * day)))
    r = rows.withColumn("_g0", F.floor(F.col("t") / (FOLD_DAYS * day))).withColumn("_g", F.explode(F.array(F.col("_g0"), F.col("_g0") - 1)))
    return r.join(by_step.drop("_one"), "_g").where((F.col("t") > F.col("cut")) & (F.col("t") <= F.col("until"))).drop("_g", "_g0", "_from")


@register("st_folds", q.query(f"""SELECT f.fold, f.cut, (SELECT count(*) FROM lab l WHERE l.t >= f.cut - {TRAIN_DAYS} * CAST({b.DAY} AS BIGINT) AND l.t + {H} * CAST({b.DAY} AS BIGINT) <= f.cut) AS n_train, (SELECT count(*) FROM decided d WHERE d.fold = f.fold) AS n_decisions FROM folds f""", **FOLD_TABLES))
def st_folds(spark, d):
    lab = ft.lab_features(fx.bars_1d(spark, d)).select("sym", "t", "z120")
    folds = folds_of(lab)
    # rows per day, then a sum over the days of each fold's training span
    per_day = lab.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    months = folds.withColumn("_m", F.explode(F.sequence(F.floor(F.col("train_from") / (32 * b.DAY)), F.floor(F.col("cut") / (32 * b.DAY)))))
    inside = months.join(per_day.withColumn("_m", F.floor(F.col("t") / (32 * b.DAY))), "_m").where((F.col("t") >= F.col("train_from")) & (F.col("t") + H * b.DAY <= F.col("cut")))
    train = inside.groupBy("fold").agg(F.sum("n").alias("n_train"))
    decided = fold_of(lab.where(F.pmod(F.col("t"), F.lit(b.DAY)) == 0), folds).groupBy("fold").agg(F.count(F.lit(1)).alias("n_decisions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return folds.select("fold", "cut").join(train, "fold", "left").join(decided, "fold", "left").select("fold", "cut", zero("n_train"), zero("n_decisions"))


@register("st_naive_score", q.query("SELECT fold, sym, t, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN 1 WHEN score <= -0.5 THEN -1 ELSE 0 END AS side FROM decided", **FOLD_TABLES))
def st_naive_score(spark, d):
    lab = ft.lab_features(fx.bars_1d(spark, d)).select("sym", "t", "z120")
    rows = fold_of(lab.where(F.pmod(F.col("t"), F.lit(b.DAY)) == 0), folds_of(lab)).withColumn("score", F.col("z120") / 2)
    return rows.select("fold", "sym", "t", F.round("score", 6).alias("score"), F.when(F.col("score") >= 0.5, 1).when(F.col("score") <= -0.5, -1).otherwise(0).alias("side"))


@register("ag_fold_threshold", q.query(f"SELECT f.fold, count(*) AS n, round(quantile_cont(abs(l.z120 / 2), 0.9), 6) AS threshold FROM folds f JOIN lab l ON l.t > f.cut - 30 * CAST({b.DAY} AS BIGINT) AND l.t <= f.cut GROUP BY f.fold", **FOLD_TABLES))
def ag_fold_threshold(spark, d):
    lab = ft.lab_features(fx.bars_1d(spark, d)).select("sym", "t", "z120")
    f = folds_of(lab).withColumn("_m", F.explode(F.sequence(F.floor((F.col("cut") - 30 * b.DAY) / (32 * b.DAY)), F.floor(F.col("cut") / (32 * b.DAY)))))
    rows = f.join(lab.withColumn("_m", F.floor(F.col("t") / (32 * b.DAY))), "_m").where((F.col("t") > F.col("cut") - 30 * b.DAY) & (F.col("t") <= F.col("cut")))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(F.abs(F.col("z120") / 2), 0.9), 6).alias("threshold"))


# ---- scalar ----


@register("fn_funding_year", q.query("SELECT sym, t, round(avg_n * 3 * 365, 6) AS yearly, CASE WHEN avg_n >= 0.0003 THEN 'short' WHEN avg_n <= -0.0003 THEN 'long' ELSE 'none' END AS view FROM favg WHERE avg_n IS NOT NULL"))
def fn_funding_year(spark, d):
    f = ft.with_funding_avg(fx.funding(spark, d)).where("avg_n IS NOT NULL")
    return f.select("sym", "t", F.round(tx.funding_year(F.col("avg_n")), 6).alias("yearly"), F.when(F.col("avg_n") >= 0.0003, "short").when(F.col("avg_n") <= -0.0003, "long").otherwise("none").alias("view"))
