"""Queries on the signal ledger, run log and scan records."""

from __future__ import annotations

from pyspark.sql import functions as F

from barproof.jobs import base as b
from barproof.jobs import sql as q
from barproof.jobs.registry import register
from barproof.operators import ledger as lg
from barproof.operators import plans as pl
from barproof.operators import replay as rp
from barproof.operators import walk
from barproof.sources import fixtures as fx
from barproof.sources import readers as rd

# The ledger: runs of one strategy, half of the rows in the other naming, some results altered, some open or flipped.
q.TABLES["led"] = f"""SELECT sym || '|1d|' || t0 AS id, sym, side, entry, sl, tp1, tp2, rm, d_stop, t0, t_end, CASE WHEN state IN ('open', 'wait') THEN NULL WHEN t0 // {b.DAY} % 17 = 0 THEN 'flipped' ELSE state END AS state, half, "at" AS closed_at, px,
  CASE WHEN state IN ('open', 'wait') THEN NULL WHEN t0 // {b.DAY} % 10 = 0 THEN r + 0.5 ELSE r END AS r, state AS true_state, r AS true_r FROM runs WHERE strat = 'xsmom30'"""


q.TABLES["runlog"] = "SELECT 'tf1' AS tf, a.anchor AS ran_at, count(p.plan_id) AS new_sigs FROM anchors a LEFT JOIN (SELECT * FROM book WHERE strat = 'revert3') p ON p.t0 = a.anchor GROUP BY a.anchor"


def raw_ledger(spark, d):
    r = b.runs(spark, d, ("xsmom30",))
    day = F.floor(F.col("t0") / b.DAY)
    open_ = F.col("state").isin("open", "wait")
    r = r.withColumns({"r": F.when(open_, None).otherwise(F.when(day % 10 == 0, F.col("r") + 0.5).otherwise(F.col("r"))), "state": F.when(open_, None).when(day % 17 == 0, "flipped").otherwise(F.col("state"))})
    snake = day % 2 == 0
    text = lambda c: F.when(snake, F.col(c).cast("string"))
    camel = lambda c: F.when(~snake, F.col(c))
    return r.select(
        F.concat_ws("|", "sym", F.lit("1d"), F.col("t0").cast("string")).alias("id"), "sym", F.lit(None).cast("string").alias("disp"), F.lit("1d").alias("tf"), F.col("side").cast("string").alias("side"), F.col("entry").cast("string").alias("entry"), "sl", "tp1", "tp2", "rm",
        text("d_stop").alias("d_stop"), camel("d_stop").alias("dStop"), "t0", text("t_end").alias("t_end"), camel("t_end").alias("tEnd"), "state", "half", text("at").alias("closed_at"), camel("at").alias("closedAt"), text("px").alias("close_px"), camel("px").alias("closePx"), text("r").alias("r_realized"), camel("r").alias("R"))


def ledger(spark, d):
    return lg.normalise(raw_ledger(spark, d))


@register("prj_ledger_norm", q.query("SELECT id, sym, sym AS disp, side, round(d_stop, 6) AS d_stop, t0, t_end, coalesce(state, 'open') AS state, half, closed_at, round(px, 6) AS close_px, round(r, 6) AS r FROM led"))
def prj_ledger_norm(spark, d):
    return b.r6(ledger(spark, d), "d_stop", "close_px", "r").select("id", "sym", "disp", "side", "d_stop", "t0", "t_end", "state", "half", "closed_at", "close_px", "r")


@register("jn_audit", q.query("SELECT CASE WHEN sym = 'AF' THEN 'no_bars' WHEN state = 'flipped' THEN 'skipped' WHEN state = true_state AND abs(r - true_r) <= 1e-6 THEN 'ok' ELSE 'mismatch' END AS finding, count(*) AS n FROM led WHERE state IS NOT NULL GROUP BY 1"))
def jn_audit(spark, d):
    return lg.audit(ledger(spark, d), fx.bars_1d(spark, d).where("sym <> 'AF'")).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


@register("ag_track", q.query(f"SELECT m.*, o.open, o.total FROM ({q.metrics('ledr', 'tf')}) m JOIN (SELECT tf, count(*) FILTER (state = 'open') AS open, count(*) AS total FROM ledr GROUP BY tf) o USING (tf)",
    ledr="SELECT '1d' AS tf, coalesce(state, 'open') AS state, coalesce(r, 0) AS r, 0 AS n FROM led"))
def ag_track(spark, d):
    return lg.track(ledger(spark, d))


@register("tk_recent", q.query("SELECT id, sym, side, t0 FROM led ORDER BY t0 DESC, id LIMIT 200"))
def tk_recent(spark, d):
    return lg.recent(ledger(spark, d)).select("id", "sym", "side", "t0")


@register("snk_public_json", q.query("""SELECT s.runs, s.signals, s.first_run, l.* FROM (SELECT id, sym, sym AS disp, '1d' AS tf, side, round(entry, 6) AS entry, round(sl, 6) AS sl, round(tp1, 6) AS tp1, round(tp2, 6) AS tp2, CAST(rm AS DOUBLE) AS rm, round(d_stop, 6) AS d_stop, t0, t_end, coalesce(state, 'open') AS state, half, closed_at, round(px, 6) AS close_px, round(r, 6) AS r FROM led ORDER BY t0 DESC, id LIMIT 200) l,
 (SELECT count(*) AS runs, CAST(sum(new_sigs) AS BIGINT) AS signals, min(ran_at) AS first_run FROM runlog) s"""))
def snk_public_json(spark, d):
    """The public ledger as one document (200 signals at most), written, read back and taken apart."""
    path = rd.scratch(spark, "public")
    lg.public_json(ledger(spark, d), lg.run_stats(run_log(spark, d)).drop("tf")).select("json").write.text(path)
    doc = spark.read.schema(lg.PUBLIC).json(path)
    rows = doc.select("stats.*", F.explode("signals").alias("s")).select(F.col("runs"), F.col("signals"), F.col("firstRun").alias("first_run"), "s.*")
    names = {"dStop": "d_stop", "tEnd": "t_end", "closedAt": "closed_at", "closePx": "close_px", "R": "r"}
    return b.r6(rows.withColumnsRenamed(names), "entry", "sl", "tp1", "tp2", "d_stop", "close_px", "r")


@register("snk_ledger", q.query("SELECT id, coalesce(state, 'open') AS state, closed_at, round(px, 6) AS close_px, round(r, 6) AS r_realized, half FROM (SELECT id, state, CASE WHEN state IS NOT NULL THEN closed_at END AS closed_at, CASE WHEN state IS NOT NULL THEN px END AS px, r, half FROM led)"))
def snk_ledger(spark, d):
    """Insert (twice: the second time nothing is new), mark half, close; then the latest state of each signal."""
    full = rd.stored(ledger(spark, d), "full")
    path = rd.scratch(spark, "ledger")
    cols = ["id", "state", "closed_at", "close_px", "r_realized", "half"]
    none = lambda t: F.lit(None).cast(t)
    insert = full.select("id", F.lit("open").alias("state"), none("long").alias("closed_at"), none("double").alias("close_px"), none("double").alias("r_realized"), F.lit(False).alias("half"))
    insert.withColumn("seq", F.lit(0)).write.parquet(path)
    rd.append_once(spark.read.parquet(path), insert.withColumn("seq", F.lit(0))).select(*cols, "seq").write.mode("append").parquet(path)
    full.where("half").select("id", F.lit("open").alias("state"), none("long").alias("closed_at"), none("double").alias("close_px"), none("double").alias("r_realized"), F.lit(True).alias("half")).withColumn("seq", F.lit(1)).write.mode("append").parquet(path)
    full.where("state <> 'open'").select("id", "state", "closed_at", "close_px", F.col("r").alias("r_realized"), "half").withColumn("seq", F.lit(2)).write.mode("append").parquet(path)
    return b.r6(rd.ledger_view(spark.read.parquet(path)), "close_px", "r_realized").select(*cols)




def run_log(spark, d):
    p = b.book(spark, d, ("revert3",)).groupBy(F.col("t0").alias("anchor")).agg(F.count(F.lit(1)).alias("k"))
    return b.anchors(fx.bars_1d(spark, d)).join(p, "anchor", "left").select(F.lit("tf1").alias("tf"), F.col("anchor").alias("ran_at"), F.coalesce("k", F.lit(0)).alias("new_sigs"))


@register("ag_runstats", q.query("SELECT r.tf, count(*) AS runs, CAST(sum(new_sigs) AS BIGINT) AS new_sigs, min(ran_at) AS first_run, any_value(s.silent) AS silent FROM runlog r JOIN (SELECT tf, coalesce(min(k) FILTER (new_sigs > 0), count(*) + 1) - 1 AS silent FROM (SELECT *, row_number() OVER (ORDER BY ran_at DESC) AS k FROM runlog) WHERE k <= 60 GROUP BY tf) s USING (tf) GROUP BY r.tf"))
def ag_runstats(spark, d):
    return lg.run_stats(run_log(spark, d))


# ---- scan records: a rule-based stand-in for the model's (anchor, symbol, combination, repetition) rows ----

q.TABLES["scan"] = """SELECT anchor, sym, side, hz, rm, side * ret20d / (vol * sqrt(20.0)) * 0.2 - 0.01 * rm + 0.001 * hz AS ev, 0.05 + vol AS se FROM arows, (VALUES (1), (-1)) s(side), (VALUES (15), (30)) h(hz), (VALUES (1.0), (2.0)) r(rm) WHERE vol > 0 AND ret20d IS NOT NULL"""
q.TABLES["nulls"] = """SELECT anchor, rep, greatest(-9, max(abs(x) * 0.2 - 0.02)) AS ev FROM (SELECT anchor, rep, CASE WHEN substr(md5(sym || anchor || rep), 1, 1) < '8' THEN ret3d ELSE ret30d END / (vol * sqrt(20.0)) AS x FROM arows, range(12) p(rep) WHERE vol > 0 AND ret30d IS NOT NULL) GROUP BY anchor, rep"""
q.TABLES["fam"] = "SELECT anchor, max(ev) AS fam_hi, list_sort(list(ev))[7] AS fam_med FROM nulls GROUP BY anchor"
q.TABLES["tops"] = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY anchor, sym ORDER BY round(ev, 9) DESC, side DESC, hz, rm) AS k FROM scan) WHERE k = 1"
q.TABLES["gated"] = "SELECT t.*, f.fam_hi, ev > fam_hi AS ok_chance, ev > 2 * se AS ok_error, CASE WHEN ev > fam_hi AND ev > 2 * se THEN 'hit' WHEN ev > fam_hi THEN 'near_miss' ELSE 'fail' END AS gate FROM tops t JOIN fam f USING (anchor)"


def scan_rows(f):
    rows = walk.symbols_at(b.anchors(f), f, walk.FEATURES).where("vol > 0")
    combos = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(h).alias("hz"), F.lit(float(r)).alias("rm")) for s in (1, -1) for h in (15, 30) for r in (1, 2)])
    x = rows.where("ret20d IS NOT NULL").withColumn("_c", F.explode(combos)).select("anchor", "sym", "ret20d", "vol", "_c.*")
    ev = F.col("side") * F.col("ret20d") / (F.col("vol") * F.sqrt(F.lit(20.0))) * 0.2 - 0.01 * F.col("rm") + 0.001 * F.col("hz")
    scan = x.withColumns({"ev": ev, "se": 0.05 + F.col("vol")}).drop("ret20d", "vol")
    n = rows.where("ret30d IS NOT NULL").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(11))))
    first = F.substring(F.md5(F.concat("sym", F.col("anchor").cast("string"), F.col("rep").cast("string"))), 1, 1) < "8"
    y = F.when(first, F.col("ret3d")).otherwise(F.col("ret30d")) / (F.col("vol") * F.sqrt(F.lit(20.0)))
    return scan, n.select("anchor", "rep", (F.abs(y) * 0.2 - 0.02).alias("ev"))


def family(nulls):
    """Chance threshold over all assets and combinations: the largest of the repetitions' maxima, and their median."""
    per = nulls.groupBy("anchor", "rep").agg(F.greatest(F.lit(-9.0), F.max("ev")).alias("ev"))
    return per.groupBy("anchor").agg(F.max("ev").alias("fam_hi"), F.element_at(F.sort_array(F.collect_list("ev")), 7).alias("fam_med"))


def best_combos(scan):
    """Each asset's best combination (one row a group by a partial maximum; ties: long, short horizon, small ratio)."""
    key = F.struct(F.round("ev", 9).alias("a"), F.col("side").alias("b"), (-F.col("hz")).alias("c"), (-F.col("rm")).alias("d"))
    return scan.groupBy("anchor", "sym").agg(F.max_by(F.struct("side", "hz", "rm", "ev", "se"), key).alias("_b")).select("anchor", "sym", "_b.*")


def gated(f):
    scan, nulls = scan_rows(f)
    return best_combos(scan).join(family(nulls), "anchor").withColumns(pl.gate(F.col("ev"), F.col("se"), F.col("fam_hi")))


@register("ag_famhi", q.query("SELECT anchor, round(fam_hi, 6) AS fam_hi, round(fam_med, 6) AS fam_med FROM fam"))
def ag_famhi(spark, d):
    return b.r6(family(scan_rows(b.feats(spark, d))[1]), "fam_hi", "fam_med")


@register("tk_best", q.query("SELECT anchor, sym, side, hz, CAST(rm AS DOUBLE) AS rm, round(ev, 6) AS ev FROM tops"))
def tk_best(spark, d):
    return b.r6(best_combos(scan_rows(b.feats(spark, d))[0]), "ev").select("anchor", "sym", "side", "hz", "rm", "ev")


@register("prj_gate", q.query("SELECT anchor, sym, round(ev, 6) AS ev, ok_chance, ok_error, gate FROM gated"))
def prj_gate(spark, d):
    return b.r6(gated(b.feats(spark, d)), "ev").select("anchor", "sym", "ev", "ok_chance", "ok_error", "gate")


def diagnosed(g):
    """What each anchor's scan came to."""
    miss = F.col("gate") == "near_miss"
    return g.groupBy("anchor").agg(
        F.first("fam_hi").alias("fam_hi"), F.min_by("sym", F.struct(-F.round("ev", 9), "sym")).alias("best_sym"), F.max("ev").alias("best_ev"), F.count(F.when(F.col("gate") == "hit", 1)).alias("hits"), F.count(F.when(miss, 1)).alias("near_misses"),
        F.array_join(F.array_sort(F.collect_list(F.when(miss, F.col("sym")))), ",").alias("near_list")).withColumn("gap", F.col("best_ev") - F.col("fam_hi"))


q.TABLES["diag"] = "SELECT anchor, any_value(fam_hi) AS fam_hi, first(sym ORDER BY round(ev, 9) DESC, sym) AS best_sym, max(ev) AS best_ev, max(ev) - any_value(fam_hi) AS gap, count(*) FILTER (gate = 'hit') AS hits, count(*) FILTER (gate = 'near_miss') AS near_misses, coalesce(string_agg(sym, ',' ORDER BY sym) FILTER (gate = 'near_miss'), '') AS near_list FROM gated GROUP BY anchor"


@register("rp_scan_diag", q.query("SELECT 'anchor' AS kind, anchor, best_sym, round(best_ev, 6) AS best_ev, round(gap, 6) AS gap, hits, near_misses, near_list FROM diag UNION ALL SELECT 'summary', NULL, NULL, round(avg(best_ev), 6), round(avg(gap), 6), CAST(sum(hits) AS BIGINT), CAST(sum(near_misses) AS BIGINT), '' FROM diag UNION ALL SELECT 'closest', anchor, best_sym, round(best_ev, 6), round(gap, 6), hits, near_misses, near_list FROM (SELECT * FROM diag ORDER BY round(gap, 9) DESC, anchor LIMIT 5)"))
def rp_scan_diag(spark, d):
    diag = rd.stored(diagnosed(gated(b.feats(spark, d))), "diag")
    cols = ["best_sym", "best_ev", "gap", "hits", "near_misses", "near_list"]
    rows = b.r6(diag, "best_ev").select(F.lit("anchor").alias("kind"), "anchor", "best_sym", "best_ev", F.round("gap", 6).alias("gap"), "hits", "near_misses", "near_list")
    total = diag.agg(F.round(F.avg("best_ev"), 6).alias("best_ev"), F.round(F.avg("gap"), 6).alias("gap"), F.sum("hits").alias("hits"), F.sum("near_misses").alias("near_misses"))
    total = total.select(F.lit("summary").alias("kind"), F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("string").alias("best_sym"), "best_ev", "gap", "hits", "near_misses", F.lit("").alias("near_list"))
    near = diag.orderBy(F.round("gap", 9).desc(), "anchor").limit(5).select(F.lit("closest").alias("kind"), "anchor", *[F.round(c, 6).alias(c) if c in ("best_ev", "gap") else c for c in cols])
    return rows.unionByName(total).unionByName(near)


# ---- plans of the gates: hits are real, near misses go to the shadow ledger ----

q.TABLES["gcand"] = q.plan_levels("SELECT 'gates' AS strat, g.sym, 'gates|' || g.sym || '|' || g.anchor AS plan_id, CAST(g.side AS INTEGER) AS side, f.c AS entry, f.vol, CAST(g.hz AS BIGINT) AS hz, CAST(g.rm AS DOUBLE) AS rm, g.anchor AS t0, g.gate = 'near_miss' AS shadow FROM gated g JOIN arows f USING (anchor, sym) WHERE g.gate IN ('hit', 'near_miss')")
q.TABLES["gord"] = "SELECT *, row_number() OVER (PARTITION BY sym, shadow ORDER BY t0, side) AS k FROM gcand"
q.TABLES["gadm"] = """SELECT DISTINCT sym, shadow, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS lt, CAST(-1 AS BIGINT) AS st, false AS ok FROM gcand
UNION ALL SELECT o.sym, o.shadow, o.k,
  CASE WHEN o.side = 1 THEN CASE WHEN a.lt > o.t0 THEN a.lt ELSE o.t_end END WHEN o.shadow OR a.st > o.t0 THEN a.lt WHEN a.lt > o.t0 THEN -1 ELSE a.lt END,
  CASE WHEN o.side = -1 THEN CASE WHEN a.st > o.t0 THEN a.st ELSE o.t_end END WHEN o.shadow OR a.lt > o.t0 THEN a.st WHEN a.st > o.t0 THEN -1 ELSE a.st END,
  CASE WHEN o.side = 1 THEN NOT a.lt > o.t0 ELSE NOT a.st > o.t0 END
FROM gadm a JOIN gord o ON a.sym = o.sym AND a.shadow = o.shadow AND o.k = a.k + 1"""
_LATER = "OVER (PARTITION BY sym, shadow ORDER BY t0 RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
q.TABLES["gplans"] = f"""SELECT * EXCLUDE (t_end, fl), least(t_end, coalesce(fl, t_end)) AS t_end, coalesce(fl < t_end, false) AS flipped FROM
 (SELECT o.*, CASE WHEN shadow THEN NULL WHEN side = 1 THEN min(CASE WHEN side = -1 THEN t0 END) {_LATER} ELSE min(CASE WHEN side = 1 THEN t0 END) {_LATER} END AS fl FROM gord o JOIN gadm a USING (sym, shadow, k) WHERE a.ok)"""
q.TABLES["gruns"] = q.replayed("gplans")


def gate_plans(spark, d, f, g):
    """Admitted plans of the gates from features and gated scan rows."""
    now = g.where("gate IN ('hit', 'near_miss')").select(F.lit("gates").alias("strat"), "sym", "side", "hz", "rm", "anchor", (F.col("gate") == "near_miss").alias("shadow"))
    rows = walk.as_of(now, f, ["sym"], "anchor", "t", ["c", "vol"]).withColumnRenamed("c", "entry").withColumnRenamed("anchor", "t0").drop("found_t")
    rows = rows.withColumn("tf_ms", F.lit(b.DAY).cast("long")).withColumn("plan_id", F.concat_ws("|", "strat", "sym", F.col("t0").cast("string")))
    return walk.admit(pl.levels(rows))


@register("rp_admit", q.query("SELECT plan_id, side, t0, t_end, flipped, false AS shadow FROM book UNION ALL SELECT plan_id, side, t0, t_end, flipped, shadow FROM gplans"))
def rp_admit(spark, d):
    f = b.feats(spark, d)
    rules = b.book(spark, d, f=f).withColumn("shadow", F.lit(False))
    cols = ["plan_id", "side", "t0", "t_end", "flipped", "shadow"]
    return rules.select(*cols).unionByName(gate_plans(spark, d, f, gated(f)).select(*cols))


@register("so_union", q.query("SELECT 'bars' AS kind, sym, '1d' AS tf, t, round(c, 6) AS c, NULL AS shadow, NULL AS state, NULL AS r FROM bars UNION ALL SELECT 'bars', sym, '1h', t, round(c, 6), NULL, NULL, NULL FROM hbars UNION ALL SELECT 'plans', sym, '1d', t0, round(entry, 6), shadow, state, round(r, 6) FROM gruns"))
def so_union(spark, d):
    """Symbol frames on one grid, and real with shadow results."""
    f = b.feats(spark, d)
    bars = f.select("sym", F.lit("1d").alias("tf"), "t", "c").unionByName(fx.bars_1h(spark, d).select("sym", F.lit("1h").alias("tf"), "t", "c"))
    runs = rp.run(gate_plans(spark, d, f, gated(f)), f).select(F.lit("plans").alias("kind"), "sym", F.lit("1d").alias("tf"), F.col("t0").alias("t"), F.col("entry").alias("c"), "shadow", "state", "r")
    return b.r6(bars.withColumn("kind", F.lit("bars")).unionByName(runs, allowMissingColumns=True), "c", "r").select("kind", "sym", "tf", "t", "c", "shadow", "state", "r")


@register("snk_plans_csv", q.query(f"""SELECT 'plan' AS kind, t0, sym, side, hz, round(CAST(rm AS DOUBLE), 6) AS rm, NULL AS state, NULL AS r, NULL AS bars, NULL AS closed_at, NULL AS shadow, NULL AS fam_hi, NULL AS best, NULL AS gap, NULL AS near_miss, NULL AS plans, NULL AS shadow_plans FROM book
 UNION ALL SELECT 'result', t0, sym, side, NULL, NULL, state, round(r, 6), n, "at", CAST(shadow AS INTEGER), NULL, NULL, NULL, NULL, NULL, NULL FROM gruns
 UNION ALL SELECT 'scan', anchor, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(fam_hi, 6), best_sym, round(gap, 6), nullif(replace(near_list, ',', '|'), ''), hits, near_misses FROM diag"""))
def snk_plans_csv(spark, d):
    """Three lists as CSV with a header, read back: plans, results (real and shadow) and what each anchor's scan said."""
    f = b.feats(spark, d)
    g = rd.stored(gated(f), "gated")
    at = rd.scratch(spark, "csv")
    lists = {
        "plan": (b.book(spark, d, f=f).select("t0", "sym", "side", "hz", "rm"), "t0 long, sym string, side int, hz int, rm double"),
        "result": (rp.run(gate_plans(spark, d, f, g), f).select("t0", "sym", "side", "state", "r", F.col("n").alias("bars"), F.col("at").alias("closed_at"), F.col("shadow").cast("int").alias("shadow")), "t0 long, sym string, side int, state string, r double, bars long, closed_at long, shadow int"),
        "scan": (diagnosed(g).select(F.col("anchor").alias("t0"), "fam_hi", F.col("best_sym").alias("best"), "gap", F.replace("near_list", F.lit(","), F.lit("|")).alias("near_miss"), F.col("hits").alias("plans"), F.col("near_misses").alias("shadow_plans")), "t0 long, fam_hi double, best string, gap double, near_miss string, plans long, shadow_plans long"),
    }
    out = None
    for kind, (df, schema) in lists.items():
        df.write.option("header", "true").csv(f"{at}/{kind}")
        back = spark.read.schema(schema).option("header", "true").csv(f"{at}/{kind}").withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back, allowMissingColumns=True)
    return b.r6(out, "rm", "r", "fam_hi", "gap").select("kind", "t0", "sym", "side", "hz", "rm", "state", "r", "bars", "closed_at", "shadow", "fam_hi", "best", "gap", "near_miss", "plans", "shadow_plans")
