"""Queries on chat messages and channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from barproof.functions import text as tx
from barproof.jobs import base as b
from barproof.jobs import sql as q
from barproof.jobs.registry import register
from barproof.operators import joins as jn
from barproof.operators import messages as ms
from barproof.operators import metrics as mt
from barproof.operators import plans as pl
from barproof.operators import walk
from barproof.sources import fixtures as fx
from barproof.sources import readers as rd

# Signals rendered as messages from bars; the fields are the expected result.
q.TABLES["m0"] = """SELECT sym AS base, sym || 'USDT' AS sym, 'chan_' || ((i // 3) % 3) AS channel, (t // 86400000) * 10 + (strpos('AFAONFNORFRO', sym) - 1) // 2 AS id, t + 3600000 AS t, i, CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS side,
  CAST(i % 6 AS INTEGER) AS mode, CASE WHEN i % 3 = 0 THEN c * 1.05 ELSE c END AS p FROM feats"""
q.TABLES["m1"] = "SELECT *, round(p, 2) AS e, round(p * (1 - side * 0.04), 2) AS xsl, round(p * (1 + side * 0.03), 2) AS xtp1, round(p * (1 + side * 0.06), 2) AS xtp2 FROM m0"
q.TABLES["sigs"] = """SELECT channel, id, t, base, sym, side, mode, CASE WHEN mode = 3 THEN NULL WHEN mode = 2 THEN (round(e - 0.2, 2) + round(e + 0.2, 2)) / 2 ELSE e END AS entry, xsl AS sl, CASE WHEN mode IN (3, 4) THEN [xtp2] ELSE [xtp1, xtp2] END AS tps FROM m1 WHERE mode <> 5"""


def rendered(spark, d):
    """channel, id, t, text: signals in several formats and languages, ambiguous ones, and plain talk."""
    f = b.feats(spark, d)
    k = F.col("i")
    side = F.when(k % 2 == 0, 1).otherwise(-1)
    p = F.when(F.col("i") % 3 == 0, F.col("c") * 1.05).otherwise(F.col("c"))
    f = f.withColumns({"side": side, "mode": (k % 6).cast("int"), "p": p})
    num = lambda x: F.format_string("%.2f", F.round(x, 2))
    comma = lambda x: F.replace(num(x), F.lit("."), F.lit(","))
    e, sl, t1, t2 = F.col("p"), F.col("p") * (1 - F.col("side") * 0.04), F.col("p") * (1 + F.col("side") * 0.03), F.col("p") * (1 + F.col("side") * 0.06)
    up = F.col("side") > 0
    way = lambda a, c: F.when(up, F.lit(a)).otherwise(F.lit(c))
    s, lit = F.col("sym"), F.lit
    lo, hi = F.round(e, 2) - 0.2, F.round(e, 2) + 0.2
    forms = [
        F.concat(way("LONG ", "SHORT "), s, lit("USDT\nEntry: "), num(e), lit("\nStop: "), num(sl), lit("\nTP1: "), num(t1), lit("\nTP2: "), num(t2)),
        F.concat(lit("#"), s, lit("USDT "), way("al", "sat"), lit("\nGiriş: "), comma(e), lit("\nZarar kes: "), comma(sl), lit("\nHedef: "), comma(t1), lit(" / "), comma(t2)),
        F.concat(s, lit("/USDT "), way("🟢 long", "🔴 short"), lit("\nEntry zone: "), num(lo), lit(" - "), num(hi), lit("\nSL: "), num(sl), lit("\nTargets: "), num(t1), lit(" - "), num(t2)),
        F.concat(s, lit("USDT "), way("BUY", "SELL"), lit("\nstop loss "), num(sl), lit("\ntake profit "), num(t2)),
        F.concat(way("📈 ", "📉 "), s, lit("-USDT\nentry "), num(e), lit(" sl "), num(sl), lit(" tp "), num(t2)),
        F.concat(s, lit("USDT LONG or SHORT\nentry "), num(e), lit("\nstop "), num(sl), lit("\ntp "), num(t2)),
    ]
    text = F.element_at(F.array(*forms), F.col("mode") + 1)
    no = F.floor((F.expr("locate(sym, 'AFAONFNORFRO')") - 1) / 2)
    return f.select(F.concat(lit("chan_"), (F.floor(F.col("i") / 3) % 3).cast("string")).alias("channel"), (F.floor(F.col("t") / b.DAY) * 10 + no).alias("id"), (F.col("t") + b.HOUR).alias("t"), text.alias("text"))


def talk(spark, d):
    c = fx.table(spark, d, "conversations")
    return c.select(F.lit("talk").alias("channel"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("t"), "text")


def messages(spark, d):
    return rendered(spark, d).unionByName(talk(spark, d))


@register("fn_parse_signal", q.query("SELECT channel, id, t, sym, side, round(entry, 6) AS entry, sl, array_to_string(list_transform(tps, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ' ') AS tps FROM sigs"))
def fn_parse_signal(spark, d):
    p = ms.parse(messages(spark, d))
    return p.select("channel", "id", "t", "sym", "side", F.round("entry", 6).alias("entry"), "sl", F.array_join(F.transform("tps", lambda x: F.round(x * 100).cast("long").cast("string")), " ").alias("tps"))


@register("tk_unparsed", q.query("SELECT channel, id, t FROM m0 WHERE mode = 5 ORDER BY t DESC, id DESC LIMIT 8"))
def tk_unparsed(spark, d):
    m = rendered(spark, d)
    miss = m.where(ms.looks_like_signal(F.col("text"))).join(ms.parse(m).select("channel", "id"), ["channel", "id"], "left_anti")
    return miss.orderBy(F.desc("t"), F.desc("id")).limit(8).select("channel", "id", "t")


HTML = """<div class="tgme_widget_message_wrap"><div data-post="%s/%d"><div class="tgme_widget_message_text js">%s</div><time datetime="%s+00:00">x</time></div></div>"""


@register("src_messages_html", q.query("SELECT channel, id, t, 'x & <y> ' || chr(39) || 'z' || chr(39) || chr(10) || sym AS text FROM m0"))
def src_messages_html(spark, d):
    """Rendered pages (one per channel and year) with markup and entities; raw web pages are negatives."""
    f = b.feats(spark, d).select(F.concat(F.lit("chan_"), (F.floor(F.col("i") / 3) % 3).cast("string")).alias("channel"), (F.floor(F.col("t") / b.DAY) * 10 + F.floor((F.expr("locate(sym, 'AFAONFNORFRO')") - 1) / 2)).alias("id"), (F.col("t") + b.HOUR).alias("t"), F.concat(F.col("sym"), F.lit("USDT")).alias("sym"))
    at = F.date_format(F.timestamp_add("MILLISECOND", F.col("t"), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")), "yyyy-MM-dd'T'HH:mm:ss")
    block = F.format_string(HTML, "channel", "id", F.concat(F.lit("x &amp; &lt;<b>y</b>&gt; &quot;z&#39;<br/>"), F.col("sym")), at)
    pages = f.withColumn("b", block).groupBy("channel", F.floor(F.col("t") / (366 * b.DAY)).alias("y")).agg(F.concat(F.lit("<html>"), F.array_join(F.collect_list("b"), ""), F.array_join(F.collect_list("b"), "")).alias("html"))
    web = fx.table(spark, d, "pages").select(F.lit("web").alias("channel"), "html")
    return rd.messages_from_html(pages.select("channel", "html").unionByName(web))


_WAY = "CASE WHEN side > 0 THEN '{}' ELSE '{}' END".format
_COMMA = "replace({}, '.', ',')".format
_LINE = " || chr(10) || "
q.TABLES["mtext"] = f"""SELECT channel, id, t, CASE mode
  WHEN 0 THEN {_WAY('LONG ', 'SHORT ')} || sym{_LINE}'Entry: ' || ne{_LINE}'Stop: ' || nsl{_LINE}'TP1: ' || n1{_LINE}'TP2: ' || n2
  WHEN 1 THEN '#' || sym || ' ' || {_WAY('al', 'sat')}{_LINE}'Giriş: ' || {_COMMA('ne')}{_LINE}'Zarar kes: ' || {_COMMA('nsl')}{_LINE}'Hedef: ' || {_COMMA('n1')} || ' / ' || {_COMMA('n2')}
  WHEN 2 THEN base || '/USDT ' || {_WAY('🟢 long', '🔴 short')}{_LINE}'Entry zone: ' || nlo || ' - ' || nhi{_LINE}'SL: ' || nsl{_LINE}'Targets: ' || n1 || ' - ' || n2
  WHEN 3 THEN sym || ' ' || {_WAY('BUY', 'SELL')}{_LINE}'stop loss ' || nsl{_LINE}'take profit ' || n2
  WHEN 4 THEN {_WAY('📈 ', '📉 ')} || base || '-USDT'{_LINE}'entry ' || ne || ' sl ' || nsl || ' tp ' || n2
  ELSE sym || ' LONG or SHORT'{_LINE}'entry ' || ne{_LINE}'stop ' || nsl{_LINE}'tp ' || n2 END AS text
  FROM (SELECT *, {', '.join(f"printf('%.2f', {x}) AS {n}" for n, x in (('ne', 'e'), ('nsl', 'xsl'), ('n1', 'xtp1'), ('n2', 'xtp2'), ('nlo', 'round(e - 0.2, 2)'), ('nhi', 'round(e + 0.2, 2)')))} FROM m1)"""


@register("src_messages_text", q.query("SELECT channel, t // 60000 * 60000 AS t, text FROM mtext"))
def src_messages_text(spark, d):
    """Pasted histories, one for each channel and year; every message comes back with its time and its text."""
    m = rendered(spark, d)
    ntz = F.timestamp_add("MILLISECOND", F.col("t"), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    head = F.when(F.col("id") % 2 == 0, F.date_format(ntz, "yyyy-MM-dd HH:mm")).otherwise(F.concat(F.lit("["), F.date_format(ntz, "dd.MM.yyyy, H:mm"), F.lit("]")))
    paste = m.withColumn("b", F.concat(head, F.lit("\n"), F.col("text"), F.lit("\n"))).groupBy("channel", F.floor(F.col("t") / (366 * b.DAY)).alias("y")).agg(F.concat(F.lit("pasted\n"), F.array_join(F.collect_list("b"), "")).alias("text"))
    out = rd.messages_from_text(paste.select("channel", "text"))
    return out.select("channel", "t", F.regexp_replace(F.regexp_replace("text", r"^[^\n]*\n", ""), r"\n$", "").alias("text"))


@register("fn_num", q.query("SELECT id, channel, 1 AS k, round(sl * 1000, 2) AS v FROM sigs UNION ALL SELECT id, channel, 2, round(sl, 2) FROM sigs UNION ALL SELECT id, channel, 3, CAST(CAST(round(sl * 100) AS BIGINT) * 1000 + 5 AS DOUBLE) FROM sigs"))
def fn_num(spark, d):
    """Three spellings of a price: '63.000,25'-like, decimal comma, thousands with commas."""
    s = ms.parse(rendered(spark, d)).select("id", "channel", "sl")
    tr = F.translate(F.format_string("%,.2f", F.round(F.col("sl") * 1000, 2)), ",.", ".,")
    thousands = F.format_number(F.round(F.col("sl") * 100).cast("long") * 1000 + 5, 0)
    forms = F.array(F.struct(F.lit(1).alias("k"), tr.alias("x")), F.struct(F.lit(2).alias("k"), F.replace(F.format_string("%.2f", "sl"), F.lit("."), F.lit(",")).alias("x")), F.struct(F.lit(3).alias("k"), thousands.alias("x")))
    return s.withColumn("_f", F.explode(forms)).select("id", "channel", "_f.k", F.round(tx.number(F.col("_f.x")), 2).alias("v"))


@register("fn_nums", q.query("SELECT channel, id, round(list_sum(list_transform(regexp_extract_all(translate(text, ',', '.'), '[0-9]+\\.[0-9]{2}'), lambda x: CAST(x AS DOUBLE))), 4) AS total, len(regexp_extract_all(translate(text, ',', '.'), '[0-9]+\\.[0-9]{2}')) AS n FROM nt",
    nt="SELECT channel, id, 'a1 ' || sl || 'x, ' || translate(CAST(sl AS VARCHAR), '.', ',') AS text FROM (SELECT channel, id, printf('%.2f', sl) AS sl FROM sigs)"))
def fn_nums(spark, d):
    s = ms.parse(rendered(spark, d)).select("channel", "id", F.format_string("%.2f", "sl").alias("x"))
    text = F.concat(F.lit("a1 "), F.col("x"), F.lit("x, "), F.replace("x", F.lit("."), F.lit(",")))
    xs = tx.numbers(text)
    return s.select("channel", "id", F.round(F.aggregate(xs, F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.size(xs).cast("long").alias("n"))


@register("fn_symbol_norm", q.query("SELECT DISTINCT base, form, base AS clean, base || 'USDT' AS usdt FROM sigs, range(4) r(form) UNION SELECT DISTINCT base, 9, base || 'PERP', base || 'USDT' FROM sigs"))
def fn_symbol_norm(spark, d):
    base = b.feats(spark, d).select(F.col("sym").alias("base")).distinct()
    a, z = F.substring("base", 1, 1), F.substring("base", 2, 1)
    forms = F.array(*[F.struct(F.lit(k).alias("form"), x.alias("x")) for k, x in ((0, F.lower("base")), (1, F.concat(a, F.lit("/"), z)), (2, F.concat(a, F.lit("-"), z)), (3, F.concat(F.lit(" "), F.col("base"), F.lit(" "))), (9, F.concat(F.col("base"), F.lit("PERP"))))])
    return base.withColumn("_f", F.explode(forms)).select("base", F.col("_f.form").cast("long").alias("form"), tx.clean_symbol(F.col("_f.x")).alias("clean"), tx.usdt_symbol(F.col("_f.x")).alias("usdt"))


@register("fn_side", q.query("SELECT id, channel, CASE (id // 10) % 6 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN 1 END AS side FROM m0"))
def fn_side(spark, d):
    w = F.array(*[F.lit(x) for x in ("Long", " sat ", "+1", "S", "BUY", "maybe")])
    return rendered(spark, d).select("id", "channel", tx.side_word(F.element_at(w, (F.floor(F.col("id") / 10) % 6 + 1).cast("int"))).alias("side"))


# ---- channel test ----

q.TABLES["msgpx"] = "SELECT s.*, CASE WHEN z.last_t > s.t THEN f.t END AS bar_t, CASE WHEN z.last_t > s.t THEN f.c END AS px FROM sigs s ASOF LEFT JOIN bars f ON s.base = f.sym AND s.t >= f.t LEFT JOIN (SELECT sym AS zs, max(t) AS last_t FROM bars GROUP BY sym) z ON z.zs = s.base"
q.TABLES["mplan0"] = f"""SELECT channel AS strat, channel || '|' || id AS plan_id, base AS sym, side, e AS entry, sl, CASE WHEN len(tps) > 1 THEN tps[1] END AS tp1, tps[-1] AS tp2, abs(ln(tps[-1] / e)) / abs(ln(e / sl)) AS rm, abs(ln(e / sl)) AS d_stop, t AS t0, t + 30 * CAST({b.DAY} AS BIGINT) AS t_end, 720 AS hz,
  coalesce(abs(ln(entry / px)), 0) AS off_entry FROM (SELECT *, coalesce(entry, px) AS e FROM msgpx WHERE px IS NOT NULL)"""
q.TABLES["mplans"] = "SELECT * FROM mplan0 WHERE off_entry <= 0.03"
q.TABLES["mfill0"] = f"""SELECT p.plan_id, min(b.t) FILTER (touch) AS a, min(b.t) FILTER (over AND NOT touch) AS z FROM (SELECT p.plan_id, b.t, b.l <= p.entry AND b.h >= p.entry AS touch, CASE WHEN p.side > 0 THEN b.h >= p.tp2 OR b.l <= p.sl ELSE b.l <= p.tp2 OR b.h >= p.sl END AS over
  FROM mplans p JOIN bars b ON p.sym = b.sym AND b.t > p.t0 AND b.t <= p.t0 + 3 * CAST({b.DAY} AS BIGINT)) b JOIN mplans p USING (plan_id) GROUP BY p.plan_id"""
q.TABLES["mfilled"] = f"SELECT p.* REPLACE (f.a AS t0, f.a + 30 * CAST({b.DAY} AS BIGINT) AS t_end, CAST(NULL AS DOUBLE) AS tp1) FROM mplans p JOIN mfill0 f USING (plan_id) WHERE f.a IS NOT NULL AND (f.z IS NULL OR f.a < f.z)"
for _n, _s in (("mruns", "mplans"), ("sruns", "mfilled")):
    q.TABLES[_n] = q.replayed(_s)
    q.TABLES[_n + "_f"] = q.replayed(f"({q.mirrored(_s, True)})")


def signals(messages):
    """Parsed signals with the symbol as bars know it."""
    p = ms.parse(messages).withColumn("sym", F.regexp_replace("sym", "USDT$", ""))
    return p.select("channel", "id", "t", "sym", "side", "entry", "sl", "tps")


def channel_plans(px):
    p = ms.to_plan(px.where("px IS NOT NULL"))
    return p.withColumns({"strat": F.col("channel"), "plan_id": F.concat_ws("|", "channel", F.col("id").cast("string")), "hz": F.lit(720)})


def near_plans(px):
    return channel_plans(px).where("off_entry <= 0.03")


def channel_runs(px, bars, strict: bool):
    p = near_plans(px)
    p = (jn.fill(p, bars) if strict else p).select("strat", "plan_id", "sym", "side", "entry", "sl", "tp1", "tp2", "rm", "d_stop", "t0", "t_end", "hz")
    return b.sides(b.two_sided(rd.stored(p, "plans"), bars, own_tp1=True, bucket_ms=8 * b.DAY))


def market(spark, d):
    """Bars and priced signals, as tables that all steps read."""
    bars = rd.stored(fx.bars_1d(spark, d), "bars")
    return bars, rd.stored(jn.as_of_message(signals(messages(spark, d)), bars), "priced")


@register("jn_asof_msg", q.query("SELECT channel, id, bar_t, round(px, 6) AS px FROM msgpx"))
def jn_asof_msg(spark, d):
    return market(spark, d)[1].select("channel", "id", "bar_t", F.round("px", 6).alias("px"))


@register("prj_toplan", q.query("SELECT plan_id, sym, side, round(entry, 6) AS entry, sl, round(tp1, 6) AS tp1, round(tp2, 6) AS tp2, round(rm, 6) AS rm, round(d_stop, 6) AS d_stop, t0, t_end, round(off_entry, 6) AS off_entry FROM mplan0"))
def prj_toplan(spark, d):
    return b.r6(channel_plans(market(spark, d)[1]), "entry", "tp1", "tp2", "rm", "d_stop", "off_entry").select("plan_id", "sym", "side", "entry", "sl", "tp1", "tp2", "rm", "d_stop", "t0", "t_end", "off_entry")


@register("jn_fill", q.query("SELECT plan_id, t0, t_end, round(entry, 6) AS entry, round(tp2, 6) AS tp2 FROM mfilled"))
def jn_fill(spark, d):
    bars, px = market(spark, d)
    return b.r6(jn.fill(near_plans(px), bars), "entry", "tp2").select("plan_id", "t0", "t_end", "entry", "tp2")


TOP = 4
q.TABLES["topsym"] = f"SELECT channel, sym, m FROM (SELECT channel, sym, count(*) AS m, row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, sym) AS k FROM sigs GROUP BY channel, sym) WHERE k <= {TOP}"


@register("jn_topsym", q.query("SELECT channel, count(*) FILTER (kept) AS kept_signals, count(*) FILTER (NOT kept) AS dropped_signals, count(DISTINCT sym) FILTER (NOT kept) AS dropped_symbols FROM (SELECT s.channel, s.sym, t.m IS NOT NULL AS kept FROM sigs s LEFT JOIN topsym t USING (channel, sym)) GROUP BY channel"))
def jn_topsym(spark, d):
    s = rd.stored(signals(messages(spark, d)), "signals")
    top = ms.top_symbols(s, TOP).withColumn("_k", F.lit(True))
    j = s.join(top, ["channel", "sym"], "left")
    no = F.col("_k").isNull()
    return j.groupBy("channel").agg(F.count("_k").alias("kept_signals"), F.count(F.when(no, 1)).alias("dropped_signals"), F.countDistinct(F.when(no, F.col("sym"))).alias("dropped_symbols"))


LINKS = """SELECT 'chan_' || (conv_id % 40) AS channel, coalesce(text, '') || ' see t.me/s/Chan_' || ((conv_id * 7 + 3) % 50) || ' and t.me/joinchat t.me/chan_' || (conv_id % 40) AS text FROM conversations"""
q.TABLES["lm"] = LINKS
q.TABLES["le"] = "SELECT DISTINCT lower(channel) AS src, 'chan_' || regexp_extract(lower(text), 't\\.me/s/chan_(\\d+)', 1) AS dst FROM lm"
q.TABLES["lreach"] = "SELECT 'chan_1' AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM lreach r JOIN le e ON e.src = r.node WHERE e.dst IN (SELECT lower(channel) FROM lm) AND r.depth < 45"


@register("jn_link_frontier", q.query("SELECT node AS channel, min(depth) AS depth, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS signals FROM lreach LEFT JOIN (SELECT channel, count(*) AS n FROM sigs GROUP BY channel) s ON s.channel = node GROUP BY node ORDER BY coalesce(any_value(s.n), 0) DESC, node LIMIT 40"))
def jn_link_frontier(spark, d):
    """Links stand in what people say; three of the channels also publish signals."""
    link = F.concat(F.lit(" see t.me/s/Chan_"), ((F.col("conv_id") * 7 + 3) % 50).cast("string"), F.lit(" and t.me/joinchat t.me/chan_"), (F.col("conv_id") % 40).cast("string"))
    said = fx.table(spark, d, "conversations").select(F.concat(F.lit("chan_"), (F.col("conv_id") % 40).cast("string")).alias("channel"), F.concat(F.coalesce("text", F.lit("")), link).alias("text"))
    m = rd.stored(said.unionByName(rendered(spark, d).select("channel", "text")), "messages")
    return ms.frontier(m, spark.range(1).select(F.lit("chan_1").alias("channel"))).select("channel", "depth", "signals")


MONKEY = f"SELECT strat AS channel, t.n, real_r, control_mean, band_lo, band_hi, p, t, CASE WHEN t.n < 30 THEN 'insufficient' WHEN p <= 0.02 AND t >= 2.5 THEN 'beats_chance' ELSE 'not_beating' END AS verdict FROM ({{c}}) c JOIN ({{t}}) t USING (strat)"


def monkey_sql(runs: str) -> str:
    return MONKEY.format(c=q.chance(runs, runs + "_f"), t=q.t_stats(runs))


def monkey(real, flipped):
    out = mt.chance(real, flipped).join(mt.t_stats(real), "strat")
    return out.withColumn("verdict", pl.verdict(F.col("n"), F.col("t"), F.col("p"))).withColumnRenamed("strat", "channel").select("channel", "n", "real_r", "control_mean", "band_lo", "band_hi", "p", "t", "verdict")


@register("ag_monkey", q.query(monkey_sql("mruns")))
def ag_monkey(spark, d):
    bars, px = market(spark, d)
    return monkey(*channel_runs(px, bars, False))


q.TABLES["mhold"] = f"SELECT s.strat AS channel, arg_max(b.c, b.t) FILTER (b.t <= s.z) / arg_min(b.c, b.t) FILTER (b.t >= s.a) - 1 AS hold FROM (SELECT strat, min(t0) AS a, max(coalesce(\"at\", t_end)) AS z FROM sruns WHERE state IN {q.CLOSED} GROUP BY strat) s JOIN bars b ON b.sym = 'AF' GROUP BY s.strat"


def hold(runs, bars):
    """What holding the base symbol over a channel's span would have made: two looked-up prices a channel."""
    span = pl.closed(runs).groupBy("strat").agg(F.min("t0").alias("a"), F.max(F.coalesce("at", "t_end")).alias("z")).withColumn("sym", F.lit("AF")).withColumn("_back", -F.col("a"))
    own = bars.select("sym", "t", "c").withColumn("_back", -F.col("t"))
    out = walk.as_of(span, own.withColumnRenamed("c", "c0"), ["sym"], "_back", "_back", ["c0"], "_t0")  # the first bar from a on
    out = walk.as_of(out, own.withColumnRenamed("c", "c1"), ["sym"], "z", "t", ["c1"], "_t1")
    return out.select(F.col("strat").alias("channel"), (F.col("c1") / F.col("c0") - 1).alias("hold"))


@register("ag_hold", q.query("SELECT channel, round(hold, 6) AS hold FROM mhold"))
def ag_hold(spark, d):
    bars, px = market(spark, d)
    real, _ = channel_runs(px, bars, True)
    return b.r6(hold(real, bars.where("sym = 'AF'")), "hold")


q.TABLES["mdel"] = "SELECT channel, CASE WHEN count(DISTINCT id) > 1 THEN 1 - count(DISTINCT id) / CAST(max(id) - min(id) + 1 AS DOUBLE) END AS deleted FROM m0 GROUP BY channel"


@register("ag_deleted", q.query("SELECT channel, round(deleted, 6) AS deleted FROM mdel"))
def ag_deleted(spark, d):
    return b.r6(ms.deleted_share(rendered(spark, d)), "deleted")


def card_sql(mode: str, plans: str, runs: str) -> str:
    return f"""SELECT c.channel, '{mode}' AS mode, m.messages, g.parsed, c.n AS tested, g.no_data, g.far, g.unfilled, c.real_r, c.control_mean, c.band_lo, c.band_hi, c.p, c.t, x.win_rate, dd.max_drawdown, round(h.hold, 6) AS hold, round(e.deleted, 6) AS deleted, c.verdict,
  CASE WHEN c.verdict = 'beats_chance' AND (z.now - m.last_t) / {b.DAY}.0 <= 90 AND e.deleted <= 0.05 THEN 'badge' ELSE 'none' END AS badge
  FROM ({monkey_sql(runs)}) c JOIN (SELECT channel, count(*) AS messages, max(t) AS last_t FROM m0 GROUP BY channel) m USING (channel) JOIN (SELECT s.strat AS channel, arg_max(b.c, b.t) FILTER (b.t <= s.z) / arg_min(b.c, b.t) FILTER (b.t >= s.a) - 1 AS hold FROM (SELECT strat, min(t0) AS a, max(coalesce("at", t_end)) AS z FROM {runs} WHERE state IN {q.CLOSED} GROUP BY strat) s JOIN bars b ON b.sym = 'AF' GROUP BY s.strat) h USING (channel)
  JOIN mdel e USING (channel) JOIN (SELECT strat AS channel, win_rate FROM ({q.metrics(runs)})) x USING (channel) JOIN (SELECT strat AS channel, max_drawdown FROM ({q.drawdown(runs)})) dd USING (channel) CROSS JOIN (SELECT max(t) AS now FROM bars) z
  JOIN (SELECT s.channel, count(*) AS parsed, count(*) FILTER (s.px IS NULL) AS no_data, count(*) FILTER (p.off_entry > 0.03) AS far, count(*) FILTER (p.off_entry <= 0.03 AND f.plan_id IS NULL) AS unfilled FROM msgpx s LEFT JOIN mplan0 p ON p.plan_id = s.channel || '|' || s.id LEFT JOIN {plans} f ON f.plan_id = p.plan_id GROUP BY s.channel) g USING (channel)"""


def card(m, px, bars, mode: str):
    """One row a channel: strict tests what the market filled, lenient what was said; both against their own chance band."""
    real, flipped = channel_runs(px, bars, mode == "strict")
    done = real.select("plan_id", F.lit(1).alias("_f"))
    g = px.join(channel_plans(px).select("channel", "id", "plan_id", "off_entry"), ["channel", "id"], "left").join(done, "plan_id", "left").groupBy("channel").agg(
        F.count(F.lit(1)).alias("parsed"), F.count(F.when(F.col("px").isNull(), 1)).alias("no_data"), F.count(F.when(F.col("off_entry") > 0.03, 1)).alias("far"),
        F.count(F.when((F.col("off_entry") <= 0.03) & F.col("_f").isNull(), 1)).alias("unfilled"))
    said = m.groupBy("channel").agg(F.count(F.lit(1)).alias("messages"), F.max("t").alias("last_t"))
    now = bars.agg(F.max("t")).first()[0]
    ch = lambda df: df.withColumnRenamed("strat", "channel")
    out = monkey(real, flipped).withColumnRenamed("n", "tested").join(said, "channel").join(g, "channel").join(hold(real, bars.where("sym = 'AF'")), "channel").join(ms.deleted_share(m), "channel")
    out = out.join(ch(mt.metrics(real)).select("channel", "win_rate"), "channel").join(ch(mt.drawdown(real)).select("channel", "max_drawdown"), "channel").withColumn("mode", F.lit(mode))
    out = out.withColumn("badge", pl.badge(F.col("tested"), F.col("t"), F.col("p"), (F.lit(now) - F.col("last_t")) / float(b.DAY), F.col("deleted")))
    return b.r6(out, "hold", "deleted").select("channel", "mode", "messages", "parsed", "tested", "no_data", "far", "unfilled", "real_r", "control_mean", "band_lo", "band_hi", "p", "t", "win_rate", "max_drawdown", "hold", "deleted", "verdict", "badge")


@register("ag_channel_card", q.query(card_sql("strict", "mfilled", "sruns") + " UNION ALL " + card_sql("lenient", "mplans", "mruns")))
def ag_channel_card(spark, d):
    m = rd.stored(rendered(spark, d), "messages")
    bars = rd.stored(fx.bars_1d(spark, d), "bars")
    px = rd.stored(jn.as_of_message(signals(m.unionByName(talk(spark, d))), bars), "priced")
    return card(m, px, bars, "strict").unionByName(card(m, px, bars, "lenient"))
