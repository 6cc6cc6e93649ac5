"""The reference results in SQL: named common tables, put together on demand."""

from __future__ import annotations

import re

from barproof.sources import fixtures as fx

WARMUP, DAY = 60, 86_400_000
STRATS = ("tsmom20", "tsmom60", "donch20", "donch55", "revert3", "fund_pct", "fund_abs", "xsmom30")
BOOK = ("tsmom20", "revert3", "xsmom30")
COST = "0.0022"
CLOSED = "('stop', 'be', 'tp2', 'expired')"

W = "(PARTITION BY sym ORDER BY t)"


def _donch(n: int) -> str:
    f = f"OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN i >= {n + 1} AND round(c, 9) > round(max(h) {f}, 9) THEN 1 WHEN i >= {n + 1} AND round(c, 9) < round(min(l) {f}, 9) THEN -1 ELSE 0 END"


TABLES: dict[str, str] = {}
for block in (fx.BARS, fx.BARS_1H, fx.FUNDING, fx.CALENDAR):
    for name, body in re.findall(r"(\w+) AS \((.*?)\)(?=,\n|$)", block, re.S):
        TABLES[name] = body

TABLES["b0"] = f"SELECT *, row_number() OVER {W} - 1 AS i, ln(c / lag(c) OVER {W}) AS r1 FROM bars"
TABLES["b1"] = f"SELECT *, pow(0.97, i) * sum(CASE WHEN i = 0 THEN 0 WHEN i = 1 THEN r1 * r1 ELSE 0.03 * r1 * r1 END * pow(0.97, -i)) OVER {W} AS v2 FROM b0"
TABLES["feats"] = f"""SELECT *, CASE WHEN i >= 50 THEN sqrt(v2) END AS vol, {', '.join(f'ln(c / lag(c, {d}) OVER {W}) AS ret{d}d' for d in (3, 20, 30, 60))},
  {_donch(20)} AS donch20d, {_donch(55)} AS donch55d FROM b1"""
TABLES["syms"] = "SELECT DISTINCT sym FROM bars"
TABLES["anchors"] = f"SELECT t AS anchor FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS ix FROM (SELECT DISTINCT t FROM bars)) WHERE ix >= {WARMUP}"
TABLES["arows"] = "SELECT p.anchor, p.sym, f.* EXCLUDE (sym) FROM (SELECT anchor, sym FROM anchors CROSS JOIN syms) p ASOF JOIN feats f ON p.sym = f.sym AND p.anchor >= f.t WHERE f.i >= 1"
TABLES["f0"] = f"SELECT *, row_number() OVER {W} - 1 AS i FROM funding"
TABLES["favg"] = "SELECT *, CASE WHEN i >= 2 THEN round(avg(r) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 12) END AS avg_n FROM f0"
TABLES["fpct"] = "SELECT sym, t, r, i, avg_n, CASE WHEN i >= 273 THEN len(list_filter(seen, lambda x: x < avg_n)) / 270.0 END AS pct FROM (SELECT *, list(avg_n) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN 269 PRECEDING AND CURRENT ROW) AS seen FROM favg)"
TABLES["frows"] = "SELECT a.*, f.avg_n, f.pct FROM arows a ASOF LEFT JOIN fpct f ON a.sym = f.sym AND a.anchor >= f.t"
TABLES["xrows"] = """SELECT *, CASE WHEN ret30d IS NOT NULL THEN row_number() OVER (PARTITION BY anchor ORDER BY round(ret30d, 9) DESC NULLS LAST, sym) END AS hi, count(ret30d) OVER (PARTITION BY anchor) AS nx FROM frows"""
TABLES["picks"] = """SELECT 'tsmom20' AS strat, 5 AS hz, 2.0 AS rm, sign(ret20d) AS side, * FROM xrows UNION ALL BY NAME SELECT 'tsmom60' AS strat, 5 AS hz, 2.0 AS rm, sign(ret60d) AS side, * FROM xrows
UNION ALL BY NAME SELECT 'donch20' AS strat, 5 AS hz, 2.0 AS rm, donch20d AS side, * FROM xrows UNION ALL BY NAME SELECT 'donch55' AS strat, 5 AS hz, 2.0 AS rm, donch55d AS side, * FROM xrows
UNION ALL BY NAME SELECT 'revert3' AS strat, 1 AS hz, 1.5 AS rm, CASE WHEN ret3d / (vol * sqrt(3.0)) < -2 THEN 1 WHEN ret3d / (vol * sqrt(3.0)) > 2 THEN -1 END AS side, * FROM xrows
UNION ALL BY NAME SELECT 'fund_pct' AS strat, 3 AS hz, 1.5 AS rm, CASE WHEN pct >= 0.9 THEN -1 WHEN pct <= 0.1 THEN 1 END AS side, * FROM xrows
UNION ALL BY NAME SELECT 'fund_abs' AS strat, 3 AS hz, 1.5 AS rm, CASE WHEN avg_n >= 0.0003 THEN -1 WHEN avg_n <= -0.0003 THEN 1 END AS side, * FROM xrows
UNION ALL BY NAME SELECT 'xsmom30' AS strat, 5 AS hz, 2.0 AS rm, CASE WHEN nx < 6 THEN 0 WHEN hi <= 3 THEN 1 WHEN nx - hi + 1 <= 3 THEN -1 END AS side, * FROM xrows"""


def plan_levels(source: str, tf_ms: int = DAY) -> str:
    return f"""SELECT *, entry * exp(-side * d_stop) AS sl, CASE WHEN rm > 1 THEN entry * exp(side * d_stop) END AS tp1, entry * exp(side * rm * d_stop) AS tp2, t0 + hz * {tf_ms} AS t_end
    FROM (SELECT *, greatest(1e-4, vol * sqrt(hz)) AS d_stop FROM ({source}))"""


TABLES["cand"] = plan_levels("SELECT strat, sym, strat || '|' || sym || '|' || anchor AS plan_id, CAST(side AS INTEGER) AS side, c AS entry, vol, hz, rm, anchor AS t0 FROM picks WHERE side IN (1, -1) AND vol > 0")
TABLES["ord"] = "SELECT *, row_number() OVER (PARTITION BY strat, sym ORDER BY t0, side) AS k FROM cand"
TABLES["adm"] = """SELECT DISTINCT strat, sym, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS lt, CAST(-1 AS BIGINT) AS st, false AS ok FROM cand
UNION ALL SELECT o.strat, o.sym, o.k,
  CASE WHEN o.side = 1 THEN CASE WHEN a.lt > o.t0 THEN a.lt ELSE o.t_end END ELSE CASE WHEN a.st > o.t0 THEN a.lt WHEN a.lt > o.t0 THEN -1 ELSE a.lt END END,
  CASE WHEN o.side = -1 THEN CASE WHEN a.st > o.t0 THEN a.st ELSE o.t_end END ELSE CASE WHEN a.lt > o.t0 THEN a.st WHEN a.st > o.t0 THEN -1 ELSE a.st END END,
  CASE WHEN o.side = 1 THEN NOT a.lt > o.t0 ELSE NOT a.st > o.t0 END
FROM adm a JOIN ord o ON a.strat = o.strat AND a.sym = o.sym AND o.k = a.k + 1"""
TABLES["kept"] = "SELECT o.* FROM ord o JOIN adm a USING (strat, sym, k) WHERE a.ok"
_F = "OVER (PARTITION BY strat, sym ORDER BY t0 RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
TABLES["plans"] = f"""SELECT * EXCLUDE (t_end, fl), least(t_end, coalesce(fl, t_end)) AS t_end, coalesce(fl < t_end, false) AS flipped FROM
 (SELECT *, CASE WHEN side = 1 THEN min(CASE WHEN side = -1 THEN t0 END) {_F} ELSE min(CASE WHEN side = 1 THEN t0 END) {_F} END AS fl FROM kept)"""
TABLES["book"] = f"SELECT * FROM plans WHERE strat IN {BOOK}"


def mirrored(source: str, own_tp1: bool = False) -> str:
    tp1 = "CASE WHEN tp1 IS NOT NULL THEN entry * exp(-side * abs(ln(tp1 / entry))) END" if own_tp1 else "CASE WHEN rm > 1 THEN entry * exp(-side * d_stop) END"
    return f"SELECT * REPLACE (-side AS side, entry * exp(side * d_stop) AS sl, {tp1} AS tp1, entry * exp(-side * rm * d_stop) AS tp2) FROM {source}"


def replayed(source: str, bars: str = "bars", cost: str = COST) -> str:
    """plan rows -> with state, at, px, raw r, net r, half, n."""
    return f"""WITH j AS (SELECT p.plan_id, p.side, p.entry, b.t, b.c, CASE WHEN p.side > 0 THEN round(b.l, 9) <= round(p.sl, 9) ELSE round(b.h, 9) >= round(p.sl, 9) END AS x_sl, CASE WHEN p.side > 0 THEN round(b.l, 9) <= round(p.entry, 9) ELSE round(b.h, 9) >= round(p.entry, 9) END AS x_be,
   coalesce(CASE WHEN p.side > 0 THEN round(b.h, 9) >= round(p.tp1, 9) ELSE round(b.l, 9) <= round(p.tp1, 9) END, false) AS x_1, CASE WHEN p.side > 0 THEN round(b.h, 9) >= round(p.tp2, 9) ELSE round(b.l, 9) <= round(p.tp2, 9) END AS x_2
   FROM {source} p JOIN {bars} b ON p.sym = b.sym AND b.t > p.t0 AND b.t <= p.t_end),
 g1 AS (SELECT plan_id, min(t) FILTER (x_sl) AS t_sl, min(t) FILTER (x_1) AS t_1, min(t) FILTER (x_2) AS t_2, max(t) AS t_last, arg_max(c, t) AS c_last FROM j GROUP BY plan_id),
 g2 AS (SELECT j.plan_id, min(t) FILTER (x_be AND t > t_1) AS t_be, min(t) FILTER (x_2 AND t >= t_1) AS t_2h FROM j JOIN g1 USING (plan_id) GROUP BY j.plan_id),
 z AS (SELECT p.*, g1.* EXCLUDE (plan_id), g2.* EXCLUDE (plan_id), side * ln(c_last / entry) / d_stop AS open_r,
   CASE WHEN t_last IS NULL THEN 'wait' WHEN t_sl <= coalesce(t_1, t_sl) AND t_sl <= coalesce(t_2, t_sl) THEN 'stop' WHEN t_2 < coalesce(t_1, t_2 + 1) THEN 'tp2'
     WHEN t_1 IS NOT NULL AND t_be <= coalesce(t_2h, t_be) THEN 'be' WHEN t_1 IS NOT NULL AND t_2h IS NOT NULL THEN 'tp2h' WHEN t_last >= t_end THEN 'expired' ELSE 'open' END AS s
   FROM {source} p LEFT JOIN g1 USING (plan_id) LEFT JOIN g2 USING (plan_id)),
 y AS (SELECT *, CASE s WHEN 'stop' THEN t_sl WHEN 'tp2' THEN t_2 WHEN 'be' THEN t_be WHEN 'tp2h' THEN t_2h ELSE t_last END AS at,
   CASE s WHEN 'stop' THEN sl WHEN 'tp2' THEN tp2 WHEN 'be' THEN entry WHEN 'tp2h' THEN tp2 ELSE c_last END AS px,
   CASE s WHEN 'wait' THEN 0 WHEN 'stop' THEN -1 WHEN 'tp2' THEN rm WHEN 'be' THEN 0.5 WHEN 'tp2h' THEN 0.5 + 0.5 * rm ELSE CASE WHEN t_1 IS NOT NULL THEN 0.5 + 0.5 * open_r ELSE open_r END END AS raw_r FROM z)
 SELECT y.* EXCLUDE (t_sl, t_1, t_2, t_be, t_2h, t_last, c_last, open_r, s), CASE WHEN s = 'tp2h' THEN 'tp2' ELSE s END AS state, raw_r - {cost} / d_stop AS r,
   t_1 IS NOT NULL AND s IN ('be', 'tp2h', 'expired', 'open') AS half, (SELECT count(*) FROM j WHERE j.plan_id = y.plan_id AND j.t <= y.at) AS n FROM y"""


TABLES["runs"] = replayed("book")
TABLES["fruns"] = replayed(f"({mirrored('book')})")
TABLES["allruns"] = replayed("plans")
TABLES["allfruns"] = replayed(f"({mirrored('plans')})")


def with_funding(source: str) -> str:
    return f"""SELECT s.* EXCLUDE (r), s.r + CASE WHEN s.state IN {CLOSED} THEN -s.side * (coalesce(b.cum, 0) - coalesce(a.cum, 0)) / s.d_stop ELSE 0 END AS r,
  CASE WHEN s.state IN {CLOSED} THEN -s.side * (coalesce(b.cum, 0) - coalesce(a.cum, 0)) / s.d_stop ELSE 0 END AS fund_r
  FROM {source} s ASOF LEFT JOIN fcum a ON s.sym = a.sym AND s.t0 >= a.t ASOF LEFT JOIN fcum b ON s.sym = b.sym AND coalesce(s.at, s.t_end) >= b.t"""


TABLES["fcum"] = f"SELECT sym, t, sum(r) OVER {W} AS cum FROM funding"
TABLES["pruns"] = f"SELECT * EXCLUDE (r, fund_r), CASE WHEN strat LIKE 'fund%' THEN r ELSE r - fund_r END AS r, CASE WHEN strat LIKE 'fund%' THEN fund_r ELSE 0 END AS fund_r FROM ({with_funding('allruns')})"
TABLES["pfruns"] = f"SELECT * EXCLUDE (r, fund_r), CASE WHEN strat LIKE 'fund%' THEN r ELSE r - fund_r END AS r FROM ({with_funding('allfruns')})"


def metrics(source: str, by: str = "strat") -> str:
    d = f"state IN {CLOSED}"
    return f"""SELECT {by}, count(*) FILTER ({d}) AS n, round(coalesce(sum(r) FILTER ({d}), 0), 6) AS total_r, round(coalesce(avg(r) FILTER ({d}), 0), 6) AS avg_r,
  round(coalesce(quantile_cont(r, 0.5) FILTER ({d}), 0), 6) AS median_r, count(*) FILTER ({d} AND r > 0) AS wins, count(*) FILTER ({d} AND r < 0) AS losses,
  round(coalesce(count(*) FILTER ({d} AND r > 0) / nullif(count(*) FILTER ({d}), 0), 0), 6) AS win_rate,
  round(CASE WHEN coalesce(sum(r) FILTER ({d} AND r < 0), 0) < 0 THEN coalesce(sum(r) FILTER ({d} AND r > 0), 0) / -sum(r) FILTER ({d} AND r < 0) WHEN sum(r) FILTER ({d} AND r > 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS profit_factor,
  round(coalesce(sum(n) FILTER ({d}) / nullif(count(*) FILTER ({d}), 0), 0), 6) AS avg_hold_bars,
  {', '.join(f"count(*) FILTER (state = '{s}') AS n_{s}" for s in ('stop', 'be', 'tp2', 'expired'))}, count(*) FILTER (NOT {d}) AS skipped FROM {source} GROUP BY {by}"""


def drawdown(source: str, by: str = "strat") -> str:
    return f"""SELECT {by}, round(max(peak - eq), 6) AS max_drawdown, round(arg_max(eq, rn), 6) AS final_equity FROM (SELECT *, greatest(0, max(eq) OVER (PARTITION BY {by} ORDER BY rn)) AS peak FROM
  (SELECT {by}, sum(r) OVER (PARTITION BY {by} ORDER BY t0, sym ROWS UNBOUNDED PRECEDING) AS eq, row_number() OVER (PARTITION BY {by} ORDER BY t0, sym) AS rn FROM {source} WHERE state IN {CLOSED})) GROUP BY {by}"""


def t_stats(source: str, by: str = "strat") -> str:
    return f"SELECT {by}, count(*) AS n, round(CASE WHEN coalesce(stddev_samp(r), 0) > 0 THEN avg(r) / (stddev_samp(r) / sqrt(count(*))) ELSE 0 END, 6) AS t FROM {source} WHERE state IN {CLOSED} GROUP BY {by}"


def halves(source: str, by: str = "strat") -> str:
    return f"""SELECT {by}, round(coalesce(avg(r) FILTER (i <= n // 2), 0), 6) AS h1, round(coalesce(avg(r) FILTER (i > n // 2), 0), 6) AS h2 FROM
  (SELECT {by}, r, row_number() OVER (PARTITION BY {by} ORDER BY t0, sym) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE state IN {CLOSED}) GROUP BY {by}"""


def chance(real: str, flipped: str, k: int = 50, by: str = "strat") -> str:
    lo, hi = int(k * 0.05) + 1, -(-k * 95 // 100)
    return f"""WITH o AS (SELECT r.{by}, r.plan_id, CASE WHEN r.state IN {CLOSED} THEN r.r ELSE 0 END AS a, CASE WHEN f.state IN {CLOSED} THEN f.r ELSE 0 END AS b FROM {real} r JOIN {flipped} f USING (plan_id)),
 own AS (SELECT {by}, coalesce(sum(r) FILTER (state IN {CLOSED}), 0) AS own FROM {real} GROUP BY {by}),
 d AS (SELECT {by}, draw, sum(CASE WHEN substr(md5(draw || '|' || plan_id), 1, 1) < '8' THEN b ELSE a END) AS total FROM o, range({k}) x(draw) GROUP BY {by}, draw)
 SELECT d.{by}, round(any_value(own), 6) AS real_r, round(avg(total), 6) AS control_mean, round(avg(CAST(total >= own AS INTEGER)), 6) AS p, round(list_sort(list(total))[{lo}], 6) AS band_lo, round(list_sort(list(total))[{hi}], 6) AS band_hi
 FROM d JOIN own USING ({by}) GROUP BY d.{by}"""


def query(body: str, **more: str) -> str:
    """``body`` with the common tables that it needs in front; ``more`` adds tables of its own."""
    tables = TABLES | more
    needed: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in re.findall(r"\b[a-z_]\w*\b", text):
            if name in tables and name not in needed and name != own:
                need(tables[name], name)
                if name not in needed:
                    needed.append(name)

    if body.lstrip().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    need(body)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({tables[n]})" for n in needed) + "\n" if needed else "") + body
