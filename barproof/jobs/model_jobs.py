"""Queries on the distribution model's variance windows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from barproof.jobs import sql as q
from barproof.jobs.registry import register
from barproof.operators import model as md
from barproof.sources import fixtures as fx

W30 = "avg(CASE WHEN i >= 1 THEN r1 * r1 END) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
q.TABLES["base30"] = f"SELECT *, {W30.format(n=30)} AS base, sqrt({W30.format(n=30)}) AS sig FROM b0"
HZ = 15


@register("wn_basevol", q.query("SELECT sym, t, round(base, 9) AS base, round(sig, 9) AS sig FROM base30"))
def wn_basevol(spark, d):
    return md.with_base_vol(fx.bars_1d(spark, d), 1).select("sym", "t", F.round("base", 9).alias("base"), F.round("sig", 9).alias("sig"))


@register("wn_zscore", q.query(f"""SELECT sym, t, round(vh, 9) AS vh, round(fut / sqrt(nullif(vh, 0)), 6) AS z, round(CASE WHEN s2 > 0 THEN abs(past / sqrt(s2)) END, 6) AS mg FROM (SELECT *, CASE WHEN lead(c, {HZ - 1}) OVER w IS NOT NULL THEN base * {HZ} END AS vh, ln(lead(c, {HZ - 1}) OVER w / lag(c) OVER w) AS fut,
  ln(lag(c) OVER w / lag(c, 6) OVER w) AS past, sum(sig * sig) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS s2 FROM base30 WINDOW w AS (PARTITION BY sym ORDER BY t))"""))
def wn_zscore(spark, d):
    z = md.with_horizon_z(fx.bars_1d(spark, d), 1, HZ)
    return z.select("sym", "t", F.round("vh", 9).alias("vh"), F.round("z", 6).alias("z"), F.round("mg", 6).alias("mg"))


BLEND = f"""SELECT sym, i, {W30.format(n=30)} AS s, {W30.format(n=365)} AS l, CASE WHEN lead(c, {HZ - 1}) OVER (PARTITION BY sym ORDER BY t) IS NOT NULL THEN avg(CASE WHEN i >= 1 THEN r1 * r1 END) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN CURRENT ROW AND {HZ - 1} FOLLOWING) END AS f FROM b0"""


@register("wn_blend", q.query(f"""SELECT sym, refit, round(CAST(CASE WHEN any_value(n) < 40 THEN 1.0 ELSE arg_min(k * 0.05, round(e, 9) * 1000 + k * 1e-9) END AS DOUBLE), 2) AS w, any_value(n) AS n FROM
  (SELECT r.sym, r.refit, g.k, count(p.i) AS n, coalesce(sum(pow(ln(p.f) - (g.k * 0.05 * ln(p.s) + (1 - g.k * 0.05) * ln(p.l)), 2)), 0) AS e FROM
    (SELECT sym, i AS refit FROM b0 WHERE i >= 180 AND (i - 180) % 60 = 0) r CROSS JOIN range(21) g(k) LEFT JOIN (SELECT * FROM blend WHERE i >= 180 AND (i - 180) % {HZ // 2} = 0 AND s > 0 AND l > 0 AND f > 0) p ON p.sym = r.sym AND p.i + {HZ} <= r.refit
   GROUP BY r.sym, r.refit, g.k) GROUP BY sym, refit""", blend=BLEND))
def wn_blend(spark, d):
    return md.blend_weights(fx.bars_1d(spark, d), 1, HZ)


# ---- seasons, quantiles, tails, neighbours ----

REFIT = 5
ANGLE = [(f, k, p) for p, n in ((24, md.DAILY), (168, md.WEEKLY)) for k in range(1, n + 1) for f in ("cos", "sin")]
BASIS = "[1.0, " + ", ".join(f"{f}(2 * pi() * {k} * how / {p})" for f, k, p in ANGLE) + "]"
TAKE = "list_transform(list_zip(row, m[k + 1]), lambda z: z[1] - z[2] * (row[k + 1] / m[k + 1][k + 1]))"
SEASON = dict(
    s0=f"SELECT sym, t, i, warm, x, CASE WHEN i < warm THEN 0 ELSE (i - warm) // {24 * REFIT} + 1 END AS q0, y FROM (SELECT sym, t, i, least(CAST(floor(n * 0.35) AS BIGINT), 180 * 24) AS warm, {BASIS} AS x, ln(r1 * r1 + 1e-12) AS y FROM (SELECT *, CAST((isodow(ny) - 1) * 24 + hour(ny) AS INTEGER) AS how FROM (SELECT sym, t, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY sym) AS n, ln(c / lag(c) OVER w) AS r1, timezone('America/New_York', to_timestamp(t / 1000.0)) AS ny FROM hbars WINDOW w AS (PARTITION BY sym ORDER BY t))))",
    s1=f"SELECT d.sym, d.q, a, b, sum(x[a] * CASE WHEN b > {md.TERMS} THEN y ELSE x[b] END) AS v FROM (SELECT DISTINCT sym, (i - warm) // {24 * REFIT} AS q FROM s0 WHERE i >= warm) d JOIN s0 ON s0.sym = d.sym AND s0.q0 <= d.q AND s0.i >= 1, range(1, {md.TERMS + 1}) ra(a), range(1, {md.TERMS + 2}) rb(b) GROUP BY d.sym, d.q, a, b",
    s2="SELECT sym, q, list(r ORDER BY a) AS m FROM (SELECT sym, q, a, list(v ORDER BY b) AS r FROM s1 GROUP BY sym, q, a) GROUP BY sym, q",
    s3=f"SELECT sym, q, 0 AS k, m, 1e-9 * m[1][1] AS eps, m[1] AS top FROM s2 UNION ALL SELECT sym, q, k + 1, CASE WHEN abs(m[k + 1][k + 1]) < eps THEN m ELSE list_transform(m, lambda row, r: CASE WHEN r = k + 1 THEN row ELSE {TAKE} END) END, eps, top FROM s3 WHERE k < {md.TERMS}",
    s4=f"SELECT sym, q, coef, list_sum(list_transform(list_zip(coef, top[1:{md.TERMS}]), lambda z: z[1] * z[2])) / top[1] AS mu FROM (SELECT sym, q, top, list_transform(m, lambda row, r: CASE WHEN abs(row[r]) < eps THEN 0 ELSE row[{md.TERMS + 1}] / row[r] END) AS coef FROM s3 WHERE k = {md.TERMS})",
)


@register("wn_season", q.query(f"SELECT s0.sym, t, round(exp(list_sum(list_transform(list_zip(coef, x), lambda z: z[1] * z[2])) - mu), 6) AS season FROM s0 LEFT JOIN s4 ON s4.sym = s0.sym AND s4.q = (i - warm) // {24 * REFIT} AND i >= warm", **SEASON))
def wn_season(spark, d):
    return md.with_season(fx.bars_1h(spark, d), 24, REFIT, share=Decimal("0.35")).select("sym", "t", F.round("season", 6).alias("season"))


TAUS = (0.1, 0.5, 0.9)
q.TABLES["zpoints"] = f"""SELECT sym, t, fut / sqrt(nullif(base * {HZ}, 0)) AS z, CASE WHEN s2 > 0 THEN abs(past / sqrt(s2)) END AS mg FROM (SELECT *, ln(lead(c, {HZ - 1}) OVER w / lag(c) OVER w) AS fut,
  ln(lag(c) OVER w / lag(c, 6) OVER w) AS past, sum(sig * sig) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS s2 FROM base30 WINDOW w AS (PARTITION BY sym ORDER BY t))"""


def z_points(spark, d):
    return md.with_horizon_z(fx.bars_1d(spark, d), 1, HZ)


QUANT = dict(
    qp="SELECT sym, mg AS x, z AS y FROM zpoints WHERE mg IS NOT NULL AND z IS NOT NULL",
    qr="SELECT sym, tau, y AS a FROM (SELECT sym, y, row_number() OVER (PARTITION BY sym ORDER BY y) - 1 AS r, count(*) OVER (PARTITION BY sym) AS n FROM qp), (VALUES (0.1), (0.5), (0.9)) v(tau) WHERE r = floor(tau * (n - 1) + 0.5)",
    qf="""SELECT sym, CAST(tau AS DOUBLE) AS tau, a, CAST(0 AS DOUBLE) AS b, 0 AS it, false AS done FROM qr UNION ALL SELECT sym, tau, na, nb, it + 1, abs(na - a) + abs(nb - b) < 1e-6 FROM (SELECT sym, tau, a, b, it, (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) AS na, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS nb FROM
      (SELECT sym, tau, a, b, it, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * y) AS t0, sum(w * x * y) AS t1 FROM (SELECT f.*, p.x, p.y, CASE WHEN p.y - (f.a + f.b * p.x) > 0 THEN f.tau ELSE 1 - f.tau END / greatest(abs(p.y - (f.a + f.b * p.x)), 1e-3) AS w FROM qf f JOIN qp p ON p.sym = f.sym WHERE NOT f.done AND f.it < 140) GROUP BY sym, tau, a, b, it))""",
)


@register("md_quantreg", q.query("SELECT sym, tau, round(arg_max(a, it), 4) AS a, round(arg_max(b, it), 4) AS b FROM qf GROUP BY sym, tau", **QUANT))
def md_quantreg(spark, d):
    fits = md.quantile_fits(z_points(spark, d).select("sym", F.col("mg").alias("x"), F.col("z").alias("y")), ["sym"], list(TAUS))
    return fits.select("sym", "tau", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@register("md_gpd", q.query("""SELECT sym, side, round(u, 6) AS u, n, round(CASE WHEN ok THEN a0 / den - 2 END, 6) AS k, round(CASE WHEN ok THEN 2 * a0 * a1 / den END, 6) AS s FROM (SELECT *, n >= 25 AND abs(den) >= 1e-12 AND 2 * a0 * a1 / nullif(den, 0) > 0 AS ok FROM
  (SELECT sym, side, any_value(u) AS u, count(*) AS n, avg(y) AS a0, sum(y * (m - pos)) / (any_value(m) - 1) / any_value(m) AS a1, avg(y) - 2 * sum(y * (m - pos)) / (any_value(m) - 1) / any_value(m) AS den FROM
    (SELECT *, row_number() OVER (PARTITION BY sym, side ORDER BY y) AS pos, count(*) OVER (PARTITION BY sym, side) AS m FROM
      (SELECT sym, 'hi' AS side, hi AS u, z - hi AS y FROM gz WHERE z > hi UNION ALL SELECT sym, 'lo', lo, lo - z FROM gz WHERE z < lo)) GROUP BY sym, side))""",
    gr="SELECT sym, z, row_number() OVER (PARTITION BY sym ORDER BY z) - 1 AS r, count(*) OVER (PARTITION BY sym) AS cnt FROM zpoints WHERE z IS NOT NULL",
    gz="SELECT *, max(CASE WHEN r = floor(0.85 * (cnt - 1) + 0.5) THEN z END) OVER (PARTITION BY sym) AS hi, max(CASE WHEN r = floor(0.15 * (cnt - 1) + 0.5) THEN z END) OVER (PARTITION BY sym) AS lo FROM gr"))
def md_gpd(spark, d):
    fits = md.tail_fits(z_points(spark, d), ["sym"])
    return fits.select("sym", "side", F.round("u", 6).alias("u"), "n", F.round("k", 6).alias("k"), F.round("s", 6).alias("s"))


NEAR = dict(
    n0="SELECT sym, t, i, c, CASE WHEN i >= least(CAST(floor(cnt * 0.35) AS BIGINT), 180) AND sig > 0 THEN sig END AS sg, coalesce(r1, 0) AS r FROM (SELECT *, count(*) OVER (PARTITION BY sym) AS cnt FROM base30)",
    n1="SELECT sym, t, sg, row_number() OVER (PARTITION BY sym ORDER BY t) - 1 AS j, CASE WHEN i >= 5 AND v5 > 0 THEN s5 / sqrt(v5) END AS m5, CASE WHEN i >= 20 AND v20 > 0 THEN s20 / sqrt(v20) END AS m20 FROM (SELECT *, "
    + ", ".join(f"sum(r) OVER w{d} AS s{d}, sum(sg * sg) OVER w{d} AS v{d}" for d in (5, 20)) + " FROM n0 WINDOW " + ", ".join(f"w{d} AS (PARTITION BY sym ORDER BY t ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)" for d in (5, 20)) + ") WHERE sg IS NOT NULL",
    n2="SELECT *, ln(sg / max(CASE WHEN r = cnt // 2 THEN sg END) OVER (PARTITION BY sym)) AS vol FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY sg) - 1 AS r, count(*) OVER (PARTITION BY sym) AS cnt FROM n1)",
    n3="SELECT n2.*, (m5 - a5) / d5 AS z5, (m20 - a20) / d20 AS z20, CASE WHEN m5 IS NOT NULL AND m20 IS NOT NULL THEN (vol - av) / dv END AS zv, max(j) OVER (PARTITION BY sym) AS jmax FROM n2 JOIN (SELECT sym, avg(m5) AS a5, stddev_samp(m5) AS d5, avg(m20) AS a20, stddev_samp(m20) AS d20, avg(vol) AS av, stddev_samp(vol) AS dv FROM n2 WHERE m5 IS NOT NULL AND m20 IS NOT NULL GROUP BY sym) USING (sym)",
    n4=f"SELECT a.sym, a.t, round(pow(a.z5 - b.z5, 2) + pow(a.z20 - b.z20, 2) + pow(a.zv - b.zv, 2), 9) AS dist FROM n3 a JOIN n3 b ON a.sym = b.sym AND b.j = b.jmax WHERE a.j + {HZ} <= a.jmax AND a.z5 IS NOT NULL AND a.z20 IS NOT NULL",
)


@register("md_neighbors", q.query("SELECT sym, t, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY dist, t) AS r, count(*) OVER (PARTITION BY sym) AS m FROM n4) WHERE r <= least(m, greatest(200, floor(m * 0.15)))", **NEAR))
def md_neighbors(spark, d):
    return md.neighbours(fx.bars_1d(spark, d), 1, HZ).select("sym", "t", F.round("dist", 6).alias("dist"))
