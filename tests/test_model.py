"""Seasons, blends, quantile lines, tails, neighbours and ranks against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barproof.operators import model as md
from barproof.operators import ranks

HOUR = 3_600_000
START = 1_709_251_200_000  # New York's clocks change nine days later


def hourly(spark, n, syms=("A",), seed=1):
    rng, rows = random.Random(seed), []
    for s in syms:
        c = 100.0
        for i in range(n):
            c *= math.exp(rng.gauss(0, 0.002 * (2 + math.sin(i / 24 * 2 * math.pi))))
            rows.append((s, START + i * HOUR, c))
    return spark.createDataFrame(rows, "sym string, t long, c double"), rows


def new_york(t):
    from datetime import UTC, datetime
    from zoneinfo import ZoneInfo

    d = datetime.fromtimestamp(t / 1000, UTC).astimezone(ZoneInfo("America/New_York"))
    return d.weekday() * 24 + d.hour


def basis(how):
    return [1.0, *[f(2 * math.pi * k * how / p) for p, n in ((24, 4), (168, 3)) for k in range(1, n + 1) for f in (math.cos, math.sin)]]


def test_season_is_the_regression_of_all_bars_before(spark):
    bars, rows = hourly(spark, 1300)
    t, c = [r[1] for r in rows], np.array([r[2] for r in rows])
    ret = np.concatenate(([0.0], np.diff(np.log(c))))
    x, y, want = np.array([basis(new_york(k)) for k in t]), np.log(ret**2 + 1e-12), {}
    warm, step = int(1300 * 0.35), 5 * 24
    for t0 in range(warm, 1300, step):
        coef = np.linalg.lstsq(x[1:t0], y[1:t0], rcond=None)[0]
        mu = (x[1:t0] @ coef).mean()
        want |= {t[i]: math.exp(x[i] @ coef - mu) for i in range(t0, min(t0 + step, 1300))}
    got = {r.t: r.season for r in md.with_season(bars, 24, 5).collect()}
    assert len(got) == 1300 and {k for k, v in got.items() if v is not None} == set(want)
    assert all(got[k] == pytest.approx(v, rel=1e-6) for k, v in want.items())


def test_season_and_blend_of_a_prefix(spark):
    """Bars that come later change no factor and no weight (the warm-up is 180 days once there are 515)."""
    rng, c, rows = random.Random(4), 100.0, []
    for i in range(1000):
        c *= math.exp(rng.gauss(0, 0.02 * (1 + (i // 90) % 3)))
        rows.append(("A", i * 24 * HOUR, c))
    bars = spark.createDataFrame(rows, "sym string, t long, c double")
    cut = bars.where(F.col("t") < 800 * 24 * HOUR)
    season = lambda b: {r.t: r.season and round(r.season, 7) for r in md.with_season(b, 1).where(F.col("t") < 800 * 24 * HOUR).collect()}
    assert season(cut) == season(bars) and sum(v is not None for v in season(cut).values()) == 620
    blend = lambda b: {r.refit: (r.w, r.n) for r in md.blend_weights(b, 1, 10).collect()}
    short, long = blend(cut), blend(bars)
    assert short == {k: v for k, v in long.items() if k < 800} and len(long) == 14 and len({w for w, _ in long.values()}) > 2


def test_a_sigma_with_season(spark):
    bars, _ = hourly(spark, 1300)
    rows = md.with_base_vol(md.with_season(bars, 24, 5), 24, 10, season="season").orderBy("t").collect()
    r = rows[-1]
    logs = [math.log(a.c / b.c) ** 2 / max(1e-6, a.season or 1.0) for a, b in zip(rows[-241:-1], rows[-242:-2])]
    assert r.base == pytest.approx(sum(logs) / len(logs)) and r.sig == pytest.approx(math.sqrt(r.base * r.season))


@pytest.mark.parametrize("together", [1, 8])
def test_quantile_lines(spark, together):
    """y = 1 + 2x + (1 + x) e: its quantiles are lines; fits end by convergence."""
    rng, inverse = random.Random(8), {0.1: -1.2816, 0.5: 0.0, 0.9: 1.2816}
    rows = [(s, x, 1 + 2 * x + (1 + x) * rng.gauss(0, 1)) for s, n in (("A", 4000), ("B", 400)) for x in (rng.random() for _ in range(n))]
    points = spark.createDataFrame([*rows, ("A", None, 1.0), ("A", 1.0, None)], "sym string, x double, y double")
    out = md.quantile_fits(points, ["sym"], list(inverse), most=140 if together == 8 else 6, tolerance=1e-4, together=together).collect()
    assert len(out) == 6
    if together == 8:
        for r in out:
            assert r.settled and r.rounds < 140
            z, tol = inverse[r.tau], 0.15 if r.sym == "A" else 0.5
            assert r.a == pytest.approx(1 + z, abs=tol) and r.b == pytest.approx(2 + z, abs=2 * tol)
            own = [(x, y) for s, x, y in rows if s == r.sym]
            assert sum(y <= r.a + r.b * x for x, y in own) / len(own) == pytest.approx(r.tau, abs=0.01)
    else:
        assert all(r.rounds == 6 or r.settled for r in out)
    assert md.quantile_fits(points.limit(0), ["sym"], [0.5]).count() == 0


def test_tails(spark):
    """Exponential tails have a shape near 0; moments as sorted exceedances give them."""
    rng = random.Random(2)
    z = {"A": [rng.expovariate(1) * rng.choice((1, -1)) for _ in range(3000)], "few": [float(k) for k in range(40)], "ties": [1.0] * 50}
    out = {(r.sym, r.side): r for r in md.tail_fits(spark.createDataFrame([(s, x) for s, xs in z.items() for x in xs] + [("A", None)], "sym string, z double"), ["sym"]).collect()}
    for side, sign in (("hi", 1), ("lo", -1)):
        v = sorted(sign * x for x in z["A"])
        u = v[math.floor(0.85 * 2999 + 0.5)] if sign > 0 else -sorted(z["A"])[math.floor(0.15 * 2999 + 0.5)]
        y = [x - u for x in v if x > u]
        n, a0 = len(y), sum(y) / len(y)
        a1 = sum(x * (n - k) / (n - 1) for k, x in enumerate(y, 1)) / n
        r = out["A", side]
        assert (r.n, r.u) == (n, pytest.approx(sign * u)) and r.k == pytest.approx(a0 / (a0 - 2 * a1) - 2) and r.s == pytest.approx(2 * a0 * a1 / (a0 - 2 * a1))
        assert abs(r.k) < 0.15 and r.s == pytest.approx(1, abs=0.15)
    assert out["few", "hi"].k is None and not any(s == "ties" for s, _ in out)
    got = spark.range(1).select(md.tail_quantile(F.lit(0.2), F.lit(1.5), F.lit(0.1)).alias("a"), md.tail_quantile(F.lit(0.0), F.lit(1.5), F.lit(0.1)).alias("b")).first()
    assert (got.a, got.b) == pytest.approx((1.5 / 0.2 * (1 - 0.1**0.2), -1.5 * math.log(0.1)))


def test_neighbours_are_the_nearest(spark):
    rng, c, rows = random.Random(6), 100.0, []
    for i in range(700):
        c *= math.exp(rng.gauss(0, 0.03))
        rows.append(("A", i * 24 * HOUR, c))
    bars = spark.createDataFrame(rows, "sym string, t long, c double")
    s = md.states(bars, 1).orderBy("j").collect()
    v = [(r.z_m5, r.z_m20, r.z_vol) for r in s]
    for k in range(3):
        own = [x[k] for x in v if x[0] is not None]
        assert np.mean(own) == pytest.approx(0, abs=1e-9) and np.std(own, ddof=1) == pytest.approx(1)
    hz = 15
    dist = {r.t: round(sum((a - b) ** 2 for a, b in zip(x, v[-1])), 9) for r, x in zip(s, v) if x[0] is not None and r.j + hz <= s[-1].j}
    for least, share in ((50, 0.15), (10, 0.3), (10**6, 0.1)):
        got = {r.t: r.dist for r in md.neighbours(bars, 1, hz, share, least).collect()}
        many = min(len(dist), max(least, math.floor(share * len(dist))))
        assert set(got) == set(sorted(dist, key=lambda t: (dist[t], t))[:many])


@pytest.mark.parametrize("values", [[5.0] * 200, [float(k % 7) for k in range(300)], [2.0**k for k in range(60)] * 3, [0.0]])
def test_the_least_k_with_ties(spark, values):
    rows = [("A", v, k) for k, v in enumerate(values)] + [("B", -v, k) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, v double, i long").repartition(4)
    for k in (0, 1, len(values) // 2, len(values)):
        got = ranks.least_k(df.withColumn("k", F.lit(k)), ["key"], "v", "i", "k", bins=8).collect()
        assert sorted((r.key, r.v, r.i) for r in got) == sorted(x for s in "AB" for x in sorted(r for r in rows if r[0] == s)[:k])


def test_ranks_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(50), k) for k in range(500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = ranks.ranked(spark.createDataFrame(rows, "key string, v int, i int"), ["key"], ["v", "i"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {(s, v, i): k for s in "ab" for k, (_, v, i) in enumerate(sorted(r for r in rows if r[0] == s))}
    assert {(r.key, r.v, r.i): r["rank"] for r in got} == want and all(r.n == sum(x[0] == r.key for x in rows) for r in got)
