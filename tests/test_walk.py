"""Admission over spans of time, blocks with halos, and strategies of the user."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barproof.operators import features as ft
from barproof.operators import plugins, walk

DAY = 86_400_000
CAND = "plan_id string, strat string, sym string, side int, t0 long, t_end long"


def folded(rows, shadow=False):
    """Plans in order of time, one after the other: plan_id -> (end, flipped)."""
    out, ends = {}, {}
    for pid, strat, sym, side, t0, t_end in sorted(rows, key=lambda r: (r[4], r[3], r[0])):
        own, other = (strat, sym, side), (strat, sym, -side)
        if own in ends and ends[own][0] > t0:
            continue
        if not shadow and other in ends and ends[other][0] > t0:
            out[ends[other][1]] = (t0, True)
            del ends[other]
        ends[own] = (t_end, pid)
        out[pid] = (t_end, False)
    return out


def candidates(rng, n, times, longest):
    return [(f"p{k}", rng.choice("st"), "A" if rng.random() < 0.8 else "B", rng.choice((1, 1, 1, -1)), t0, t0 + rng.randrange(1, longest)) for k, t0 in enumerate(rng.sample(range(times), n))]


@pytest.mark.parametrize(("span", "longest", "times"), [(7, 30, 400), (50, 8, 300), (10**9, 20, 270), (3, 200, 500)])
def test_admission_over_spans(spark, span, longest, times):
    rows = candidates(random.Random(span), 260, times, longest)
    got = {r.plan_id: (r.t_end, r.flipped) for r in walk.admit(spark.createDataFrame(rows, CAND), span).collect()}
    # one fold for each (strategy, symbol)
    want = folded(rows)
    assert got == want and 20 < len(want) < len(rows)


def test_admission_of_sparse_and_shadow_candidates(spark):
    rows = [(f"p{k}", "s", "A", side, t, t + n) for k, (side, t, n) in enumerate([(1, 0, 1000), (1, 10, 5), (1, 500, 10), (1, 1000, 10), (-1, 1000, 700), (-1, 1650, 10), (1, 1650, 10)])]
    assert {r.plan_id for r in walk.admit(spark.createDataFrame(rows, CAND), 20).collect()} == set(folded(rows))
    shadows = candidates(random.Random(9), 120, 300, 25)
    df = spark.createDataFrame(shadows, CAND).withColumn("shadow", F.lit(True)).unionByName(spark.createDataFrame([(f"r{r[0]}", *r[1:]) for r in shadows], CAND).withColumn("shadow", F.lit(False)))
    got = {r.plan_id: (r.t_end, r.flipped) for r in walk.admit(df, 40).collect()}
    assert got == folded(shadows, shadow=True) | {f"r{p}": x for p, x in folded(shadows).items()}
    assert walk.admit(spark.createDataFrame([], CAND)).count() == 0


def series(spark, n, syms=("A",), step=DAY, seed=3):
    rng, rows = random.Random(seed), []
    for s in syms:
        c, t = 100.0, 0
        for _ in range(n):
            o, c = c, c * math.exp(rng.gauss(0, 0.02))
            t += step * rng.choice((1, 1, 1, 2, 40))
            rows.append((s, t, o, max(o, c) * 1.004, min(o, c) * 0.997, c, float(rng.randrange(1, 50))))
    return spark.createDataFrame(rows, "sym string, t long, o double, h double, l double, c double, v double")


FEATURES = {
    "index": lambda b: ft.with_index(b).select("sym", "t", "i"),
    "features": lambda b: walk.features_for(b, 1).select("sym", "t", "i", "vol", "ret20d", "ret60d", "donch20d", "donch55d"),
    "lab": lambda b: ft.lab_features(b).select("sym", "t", "vol", "y", "z24", "z120", "hacimz"),
    "rank": lambda b: ft.with_funding_pct(b.withColumn("r", F.ln("c")), 3, 40).select("sym", "t", "avg_n", "pct"),
    "position": lambda b: ft.with_position_pct(b.withColumn("r", F.ln("c")), 3, 20).select("sym", "t", "pos_pct"),
    "target": lambda b: ft.with_forward_abs(b, 6).select("sym", "t", "fwd_abs", "peak"),
}


def ordered(rows):
    return [tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r) for r in rows]


@pytest.mark.parametrize("name", FEATURES)
def test_blocks_change_nothing(spark, monkeypatch, name):
    """Small blocks give what one block of all gives (the recurrence needs blocks that two of which outlast its memory)."""
    long = name in ("features", "lab")
    bars = series(spark, 1000, "AB") if long else series(spark, 400, "AB")
    get = lambda: sorted(ordered(tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r) for r in FEATURES[name](bars).collect()))
    want = get()
    monkeypatch.setattr(ft, "BLOCK", 330 if long else 16)
    assert get() == want and len(want) > 300


def test_a_busy_symbol_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ft, "BLOCK", 16)
    sizes = ft.framed(series(spark, 400), 4).groupBy("_blk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_own").cast("int")).alias("own")).collect()
    assert len(sizes) >= 400 // 16 and max(r.n for r in sizes) <= 20 and sum(r.own or 0 for r in sizes) == 400


@pytest.mark.parametrize("name", ["index", "features", "lab", "rank", "position"])
def test_a_prefix_of_bars_gives_the_same_features(spark, monkeypatch, name):
    monkeypatch.setattr(ft, "BLOCK", 330 if name in ("features", "lab") else 16)
    bars = series(spark, 700 if name in ("features", "lab") else 300)
    cut = sorted(r.t for r in bars.collect())[-89]
    whole = sorted(ordered(tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r) for r in FEATURES[name](bars).where(F.col("t") <= cut).collect()))
    assert whole == sorted(ordered(tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r) for r in FEATURES[name](bars.where(F.col("t") <= cut)).collect()))


def test_symbols_at_anchors(spark):
    """The last bar at or before each anchor, in gaps and after a symbol's end too."""
    bars = series(spark, 60, "ABC", step=1000)
    known = {}
    for r in bars.collect():
        known.setdefault(r.sym, []).append(r.t)
    at = sorted({t for ts in known.values() for t in ts[::3]} | {1, 777, 10**6})
    got = {(r.anchor, r.sym): r.found_t for r in walk.symbols_at(spark.createDataFrame([(t,) for t in at], "anchor long"), bars, ["c"], day_ms=5000).collect()}
    want = {(a, s): max(t for t in ts if t <= a) for a in at for s, ts in known.items() if sum(t <= a for t in ts) >= 2}
    assert got == want


def rule(column):
    return lambda bars: ft.with_returns(bars, {"m": 5}).select("sym", "t", column.alias("side"), F.lit(3).alias("hz"), F.lit(2.0).alias("rm"))


def test_a_strategy_of_the_user(spark):
    own = plugins.Registry()
    own.register("up")(rule(F.when(F.col("m") > 0, 1).when(F.col("m") < 0, -1).otherwise(0)))
    out = own.candidates(series(spark, 200, "AB"), DAY)
    rows = out.collect()
    assert len(rows) > 200 and {r.side for r in rows} == {1, -1} and all(r.t_end == r.t0 + 3 * DAY and r.strat == "up" for r in rows)
    assert walk.admit(out).count() < len(rows)
    with pytest.raises(ValueError, match="already"):
        own.register("up")(rule(F.lit(1)))


def next_bar(bars):
    return ft.unframed(ft.framed(bars, 0, 1).withColumn("n", F.lead("c").over(ft.by_block()))).select("sym", "t", F.when(F.col("n") > F.col("c"), 1).otherwise(-1).alias("side"), F.lit(3).alias("hz"), F.lit(2.0).alias("rm"))


def of_whole(bars):
    """Buys below the mean of all bars: nothing of a single later bar, but of all of them."""
    mean = bars.groupBy("sym").agg(F.avg("c").alias("m"))
    return bars.join(mean, "sym").where("c < m").select("sym", "t", F.lit(1).alias("side"), F.lit(3).alias("hz"), F.lit(2.0).alias("rm"))


@pytest.mark.parametrize("generator", [next_bar, of_whole])
def test_a_strategy_that_looks_ahead_is_refused(spark, generator):
    with pytest.raises(plugins.LooksAhead, match="looks ahead"):
        plugins.guarded(generator, series(spark, 120, "AB"))


def test_a_strategy_without_a_side_is_refused(spark):
    with pytest.raises(ValueError, match="side"):
        plugins.guarded(lambda bars: bars, series(spark, 10))
