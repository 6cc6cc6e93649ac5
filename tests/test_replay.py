"""Replay, metrics and admission on hand-made bars."""

import math

import pytest

from barproof.operators import metrics as mt
from barproof.operators import plans as pl
from barproof.operators import replay as rp
from barproof.operators import walk

PLAN = "plan_id string, strat string, sym string, side int, entry double, sl double, tp1 double, tp2 double, rm double, d_stop double, t0 long, t_end long"
COST = 0.022


def plan(name, **kw):
    p = dict(plan_id=name, strat="s", sym=name, side=1, entry=100.0, sl=90.0, tp1=None, tp2=110.0, rm=1.0, d_stop=0.1, t0=0, t_end=10_000) | kw
    return tuple(p.values())


def bar(sym, t, h, l, c):
    return (sym, t, 100.0, float(h), float(l), float(c), 1.0)


CASES = {
    # name: (plan overrides, bars, state, r before costs, n)
    "target": ({}, [(1000, 111, 99, 105)], "tp2", 1.0, 1),
    "stopped": ({}, [(1000, 101, 89, 95)], "stop", -1.0, 1),
    "stop_first": ({}, [(1000, 111, 89, 100)], "stop", -1.0, 1),
    "breakeven": ({"tp1": 105.0}, [(1000, 106, 101, 104), (2000, 104, 99, 101)], "be", 0.5, 2),
    "half_then_target": ({"tp1": 105.0, "rm": 2.0, "tp2": 120.0}, [(1000, 106, 101, 104), (2000, 121, 101, 120)], "tp2", 1.5, 2),
    "both_in_one_bar": ({"tp1": 105.0, "rm": 2.0, "tp2": 120.0}, [(1000, 121, 99, 120)], "tp2", 1.5, 1),
    "expired": ({}, [(5000, 104, 99, 102), (10_000, 104, 99, 103)], "expired", math.log(1.03) / 0.1, 2),
    "open": ({}, [(5000, 104, 99, 102)], "open", math.log(1.02) / 0.1, 1),
    "waiting": ({}, [(20_000, 104, 99, 102)], "wait", 0.0, 0),
    "short": ({"side": -1, "sl": 110.0, "tp2": 90.0}, [(1000, 101, 89, 95)], "tp2", 1.0, 1),
    "entry_bar_ignored": ({"t0": 1000}, [(1000, 120, 80, 100), (2000, 111, 99, 100)], "tp2", 1.0, 1),
}


@pytest.fixture(scope="module")
def outcomes(spark):
    plans = spark.createDataFrame([plan(k, **v[0]) for k, v in CASES.items()] + [plan("nobars")], PLAN)
    bars = spark.createDataFrame([bar(k, *b) for k, v in CASES.items() for b in v[1]], "sym string, t long, o double, h double, l double, c double, v double")
    return {r.plan_id: r for r in rp.run(plans, bars, bucket_ms=3000).collect()}


@pytest.mark.parametrize("name", CASES)
def test_outcome(outcomes, name):
    _, _, state, r, n = CASES[name]
    got = outcomes[name]
    assert (got.state, got.n) == (state, n)
    assert got.r == pytest.approx(r - COST)


def test_symbol_without_bars(outcomes):
    assert (outcomes["nobars"].state, outcomes["nobars"].r) == ("no-data", 0.0)


def test_metrics_and_drawdown(spark):
    rows = [("s", "a", 1, "tp2", 1.73, 1), ("s", "b", 2, "stop", -1.022, 2), ("s", "c", 3, "open", 9.0, 3)]
    df = spark.createDataFrame(rows, "strat string, sym string, t0 long, state string, r double, n long")
    m = mt.metrics(df).first()
    assert (m.n, m.wins, m.losses, m.skipped) == (2, 1, 1, 1)
    assert m.profit_factor == pytest.approx(1.73 / 1.022, abs=1e-6)
    assert mt.drawdown(df).first().max_drawdown == pytest.approx(1.022)


def test_admission_keeps_skips_and_flips(spark):
    rows = [("s", "x", "a", 1, 6000, 16000), ("s", "x", "b", 1, 11000, 21000), ("s", "x", "c", 1, 16000, 26000), ("s", "y", "d", 1, 6000, 16000), ("s", "y", "e", -1, 11000, 21000)]
    df = spark.createDataFrame(rows, "strat string, sym string, plan_id string, side int, t0 long, t_end long")
    got = {r.plan_id: (r.t_end, r.flipped) for r in walk.admit(df).collect()}
    assert got == {"a": (16000, False), "c": (26000, False), "d": (11000, True), "e": (21000, False)}


def test_mirror_twice_is_the_plan(spark):
    p = spark.createDataFrame([plan("p", sl=100 * math.exp(-0.1), tp1=100 * math.exp(0.1), tp2=100 * math.exp(0.2), rm=2.0)], PLAN)
    a, b = p.first(), pl.mirror(pl.mirror(p)).first()
    assert [b[c] for c in ("sl", "tp1", "tp2", "side")] == pytest.approx([a[c] for c in ("sl", "tp1", "tp2", "side")])
