"""Strategies of the user: any function from bars to plans, behind a guard against looking ahead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barproof.operators import features as ft
from barproof.operators import plans as pl
from barproof.sources import readers as rd

#: Bars (sym, t, o, h, l, c, v and whatever else the caller's have) -> sym, t, side (1, -1; other rows are no plan), hz (bars) and rm; more columns may follow.
Generator = Callable[[DataFrame], DataFrame]
NEEDED = ("sym", "t", "side", "hz", "rm")


class LooksAhead(ValueError):
    """A strategy's plans change when bars after them are taken away."""


class Registry:
    """Named strategies, each tried by the guard before its plans are given out."""

    def __init__(self):
        self._found: dict[str, Generator] = {}

    def register(self, name: str) -> Callable[[Generator], Generator]:
        def put(f: Generator) -> Generator:
            if name in self._found:
                raise ValueError(f"there is a strategy {name} already")
            self._found[name] = f
            return f

        return put

    def names(self) -> list[str]:
        return sorted(self._found)

    def candidates(self, bars: DataFrame, tf_ms: int, names: list[str] | None = None, cuts: int = 3) -> DataFrame:
        """Plans of the strategies on bars with ``vol``, with levels, as ``walk.candidates`` gives them."""
        bars = rd.stored(bars if "vol" in bars.columns else ft.with_ewma_vol(bars), "bars")
        out = None
        for name in names or self.names():
            own = guarded(self._found[name], bars, name, cuts).withColumn("strat", F.lit(name))
            out = own if out is None else out.unionByName(own)
        p = out.where(F.col("side").isin(1, -1)).join(bars.select("sym", "t", F.col("c").alias("entry"), "vol"), ["sym", "t"]).where("vol > 0")
        p = p.select("strat", F.col("hz").cast("int").alias("hz"), F.col("rm").cast("double").alias("rm"), F.col("side").cast("int").alias("side"), "sym", "entry", "vol", F.col("t").alias("t0"))
        return pl.levels(p.withColumn("tf_ms", F.lit(tf_ms).cast("long")).withColumn("plan_id", F.concat_ws("|", "strat", "sym", F.col("t0").cast("string"))))


def _comparable(rows: DataFrame, names: list[str]) -> list[Column]:
    kinds = dict(rows.dtypes)
    return [F.round(c, 9).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in names]


def guarded(generator: Generator, bars: DataFrame, name: str = "strategy", cuts: int = 3) -> DataFrame:
    """The generator's plans on all bars (NEEDED columns), if it decides the same without the bars after them.

    It runs again on the bars up to each of some times, half of them in the bars' middle
    between two: its plans up to then must be those it gave on all bars, no more and no
    less, compared by anti-joins; else ``LooksAhead``.  This costs a run on part of the
    bars for each cut, once for a set of bars.
    """
    whole = generator(bars)
    if lacking := [c for c in NEEDED if c not in whole.columns]:
        raise ValueError(f"{name} gives no {', '.join(lacking)}")
    whole = rd.stored(whole.select(*NEEDED), "plans")
    shares = [(k + 1) / (cuts + 1) for k in range(cuts)]
    for cut in bars.agg(F.percentile_approx("t", shares, 10_000).alias("p")).first()["p"] or []:
        before = rd.stored(generator(bars.where(F.col("t") <= cut)).select(*NEEDED), "plans")
        known = whole.where(F.col("t") <= cut)
        columns = _comparable(whole, list(NEEDED))
        for a, b, what in ((known, before, "without the bars after them, plans vanish"), (before, known, "without the bars after them, plans appear")):
            odd = a.select(columns).join(b.select(_comparable(b, list(NEEDED))).distinct(), list(NEEDED), "left_anti").orderBy("t", "sym").first()
            if odd is not None:
                raise LooksAhead(f"{name} looks ahead of {cut}: {what}, for example {odd.asDict()}")
    return whole


#: What ``register`` of this module puts strategies into.
STRATEGIES = Registry()
register = STRATEGIES.register
