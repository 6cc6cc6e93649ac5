"""Variance, seasons, quantiles, tails and neighbours of the distribution model: windows, grouped sums and joins."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barproof.operators import features as ft
from barproof.operators import ranks
from barproof.sources import readers as rd


def _base_vol(b: DataFrame, per_day: int, days: int, season: str | None) -> DataFrame:
    sea = F.coalesce(F.greatest(F.col(season), F.lit(1e-6)), F.lit(1.0)) if season else F.lit(1.0)
    b = b.withColumn("_d", F.when(F.col("i") >= 1, F.pow(ft.log_return(), 2) / sea))
    b = b.withColumn("base", F.avg("_d").over(ft.by_block().rowsBetween(-days * per_day, -1)))
    return b.withColumn("sig", F.sqrt(F.col("base") * (F.coalesce(F.col(season), F.lit(1.0)) if season else F.lit(1.0)))).drop("_d")


def with_base_vol(bars: DataFrame, per_day: int, days: int = 30, season: str | None = None) -> DataFrame:
    """Deseasonalised variance of the ``days`` before (row 0 and the current bar excluded) and sigma; ``season`` names the column of ``with_season``."""
    return ft.unframed(_base_vol(ft.framed(bars, days * per_day + 1), per_day, days, season))


def with_horizon_z(bars: DataFrame, per_day: int, hz: int, days: int = 30) -> DataFrame:
    """Variance over the next ``hz`` bars by the base, normalised future return, and size of the five-day trend."""
    n, w = 5 * per_day, ft.by_block()
    b = _base_vol(ft.framed(bars, days * per_day + n + 2, hz), per_day, days, None)
    future = F.ln(F.lead("c", hz - 1).over(w) / F.lag("c").over(w))
    b = b.withColumn("vh", F.when(F.lead("c", hz - 1).over(w).isNotNull(), F.col("base") * hz)).withColumn("z", F.when(F.col("vh") > 0, future / F.sqrt("vh")))
    past = F.ln(F.lag("c").over(w) / F.lag("c", n + 1).over(w))
    s2 = F.sum(F.pow("sig", 2)).over(w.rowsBetween(-n, -1))
    return ft.unframed(b.withColumn("mg", F.when(s2 > 0, F.abs(past / F.sqrt(s2)))))


def blend_weights(bars: DataFrame, per_day: int, hz: int, short: int = 30, long: int = 365, least: int = 40, refit_days: int = 60) -> DataFrame:
    """(sym, refit, w, n): the weight in {0, .05, .., 1} of the short variance that explained the variance to come best so far.

    At each refit date (bar number ``refit``, every ``refit_days``) only points whose future
    was over by then count: a point k has hz bars from k on, so k + hz <= refit.  Squared log
    errors of all 21 weights are summed by the first refit date that may see them, and the
    sums run along the refit dates; 1 with fewer than ``least`` points.
    """
    w, warm, step = ft.by_block(), 180 * per_day, refit_days * per_day
    b = ft.framed(bars, long * per_day + 1, hz).withColumn("_r2", F.when(F.col("i") >= 1, F.pow(ft.log_return(), 2)))
    b = b.withColumns({
        "_s": F.avg("_r2").over(w.rowsBetween(-short * per_day, -1)), "_l": F.avg("_r2").over(w.rowsBetween(-long * per_day, -1)),
        "_f": F.when(F.lead("c", hz - 1).over(w).isNotNull(), F.avg("_r2").over(w.rowsBetween(0, hz - 1))),
    })
    b = ft.unframed(b)
    p = b.where((F.col("i") >= warm) & ((F.col("i") - warm) % max(1, hz // 2) == 0) & (F.col("_s") > 0) & (F.col("_l") > 0) & (F.col("_f") > 0))
    seen = F.greatest(F.lit(0), F.ceil((F.col("i") + hz - warm) / step)).cast("long")
    p = p.select("sym", seen.alias("q"), F.ln("_s").alias("s"), F.ln("_l").alias("l"), F.ln("_f").alias("f")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20))))
    weight = F.col("k") * 0.05
    err = F.pow(F.col("f") - (weight * F.col("s") + (1 - weight) * F.col("l")), 2)
    sums = p.groupBy("sym", "q", "k").agg(F.sum(err).alias("e"), F.count(F.lit(1)).alias("n"))
    # every refit date of a symbol, whether points came due at it or not
    dates = bars.groupBy("sym").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > warm)
    dates = dates.select("sym", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1 - warm) / step))).alias("q")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20))))
    so_far = Window.partitionBy("sym", "k").orderBy("q").rangeBetween(Window.unboundedPreceding, 0)  # a row a refit date
    g = dates.join(sums, ["sym", "q", "k"], "left").withColumns({"e": F.coalesce(F.sum("e").over(so_far), F.lit(0.0)), "n": F.coalesce(F.sum("n").over(so_far), F.lit(0))})
    best = g.groupBy("sym", "q").agg(F.min_by("k", F.struct(F.round("e", 9), "k")).alias("k"), F.max("n").alias("n"))
    return best.select("sym", (F.col("q") * step + warm).alias("refit"), F.round(F.when(F.col("n") < least, 1.0).otherwise(F.col("k") * 0.05), 2).alias("w"), "n")


def warm_up(n: Column, per_day: int, share: float | Decimal = 0.35) -> Column:
    """Bars before the first fit: 35 % of a symbol's, 180 days at most.

    A float is multiplied in binary, where 720 * 0.35 is just below 252, as the original has it; a Decimal, like SQL's literal, exactly.
    """
    return F.least(F.floor(n * F.lit(share)), F.lit(180 * per_day)).cast("long")


#: Terms of the seasonal regression: 1, four waves of the day, three of the week.
DAILY, WEEKLY = 4, 3
TERMS = 1 + 2 * DAILY + 2 * WEEKLY


def season_basis(how: Column) -> Column:
    """The terms at an hour of the week."""
    waves = [(k, 24) for k in range(1, DAILY + 1)] + [(k, 168) for k in range(1, WEEKLY + 1)]
    angle = lambda k, period: F.lit(2 * math.pi * k) * how / period
    return F.array(F.lit(1.0), *[f(angle(k, p)) for k, p in waves for f in (F.cos, F.sin)])


def solved(m: Column, size: int) -> Column:
    """The solution of ``size`` normal equations, as rows of coefficients and right side, by elimination; a term that the ones before it determine gets 0."""
    least = F.lit(1e-9) * m[0][0]

    def cleared(rows: Column, k: Column) -> Column:
        pivot = F.element_at(rows, k + 1)
        d = F.element_at(pivot, k + 1)
        take = lambda row: F.zip_with(row, pivot, lambda x, y: x - y * (F.element_at(row, k + 1) / d))
        return F.when(F.abs(d) < least, rows).otherwise(F.transform(rows, lambda row, r: F.when(r == k, row).otherwise(take(row))))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), m, cleared)
    return F.transform(done, lambda row, r: F.when(F.abs(F.element_at(row, r + 1)) < least, 0.0).otherwise(F.element_at(row, size + 1) / F.element_at(row, r + 1)))


def season_fits(bars: DataFrame, per_day: int, refit_days: int = 30, share: float | Decimal = 0.35) -> DataFrame:
    """(sym, q, coef, mu) of each refit: the seasonal regression of ln(r^2 + 1e-12) on all bars before bar number warm-up + q * refit.

    Bars become sums by hour of the week and the first refit that may see them, these the
    cells of the normal equations, and the cells run along the refits.
    """
    step = refit_days * per_day
    sizes = bars.groupBy("sym").agg(F.count(F.lit(1)).alias("_n")).withColumn("_warm", warm_up(F.col("_n"), per_day, share))
    b = ft.unframed(ft.framed(bars, 1).withColumn("_y", F.ln(F.pow(ft.log_return(), 2) + 1e-12))).where("i >= 1").join(sizes, "sym")
    q = F.when(F.col("i") < F.col("_warm"), 0).otherwise(F.floor((F.col("i") - F.col("_warm")) / step) + 1).cast("long")
    sums = b.groupBy("sym", q.alias("q"), ft.ny_hour_of_week(F.col("t")).alias("how")).agg(F.count(F.lit(1)).alias("m"), F.sum("_y").alias("y"))
    cells = sums.withColumn("x", season_basis(F.col("how"))).select("sym", "q", "x", "m", "y", F.posexplode("x").alias("a", "xa"))
    cells = cells.select("sym", "q", "a", F.posexplode(F.concat(F.transform("x", lambda x: x * F.col("m")), F.array("y"))).alias("b", "v"), "xa").groupBy("sym", "q", "a", "b").agg(F.sum(F.col("v") * F.col("xa")).alias("v"))
    dates = sizes.where("_n > _warm").select("sym", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1 - F.col("_warm")) / step))).alias("q"))
    grid = dates.select("*", F.explode(F.sequence(F.lit(0), F.lit(TERMS - 1))).alias("a")).select("*", F.explode(F.sequence(F.lit(0), F.lit(TERMS))).alias("b"))
    so_far = Window.partitionBy("sym", "a", "b").orderBy("q").rangeBetween(Window.unboundedPreceding, 0)  # a row a refit
    run = grid.join(cells, ["sym", "q", "a", "b"], "left").withColumn("v", F.coalesce(F.sum("v").over(so_far), F.lit(0.0)))
    rows = run.groupBy("sym", "q", "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda x: x["v"]).alias("row"))
    m = rows.groupBy("sym", "q").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "row"))), lambda x: x["row"]).alias("m")).where(F.col("m")[0][0] > 0)
    fits = m.withColumn("coef", solved(F.col("m"), TERMS))
    dot = F.aggregate(F.zip_with("coef", F.slice(F.col("m")[0], 1, TERMS), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return fits.select("sym", "q", "coef", (dot / F.col("m")[0][0]).alias("mu"))


def with_season(bars: DataFrame, per_day: int, refit_days: int = 30, name: str = "season", share: float | Decimal = 0.35) -> DataFrame:
    """Adds the causal seasonal variance factor: exp(fit - its mean), null during the warm-up (``share`` of the bars, see ``warm_up``)."""
    step = refit_days * per_day
    sizes = bars.groupBy("sym").agg(F.count(F.lit(1)).alias("_n")).withColumn("_warm", warm_up(F.col("_n"), per_day, share)).drop("_n")
    fits = rd.stored(season_fits(bars, per_day, refit_days, share), "season")
    b = ft.with_index(bars).join(sizes, "sym").withColumn("q", F.floor((F.col("i") - F.col("_warm")) / step))
    b = b.join(fits, ["sym", "q"], "left")
    fit = F.aggregate(F.zip_with("coef", season_basis(ft.ny_hour_of_week(F.col("t"))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return b.withColumn(name, F.exp(fit - F.col("mu"))).drop("_warm", "q", "coef", "mu")


def quantile_fits(points: DataFrame, keys: list[str], taus: list[float], most: int = 140, tolerance: float = 1e-6, together: int = 8) -> DataFrame:
    """Lines y = a + b x at each quantile: keys, tau, a, b, rounds, settled; ``points`` has keys, x and y.

    Reweighted least squares from the empirical quantile: a round is a join with the fits
    and a grouped sum, for all keys and quantiles at once.  ``together`` rounds are one
    job; then fits that moved less than ``tolerance`` leave, until none is left or
    ``most`` rounds are done.
    """
    points = rd.stored(points.where("x IS NOT NULL AND y IS NOT NULL").select(*keys, "x", "y"), "points")
    tau = F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau")
    start = ranks.ranked(points, keys, ["y"]).select(*keys, "y", "rank", "n", tau).where(F.col("rank") == F.floor(F.col("tau") * (F.col("n") - 1) + 0.5))
    fits = rd.stored(start.select(*keys, "tau", F.col("y").alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("rounds"), F.lit(False).alias("settled")), "fits")
    done, rounds = [], 0
    while rounds < most and not fits.isEmpty():
        now = fits
        for _ in range(min(together, most - rounds)):
            rounds += 1
            p = points.join(now, keys)
            r = F.col("y") - (F.col("a") + F.col("b") * F.col("x"))
            w = F.when(r > 0, F.col("tau")).otherwise(1 - F.col("tau")) / F.greatest(F.abs(r), F.lit(1e-3))
            sums = {"s0": w, "s1": w * F.col("x"), "s2": w * F.col("x") * F.col("x"), "t0": w * F.col("y"), "t1": w * F.col("x") * F.col("y")}
            g = p.groupBy(*keys, "tau").agg(*[F.first(c).alias(c) for c in ("a", "b", "rounds", "settled")], *[F.sum(e).alias(n) for n, e in sums.items()])
            det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
            fixed = F.col("settled") | (F.abs(det) < 1e-14)
            g = g.withColumns({"na": F.when(fixed, F.col("a")).otherwise((F.col("t0") * F.col("s2") - F.col("t1") * F.col("s1")) / det), "nb": F.when(fixed, F.col("b")).otherwise((F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / det)})
            moved = F.abs(F.col("na") - F.col("a")) + F.abs(F.col("nb") - F.col("b"))
            now = g.select(*keys, "tau", F.col("na").alias("a"), F.col("nb").alias("b"), F.when(F.col("settled"), F.col("rounds")).otherwise(F.lit(rounds)).alias("rounds"), (fixed | (moved < tolerance)).alias("settled"))
        now = rd.stored(now, "fits")
        done.append(now.where("settled") if rounds < most else now)
        fits = now.where("NOT settled")
    out = done[0] if done else fits
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def tail_fits(points: DataFrame, keys: list[str], share: float = 0.15, least: int = 25) -> DataFrame:
    """Generalised Pareto fits of both tails: keys, side (hi, lo), u, n, k and s (null with fewer than ``least`` exceedances); ``points`` has keys and z.

    By probability-weighted moments: the exceedances' ranks follow from the ranks of z.
    """
    r = rd.stored(ranks.ranked(points.where("z IS NOT NULL").select(*keys, "z"), keys, ["z"]), "ranks")
    at = lambda p, name: F.max(F.when(F.col("rank") == ranks.at_share(p), F.col("z"))).alias(name)
    u = r.groupBy(*keys).agg(at(1 - share, "u_hi"), at(share, "u_lo"))
    e = r.join(u, keys)
    e = e.withColumn("side", F.when(F.col("z") > F.col("u_hi"), "hi").when(F.col("z") < F.col("u_lo"), "lo")).where("side IS NOT NULL")
    hi = F.col("side") == "hi"
    e = e.select(*keys, "side", F.when(hi, F.col("u_hi")).otherwise(F.col("u_lo")).alias("u"), F.when(hi, F.col("z") - F.col("u_hi")).otherwise(F.col("u_lo") - F.col("z")).alias("y"), F.when(hi, F.col("n") - 1 - F.col("rank")).otherwise(F.col("rank")).alias("above"))  # how many exceed by more
    g = e.groupBy(*keys, "side", "u").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("a0"), F.sum(F.col("y") * F.col("above")).alias("_w"))
    g = g.withColumn("a1", F.col("_w") / (F.col("n") - 1) / F.col("n")).withColumn("_d", F.col("a0") - 2 * F.col("a1"))
    s = F.try_divide(2 * F.col("a0") * F.col("a1"), F.col("_d"))
    ok = (F.col("n") >= least) & (F.abs("_d") >= 1e-12) & (s > 0)
    return g.select(*keys, "side", "u", "n", F.when(ok, F.try_divide(F.col("a0"), F.col("_d")) - 2).alias("k"), F.when(ok, s).alias("s"))


def tail_quantile(k: Column, s: Column, p: Column) -> Column:
    """The exceedance that a share ``p`` of exceedances is beyond."""
    return F.when(F.abs(k) < 1e-6, -s * F.ln(p)).otherwise(s / k * (1 - F.pow(p, k)))


STATE = ("m5", "m20", "vol")


def states(bars: DataFrame, per_day: int, days: int = 30) -> DataFrame:
    """Standardised state of each bar after the warm-up: momentum over 5 and 20 days in units of volatility, and volatility against its median (sym, t, j, z_m5, z_m20, z_vol); j numbers the bars with a volatility."""
    w = ft.by_block()
    sizes = bars.groupBy("sym").agg(F.count(F.lit(1)).alias("_n")).select("sym", warm_up(F.col("_n"), per_day).alias("_warm"))
    b = _base_vol(ft.framed(bars, (days + 20) * per_day + 2), per_day, days, None)
    # volatility begins after the warm-up, and so do the sums of it
    b = b.join(sizes, "sym").withColumn("_sig", F.when((F.col("i") >= F.col("_warm")) & (F.col("sig") > 0), F.col("sig"))).withColumn("_r", F.coalesce(ft.log_return(), F.lit(0.0)))
    for d in (5, 20):
        frame = w.rowsBetween(-(d * per_day - 1), 0)
        v = F.sum(F.pow("_sig", 2)).over(frame)
        b = b.withColumn(f"m{d}", F.when((F.col("i") >= d * per_day) & (v > 0), F.sum("_r").over(frame) / F.sqrt(v)))
    b = ft.unframed(b).where("_sig IS NOT NULL").select("sym", "t", "_sig", "m5", "m20")
    b = rd.stored(ft.with_index(b).withColumnRenamed("i", "j"), "states")
    middle = ranks.ranked(b.select("sym", "_sig"), ["sym"], ["_sig"]).where(F.col("rank") == F.floor(F.col("n") / 2)).select("sym", F.col("_sig").alias("_med"))
    b = b.join(middle, "sym").withColumn("vol", F.ln(F.col("_sig") / F.col("_med"))).drop("_sig", "_med")
    whole = F.col("m5").isNotNull() & F.col("m20").isNotNull()
    of = b.where(whole).groupBy("sym").agg(*[F.avg(c).alias(f"_a_{c}") for c in STATE], *[F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}") for c in STATE])
    return b.join(of, "sym").select("sym", "t", "j", *[F.when(whole, (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_s_{c}")).alias(f"z_{c}") for c in STATE])


def neighbours(bars: DataFrame, per_day: int, hz: int, share: float = 0.15, least: int = 200, days: int = 30) -> DataFrame:
    """(sym, t, dist): the windows of ``hz`` bars whose starting state is nearest to the symbol's last one, the larger of ``least`` and a ``share`` of all; ties by time.

    Without a state now, every window that has one counts (dist null).
    """
    s = rd.stored(states(bars, per_day, days), "states")
    z = [f"z_{c}" for c in STATE]
    last = s.groupBy("sym").agg(F.max("j").alias("_last"), *[F.max_by(c, "j").alias(f"_{c}") for c in z])
    c = s.join(last, "sym").where((F.col("j") + hz <= F.col("_last")) & F.col("z_m5").isNotNull())
    dist = sum(((F.col(x) - F.col(f"_{x}")) * (F.col(x) - F.col(f"_{x}")) for x in z[1:]), (F.col(z[0]) - F.col(f"_{z[0]}")) * (F.col(z[0]) - F.col(f"_{z[0]}")))
    c = rd.stored(c.select("sym", "t", F.round(dist, 9).alias("dist")), "near")
    many = c.groupBy("sym").agg(F.count(F.lit(1)).alias("_m")).select("sym", F.least("_m", F.greatest(F.lit(least), F.floor(F.col("_m") * share))).alias("_k"))
    chosen = ranks.least_k(c.where("dist IS NOT NULL").join(many, "sym"), ["sym"], "dist", "t", "_k").drop("_k")
    return chosen.unionByName(c.where("dist IS NULL"))
