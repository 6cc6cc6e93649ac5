"""Trade plans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-way cost, a share of the price.
COST = 2 * 11 / 1e4
CLOSED = ("stop", "be", "tp2", "expired")


def levels(df: DataFrame, d_stop: Column | None = None) -> DataFrame:
    """Adds d_stop, sl, tp1, tp2, t_end from side, entry, vol, hz, rm, t0 and tf_ms."""
    d = F.greatest(F.lit(1e-4), F.col("vol") * F.sqrt(F.col("hz"))) if d_stop is None else d_stop
    out = df.withColumn("d_stop", d)
    s, e, d = F.col("side"), F.col("entry"), F.col("d_stop")
    return out.withColumns({"sl": e * F.exp(-s * d), "tp1": F.when(F.col("rm") > 1, e * F.exp(s * d)), "tp2": e * F.exp(s * F.col("rm") * d), "t_end": F.col("t0") + F.col("hz") * F.col("tf_ms")})


def plan_levels(df: DataFrame, per_day: int) -> DataFrame:
    """A model plan's levels with stop in per cent, typical and longest days, and size at 1 % risk."""
    s, e, d = F.col("side"), F.col("entry"), F.col("d_stop")
    loss = 1 - F.exp(-d)
    return df.withColumns({
        "sl": e * F.exp(-s * d), "tp1": F.when(F.col("rm") > 1, e * F.exp(s * d)), "tp2": e * F.exp(s * d * F.col("rm")),
        "stop_pct": loss * 100, "d_med": F.col("t_med") / per_day, "d_max": F.col("hz") / per_day, "pos_pct": 0.01 / loss * 100,
    })


def mirror(df: DataFrame, own_tp1: bool = False) -> DataFrame:
    """The plan on the other side of its entry; with ``own_tp1`` a stated first target keeps its distance."""
    s, e, d = F.col("side"), F.col("entry"), F.col("d_stop")
    if own_tp1:
        tp1 = F.when(F.col("tp1").isNotNull() & (F.col("tp1") != 0), e * F.exp(-s * F.abs(F.ln(F.col("tp1") / e))))
    else:
        tp1 = F.when(F.col("rm") > 1, e * F.exp(-s * d))
    return df.withColumns({"sl": e * F.exp(s * d), "tp1": tp1, "tp2": e * F.exp(-s * F.col("rm") * d), "side": -s})


def net_r(r: Column, f8: float | None = None, cost: float = COST) -> Column:
    """R after costs and, for a constant funding rate per eight hours, after funding for the hours held."""
    out = r - cost / F.col("d_stop")
    if f8 is not None:
        held = F.greatest(F.lit(0), F.col("at") - F.col("t0")) / 3.6e6
        out = out - F.when(F.col("at").isNotNull(), F.col("side") * f8 * (held / 8) / F.col("d_stop")).otherwise(0.0)
    return out


def closed(df: DataFrame) -> DataFrame:
    return df.where(F.col("state").isin(*CLOSED))


def gate(ev: Column, se: Column, fam_hi: Column) -> dict[str, Column]:
    chance = F.coalesce(ev > fam_hi, F.lit(False))
    error = F.coalesce(ev > 2 * se, F.lit(False))
    return {"ok_chance": chance, "ok_error": error, "gate": F.when(chance & error, "hit").when(chance, "near_miss").otherwise("fail")}


def decision(n: Column, t: Column, h1: Column, h2: Column, p: Column) -> Column:
    return F.when((n >= 30) & (t >= 2.5) & (h1 > 0) & (h2 > 0) & (p <= 0.02), "pass").otherwise("fail")


def verdict(n: Column, t: Column, p: Column) -> Column:
    return F.when(n < 30, "insufficient").when((p <= 0.02) & (t >= 2.5), "beats_chance").otherwise("not_beating")


def badge(n: Column, t: Column, p: Column, idle_days: Column, deleted: Column) -> Column:
    ok = (verdict(n, t, p) == "beats_chance") & (idle_days <= 90) & (deleted <= 0.05)
    return F.when(ok, "badge").otherwise("none")
