"""Results of runs: metrics, equity, chance control, decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from barproof.operators import plans as pl


def metrics(runs: DataFrame, by: str = "strat") -> DataFrame:
    """One row per strategy over closed runs (columns r, n bars, state)."""
    done = F.col("state").isin(*pl.CLOSED)
    r = F.when(done, F.col("r"))
    win, loss = F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))
    count = lambda c: F.count(F.when(c, 1))
    n = count(done)
    share = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    w, x = F.coalesce(win, F.lit(0.0)), F.coalesce(loss, F.lit(0.0))
    return runs.groupBy(by).agg(
        n.alias("n"), F.round(F.coalesce(F.sum(r), F.lit(0.0)), 6).alias("total_r"), F.round(F.coalesce(F.avg(r), F.lit(0.0)), 6).alias("avg_r"),
        F.round(F.coalesce(F.percentile(r, 0.5), F.lit(0.0)), 6).alias("median_r"), count(r > 0).alias("wins"), count(r < 0).alias("losses"), F.round(share(count(r > 0)), 6).alias("win_rate"),
        F.round(F.when(x > 0, w / x).when(w > 0, F.lit(float("inf"))).otherwise(0.0), 6).alias("profit_factor"), F.round(share(F.sum(F.when(done, F.col("n")))), 6).alias("avg_hold_bars"),
        *[count(F.col("state") == s).alias(f"n_{s}") for s in pl.CLOSED], count(~done).alias("skipped"))


#: Length of the blocks of plans by start, in milliseconds.
BLOCK = 512 * 86_400_000


def drawdown(runs: DataFrame, by: str = "strat", order: tuple[str, ...] = ("t0", "sym"), block_ms: int = BLOCK) -> DataFrame:
    """Largest fall of the running total below its peak (peak starts at 0), in plan order within a strategy.

    Blocks of time have their own running totals; a block's total, highest and
    lowest point and largest fall say all that later blocks need.
    """
    w = Window.partitionBy(by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = pl.closed(runs).withColumn("_b", F.floor(F.col(order[0]) / block_ms)).withColumn("_eq", F.sum("r").over(w)).withColumn("_peak", F.max("_eq").over(w))
    g = e.groupBy(by, "_b").agg(F.sum("r").alias("_sum"), F.max("_eq").alias("_high"), F.min("_eq").alias("_low"), F.max(F.col("_peak") - F.col("_eq")).alias("_fall"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    g = g.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    g = g.withColumn("_top", F.greatest(F.lit(0.0), F.max(F.col("_base") + F.col("_high")).over(before)))
    fall = F.greatest(F.col("_fall"), F.col("_top") - F.col("_base") - F.col("_low"))
    return g.groupBy(by).agg(F.round(F.max(fall), 6).alias("max_drawdown"), F.round(F.sum("_sum"), 6).alias("final_equity"))


def t_stat(r: Column) -> Column:
    sd = F.stddev_samp(r)
    return F.when(sd > 0, F.avg(r) / (sd / F.sqrt(F.count(r)))).otherwise(0.0)


def t_stats(runs: DataFrame, by: str = "strat") -> DataFrame:
    return pl.closed(runs).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(t_stat(F.col("r")), F.lit(0.0)), 6).alias("t"))


def numbered(rows: DataFrame, by: str, order: tuple[str, ...], block_ms: int = BLOCK) -> DataFrame:
    """Each row's place in its strategy (``_i``, from 1) and the number of rows (``_n``), from counts of blocks and places within them."""
    e = rows.withColumn("_b", F.floor(F.col(order[0]) / block_ms))
    blocks = e.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(by)
    blocks = blocks.withColumns({"_n": F.sum("_m").over(w), "_first": F.sum("_m").over(w.orderBy("_b")) - F.col("_m")})  # one row a block
    e = e.withColumn("_i", F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order))).join(blocks, [by, "_b"])
    return e.withColumn("_i", F.col("_first") + F.col("_i")).drop("_b", "_m", "_first")


def halves(runs: DataFrame, by: str = "strat", order: tuple[str, ...] = ("t0", "sym"), block_ms: int = BLOCK) -> DataFrame:
    """Mean R of the first floor(n/2) closed runs and of the rest."""
    e = numbered(pl.closed(runs), by, order, block_ms)
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    return e.groupBy(by).agg(F.round(F.coalesce(F.avg(F.when(first, F.col("r"))), F.lit(0.0)), 6).alias("h1"), F.round(F.coalesce(F.avg(F.when(~first, F.col("r"))), F.lit(0.0)), 6).alias("h2"))


def _turned(x: np.ndarray) -> np.ndarray:
    """The transpose of one step of a 32-bit xorshift (13, 17, 5)."""
    x = x ^ (x >> np.uint64(5))
    x = (x ^ (x << np.uint64(17))) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(13))


def _linear(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for b in range(32):
        out ^= np.where((x >> np.uint64(b)) & np.uint64(1), columns[b], np.uint64(0))
    return out


@F.pandas_udf(LongType())
def xorshift_mask(n: pd.Series) -> pd.Series:
    """The generator is linear, so the top bit of its n-th number is the parity of some bits of its seed: this says which.

    Powers of the step are combined by the bits of n, so draws of any plan come without those before it.
    """
    x, steps = np.full(len(n), 1 << 31, np.uint64), n.to_numpy().astype(np.uint64)
    power = _turned(np.uint64(1) << np.arange(32, dtype=np.uint64))
    while steps.any():
        x = np.where(steps & np.uint64(1), _linear(power, x), x)
        power, steps = _linear(power, power), steps >> np.uint64(1)
    return pd.Series(x.astype(np.int64))


def heads(draw: Column, plan_id: Column) -> Column:
    """A fair coin that depends on draw and plan only."""
    return F.substring(F.md5(F.concat_ws("|", draw.cast("string"), plan_id)), 1, 1) < "8"


def control_totals(real: DataFrame, flipped: DataFrame, k: int = 50, by: str = "strat", rng: str = "hash", order: tuple[str, ...] = ("t0", "sym")) -> DataFrame:
    """Totals of k draws in which each plan keeps or flips its side.

    A plan has two outcomes only, so both are replayed once; the draws are
    multiplied out on two numbers per plan and summed before they are shuffled.
    ``rng``: "hash" (of draw and plan), or "xorshift" (one sequence a draw, seeded
    with 1000 + draw, a number for each plan in order).
    """
    result = F.when(F.col("state").isin(*pl.CLOSED), F.col("r")).otherwise(0.0)
    both = (numbered(real, by, order) if rng == "xorshift" else real).select(by, "plan_id", result.alias("_r"), *(["_i"] if rng == "xorshift" else []))
    one = both.join(flipped.select("plan_id", result.alias("_f")), "plan_id")
    if rng == "xorshift":
        one = one.withColumn("_mask", xorshift_mask("_i"))
        turned = lambda: F.bit_count(F.col("_mask").bitwiseAND(F.col("draw") + 1000)) % 2 == 0
    else:
        turned = lambda: heads(F.col("draw"), F.col("plan_id"))
    one = one.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return one.groupBy(by, "draw").agg(F.sum(F.when(turned(), F.col("_f")).otherwise(F.col("_r"))).alias("total"))


def chance(real: DataFrame, flipped: DataFrame, k: int = 50, by: str = "strat", rng: str = "hash") -> DataFrame:
    """Share of draws at least as good as the real total, and their mean and band."""
    own = real.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("state").isin(*pl.CLOSED), F.col("r"))), F.lit(0.0)).alias("real"))
    draws = control_totals(real, flipped, k, by, rng).join(own, by)
    lo, hi = int(k * 0.05), -(-k * 95 // 100) - 1
    s = F.sort_array(F.collect_list("total"))  # k numbers
    return draws.groupBy(by).agg(F.round(F.first("real"), 6).alias("real_r"), F.round(F.avg("total"), 6).alias("control_mean"), F.round(F.avg((F.col("total") >= F.col("real")).cast("double")), 6).alias("p"),
                                 F.round(F.element_at(s, lo + 1), 6).alias("band_lo"), F.round(F.element_at(s, hi + 1), 6).alias("band_hi"))


def running_sum(rows: DataFrame, value: str, name: str, block_ms: int = BLOCK) -> DataFrame:
    """The sum up to each row of a symbol in order of time: within its block, and of the blocks before it."""
    rows = rows.withColumn("_b", F.floor(F.col("t") / block_ms))
    before = Window.partitionBy("sym").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = rows.groupBy("sym", "_b").agg(F.sum(value).alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0.0))).drop("_s")
    own = F.sum(value).over(Window.partitionBy("sym", "_b").orderBy("t"))
    return rows.withColumn("_own", own).join(blocks, ["sym", "_b"]).withColumn(name, F.col("_base") + F.col("_own")).drop("_b", "_own", "_base")


def add_funding(runs: DataFrame, funding: DataFrame) -> DataFrame:
    """Closed runs pay (long) or get (short) the payments in (t0, exit], by a difference of as-of sums."""
    from barproof.operators import walk

    cum = running_sum(funding, "r", "cum").select("sym", "t", "cum")
    out = runs.withColumn("_to", F.coalesce("at", "t_end"))
    out = walk.as_of(out, cum, ["sym"], "t0", "t", ["cum"], "_f0").withColumnRenamed("cum", "_c0")
    out = walk.as_of(out, cum, ["sym"], "_to", "t", ["cum"], "_f1").withColumnRenamed("cum", "_c1")
    paid = F.coalesce("_c1", F.lit(0.0)) - F.coalesce("_c0", F.lit(0.0))
    has = F.col("state").isin(*pl.CLOSED)
    out = out.withColumn("fund_r", F.when(has, -F.col("side") * paid / F.col("d_stop")).otherwise(0.0))
    return out.withColumn("r", F.col("r") + F.col("fund_r")).drop("_to", "_f0", "_f1", "_c0", "_c1")
