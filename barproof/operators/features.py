"""Causal features per symbol: every frame ends at the current row or before it.

Functions take bars (sym, t, o, h, l, c, v) and add columns.  No window spans a whole
symbol: bars are numbered by spans of time, a symbol's rows are cut into blocks of
consecutive numbers, and each block gets a halo of the rows before (and, for targets,
after) it that its frames reach.  One busy symbol is so many independent windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows in a block (or a multiple of it); also those of the recurrence, for which 0.97 ** -BLOCK must stay far from overflow.
BLOCK = 1024
HOUR = 3_600_000


def with_index(bars: DataFrame, step_ms: int = HOUR, size: str | None = None) -> DataFrame:
    """``i``: position from 0 within the symbol; as ``size``, if named, how many rows the symbol has.

    Rows are numbered within spans of BLOCK steps of time (``step_ms``: at most the usual
    distance of two rows), and the spans' counts, one row a span, are summed along the symbol.
    """
    span = F.floor(F.col("t") / (BLOCK * step_ms))
    counts = bars.groupBy("sym", span.alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("sym")
    counts = counts.withColumn("_base", F.sum("_n").over(along.orderBy("_span")) - F.col("_n"))
    if size:
        counts = counts.withColumn(size, F.sum("_n").over(along))
    place = F.row_number().over(Window.partitionBy("sym", "_span").orderBy("t")) - 1
    out = bars.drop("i").withColumn("_span", span).withColumn("_i", place).join(counts.drop("_n"), ["sym", "_span"])
    return out.withColumn("i", (F.col("_base") + F.col("_i")).cast("long")).drop("_span", "_i", "_base")


def framed(bars: DataFrame, back: int, ahead: int = 0, step_ms: int = HOUR, known: bool = False) -> DataFrame:
    """Rows, numbered unless ``i`` is ``known``, in blocks (``_blk``) with copies of the ``back`` rows before each and the ``ahead`` rows after it; ``_own`` tells a block's own rows."""
    block = BLOCK * -(-4 * (back + ahead) // BLOCK) or BLOCK
    b = bars if known else with_index(bars, step_ms)
    first, last = F.floor((F.col("i") - ahead) / block), F.floor((F.col("i") + back) / block)
    b = b.withColumn("_blk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return b.withColumn("_own", F.col("_blk") == F.floor(F.col("i") / block))


def by_block() -> WindowSpec:
    """The window of framed rows."""
    return Window.partitionBy("sym", "_blk").orderBy("t")


def unframed(b: DataFrame) -> DataFrame:
    return b.where("_own").drop("_blk", "_own")


def log_return(steps: int = 1) -> Column:
    """Over framed rows with at least ``steps`` rows of halo."""
    return F.ln(F.col("c") / F.lag("c", steps).over(by_block()))


def with_returns(bars: DataFrame, steps: dict[str, int]) -> DataFrame:
    """Log returns over so many rows, by name."""
    b = framed(bars, max(steps.values()))
    return unframed(b.withColumns({n: log_return(k) for n, k in steps.items()}))


def with_excursion(bars: DataFrame) -> DataFrame:
    pc = F.lag("c").over(by_block())
    return unframed(framed(bars, 1).withColumns({"ex_hi": F.ln(F.greatest("h", "c") / pc), "ex_lo": F.ln(F.least("l", "c") / pc)}))


def with_ewma_vol(bars: DataFrame, lam: float = 0.97, warm: int = 50, name: str = "vol") -> DataFrame:
    """EWMA volatility without a row-by-row loop.

    The recurrence v = lam v + (1-lam) r^2 is a weighted running sum.  To keep
    the powers finite it runs in blocks: each block sums its own returns in
    parallel and takes the end values of the two blocks before it (what lies
    further back weighs less than lam ** (2 * BLOCK), below double precision).
    """
    b = framed(bars, 1).withColumn("_r2", F.pow(log_return(), 2)).where("_own")
    b = b.withColumn("_j", F.col("i") % BLOCK)
    w = F.when(F.col("i") == 0, 0.0).when(F.col("i") == 1, F.col("_r2")).otherwise((1 - lam) * F.col("_r2"))
    b = b.withColumn("_sum", F.pow(F.lit(lam), F.col("_j")) * F.sum(w * F.pow(F.lit(lam), -F.col("_j"))).over(by_block()))
    ends = b.groupBy("sym", "_blk").agg(F.max_by("_sum", "i").alias("_end"))
    along = Window.partitionBy("sym").orderBy("_blk")  # a row a block
    ends = ends.withColumn("_before", F.coalesce(F.lag("_end").over(along), F.lit(0.0)) + F.coalesce(F.lag("_end", 2).over(along), F.lit(0.0)) * lam**BLOCK)
    b = b.join(ends.select("sym", "_blk", "_before"), ["sym", "_blk"])
    v = F.col("_sum") + F.col("_before") * F.pow(F.lit(lam), F.col("_j") + 1)
    return b.withColumn(name, F.when(F.col("i") >= max(warm, 1), F.sqrt(v))).drop("_r2", "_blk", "_own", "_j", "_sum", "_before")


def donchian(length: int) -> Column:
    """1 above the highest high of the ``length`` bars before, -1 below the lowest low, else 0; over framed rows."""
    before = by_block().rowsBetween(-length, -1)
    ready = F.col("i") >= length + 1
    c, hi, lo = (F.round(x, 9) for x in (F.col("c"), F.max("h").over(before), F.min("l").over(before)))  # equal prices stay equal whatever the last bit
    return F.when(ready & (c > hi), 1).when(ready & (c < lo), -1).otherwise(0)


def with_donchian(bars: DataFrame, lengths: dict[str, int]) -> DataFrame:
    return unframed(framed(bars, max(lengths.values()) + 1).withColumns({n: donchian(k) for n, k in lengths.items()}))


def _funding_avg(framed_rows: DataFrame, n: int) -> DataFrame:
    frame = by_block().rowsBetween(-(n - 1), 0)
    return framed_rows.withColumn("avg_n", F.when(F.col("i") >= n - 1, F.round(F.avg("r").over(frame), 12)))


def with_funding_avg(funding: DataFrame, n: int = 3) -> DataFrame:
    """Mean of the last n payments; null with fewer."""
    return unframed(_funding_avg(framed(funding, n - 1), n))


def with_funding_pct(funding: DataFrame, n: int = 3, win: int = 270) -> DataFrame:
    """Share of the last ``win`` n-payment means strictly below the current one; null while i < win + n."""
    f = _funding_avg(framed(funding, n + win), n)
    seen = F.collect_list("avg_n").over(by_block().rowsBetween(-(win - 1), 0))
    below = F.size(F.filter(seen, lambda x: x < F.col("avg_n")))
    return unframed(f.withColumn("pct", F.when(F.col("i") >= win + n, below / F.lit(win))))


def with_position_pct(funding: DataFrame, n: int = 3, days: int = 90) -> DataFrame:
    """The lab's rank, for a decision just after each payment: at least days*3/2 payments,
    the current mean against the days*3-1 before it (at least 30), strictly below."""
    f = _funding_avg(framed(funding, n + days * 3), n)
    ref = F.collect_list("avg_n").over(by_block().rowsBetween(-(days * 3 - 1), -1))
    pct = F.size(F.filter(ref, lambda x: x < F.col("avg_n"))) / F.size(ref)
    return unframed(f.withColumn("pos_pct", F.when((F.col("i") + 1 >= days * 3 // 2) & (F.size(ref) >= 30) & F.col("avg_n").isNotNull(), pct)))


def clip(c: Column, a: float) -> Column:
    return F.least(F.greatest(c, F.lit(-a)), F.lit(a))


def lab_features(bars: DataFrame, hour_ms: int = 3_600_000) -> DataFrame:
    """The forecaster's features; rows without target, volatility or 120-bar momentum go."""
    first = bars.groupBy("sym").agg(F.min("t").alias("_t0"), F.count("v").alias("_volumes"))
    b = framed(with_ewma_vol(bars, warm=0, name="vol"), 168, known=True)
    b = b.withColumn("r1", log_return()).withColumn("vol", F.when(F.col("i") >= 1, F.col("vol"))).withColumn("_volp", F.nullif(F.lag("vol").over(by_block()), F.lit(0.0)))
    b = b.withColumn("y", F.col("r1") / F.col("_volp"))
    for n in (6, 24, 120):
        b = b.withColumn(f"z{n}", log_return(n) / (F.col("_volp") * F.sqrt(F.lit(float(n)))))
    b = unframed(_volume_z(b)).join(first, "sym").withColumn("hacimz", F.when(F.col("_volumes") > 200, F.col("hacimz")).otherwise(0.0))
    b = b.withColumn("aralik", (F.col("h") - F.col("l")) / F.col("c"))
    day = F.floor(F.col("t") / 86_400_000)
    b = b.withColumn("saat", F.floor(F.pmod(F.col("t"), F.lit(86_400_000)) / hour_ms).cast("int")).withColumn("gun", F.pmod(day + 3, F.lit(7)).cast("int"))
    b = b.withColumn("time_idx", F.floor((F.col("t") - F.col("_t0")) / hour_ms).cast("long"))
    b = b.where("y IS NOT NULL AND vol IS NOT NULL AND z120 IS NOT NULL")
    return b.withColumns({"y": clip(F.col("y"), 8), **{f"z{n}": clip(F.col(f"z{n}"), 8) for n in (6, 24, 120)}}).drop("_volp", "i", "_t0", "_volumes")


def _volume_z(b: DataFrame, frame: int = 168, least: int = 48) -> DataFrame:
    """z-score of the log volume over the last ``frame`` framed bars; 0 where it can't be had."""
    b = b.withColumn("_lv", F.ln(F.nullif(F.col("v"), F.lit(0.0))))
    w = by_block().rowsBetween(-(frame - 1), 0)
    z = (F.col("_lv") - F.avg("_lv").over(w)) / F.nullif(F.stddev_samp("_lv").over(w), F.lit(0.0))
    return b.withColumn("hacimz", clip(F.coalesce(F.when(F.count("_lv").over(w) >= least, z), F.lit(0.0)), 5)).drop("_lv")


def ny_hour_of_week(t: Column) -> Column:
    """0..167 in New York, Monday 0; daylight saving included."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.timestamp_add("MILLISECOND", t, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")))
    return F.weekday(local) * 24 + F.hour(local)


def with_forward_abs(bars: DataFrame, hours: int = 24) -> DataFrame:
    """|log| move over the window that opens at the bar (from the close before it) and where its largest step is."""
    w = by_block()
    steps = F.array(*[F.abs(F.ln(F.lead("c", k).over(w) / F.lead("c", k - 1).over(w))) for k in range(hours)])
    b = framed(bars, 1, hours).withColumns({"_pc": F.lag("c").over(w), "_fc": F.lead("c", hours - 1).over(w), "_steps": steps})
    ok = F.col("_pc").isNotNull() & F.col("_fc").isNotNull()
    rounded = F.transform("_steps", lambda x: F.round(x, 9))
    b = b.withColumn("fwd_abs", F.when(ok, F.abs(F.ln(F.col("_fc") / F.col("_pc"))))).withColumn("peak", F.when(ok, F.array_position(rounded, F.array_max(rounded)) - 1))
    return unframed(b).drop("_pc", "_fc", "_steps", "i")
