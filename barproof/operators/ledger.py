"""The signal ledger: normalising, auditing, summarising and exporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barproof.operators import metrics as mt
from barproof.operators import replay as rp


def normalise(rows: DataFrame) -> DataFrame:
    """snake_case or camelCase, numbers as text or not -> one schema with defaults."""
    num = lambda *names: F.coalesce(*[F.col(n).cast("string").try_cast("double") for n in names if n in rows.columns])
    ms = lambda *names: num(*names).cast("long")
    return rows.select(
        "id", "sym", F.coalesce("disp", "sym").alias("disp"), "tf", num("side").cast("int").alias("side"), num("entry").alias("entry"), num("sl").alias("sl"), num("tp1").alias("tp1"), num("tp2").alias("tp2"), num("rm").alias("rm"),
        num("d_stop", "dStop").alias("d_stop"), ms("t0").alias("t0"), ms("t_end", "tEnd").alias("t_end"), F.coalesce("state", F.lit("open")).alias("state"), F.coalesce(F.col("half").cast("boolean"), F.lit(False)).alias("half"),
        ms("closed_at", "closedAt").alias("closed_at"), num("close_px", "closePx").alias("close_px"), num("r_realized", "R").alias("r"))


def audit(signals: DataFrame, bars: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Recorded against replayed results: one row per signal that isn't open, with its finding."""
    s = signals.where("state <> 'open'").withColumn("plan_id", F.col("id"))
    again = rp.run(s.drop("state", "r", "half"), bars).select("id", F.col("state").alias("again"), F.col("r").alias("r_again"))
    j = s.join(again, "id")
    ok = (F.col("again") == F.col("state")) & F.coalesce(F.abs(F.col("r_again") - F.col("r")) <= tol, F.lit(False))
    finding = F.when(F.col("again") == "no-data", "no_bars").when(F.col("state") == "flipped", "skipped").when(ok, "ok").otherwise("mismatch")
    return j.select("id", "sym", "state", "r", "again", "r_again", finding.alias("finding"))


def track(signals: DataFrame) -> DataFrame:
    """Metrics on recorded R by timeframe, with open and total counts."""
    rows = signals.withColumn("r", F.coalesce("r", F.lit(0.0))).withColumn("n", F.lit(0))
    return mt.metrics(rows, "tf").join(rows.groupBy("tf").agg(F.count(F.when(F.col("state") == "open", 1)).alias("open"), F.count(F.lit(1)).alias("total")), "tf")


def run_stats(runs: DataFrame, last: int = 60) -> DataFrame:
    """Runs, new signals, first run, and for how many of the last runs nothing new came."""
    total = runs.groupBy("tf").agg(F.count(F.lit(1)).alias("runs"), F.sum("new_sigs").alias("new_sigs"), F.min("ran_at").alias("first_run"))
    recent = runs.withColumn("k", F.row_number().over(Window.partitionBy("tf").orderBy(F.desc("ran_at")))).where(F.col("k") <= last)
    streak = recent.groupBy("tf").agg((F.coalesce(F.min(F.when(F.col("new_sigs") > 0, F.col("k"))), F.count(F.lit(1)) + 1) - 1).cast("long").alias("silent"))
    return total.join(streak, "tf")


def recent(signals: DataFrame, n: int = 200) -> DataFrame:
    return signals.orderBy(F.desc("t0"), "id").limit(n)


#: The public document.
PUBLIC = """stats struct<runs: long, signals: long, firstRun: long>, signals array<struct<id: string, sym: string, disp: string, tf: string, side: int, entry: double, sl: double, tp1: double, tp2: double, rm: double, dStop: double,
  t0: long, tEnd: long, state: string, half: boolean, closedAt: long, closePx: double, R: double>>"""


def public_json(signals: DataFrame, stats: DataFrame, n: int = 200) -> DataFrame:
    """The newest signals (n at most, newest first) and the run statistics as one JSON document: n, json."""
    names = {"d_stop": "dStop", "t_end": "tEnd", "closed_at": "closedAt", "close_px": "closePx", "r": "R"}
    fields = ["id", "sym", "disp", "tf", "side", "entry", "sl", "tp1", "tp2", "rm", "d_stop", "t0", "t_end", "state", "half", "closed_at", "close_px", "r"]
    one = recent(signals, n).select((-F.col("t0")).alias("k"), "id", F.struct(*[F.col(c).alias(names.get(c, c)) for c in fields]).alias("s"))
    listed = one.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id", "s"))), lambda x: x["s"]).alias("signals"))
    said = stats.agg(F.first(F.struct(F.col("runs"), F.col("new_sigs").alias("signals"), F.col("first_run").alias("firstRun"))).alias("stats"))
    both = listed.withColumn("_one", F.lit(1)).join(said.withColumn("_one", F.lit(1)), "_one")  # one row each
    return both.select(F.size("signals").alias("n"), F.to_json(F.struct("stats", "signals")).alias("json"))
