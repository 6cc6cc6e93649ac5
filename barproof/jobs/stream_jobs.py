"""Streaming jobs over files, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from barproof.jobs import base as b
from barproof.jobs import sql as q
from barproof.jobs.registry import register
from barproof.operators import features as ft
from barproof.sources import fixtures as fx
from barproof.sources import readers as rd
from barproof.sources.store import MonthStore
from barproof.streaming import monitor as mo

#: In how many instalments a table arrives.
PARTS = 4


def run_to_end(query):
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


def part_of(df, at: str):
    """The span of time, of PARTS equal ones, that a row is in; and a span's length."""
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    size = max(1, -(-((hi or 0) - (lo or 0) + 1) // PARTS))
    return df.withColumn("part", F.floor((F.col(at) - F.lit(lo or 0)) / size).cast("int")), size


@register("sm_bars", q.query("SELECT sym, t, round(CASE WHEN i % 10 = 0 THEN c * 1.01 ELSE c END, 6) AS c FROM b0"))
def sm_bars(spark, d):
    bars = ft.with_index(fx.bars_1d(spark, d))
    again = bars.where("i % 10 = 0").withColumn("c", F.col("c") * 1.01).withColumn("seq", F.lit(1).cast("long"))
    src = rd.scratch(spark, "in")
    cols = ["sym", "t", "o", "h", "l", "c", "v", "seq"]
    again.select(*cols).write.parquet(f"{src}/a")  # the newer version arrives first
    bars.withColumn("seq", F.lit(0).cast("long")).select(*cols).write.parquet(f"{src}/b")
    stream = spark.readStream.schema(mo.BAR_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(src)
    store = MonthStore(spark, rd.scratch(spark, "store"), mo.BAR_SCHEMA)
    run_to_end(mo.upsert_bars(stream, store, rd.scratch(spark, "check")))
    store.vacuum()
    return b.r6(store.read(), "c").select("sym", "t", "c")


@register("sm_monitor", q.query("""SELECT plan_id, state AS event, "at", round(r, 6) AS r FROM runs WHERE strat = 'revert3'"""))
def sm_monitor(spark, d):
    """Bars arrive by spans of time, each span's plans one instalment after its bars, and some of both again; the stream is stopped and started in between."""
    f = b.feats(spark, d)
    plans, size = part_of(rd.stored(b.book(spark, d, ("revert3",), f), "book").select("sym", *mo.PLAN_FIELDS), "t0")
    bars, bar_size = part_of(f.select("sym", *mo.BAR_FIELDS), "t")
    src, out, check = (rd.scratch(spark, x) for x in ("follow", "events", "events-check"))
    bar_schema = bars.drop("part").schema
    bars.limit(0).drop("part").write.parquet(f"{src}/bars")
    plans.limit(0).drop("part").write.parquet(f"{src}/plans")
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{src}/{name}")
    put = lambda df, name: df.drop("part").write.mode("append").parquet(f"{src}/{name}")
    stream = mo.follow(read("plans", plans.drop("part").schema), read("bars", bar_schema), f"{2 * max(size, bar_size)} milliseconds")
    for k in range(PARTS + 1):
        put(bars.where((F.col("part") == k) | ((F.col("part") == k - 1) & (F.col("t") % 7 == 0))), "bars")
        put(plans.where((F.col("part") == k - 1) | ((F.col("part") == k - 2) & (F.col("t0") % 3 == 0))), "plans")
        run_to_end(mo.start(stream, out, check))
    end = plans.agg(F.max("t_end")).first()[0] or 0
    put(spark.createDataFrame([(None, end + 3 * max(size, bar_size), None, None, None)], bar_schema), "bars")
    run_to_end(mo.start(stream, out, check))
    events = spark.read.schema(mo.EVENTS).parquet(out)
    return events.where("event <> 'half'").select("plan_id", "event", "at", F.round("r", 6).alias("r"))


@register("sm_admit", q.query("SELECT plan_id FROM plans WHERE strat = 'revert3'"))
def sm_admit(spark, d):
    """Candidates arrive by spans of time, the later half of a span before the earlier one, and some again."""
    c, size = part_of(rd.stored(b.cand(spark, d, ("revert3",)).select("strat", "sym", "plan_id", "t0", "side", "t_end"), "cand"), "t0")
    src, out, check = (rd.scratch(spark, x) for x in ("admit", "admitted", "admit-check"))
    schema = c.drop("part").schema
    c.limit(0).drop("part").write.parquet(src)
    stream = mo.admit(spark.readStream.schema(schema).parquet(src), f"{2 * size} milliseconds")
    for k in range(0, PARTS, 2):
        for some in (F.col("part") == k + 1, (F.col("part") == k) | ((F.col("part") == k + 1) & (F.col("t0") % 3 == 0))):
            c.where(some).drop("part").write.mode("append").parquet(src)
            run_to_end(mo.start(stream, out, check))
    end = c.agg(F.max("t_end")).first()[0] or 0
    spark.createDataFrame([(None, None, None, end + 3 * size, None, None)], schema).write.mode("append").parquet(src)
    run_to_end(mo.start(stream, out, check))
    return spark.read.schema("plan_id string, flips boolean").parquet(out).select("plan_id")
