"""Structured Streaming jobs: late bars, open plans against incoming bars, admission.

The last two keep what arrives until the watermark has passed it and then take it in
order of time, so their results don't depend on how rows are spread over files and
micro-batches, as long as none comes later than the watermark's delay.  Whatever is
later is history: it belongs in the store of bars, and in a batch replay of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barproof.operators import plans as pl
from barproof.sources.store import MonthStore

BAR_SCHEMA = "sym string, t long, o double, h double, l double, c double, v double, seq long"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def upsert_bars(stream: DataFrame, store: MonthStore, checkpoint: str):
    """Bars arriving late, again or in a newer version: every micro-batch is merged into the months it touches, however late they are."""
    return stream.writeStream.foreachBatch(store.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PLAN = "plan_id string, side int, entry double, sl double, tp1 double, tp2 double, rm double, d_stop double, t0 long, t_end long"
PLAN_FIELDS = [f.split(" ")[0] for f in PLAN.split(", ")]
BAR_FIELDS = ["t", "h", "l", "c"]
EVENTS = "plan_id string, event string, at long, r double"


class _InOrder(StatefulProcessor):
    """Rows wait, once each, until the watermark has passed them; then ``take`` gets them by time."""

    waiting: str  # schema of what waits, its time first
    kept: str  # schema of what stays, by a name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getValueState("queue", f"rows array<struct<{self.waiting}>>")
        self.open = handle.getMapState("open", "name string", self.kept)
        self.through = None

    def close(self) -> None:
        pass

    def wait(self, rows: list[tuple]) -> None:
        old = [tuple(r) for r in self.queue.get()[0]] if self.queue.exists() else []
        rows = sorted({*old, *rows}, key=lambda r: [(x is None, x) for x in r])
        if rows:
            self.queue.update((rows,))
        elif self.queue.exists():
            self.queue.clear()

    def due(self, until: int) -> list[tuple]:
        rows = [tuple(r) for r in self.queue.get()[0]] if self.queue.exists() else []
        late = [r for r in rows if r[0] > until]
        if len(late) < len(rows):
            if late:
                self.queue.update((late,))
            else:
                self.queue.clear()
        return [r for r in rows if r[0] <= until]

    def wake(self, at: int) -> None:
        self.handle.registerTimer(int(at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        if self.through != (key, until):  # the first timer of a key does what all would
            self.through = (key, until)
            yield from self.take(key, until)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        yield from self.take(key, until)
        self.put(key, rows)
        self.through = None


class _Follow(_InOrder):
    """One symbol's open plans (one shard of them) and the bars that no plan has seen yet."""

    waiting = "t: long, h: double, l: double, c: double"
    kept = PLAN + ", half boolean, closed boolean, last_t long, last_c double"

    def put(self, key, rows) -> None:
        bars = []
        for r in rows:
            if r.kind == "bar" and r.sym is not None:
                bars.append((r.t, r.h, r.l, r.c))
            elif r.kind == "plan" and not self.open.containsKey((r.plan_id,)):
                self.open.updateValue((r.plan_id,), (*[r[f] for f in PLAN_FIELDS], False, False, None, None))
                self.wake(r.t_end)
        self.wait(bars)

    def take(self, key, until: int) -> Iterator[Row]:
        bars = self.due(until)
        names = PLAN_FIELDS + ["half", "closed", "last_t", "last_c"]
        for (name,), value in [*self.open.iterator()]:
            p = dict(zip(names, value))
            for t, h, lo, c in bars:
                if p["closed"] or t > p["t_end"]:
                    break
                if t > p["t0"]:
                    for event, r in self.seen(p, t, h, lo, c):
                        yield Row(plan_id=name, event=event, at=t, r=r)
            if p["t_end"] > until:
                self.open.updateValue((name,), tuple(p[f] for f in names))
                continue
            if not p["closed"]:
                yield Row(plan_id=name, event=self.ended(p), at=p["last_t"], r=self.at_end(p))
            self.open.removeKey((name,))

    def seen(self, p: dict, t: int, h: float, lo: float, c: float) -> Iterator[tuple[str, float | None]]:
        up, cost = p["side"] > 0, pl.COST / p["d_stop"]
        adv, fav = (lo, h) if up else (h, lo)
        reaches = lambda x, level, above: round(x, 9) >= round(level, 9) if above else round(x, 9) <= round(level, 9)
        p["last_t"], p["last_c"] = t, c
        if reaches(adv, p["entry"] if p["half"] else p["sl"], not up):
            p["closed"] = True
            yield "be" if p["half"] else "stop", (0.5 if p["half"] else -1.0) - cost
            return
        if p["tp1"] and not p["half"] and reaches(fav, p["tp1"], up):
            p["half"] = True
            yield "half", None
        if reaches(fav, p["tp2"], up):
            p["closed"] = True
            yield "tp2", (0.5 + 0.5 * p["rm"] if p["half"] else p["rm"]) - cost

    def ended(self, p: dict) -> str:
        return "wait" if p["last_t"] is None else "expired" if p["last_t"] >= p["t_end"] else "open"

    def at_end(self, p: dict) -> float:
        r = 0.0 if p["last_t"] is None else p["side"] * math.log(p["last_c"] / p["entry"]) / p["d_stop"]
        return (0.5 + 0.5 * r if p["half"] else r) - pl.COST / p["d_stop"]


def follow(plans: DataFrame, bars: DataFrame, delay: str, shards: int = 4) -> DataFrame:
    """Streams of plans (sym and PLAN) and bars (sym, t, h, l, c) -> a row when a plan halves, closes or ends.

    An event is ``half``, ``stop``, ``be``, ``tp2`` when a bar says so, and at ``t_end`` by
    timer ``expired``, or ``open`` (``wait``) if no bar came at that time (at all), with R at
    the last close.  State is a symbol's open plans and the bars that the watermark hasn't
    passed.  A plan stays, marked as closed, until the watermark passes ``t_end``, so one
    that comes again changes nothing: before that the mark says so, after it the row is
    late.  Then nothing of it remains.  Busy symbols are spread over ``shards`` by plan;
    each shard gets the symbol's bars.  A bar without ``sym`` moves the watermark only.
    """
    nothing = lambda fields: [F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in fields]
    p = plans.select(F.lit("plan").alias("kind"), "sym", F.pmod(F.xxhash64("plan_id"), F.lit(shards)).cast("int").alias("shard"), F.timestamp_millis("t0").alias("at"), *PLAN_FIELDS, *nothing(["t long", "h double", "l double", "c double"]))
    b = bars.select(F.lit("bar").alias("kind"), "sym", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.timestamp_millis("t").alias("at"), *nothing(PLAN.split(", ")), *BAR_FIELDS)
    both = p.unionByName(b).withWatermark("at", delay)
    return both.groupBy("sym", "shard").transformWithState(_Follow(), EVENTS, "append", "eventTime")


class _Admit(_InOrder):
    """One strategy's open plans of a symbol: the end of the long one and of the short one."""

    waiting = "t0: long, side: int, plan_id: string, t_end: long"
    kept = "t_end long"

    def put(self, key, rows) -> None:
        rows = [(r.t0, r.side, r.plan_id, r.t_end) for r in rows if r.plan_id is not None]
        for t in {r[0] for r in rows}:
            self.wake(t)
        self.wait(rows)

    def take(self, key, until: int) -> Iterator[Row]:
        ends = {name: value[0] for (name,), value in self.open.iterator()}
        before = dict(ends)
        for t0, side, plan_id, t_end in self.due(until):
            mine, other = ("long", "short") if side > 0 else ("short", "long")
            if ends.get(mine, t0) > t0:
                continue
            flips = ends.pop(other, t0) > t0 if ends.get(other, t0) > t0 else False
            ends[mine] = t_end
            self.wake(t_end)
            yield Row(plan_id=plan_id, flips=flips)
        ends = {k: t for k, t in ends.items() if t > until}  # what has ended decides nothing more
        for k in before.keys() - ends.keys():
            self.open.removeKey((k,))
        for k, t in ends.items():
            if before.get(k) != t:
                self.open.updateValue((k,), (t,))


def admit(candidates: DataFrame, delay: str) -> DataFrame:
    """A stream of candidates (strat, sym, plan_id, t0, side, t_end) -> those that open, with whether they flip an open plan.

    Candidates may come in any order and more than once within ``delay``; state is what
    the watermark hasn't passed and at most two open plans of a strategy and symbol, and
    goes when these have ended.  A row without ``plan_id`` moves the watermark only.
    """
    rows = candidates.select("strat", "sym", "plan_id", "t0", "side", "t_end", F.timestamp_millis("t0").alias("at")).withWatermark("at", delay)
    return rows.groupBy("strat", "sym").transformWithState(_Admit(), "plan_id string, flips boolean", "append", "eventTime")


def start(df: DataFrame, out: str, checkpoint: str):
    """Runs a stream of ``follow`` or ``admit`` over what is there; a later call with the same checkpoint goes on from it."""
    spark = df.sparkSession
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE[0], before)
