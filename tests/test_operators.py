"""As-of joins, funding, fills, lists, ledger, pages, links, blocks of time and streams on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from barproof.operators import features as ft
from barproof.operators import graphs, joins, ledger, metrics, walk
from barproof.operators import messages as ms
from barproof.operators import replay as rp
from barproof.sources import readers as rd
from barproof.sources.store import MONTH, MonthStore
from barproof.streaming import monitor as mo

H8, HOUR, DAY = 28_800_000, 3_600_000, 86_400_000
COST = 0.022


@pytest.mark.parametrize("span", [10, 100, 10**9])
def test_as_of_join_is_the_last_row_before(spark, span):
    import random

    rng = random.Random(1)
    right = sorted({(s, rng.randrange(0, 2000)) for s in "ab" for _ in range(40)})
    left = [(k, rng.choice("abc"), rng.randrange(-50, 2100)) for k in range(200)]
    want = {k: max((t for x, t in right if x == s and t <= at), default=None) for k, s, at in left}
    r = spark.createDataFrame([(s, t, float(t)) for s, t in right], "sym string, t long, v double")
    out = walk.as_of(spark.createDataFrame(left, "k int, sym string, at long"), r, ["sym"], "at", "t", ["v"], span_ms=span).collect()
    assert {x.k: x.found_t for x in out} == want and all(x.v == x.found_t for x in out) and len(out) == 200


def payments(spark, rates):
    return spark.createDataFrame([("A", i * H8, r) for i, r in enumerate(rates)], "sym string, t long, r double")


def test_funding_rank_at_the_ends(spark):
    hi = ft.with_funding_pct(payments(spark, [0.0001 if i < 297 else 0.001 for i in range(300)])).orderBy(F.desc("t")).first()
    lo = ft.with_funding_pct(payments(spark, [0.0001 if i < 297 else -0.001 for i in range(300)])).orderBy(F.desc("t")).first()
    assert hi.pct >= 0.98 and lo.pct == 0


def test_funding_mean_needs_three_payments(spark):
    got = [r.avg_n for r in ft.with_funding_avg(payments(spark, [0.0001, 0.0002, 0.0003, 0.0004])).orderBy("t").collect()]
    assert got[:2] == [None, None] and got[2:] == pytest.approx([0.0002, 0.0003])


def test_funding_is_paid_after_the_start_and_up_to_the_exit(spark):
    runs = spark.createDataFrame([("p", "A", 0, 2 * H8, None, "stop", -1, 1.0, 0.0), ("q", "A", H8, H8, None, "stop", -1, 1.0, 0.0), ("o", "A", 0, 9 * H8, None, "open", -1, 1.0, 0.0)], "plan_id string, sym string, t0 long, t_end long, at long, state string, side int, d_stop double, r double")
    out = {r.plan_id: r.fund_r for r in metrics.add_funding(runs, payments(spark, [0.0001, 0.0002, 0.0003, 0.0004])).collect()}
    assert (out["p"], out["q"], out["o"]) == pytest.approx((0.0005, 0.0, 0.0))


@pytest.mark.parametrize("block", [3, 1000])
def test_drawdown_and_halves_by_blocks(spark, block):
    import random

    rng = random.Random(3)
    rows = [("s", "A", t, rng.uniform(-1, 1), "stop") for t in range(41)]
    df = spark.createDataFrame(rows, "strat string, sym string, t0 long, r double, state string")
    eq = peak = worst = 0.0
    for *_, r, _ in rows:
        eq += r
        peak = max(peak, eq)
        worst = max(worst, peak - eq)
    d = metrics.drawdown(df, block_ms=block).first()
    assert (d.max_drawdown, d.final_equity) == pytest.approx((worst, eq), abs=2e-6)
    h = metrics.halves(df, block_ms=block).first()
    r = [x[3] for x in rows]
    assert (h.h1, h.h2) == pytest.approx((sum(r[:20]) / 20, sum(r[20:]) / 21), abs=2e-6)


def test_sequential_draws(spark):
    """Draw k gives plan i the i-th number of a generator seeded with 1000 + k."""

    def flips(seed, n):
        x, out = seed, []
        for _ in range(n):
            x = (x ^ x << 13) & 0xFFFFFFFF
            x ^= x >> 17
            x = (x ^ x << 5) & 0xFFFFFFFF
            out.append(x < 2**31)
        return out

    n, k = 70, 9
    make = lambda sign: spark.createDataFrame([(f"p{i}", "s", "A", i, sign * 2.0**-i, "stop") for i in range(n)], "plan_id string, strat string, sym string, t0 long, r double, state string")
    got = {r.draw: r.total for r in metrics.control_totals(make(1), make(-1), k, rng="xorshift").collect()}
    assert got == pytest.approx({d: sum((-1 if f else 1) * 2.0**-i for i, f in enumerate(flips(1000 + d, n))) for d in range(k)}, abs=1e-12)


FILLS = {  # bars (t, h, l) after the message, and where the plan starts
    "touched": ([(1, 101, 99)], 1), "later": ([(1, 104, 102), (2, 103, 100)], 2), "target first": ([(1, 111, 102), (2, 101, 99)], None), "stop first": ([(1, 99, 89)], None), "both in one bar": ([(1, 111, 99)], 1), "too late": ([(80, 101, 99)], None),
}


def test_fill(spark):
    plans = spark.createDataFrame([(n, n, 1, 100.0, 90.0, 105.0, 110.0, 0, 0) for n in FILLS], "plan_id string, sym string, side int, entry double, sl double, tp1 double, tp2 double, t0 long, t_end long")
    bars = spark.createDataFrame([(n, t * HOUR, 100.0, float(h), float(lo), 100.0, 1.0) for n, (bs, _) in FILLS.items() for t, h, lo in bs], "sym string, t long, o double, h double, l double, c double, v double")
    out = {r.plan_id: r for r in joins.fill(plans, bars).collect()}
    assert {n: r.t0 // HOUR for n, r in out.items()} == {n: t for n, (_, t) in FILLS.items() if t is not None}
    assert all(r.tp1 is None and r.t_end == r.t0 + 30 * DAY for r in out.values())


def test_plans_from_a_list(spark):
    c = [100 * math.exp(0.001 * i) for i in range(300)]
    bars = spark.createDataFrame([("BTCUSDT", i * HOUR, x, x * 1.001, x * 0.999, x, 1.0) for i, x in enumerate(c)], "sym string, t long, o double, h double, l double, c double, v double")
    feats = walk.features_for(bars, 24)
    rows = [(str(200 * HOUR + 1234), "btcusdt", "long", "24", "2", None, None), (str(210 * HOUR), "BTCUSDT", "-1", "12", None, str(c[210] * 1.02), str(c[210] * 0.96)), (str(220 * HOUR), "ETHUSDT", "1", "24", "2", None, None),
            (str(5000 * HOUR), "BTCUSDT", "1", "24", "2", None, None), (str(230 * HOUR), "BTCUSDT", "1", "24", "2", str(c[230] * 1.02), str(c[230] * 1.05)), (str(240 * HOUR), "BTCUSDT", "??", "24", "2", None, None)]
    plans, skipped = joins.plans_from_list(spark.createDataFrame(rows, "t0 string, sym string, side string, hz string, rm string, sl string, tp string"), feats, HOUR)
    a, b = plans.orderBy("t0").collect()
    assert sorted(r.reason for r in skipped.collect()) == ["bar", "sym", "vol"]
    assert (a.t0, a.side, a.entry) == (200 * HOUR, 1, pytest.approx(c[200])) and a.d_stop == pytest.approx(feats.where(f"t = {200 * HOUR}").first().vol * math.sqrt(24))
    assert (b.side, b.t_end) == (-1, 222 * HOUR) and b.rm == pytest.approx(math.log(1 / 0.96) / math.log(1.02))


LEDGER = "id string, sym string, disp string, tf string, side string, entry string, sl string, tp1 string, tp2 string, rm string, d_stop string, dStop double, t0 long, t_end string, tEnd long, state string, half boolean, closed_at string, closedAt long, close_px string, closePx double, r_realized string, R double"


def signal(i, sym, t0=1000, state=None, r=None, snake=True):
    two = lambda v: (str(v), None) if snake and v is not None else (None, v)
    return (i, sym, None, "1h", "1", "100", "90", None, "110", "1", *two(0.1), t0, *two(9000), state, None, *two(2000 if state else None), *two(110.0 if state else None), *two(r))


def test_ledger(spark):
    rows = [signal("1", "BTC", state="tp2", r=1 - COST), signal("2", "ETH", state="stop", r=-1 - COST, snake=False), signal("3", "SOL", 3000), signal("4", "BTC", state="flipped", r=0.1), signal("5", "BTC", state="tp2", r=0.5), signal("6", "NOBARS", state="tp2", r=0.5)]
    s = ledger.normalise(spark.createDataFrame(rows, LEDGER))
    own = {r.id: r for r in s.collect()}
    assert (own["1"].side, own["1"].d_stop, own["1"].t_end, own["1"].tp1, own["3"].state) == (1, 0.1, 9000, None, "open") and (own["2"].d_stop, own["2"].closed_at, own["2"].r) == (0.1, 2000, -1 - COST)
    bars = spark.createDataFrame([("BTC", 2000, 100.0, 112.0, 98.0, 110.0, 1.0), ("ETH", 2000, 100.0, 101.0, 88.0, 95.0, 1.0)], "sym string, t long, o double, h double, l double, c double, v double")
    assert {r.id: r.finding for r in ledger.audit(s, bars).collect()} == {"1": "ok", "2": "ok", "4": "skipped", "5": "mismatch", "6": "no_bars"}
    t = ledger.track(s.where("id IN ('1', '2', '3')")).first()
    assert (t.total, t.n, t.open, t.wins, t.losses) == (3, 2, 1, 1, 1) and t.total_r == pytest.approx(-2 * COST)
    stats = spark.createDataFrame([("1h", 7, 3, 1000)], "tf string, runs long, new_sigs long, first_run long")
    doc = spark.createDataFrame(ledger.public_json(s, stats, 2).collect()).select(F.from_json("json", ledger.PUBLIC).alias("d")).select("d.*").first()
    assert (doc.stats.runs, doc.stats.signals, doc.stats.firstRun) == (7, 3, 1000) and [(x.id, x.tEnd, x.dStop) for x in doc.signals] == [("3", 9000, 0.1), ("1", 9000, 0.1)]


def test_pages_and_pastes(spark):
    block = '<div class="tgme_widget_message_wrap"><div data-post="chan/%d"><div class="tgme_widget_message_text x">a &amp; <b>b</b><br/>c&#39;</div><time datetime="2024-01-02T03:04:05+00:00">x</time></div></div>'
    pages = spark.createDataFrame([("chan", "<html>" + block % 7 + block % 8 + block % 7), ("chan", "<p>nothing</p>"), ("chan", None)], "channel string, html string")
    got = rd.messages_from_html(pages).orderBy("id").collect()
    assert [(r.id, r.t, r.text) for r in got] == [(i, 1_704_164_645_000, "a & b\nc'") for i in (7, 8)]
    paste = "head\n2024-01-02 03:04\nfirst\n[05.06.2024, 7:08] second\nmore"
    got = rd.messages_from_text(spark.createDataFrame([("c", paste), ("c", None)], "channel string, text string")).orderBy("k").collect()
    assert [r.t for r in got] == [1_704_164_640_000, 1_717_571_280_000] and "more" in got[1].text


SIGNALS = [
    ("Swing idea: DOTUSDT, buy 🟢\nentry zone 7.10\nstop-loss 6.80\ntp 1: 7.40\ntp 2: 7.90", ("DOTUSDT", 1, 7.1, 6.8, [7.4, 7.9])),
    ("AVAX / USDT sat\nGiriş 38,50 - 39,50\nZarar kes 40,10\nHedefler 37,00 / 35,50", ("AVAXUSDT", -1, 39.0, 40.1, [37.0, 35.5])),
    ("LINKUSDT short\nentry 17.20\nsl 16.60\ntp 18.10", None), ("XRP closed the week near 0,62, nothing to do", None), ("ATOM buy, target 14", None), ("NEARUSDT long and short are both possible\nsl 5\ntp 7", None),
    ("📈 FIL/USDT\nstop 5,10\ntargets 5,80 | 6,40", ("FILUSDT", 1, None, 5.1, [5.8, 6.4])),
    ("OPUSDT sell\nentry 1 2.45\nstop 2.60\ntp1 2.30 tp2 2.05 tp3 1.80", ("OPUSDT", -1, 2.45, 2.6, [2.3, 2.05, 1.8])),
    ("INJUSDT buy\nentry 31.5\nsl 30.2\ntp 31.5", None), ("INJUSDT buy\nentry 31.5\nsl 30.2\ntp1 31.5 tp2 33 tp3 36", ("INJUSDT", 1, 31.5, 30.2, [33.0, 36.0])),
    ("SUIUSDT buy\nentry 1.20\nsl 1.25\ntp 1.40", None), (None, None), ("", None),
]


def test_parsed_messages(spark):
    df = spark.createDataFrame([("c", i, 0, t) for i, (t, _) in enumerate(SIGNALS)], "channel string, id long, t long, text string")
    got = {r.id: (r.sym, r.side, r.entry, r.sl, r.tps) for r in ms.parse(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(SIGNALS) if w}


def test_message_to_plan(spark):
    rows = [("c", 1, 1, None, 95.0, [105.0, 110.0], 0, 100.0), ("c", 2, 1, 100.0, 100.0, [110.0], 0, 100.0), ("c", 3, 1, 104.0, 95.0, [110.0], 0, 100.0)]
    out = {r.id: r for r in ms.to_plan(spark.createDataFrame(rows, "channel string, id long, side int, entry double, sl double, tps array<double>, t long, px double")).collect()}
    assert set(out) == {1, 3} and (out[1].entry, out[1].tp1, out[1].tp2, out[1].off_entry) == (100.0, 105.0, 110.0, 0.0) and out[1].d_stop == pytest.approx(math.log(100 / 95))
    assert out[3].off_entry == pytest.approx(math.log(1.04))


def test_links_go_on_until_no_channel_is_new(spark):
    n = 66
    links = spark.createDataFrame([(f"c{i:05}", f"c{i + 1:05}") for i in range(n)] + [("c00003", "c00000")], "src string, dst string")
    got = {r.node: r.depth for r in graphs.reach(spark.createDataFrame([("c00000",)], "node string"), links).collect()}
    assert got == {f"c{i:05}": i for i in range(n + 1)}


def test_shadow_plans_have_their_own_ledger(spark):
    rows = [("a", 1, 0, 100, False), ("b", -1, 10, 110, True), ("c", -1, 20, 120, True), ("d", 1, 30, 130, True), ("e", -1, 40, 140, False), ("f", 1, 50, 150, False)]
    cand = spark.createDataFrame([(i, "s", "A", side, a, z, sh) for i, side, a, z, sh in rows], "plan_id string, strat string, sym string, side int, t0 long, t_end long, shadow boolean")
    got = {r.plan_id: (r.t_end, r.flipped) for r in walk.admit(cand).collect()}
    assert got == {"a": (40, True), "b": (110, False), "d": (130, False), "e": (50, True), "f": (150, False)}


def bar_row(sym, t, c, seq):
    return (sym, t, c, c, c, c, 1.0, seq)


def test_late_and_repeated_bars(spark, tmp_path):
    """The newest version of a bar wins, in whatever order and however late batches come in."""
    m = MONTH
    rows = [[bar_row("A", 1, 10.0, 0), bar_row("A", 2, 20.0, 0)], [bar_row("A", 400 * m, 30.0, 1)], [bar_row("A", 2, 21.0, 2), bar_row("A", 1, 9.0, 2)], [bar_row("A", 2, 20.0, 0)]]
    src, check = str(tmp_path / "src"), str(tmp_path / "check")
    store = MonthStore(spark, str(tmp_path / "store"), mo.BAR_SCHEMA)
    for part in rows:
        spark.createDataFrame(part, mo.BAR_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(mo.BAR_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    mo.upsert_bars(stream, store, check).awaitTermination()
    want = [(1, 9.0), (2, 21.0), (400 * m, 30.0)]
    assert sorted((r.t, r.c) for r in store.read().collect()) == want
    store.vacuum()
    assert sorted((r.t, r.c) for r in store.read().collect()) == want


def files_of(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_an_update_rewrites_its_months_only(spark, tmp_path):
    store = MonthStore(spark, str(tmp_path), mo.BAR_SCHEMA)
    make = lambda *rows: spark.createDataFrame(list(rows), mo.BAR_SCHEMA)
    store.merge(make(*[bar_row(s, k * MONTH + i, float(i), 0) for s in "ABC" for k in range(4) for i in range(5)]), 0)
    before = files_of(tmp_path)
    assert store.merge(make(bar_row("B", 2 * MONTH + 1, 77.0, 1)), 1) == ["2"]
    new = {p: t for p, t in files_of(tmp_path).items() if p not in before}
    assert new and all("/1/month=2/" in p for p in new) and before.items() <= files_of(tmp_path).items()
    assert store.read().count() == 60 and store.read().where("c = 77").count() == 1
    assert store.merge(make(bar_row("B", 2 * MONTH + 1, 99.0, 9)), 1) == [] and store.read().where("c = 99").count() == 0  # a committed batch that comes again
    assert store.merge(make(bar_row("B", 2 * MONTH + 1, 5.0, 0)), 2) == ["2"] and store.read().where("c = 77").count() == 1  # an older version


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = MonthStore(spark, str(tmp_path), mo.BAR_SCHEMA)
    store.merge(spark.createDataFrame([bar_row("A", 1, 1.0, 0)], mo.BAR_SCHEMA), 0)
    update = spark.createDataFrame([bar_row("A", 1, 2.0, 1), bar_row("A", 2, 3.0, 1)], mo.BAR_SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(MonthStore, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.merge(update, 1)
    assert [(r.t, r.c) for r in store.read().collect()] == [(1, 1.0)]
    store.merge(update, 1)
    assert sorted((r.t, r.c) for r in store.read().collect()) == [(1, 2.0), (2, 3.0)]


PLANS = "sym string, " + mo.PLAN
BARS = "sym string, t long, h double, l double, c double"


class Followed:
    """Plans and bars arrive in instalments; the stream starts anew for each."""

    def __init__(self, spark, folder, delay):
        self.spark, self.at = spark, {x: str(folder / x) for x in ("plans", "bars", "out", "check")}
        for name, schema in (("plans", PLANS), ("bars", BARS)):
            spark.createDataFrame([], schema).write.parquet(self.at[name])
        self.stream = mo.follow(*(spark.readStream.schema(x).parquet(self.at[n]) for n, x in (("plans", PLANS), ("bars", BARS))), f"{delay} milliseconds", shards=2)

    def put(self, plans=(), bars=()):
        for name, schema, rows in (("plans", PLANS, plans), ("bars", BARS, bars)):
            if rows:
                self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(self.at[name])
        query = mo.start(self.stream, self.at["out"], self.at["check"])
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    def events(self):
        return sorted((r.plan_id, r.at, r.event, None if r.r is None else round(r.r, 6)) for r in self.spark.read.schema(mo.EVENTS).parquet(self.at["out"]).collect())


def a_plan(name, t0, t_end, sym="S"):
    return (sym, name, 1, 100.0, 90.0, 105.0, 120.0, 2.0, 0.1, t0, t_end)


def test_plans_followed_over_batches(spark, tmp_path):
    """Bars that come before their plan, out of order or twice make no difference; a plan closes once, whatever comes later, and nothing of it stays."""
    s = Followed(spark, tmp_path, 1000)
    bar = lambda t, h, lo, c=100.0: ("S", t, float(h), float(lo), c)
    s.put(bars=[bar(1100, 104, 99), bar(1010, 106, 101)])
    s.put(plans=[a_plan("p", 1000, 4000), a_plan("q", 1050, 3000), a_plan("w", 2990, 2995), a_plan("g", 1050, 3001)], bars=[bar(1010, 106, 101)])
    s.put(bars=[bar(3000, 103, 101, 102.0), bar(1200, 104, 101)])
    s.put(plans=[a_plan("p", 1000, 4000)], bars=[bar(3200, 125, 101), bar(3900, 104, 80)])  # p was stopped at entry: it comes again, and bars that would reach its target
    s.put(plans=[a_plan("p", 1000, 4000), a_plan("q", 1050, 3000)], bars=[bar(2000, 130, 80)])  # late by now
    kept = s.put(bars=[(None, 99_999, None, None, None)])
    r = math.log(1.02) / 0.1
    assert s.events() == [("g", 3000, "open", round(r - 0.022, 6)), ("p", 1010, "half", None), ("p", 1100, "be", 0.478), ("q", 3000, "expired", round(r - 0.022, 6)), ("w", None, "wait", -0.022)]
    assert kept[-1] == 0


def test_following_equals_the_replay(spark, tmp_path):
    import random

    rng = random.Random(11)
    price, bars = 100.0, []
    for k in range(1, 121):
        price *= math.exp(rng.gauss(0, 0.03))
        bars.append(("S", 10 * k, price * 1.01, price * 0.99, price))
    plans = []
    for k in range(40):
        t0, side, d = 10 * rng.randrange(1, 110), rng.choice((1, -1)), rng.choice((0.03, 0.08))
        c = bars[t0 // 10 - 1][4]
        plans.append(("S", f"p{k}", side, c, c * math.exp(-side * d), c * math.exp(side * d), c * math.exp(2 * side * d), 2.0, d, t0, t0 + 10 * rng.randrange(0, 15) + rng.choice((0, 5))))
    s = Followed(spark, tmp_path, 600)
    for lo in range(0, 1200, 400):
        some = [b for b in bars if lo < b[1] <= lo + 400] + [b for b in bars if lo - 100 < b[1] <= lo]
        rng.shuffle(some)
        s.put([p for p in plans if lo - 200 < p[9] <= lo + 200], some)
    s.put([p for p in plans if p[9] > 1000], [(None, 99_999, None, None, None)])
    want = rp.run(spark.createDataFrame(plans, PLANS), spark.createDataFrame([(b[0], b[1], 1.0, *b[2:], 1.0) for b in bars], "sym string, t long, o double, h double, l double, c double, v double"), bucket_ms=50).collect()
    assert {(r.plan_id, r.state, r["at"], round(r.r, 6)) for r in want} == {(p, e, at, r) for p, at, e, r in s.events() if e != "half"}
    assert len({r.state for r in want}) >= 5


def test_admission_in_a_stream(spark, tmp_path):
    """Out of order, repeated and in several batches: as in one batch, and nothing is kept of plans that have ended."""
    import random

    rng = random.Random(5)
    schema = "strat string, sym string, plan_id string, t0 long, side int, t_end long"
    rows = [("s", rng.choice("AB"), f"p{k}", t0, rng.choice((1, -1)), t0 + rng.randrange(1, 60)) for k, t0 in enumerate(rng.choices(range(1000), k=150))]
    want = {r.plan_id for r in walk.admit(spark.createDataFrame(rows, schema)).collect()}
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.createDataFrame([], schema).write.parquet(src)
    stream = mo.admit(spark.readStream.schema(schema).parquet(src), "500 milliseconds")
    for lo in (250, 0, 750, 500):
        some = [r for r in rows if lo <= r[3] < lo + 250]
        spark.createDataFrame(some + some[:20], schema).write.mode("append").parquet(src)
        mo.start(stream, out, check).awaitTermination()
    spark.createDataFrame([(None, None, None, 9999, None, None)], schema).write.mode("append").parquet(src)
    query = mo.start(stream, out, check)
    query.awaitTermination()
    got = [r.plan_id for r in spark.read.schema("plan_id string, flips boolean").parquet(out).collect()]
    assert sorted(got) == sorted(want) and len(want) < 150
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1] == 0
