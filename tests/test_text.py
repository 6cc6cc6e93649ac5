"""Numbers and signals in text."""

import pytest
from pyspark.sql import functions as F

from barproof.functions import text as tx
from barproof.operators import messages as ms


@pytest.mark.parametrize(("text", "value"), [("1.234,56", 1234.56), ("63,000", 63000.0), ("0,45", 0.45), ("63000", 63000.0), ("1,234.5", 1234.5), ("x", None), ("", None)])
def test_number(spark, text, value):
    assert spark.range(1).select(tx.number(F.lit(text)).alias("v")).first().v == value


SIGNALS = [
    ("BTCUSDT LONG\nEntry: 63000\nStop: 61000\nTP1: 64000\nTP2: 66000", ("BTCUSDT", 1, 63000.0, 61000.0, [64000.0, 66000.0])),
    ("#ETH/USDT sat\nGiriş: 3.000,00\nStop: 3.100,00\nHedef: 2.900,00 / 2.800,00", ("ETHUSDT", -1, 3000.0, 3100.0, [2900.0, 2800.0])),
    ("BTCUSDT LONG or SHORT\nstop 1\ntp 2", None),
    ("nothing to see here", None),
    ("BTCUSDT LONG\nEntry 100\nStop 110\nTP 120", None),
]


@pytest.mark.parametrize(("text", "want"), SIGNALS)
def test_parse(spark, text, want):
    got = ms.parse(spark.createDataFrame([("c", 1, 0, text)], "channel string, id long, t long, text string")).collect()
    assert (got == [] if want is None else [(r.sym, r.side, r.entry, r.sl, r.tps) for r in got] == [want])


PRICES = [  # a price of one digit before its decimals is no ordinal, a lone digit in a list is one
    ("NOUSDT LONG\nEntry: 7.77\nStop: 7.46\nTP1: 8.00\nTP2: 8.24", (7.77, [8.0, 8.24])),
    ("NO/USDT long\nEntry zone: 8.60 - 9,00\nSL: 8.45\nTargets: 9.07 - 9.33", (8.8, [9.07, 9.33])),
    ("#NOUSDT al\nGiriş: 7,55\nZarar kes: 7,25\nHedef: 7,77 / 8,00", (7.55, [7.77, 8.0])),
    ("NOUSDT buy\nentry 1 2.45 2. 2.55\nstop 2.20\ntp 1 3.00 2 3.50", (2.5, [3.0, 3.5])),
    ("NOUSDT buy\nentry 7\nstop 6\ntp 8\ntp 8.00\ntp 9.50", (7.0, [8.0, 9.5])),
    ("NOUSDT buy\nentry 7\nstop 6\ntp 8", (7.0, [8.0])),
]


def test_prices_of_one_digit_are_no_ordinals(spark):
    df = spark.createDataFrame([("c", i, 0, t) for i, (t, _) in enumerate(PRICES)], "channel string, id long, t long, text string")
    assert {r.id: (round(r.entry, 9), r.tps) for r in ms.parse(df).collect()} == {i: w for i, (_, w) in enumerate(PRICES)}
