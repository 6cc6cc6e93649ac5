"""Queries against their SQL on small tables that hold what the smallest given ones don't."""

import random

import pytest

from test_market import plain

#: Prices of whole units below ten: after a fall the walk comes back to 8.80 on every sixth day.
FALL, DAYS = 48, 200
#: 35 % of so many hours is a whole number, but not in binary.
HOURS = 720
NAMES = ("fn_parse_signal", "prj_toplan", "jn_fill", "ag_monkey", "ag_channel_card", "wn_volz", "wn_feat", "so_union", "wn_season")


def levels():
    rng = random.Random(5)
    return [-50 * (i + 1) if i < FALL else -2430 if i % 6 == 2 else -2430 + rng.randint(-20, 20) for i in range(DAYS)]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A folder of tables and a connection that has them as views."""
    duckdb = pytest.importorskip("duckdb")
    at, con, cs = tmp_path_factory.mktemp("tables"), duckdb.connect(), levels()
    con.execute("CREATE TABLE days (i INTEGER, q DOUBLE)")
    con.executemany("INSERT INTO days VALUES (?, ?)", [(i, (x - y + 101) / 2) for i, (x, y) in enumerate(zip(cs, [0, *cs]))])
    made = {
        "lineitem": "SELECT 'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1996-01-01' + to_days(i) AS l_shipdate, q AS l_quantity, 0.05 AS l_discount, 1 AS l_linenumber FROM days",
        # some in every hour, one within half a millisecond of the next
        "events": f"""SELECT i AS event_id, CASE WHEN i = 1499 THEN TIMESTAMP '2024-01-11 09:59:59.999600' ELSE TIMESTAMP '2024-01-01' + to_seconds(i * 600) END AS ts, 'view' AS event_type, (i * i * 7919 % 20011) / 100.0::DOUBLE AS value FROM range({6 * HOURS}) r(i) WHERE i * i % 7 <> 4""",
        "conversations": "SELECT CAST(range AS BIGINT) AS conv_id, 1 AS turn, 'user' AS role, 'how are you' AS text FROM range(3)",
    }
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{at}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, tables, name):
    import __spark_entry__ as entry

    at, con = tables
    found = entry.queries()[name](spark, at)
    columns = sorted(found.columns)
    want = con.sql(entry.oracle_sql()[name])
    place = [want.columns.index(c) for c in columns]
    key = lambda r: [str(x) for x in r]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=key)
    assert rows and rows == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=key)
