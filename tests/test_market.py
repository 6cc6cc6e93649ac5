"""Queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
NAMES = ("ag_event_h1", "src_bars", "rp_admit", "so_union", "snk_plans_csv", "snk_public_json", "ag_drawdown", "ag_halves", "jn_asof_bar", "ag_channel_card", "jn_link_frontier", "ag_funding_r")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return (v is None, "" if v is None else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v))


@pytest.mark.skipif(not DATA.is_dir(), reason="needs the given tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, con, name):
    import __spark_entry__ as entry

    found = entry.queries()[name](spark, str(DATA))
    columns = sorted(found.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
