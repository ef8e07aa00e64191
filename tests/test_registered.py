"""Every registered query against its SQL on the smallest data folder (a fast, representative part)."""

import duckdb
import pytest

from checks import registered
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
FAST = [n for n in registered.QUERIES if not n.startswith(("source_", "posting_lifecycle", "scan_log", "scan_totals_first", "stream_l", "digest_", "match_", "company_match", "register_ids"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query(spark, duck, name):
    q = registered.QUERIES[name]
    df = q.run(spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        assert got[0]
        return
    res = duck.execute(q.sql)
    assert got == rows_of([d[0] for d in res.description], res.fetchall())
