import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Queries of the folders that may be left out have their own tests.
OWN = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def plain(rows, columns):
    out = rows[columns].copy()
    for c in columns:
        out[c] = out[c].map(lambda v: "" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v))
    return out.sort_values(columns).reset_index(drop=True)


def test_entry(spark):
    found = {r["ordinal"]: r["count"] for r in entry.entry(spark).collect()}
    assert set(found) == {2, 3} and found[3] == 16


@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.execute(sql).fetchdf()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    pd.testing.assert_frame_equal(plain(got, columns), plain(want, columns))


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
