import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("panel_")))
def test_panel_queries_match_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    got, want = entry.queries()[name](spark, SMALL).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)

    def plain(df):
        out = df[sorted(df.columns)].copy()
        for c in out.columns:
            out[c] = [("~" if x is None or x is pd.NA or x is pd.NaT or x != x else x.isoformat()[:10] if hasattr(x, "isoformat") else str(x) if isinstance(x, (str, bool)) or type(x).__name__ == "bool_" else repr(float(x) + 0.0)) for x in out[c].astype(object)]
        return sorted(map(tuple, out.to_numpy().tolist()))

    assert plain(got) == plain(want)
