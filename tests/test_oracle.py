"""Every query of the market engine against DuckDB on the same tables."""

from numbers import Number

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "nation lineitem orders events embeddings documents labels".split()


def rows(df):
    cols = sorted(df.columns)
    out = []
    for r in df[cols].itertuples(index=False):
        out.append(tuple("null" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, Number) else str(v) for v in r))
    return cols, sorted(out)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = rows(registry.queries()[name](spark, SF).toPandas())
    want = rows(con.execute(registry.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, bad[:3]
