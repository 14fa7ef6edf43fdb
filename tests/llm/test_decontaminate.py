"""Both ways of decontamination give the rows of their SQL."""

import duckdb
import pytest

from tidemark.llm import decontaminate

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.fixture(scope="module")
def want():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return sorted(map(tuple, con.sql(decontaminate.SQL).df()[COLUMNS].itertuples(index=False)))


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_WINDOWS, 100])
def test_same_rows_as_sql(spark, want, most):
    """With 100 windows at most in a broadcast, the windows that occur are found first and looked up in parts."""
    docs, items = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "benchmark"))
    r = decontaminate.contamination(docs, items, most).select(*COLUMNS).toPandas()
    assert r.contaminated.sum() > 5
    assert sorted(map(tuple, r.itertuples(index=False))) == want


def test_no_text_is_shuffled(spark):
    """The exchanges of the way for large benchmarks carry hashes and hits, never a document's text or words."""
    docs, items = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "benchmark"))
    plan = decontaminate.contamination(docs, items, 100)._jdf.queryExecution().optimizedPlan().toString()
    aggregate = [line for line in plan.splitlines() if "Aggregate [rid" in line]
    assert aggregate and all("words#" not in line.replace("n_words#", "") for line in aggregate)
