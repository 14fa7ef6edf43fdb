"""States of versioned tables written as Parquet, null counts, and the watchdog on a live stream."""

import time

import pytest

from tidemark.sources.errors import NotFound
from tidemark.sources.versioned import CHECKPOINT, VersionedTable
from tidemark.streaming import feed


def test_states_give_the_same_files(spark, tmp_path):
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", spark.createDataFrame([], "a int, b string").schema)
    for i in range(CHECKPOINT + 2):
        t.append(spark.createDataFrame([(i, None if i % 2 else "x")], "a int, b string").coalesce(1))
    last = CHECKPOINT + 2
    assert t.store.exists(f"_states/{CHECKPOINT:020d}.json") and t._state(last)[0] == CHECKPOINT and t._state(CHECKPOINT - 1)[0] == -1
    for v in (3, CHECKPOINT, last):
        assert sorted(r.a for r in t.read(version=v).collect()) == list(range(v))
        whole = t.log(v).where("kind = 'add'").count()
        assert t.files(v).count() == whole == v
    assert t.files().selectExpr("sum(nulls['b'])", "sum(nulls['a'])").head()[:] == ((CHECKPOINT + 2) // 2, 0)
    t.compact()
    t.checkpoint()
    assert t.files().count() == 1 and sorted(r.a for r in t.read().collect()) == list(range(last))
    assert t.append(spark.createDataFrame([(99, "y", 1.5)], "a int, b string, c double")) == last + 2
    assert t.schema().names == ["a", "b", "c"] and t.schema(last).names == ["a", "b"]
    with pytest.raises(NotFound):
        t.files(last + 9).count()


def test_watchdog(spark, tmp_path):
    """A symbol that falls silent is reported stale on a stream that keeps running."""
    schema = "symbol string, seq long, ts_us long, bid double, ask double, latency_us double"
    spark.createDataFrame([("X", 1, 10, 1.0, 2.0, 5.0), ("X", 3, 20, 1.0, 2.0, 5.0)], schema).write.parquet(f"{tmp_path}/in")
    out = feed.anomalies(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), silent_ms=300)
    q = out.writeStream.format("memory").queryName("watched").outputMode("append").start()
    try:
        until = time.time() + 90
        while time.time() < until and not spark.sql("select 1 from watched where type = 'stale'").head():
            if q.exception():
                raise q.exception()
            time.sleep(0.5)
    finally:
        q.stop()
    got = [tuple(r) for r in spark.sql("select type, seq, expected from watched").collect()]
    assert got[0] == ("gap", 3, 2) and got[1] == ("stale", 3, 4)
