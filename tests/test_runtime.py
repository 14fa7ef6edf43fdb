"""Sources at a bounded rate, admission, plugins, the engine's life, and reading with page checksums."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import storage
from tidemark.sources.errors import AlreadyExists, InvalidArgument, NotFound
from tidemark.streaming import runtime


def test_admission(spark):
    b = spark.range(10).withColumnRenamed("id", "seq")
    got = {p: sorted(r.seq for r in runtime.admit(b, 3, p).collect()) for p in ("block", "reject_new", "drop_oldest")}
    assert got == {"block": list(range(10)), "reject_new": [0, 1, 2], "drop_oldest": [7, 8, 9]}
    with pytest.raises(InvalidArgument):
        runtime.admit(b, 3, "other")


def test_plugins(spark):
    seen, lives = [], []
    p = runtime.Plugins()
    p.register(runtime.Plugin("a", "A", "1", lambda hook, b: seen.append((hook, b.count())), frozenset({"tick"}), lambda: lives.append("on"), lambda: lives.append("off")))
    p.register(runtime.Plugin("b", "B", "1", lambda hook, b: 1 / 0))
    with pytest.raises(AlreadyExists):
        p.register(runtime.Plugin("a", "A", "2", print))
    with pytest.raises(InvalidArgument):
        p.register(runtime.Plugin("c", "", "1", print))
    with pytest.raises(NotFound):
        p.activate("z")
    assert p.dispatch("tick", spark.range(2)) == 0
    for i in ("a", "a", "b"):
        p.activate(i)
    assert p.dispatch("tick", spark.range(2)) == 1 and p.dispatch("signal", spark.range(3)) == 0
    assert seen == [("tick", 2)] and p.calls == {"a": 1} and p.faults == {"b": 2}
    p.deactivate("a")
    assert p.dispatch("tick", spark.range(2)) == 0 and lives == ["on", "off"]


def test_engine(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = runtime.files(spark, f"{tmp_path}/in", "id long", per_trigger=1).observe("seen", F.count("*").alias("n"))
    e = runtime.Engine()
    e.add("sink", lambda: rows.writeStream.format("memory").queryName("engine_sink").start())
    with pytest.raises(AlreadyExists):
        e.add("sink", lambda: None)
    assert e.state == "created"
    e.drain()
    e.start()
    e.drain()
    assert e.state == "running" and e.health() == "healthy"
    assert spark.table("engine_sink").count() == 30
    m = e.metrics()["sink"]
    assert m["active"] and m["batch"] >= 2 and set(m["observed"]) <= {"seen"}
    e.stop()
    assert e.state == "stopped" and e.metrics() == {}
    bad = runtime.Engine()
    bad.add("x", lambda: spark.readStream.schema("a int").parquet(f"{tmp_path}/in").groupBy("b").count().writeStream.start())
    with pytest.raises(Exception):
        bad.start()
    assert bad.state == "faulted" and bad.health() == "unhealthy"


def test_page_checksums(spark, tmp_path):
    """A flipped byte of a page fails the checked read."""
    path = f"{tmp_path}/t"
    spark.range(20_000).select(F.xxhash64("id").alias("h")).coalesce(1).write.option("compression", "none").parquet(path)
    assert storage.checked(spark, f"file://{path}").agg(F.count("h")).head()[0] == 20_000
    file = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet")
    data = bytearray(file.read_bytes())
    data[len(data) // 3] ^= 255
    file.write_bytes(data)
    crc = file.with_name(f".{file.name}.crc")
    crc.unlink(missing_ok=True)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        storage.checked(spark, f"file://{path}").agg(F.sum(F.col("h") % 2)).head()
