"""Versioned tables, drift and CSV bars."""

import threading
from datetime import date

import pytest
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.sources import bars_csv, schemas
from tidemark.sources.errors import AlreadyExists, ConcurrentModification, Corruption, InvalidArgument, NotFound
from tidemark.sources.versioned import Catalog, VersionedTable

SCHEMA = StructType([StructField("id", LongType()), StructField("kind", StringType()), StructField("price", DoubleType()), StructField("day", DateType())])


def rows(spark, ids, kind="a"):
    return spark.createDataFrame([(i, kind, i / 2, date(2024, 1, 1 + i % 28)) for i in ids], SCHEMA).coalesce(1)


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture
def made(spark, tmp_path):
    return VersionedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, [("kind", "identity", "kind"), ("b", "bucket[4]", "id")])


def test_versions(spark, made):
    t = made
    assert t.read().count() == 0 and t.version() == 0
    t.append(rows(spark, range(10)))
    t.append(rows(spark, range(10, 20), "b c/d=%é"))
    t.delete([("id", ">=", 15)])
    t.overwrite(rows(spark, [99]))
    assert [ids(t.read(version=v)) for v in range(5)] == [[], list(range(10)), list(range(20)), list(range(15)), [99]]
    h = {r.version: r for r in t.history().collect()}
    assert [h[v].operation for v in range(5)] == ["create", "append", "append", "delete", "overwrite"]
    assert t.as_of(h[2].time_ms) == 2 and ids(t.read(as_of=h[3].time_ms)) == list(range(15))
    assert t.lineage() == []
    with pytest.raises(NotFound):
        t.read(version=9)
    with pytest.raises(NotFound):
        t.as_of(5)
    with pytest.raises(AlreadyExists):
        VersionedTable.create(spark, t.location, SCHEMA)
    assert ids(t.read(version=2, partitions={"kind": "b c/d=%é"})) == list(range(10, 20))


def test_skipping(spark, made):
    t = made
    t.append(rows(spark, range(100, 150)))
    t.append(rows(spark, range(400, 450)))
    every = t.files().count()
    for where, n in (
        ([("price", "between", (60.0, 65.0))], 11), ([("price", ">=", 300.0)], 0), ([("id", "=", 101)], 1), ([("id", "<", 101)], 1), ([("id", "<=", 101)], 2), ([("id", ">", 448)], 1),
        ([("kind", "=", "z")], 0), ([("day", "=", date(2024, 1, 5))], sum(i % 28 == 4 for i in (*range(100, 150), *range(400, 450)))), ([("id", ">", 120), ("price", "<", 61.0)], 1),
    ):
        assert t.read(where).count() == n, where
        assert t.select_files(where).count() < every or where[0][0] == "day"
    assert t.select_files([("price", ">=", 300.0)]).count() == 0
    with pytest.raises(NotFound):
        t.read([("none", "=", 1)])
    # Nulls and NaN have no bounds that could hide rows.
    t.append(spark.createDataFrame([(None, None, float("nan"), None), (2**62 + 1, "n", None, None)], SCHEMA).coalesce(1))
    assert t.read([("price", ">", 1e9)]).count() == 1 and t.read([("id", "=", 2**62 + 1)]).count() == 1


def test_concurrency(spark, made):
    t = made
    a = t.stage(rows(spark, [1]), SCHEMA, t._meta(0)[1])
    b = t.stage(rows(spark, [2], "b"), SCHEMA, t._meta(0)[1])
    assert t.commit(0, "append", a) == 1
    with pytest.raises(ConcurrentModification):
        t.commit(0, "append", b)
    with pytest.raises(ConcurrentModification):
        t.commit(0, "append", a, rebase=True)
    assert t.commit(0, "append", b, rebase=True) == 2
    lines = t.stage(rows(spark, [3]), SCHEMA, t._meta(0)[1])
    done = []

    def work(k):
        own = VersionedTable(spark, t.location)
        for i in range(4):
            mine = [{**x, "path": f"{x['path']}-{k}-{i}"} for x in lines]
            done.append(own.retrying(lambda s: s.commit(s.version(), "append", mine)))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sorted(done) == list(range(3, 15)) and t.files().count() == 14


def test_maintenance(spark, tmp_path):
    t = VersionedTable.create(spark, f"file://{tmp_path}/m", SCHEMA, [("kind", "identity", "kind")])
    for k in range(3):
        t.append(rows(spark, range(5 * k, 5 * k + 5)))
    t.append(rows(spark, [77], "alone"))
    assert t.files().count() == 4 and t.compaction_plan().select("group").distinct().count() == 1
    v = t.compact()
    assert v == 5 and t.files().count() == 2 and ids(t.read()) == [*range(15), 77] and t.compact() is None
    assert ids(t.read(partitions={"kind": "alone"})) == [77]
    t.pin(2)
    assert t.vacuum() == [] and len(t.vacuum(0, dry_run=True)) == 1
    t.unpin(2)
    assert len(t.vacuum(0)) == 3 and ids(t.read()) == [*range(15), 77]
    assert t.audit().count() == 0
    t.stage(rows(spark, [5]), SCHEMA, t._meta(0)[1])
    assert [r.problem for r in t.audit().collect()] == ["orphan"]
    assert t.clean_orphans() == 1 and t.audit().count() == 0
    t.commit(5, "append", [{"kind": "add", "path": "0" * 32 + "/x.parquet", "bytes": 1, "rows": 1, "part": {}, "low": {"price": 200.0}, "high": {"price": 150.0}}])
    assert sorted(r.problem for r in t.audit().collect()) == ["bounds", "missing"]


def test_evolution(spark, made, tmp_path):
    t = made
    t.append(rows(spark, [1]))
    t.append(rows(spark, [2]).selectExpr("*", "1.5D AS fee"))
    assert t.schema().names == ["id", "kind", "price", "day", "fee"] and t.schema(1).names == SCHEMA.names
    assert sorted((r.id, r.fee) for r in t.read().collect()) == [(1, None), (2, 1.5)]
    with pytest.raises(InvalidArgument):
        t.append(rows(spark, [3]).selectExpr("*", "1 AS more"), additive=False)
    with pytest.raises(InvalidArgument):
        t.append(rows(spark, [3]).selectExpr("id", "kind", "true AS price", "day"))
    narrow = VersionedTable.create(spark, f"file://{tmp_path}/n", StructType.fromDDL("a int"))
    narrow.append(spark.createDataFrame([(1,)], "a int"))
    narrow.append(spark.createDataFrame([(2**40,)], "a long"))
    assert sorted(r.a for r in narrow.read().collect()) == [1, 2**40]
    q = schemas.QUOTE_L1
    change = lambda **kw: StructType([StructField(f.name, kw.get(f.name, f.dataType), False) for f in q])
    assert not schemas.drift(q, change(bid_price=BooleanType())).valid
    assert not schemas.drift(q, StructType(q.fields[1:])).valid
    wide = schemas.drift(q, change(symbol_id=LongType()))
    assert wide.valid and wide.changes and wide.evolved["symbol_id"].dataType == LongType()
    more = StructType([*q.fields, StructField("exchange_fee", DoubleType(), True)])
    assert len(schemas.drift(q, more).evolved) == 8 and not schemas.drift(q, more, additive=False).valid
    assert schemas.drift(change(symbol_id=LongType()), q).notes and q["symbol_id"].dataType == IntegerType()


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.create("crypto", "quotes", SCHEMA).append(rows(spark, [4]))
    assert c.namespaces() == ["crypto"] and c.tables("crypto") == ["quotes"] and c.exists("crypto", "quotes")
    assert spark.sql(f"SELECT count(*) FROM {c.view('crypto', 'quotes')}").head()[0] == 1
    with pytest.raises(InvalidArgument):
        c.load("..", "x")
    c.drop("crypto", "quotes", purge=True)
    assert not c.exists("crypto", "quotes")
    with pytest.raises(NotFound):
        c.load("crypto", "quotes")


HEAD = "timeOpen;timeClose;timeHigh;timeLow;name;open;high;low;close;volume;marketCap;timestamp\n"


def line(day, o, h, lo, c, v):
    return f'"{day}T00:00:00.000Z";"x";"x";"x";"2781";{o};{h};{lo};{c};{v};1000;"{day}T23:59:59.999Z"\n'


def test_csv(spark, tmp_path):
    (tmp_path / "BTC_2026.csv").write_text(HEAD + line("2026-10-29", 100, 110, 90, 105, 500) + line("2026-10-30", 105, 115, 95, 110, 600) + line("2026-10-31", 110, 120, 100, 115, 700))
    r = bars_csv.read(spark, str(tmp_path / "BTC_2026.csv"))
    assert {k: bars_csv.report(r)[k] for k in ("read", "good", "set_aside")} == {"read": 3, "good": 3, "set_aside": 0}
    good, _ = bars_csv.bars(r)
    one = good.orderBy("bar_timestamp_ns").first()
    assert (one.symbol, one.symbol_id, one.bar_timestamp_ns, one.vwap, one.buy_volume) == ("BTC", 1, 1793232000 * 10**9, 101.25, 250.0)
    bars_csv.write(good, str(tmp_path / "out"))
    assert (tmp_path / "out/symbol=BTC/year=2026").is_dir()
    (tmp_path / "bad.csv").write_text(HEAD + line("2026-10-29", 100, 90, 110, 105, 500) + line("2026-10-30", -50, 100, 40, 90, 500) + line("2026-10-31", 100, 120, 80, 110, 1000) + line("nonsense", 1, 1, 1, 1, 1) + line("2026-11-01", "x", 1, 1, 1, 1))
    r = bars_csv.read(spark, str(tmp_path / "bad.csv"))
    n = bars_csv.report(r)
    assert (n["read"], n["good"], n["set_aside"], n["high_low"], n["price"], n["time"], n["number"]) == (5, 1, 4, 1, 1, 1, 1)
    with pytest.raises(Exception, match="broken row"):
        bars_csv.bars(r, quarantine=False)[0].count()
    (tmp_path / "comma.csv").write_text("Date,Open,High,Low,Close\n2026-01-02,1,2,1,2\n")
    assert bars_csv.bars(bars_csv.read(spark, str(tmp_path / "comma.csv")))[0].count() == 1
    (tmp_path / "none.csv").write_text("Date,Open\n2026-01-02,1\n")
    with pytest.raises(InvalidArgument):
        bars_csv.read(spark, str(tmp_path / "none.csv"))
    (tmp_path / "allbad.csv").write_text("Date,Open,High,Low,Close\nx,1,2,1,2\n")
    with pytest.raises(Corruption):
        bars_csv.report(bars_csv.read(spark, str(tmp_path / "allbad.csv")))
