"""Queries on versioned tables, files and CSV bars. Each builds its table in the shared folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.market import table
from ..sources import bars_csv, versioned
from ..sources.storage import scratch
from .registry import BARS, _bars, _round, query

_LINES = "l_orderkey, l_linenumber, l_quantity, l_returnflag"


def _versions(spark, d):
    """A table of three versions after its creation: order keys not divisible by 3, then the others, then without quantities above 45."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    t = versioned.VersionedTable.create(spark, scratch(spark, "lines"), lines.schema, [("flag", "identity", "l_returnflag"), ("year", "year", "l_shipdate")])
    t.append(lines.where("l_orderkey % 3 > 0"))
    t.append(lines.where("l_orderkey % 3 = 0"))
    return t


@query(f"SELECT 1 AS at, {_LINES} FROM lineitem WHERE l_orderkey % 3 > 0 UNION ALL SELECT 2 AS at, {_LINES} FROM lineitem UNION ALL SELECT 3 AS at, {_LINES} FROM lineitem WHERE l_quantity <= 45")
def time_travel(spark, d):
    t = _versions(spark, d)
    t.delete([("l_quantity", ">", 45.0)])
    at = lambda v: t.read(version=v).select(F.lit(v).alias("at"), *_LINES.split(", "))
    return at(1).unionByName(at(2)).unionByName(at(3))


@query(f"SELECT {_LINES} FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate >= TIMESTAMP '1995-06-01' AND l_shipdate <= TIMESTAMP '1996-03-01' AND l_orderkey < 20000")
def skipping_scan(spark, d):
    where = [("l_shipdate", "between", (datetime(1995, 6, 1), datetime(1996, 3, 1))), ("l_orderkey", "<", 20000)]
    return _versions(spark, d).read(where, partitions={"flag": "A"}).select(*_LINES.split(", "))


@query(f"SELECT {_LINES} FROM lineitem")
def compaction_equivalence(spark, d):
    t = _versions(spark, d)
    t.compact()
    return t.read().select(*_LINES.split(", "))


@query(f"WITH {BARS}, n AS (SELECT *, CAST(epoch_us(CAST(day AS TIMESTAMP)) * 1000 AS BIGINT) AS ns FROM bars) SELECT symbol, ns AS bar_timestamp_ns, round(open, 9) + 0.0 AS open, round(high, 9) + 0.0 AS high, round(low, 9) + 0.0 AS low, round(close, 9) + 0.0 AS close, round(volume, 9) + 0.0 AS volume FROM n")
def csv_roundtrip_ingest(spark, d):
    at = scratch(spark, "csv")
    rows = _bars(spark, d).select("symbol", F.concat(F.col("day").cast("string"), F.lit("T00:00:00.000Z")).alias("timeOpen"), "open", "high", "low", "close", "volume", F.col("market_cap").alias("marketCap"))
    rows.repartition("symbol").write.partitionBy("symbol").option("header", True).option("sep", ";").csv(f"{at}/raw")
    read = bars_csv.read(spark, f"{at}/raw")
    good, _ = bars_csv.bars(read)
    return _round(good.select("symbol", "bar_timestamp_ns", "open", "high", "low", "close", "volume"), "open", "high", "low", "close", "volume", places=9)


def _paths(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("part-"), F.col("o_orderkey").cast("string")).alias("path"), "o_orderkey")
    return o.where("o_orderkey % 5 > 0").drop("o_orderkey"), o.where("o_orderkey % 7 > 0").drop("o_orderkey")


@query("SELECT 'part-' || o_orderkey AS path FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 = 0")
def orphan_files(spark, d):
    return versioned.orphan_files(*_paths(spark, d))


@query("SELECT 'part-' || o_orderkey AS path FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 > 0")
def missing_files(spark, d):
    return versioned.missing_files(*_paths(spark, d))


@query("SELECT event_id, strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS on_day, strftime(ts, '%Y-%m-%d-%H') AS hour, coalesce(nullif(event_type, 'click'), 'null') AS kind FROM events")
def partition_transforms(spark, d):
    v = versioned.partition_value
    ts = versioned.ns_time(F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    return table(spark, d, "events").select("event_id", *[v(ts, t).alias(a) for t, a in (("year", "year"), ("month", "month"), ("day", "on_day"), ("hour", "hour"))], v(F.nullif(F.col("event_type"), F.lit("click")), "identity").alias("kind"))
