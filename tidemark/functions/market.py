"""Market shapes made from the trade-like tables: daily bars and quote packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """symbol, day, open, high, low, close, volume, vwap, market_cap, tick_count: one row per symbol and day."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    trades = lineitem.where("l_quantity > 0").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("day"), price.alias("price"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("v"),
    )
    return trades.groupBy("symbol", "day").agg(
        F.min(F.struct("seq", "price"))["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(F.struct("seq", "price"))["price"].alias("close"),
        F.sum("q").alias("volume"), (F.sum("v") / F.sum("q")).alias("vwap"), F.sum("v").alias("market_cap"), F.count("*").alias("tick_count"),
    )


def quotes(events: DataFrame) -> DataFrame:
    """symbol, seq, ts_us, bid, ask, last, latency_us: a quote packet from each event."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), ts.alias("ts_us"), (F.col("value") - (F.col("user_id") % 3 - 1) * 0.01).alias("bid"),
        (F.col("value") + 0.01).alias("ask"), F.col("value").alias("last"), ((F.col("event_id") * 7919) % 5000).alias("latency_us"), "user_id",
    )


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c, places) + F.lit(0.0)
