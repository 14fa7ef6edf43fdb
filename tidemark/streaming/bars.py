"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(symbol, start, end, open, high, low, close, volume, ticks) of ticks (symbol, ts timestamp, seq, price, size).

    Works on batches and streams alike. In append mode a window comes out once its end is `late` behind the newest tick;
    later ticks for it are dropped. The state is one row for each open window of each symbol.
    """
    w = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    at = F.struct("ts", "seq", "price")
    b = w.agg(F.min(at)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(at)["price"].alias("close"), F.sum("size").alias("volume"), F.count("*").alias("ticks"))
    return b.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume", "ticks")


def distinct_ticks(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Ticks without repeats of a symbol's sequence number that arrive within the delay."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "seq"])
