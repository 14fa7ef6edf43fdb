"""Streaming queries, run over all of a table as a stream; their SQL is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.market import quotes, table
from ..sources.storage import scratch
from ..streaming import bars, feed, pipeline
from .registry import QUOTES, _round, query


def _stream(spark, d):
    """The events as a stream of one table's files."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/[e]vents.parquet")  # a pattern, as a stream takes no single file


@query(
    """WITH t AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start FROM events)
SELECT symbol, CAST(epoch(start) AS BIGINT) AS start, round(arg_min(price, struct_pack(a := ts, b := seq)), 6) + 0.0 AS open, round(max(price), 6) + 0.0 AS high, round(min(price), 6) + 0.0 AS low, round(arg_max(price, struct_pack(a := ts, b := seq)), 6) + 0.0 AS close, CAST(sum(user_id) AS BIGINT) AS volume, count(*) AS ticks
FROM t GROUP BY symbol, start HAVING start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
)
def stream_bars(spark, d):
    ticks = _stream(spark, d).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.col("user_id").alias("size"))
    b = pipeline.run_to_end(bars.bars(ticks, "6 hours"), scratch(spark, "bars"))
    return _round(b.select("symbol", F.unix_seconds("start").alias("start"), "open", "high", "low", "close", "volume", "ticks"), "open", "high", "low", "close")


@query(
    f"""WITH {QUOTES}, l AS (SELECT *, lag(seq) OVER (PARTITION BY symbol ORDER BY ts_us, seq) AS p FROM quotes)
SELECT symbol, 'gap' AS type, seq, p + 1 AS expected FROM l WHERE seq > p + 1 UNION ALL SELECT symbol, 'out_of_order' AS type, seq, p + 1 AS expected FROM l WHERE seq <= p
UNION ALL SELECT symbol, 'crossed' AS type, seq, seq AS expected FROM l WHERE bid > 0 AND ask > 0 AND bid >= ask"""
)
def stream_feed_monitor(spark, d):
    a = pipeline.run_to_end(feed.anomalies(quotes(_stream(spark, d)), silent_ms=None), scratch(spark, "feed"))
    return a.select("symbol", "type", "seq", "expected")
