"""Quote-feed monitoring in batch form, filters, routing and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fold import ordered_fold


def arrival():
    return Window.partitionBy("symbol").orderBy("ts_us", "seq")


def gaps(quotes: DataFrame) -> DataFrame:
    """Adds gap (sequence numbers missing since the packet before) and out_of_order."""
    last = F.lag("seq").over(arrival())
    return quotes.withColumns({"gap": F.greatest(F.col("seq") - last - 1, F.lit(0)), "out_of_order": F.coalesce(F.col("seq") <= last, F.lit(False))})


def jitter(quotes: DataFrame) -> DataFrame:
    """Adds jitter_us: change of the time between packets; null before the third packet."""
    q = quotes.withColumn("delta_us", F.col("ts_us") - F.lag("ts_us").over(arrival()))
    before = F.lag("delta_us").over(arrival())
    return q.withColumn("jitter_us", F.when(before > 0, F.abs(F.col("delta_us") - before)))


def crossed(quotes: DataFrame) -> DataFrame:
    return quotes.where("bid > 0 and ask > 0 and bid >= ask")


def stats(quotes: DataFrame) -> DataFrame:
    """Per symbol: packets, gaps, out-of-order and crossed counts, latency bounds and mean."""
    return gaps(quotes).groupBy("symbol").agg(
        F.count("*").alias("packets"), F.sum(F.coalesce("gap", F.lit(0))).alias("gap_total"), F.count_if("out_of_order").alias("out_of_order"),
        F.count_if((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("bid") >= F.col("ask"))).alias("crossed"),
        F.min("latency_us").alias("latency_min"), F.max("latency_us").alias("latency_max"), F.avg("latency_us").alias("latency_avg"),
    )


def last_n(quotes: DataFrame, n: int) -> DataFrame:
    """The last n packets of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts_us"), F.desc("seq"))
    return quotes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def late_p99(quotes: DataFrame, n: int = 1000) -> DataFrame:
    """99th percentile of the latencies of each symbol's last n packets: the value of rank floor(0.99 (n - 1))."""
    got = last_n(quotes, n).groupBy("symbol").agg(F.array_sort(F.collect_list("latency_us")).alias("all"))
    return got.select("symbol", F.get("all", F.floor(0.99 * (F.size("all") - 1)).cast("int")).alias("p99_us"))


def route(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Deliveries (subscriber, event_id): one by topic and one by type, at the subscriber's least priority or above.

    subscriptions: subscriber, topic, type, min_priority. Two equi-joins and a union, so an event may be delivered twice.
    """
    by_topic = events.join(subscriptions.where("topic is not null"), "topic").where("priority >= min_priority").select("subscriber", "event_id", F.lit("topic").alias("via"))
    by_type = events.join(subscriptions.where("type is not null").drop("topic"), "type").where("priority >= min_priority").select("subscriber", "event_id", F.lit("type").alias("via"))
    return by_topic.unionByName(by_type)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mark_to_market(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """As-of join: each position row (symbol, ts_us, pos_id) with the last quote at its time or before; of quotes at one time, that of the largest seq.

    A union ordered by time and one window, so that a symbol's rows are sorted once and never paired.
    """
    p = positions.select("symbol", "ts_us", "pos_id", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("double").alias("last"), F.lit(1).alias("kind"))
    q = quotes.select("symbol", "ts_us", F.lit(None).cast("long").alias("pos_id"), F.col("seq").cast("long").alias("seq"), "last", F.lit(0).alias("kind"))
    w = Window.partitionBy("symbol").orderBy("ts_us", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return p.unionByName(q).withColumn("mark", F.last("last", ignorenulls=True).over(w)).where("kind = 1").select("symbol", "ts_us", "pos_id", "mark")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def jitter_average(quotes: DataFrame, decay: float = 0.95) -> DataFrame:
    """(symbol, seq, mean_jitter): the exponentially weighted mean of the jitter, 0 before the first; a null jitter leaves it."""

    def step(state, row):
        mean = 0.0 if state is None else state[0]
        j = row[3]
        mean = mean if j is None or j != j else decay * mean + (1 - decay) * j
        return (mean,), (mean,)

    j = jitter(quotes).select("symbol", "ts_us", "seq", F.col("jitter_us").cast("double").alias("jitter_us"))
    return ordered_fold(j, ["symbol"], ["ts_us", "seq"], step, "mean_jitter double").select("symbol", "seq", "mean_jitter")


def latest(quotes: DataFrame) -> DataFrame:
    """Market snapshot: the last packet of each symbol, by seq. An aggregation, so it also runs on a stream in update mode."""
    return quotes.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in quotes.columns if c != "symbol"]), "seq").alias("x")).select("symbol", "x.*")


def symbols(df: DataFrame, names: list[str], column: str = "symbol") -> DataFrame:
    """Rows whose symbol is one of the names, whatever the case."""
    return df.where(F.lower(column).isin([n.lower() for n in names]))


def tick_price(price: Column) -> Column:
    """A price rounded by its level: 2 digits from 100 up, 4 from 1 up, 6 below."""
    return F.when(price >= 100, F.round(price, 2)).when(price >= 1, F.round(price, 4)).otherwise(F.round(price, 6))


def nearest_rank(values: DataFrame, p: float, by: str = "symbol", value: str = "latency_us") -> DataFrame:
    """(by, value): the value of rank ceil(p n), from 1, in each group."""
    return values.groupBy(by).agg(F.expr(f"percentile_disc({float(p)}) WITHIN GROUP (ORDER BY {value})").alias(value))


def counters(quotes: DataFrame, stale_us: int, spike_us: int) -> DataFrame:
    """Per symbol the counts of `stats`, and stale (a pause of more than stale_us before the packet) and spikes (latency above spike_us)."""
    q = jitter(quotes)
    more = q.groupBy("symbol").agg(F.count_if(F.col("delta_us") > stale_us).alias("stale"), F.count_if(F.col("latency_us") > spike_us).alias("spikes"), F.avg("jitter_us").alias("jitter_avg"))
    return stats(quotes).join(more, "symbol")
