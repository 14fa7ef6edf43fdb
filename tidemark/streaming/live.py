"""A live feed: prices that walk by geometric Brownian motion, as a batch or as a stream at a given rate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.feed import tick_price

YEAR = 365 * 24 * 3600.0
MOST = 3  # symbols in a cycle


def uniform(*parts: Column) -> Column:
    """A number above 0 and up to 1 that depends on the given values alone."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") + 1) / float(16**12)


def normal(*parts: Column) -> Column:
    """A standard normal number, by Box and Muller, that depends on the given values alone."""
    return F.sqrt(-2 * F.ln(uniform(*parts, F.lit("r")))) * F.cos(2 * math.pi * uniform(*parts, F.lit("a")))


def moves(cycles: DataFrame, symbols: list[tuple[str, float, float]], seconds: float, seed: int = 1) -> DataFrame:
    """(symbol, seq, start, z) for cycles (seq): in each cycle one to MOST symbols move, by a normal step z of their volatility a year.

    symbols: (name, first price, volatility). All ticks of a cycle carry its number.
    """
    names = F.array(*[F.struct(F.lit(n).alias("symbol"), F.lit(p).alias("start"), F.lit(v * math.sqrt(seconds / YEAR)).alias("step")) for n, p, v in symbols])
    c = cycles.select("seq", F.explode(names).alias("s")).select("seq", "s.*")
    # A symbol is among a cycle's if its draw is one of the least, so no cycle is without one.
    draws = F.array_sort(F.array(*[uniform(F.lit(seed), F.col("seq"), F.lit(n)) for n, _, _ in symbols]))
    count = F.floor(uniform(F.lit(seed), F.col("seq"), F.lit("#")) * min(MOST, len(symbols)) - 1e-12).cast("int")
    own = uniform(F.lit(seed), F.col("seq"), F.col("symbol"))
    c = c.where(own <= F.get(draws, F.greatest(count, F.lit(0))))
    return c.select("symbol", "seq", "start", (F.col("step") * normal(F.lit(seed), F.col("seq"), F.col("symbol"))).alias("z"))


def quoted(ticks: DataFrame, spread: float = 2e-4) -> DataFrame:
    """Adds bid and ask about last, all rounded by price level."""
    half = F.col("last") * spread / 2
    return ticks.select("symbol", "seq", tick_price(F.col("last") - half).alias("bid"), tick_price(F.col("last") + half).alias("ask"), tick_price(F.col("last")).alias("last"))


def replay(spark: SparkSession, n: int, symbols: list[tuple[str, float, float]], seconds: float = 1.0, seed: int = 1) -> DataFrame:
    """The first n cycles as a batch: symbol, seq, bid, ask, last."""
    m = moves(spark.range(n).select(F.col("id").alias("seq")), symbols, seconds, seed)
    w = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return quoted(m.select("symbol", "seq", (F.col("start") * F.exp(F.sum("z").over(w))).alias("last")))


def live(spark: SparkSession, symbols: list[tuple[str, float, float]], cycles_per_batch: int = 10, ms_per_batch: int = 1000, seconds: float = 1.0, seed: int = 1) -> DataFrame:
    """The same feed as a stream: the walk of each symbol is kept in state, so its prices are those of `replay`."""
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", cycles_per_batch).option("advanceMillisPerBatch", ms_per_batch).load()
    m = moves(source.select(F.col("value").alias("seq")), symbols, seconds, seed)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("seq")
        walk = at + rows["z"].cumsum()
        state.update((float(walk.iloc[-1]),))
        yield pd.DataFrame({"symbol": key[0], "seq": rows["seq"], "log": walk, "start": rows["start"]})

    out = m.groupBy("symbol").applyInPandasWithState(run, "symbol string, seq long, log double, start double", "log double", "append", GroupStateTimeout.NoTimeout)
    return quoted(out.select("symbol", "seq", (F.col("start") * F.exp("log")).alias("last")))
