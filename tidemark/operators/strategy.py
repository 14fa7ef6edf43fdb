"""Strategies and position accounting: windows make the columns, an ordered fold keeps the positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import scratch
from . import resting
from .features import donchian
from .fold import ordered_fold


def breakout(bars: DataFrame, lookback: int = 20, stop: float = 0.05, trail: float = 0.08, gate: float | None = None) -> DataFrame:
    """(symbol, day, close, signal, position, entry, gain): long above the channel's high; out at the stop, the trailing stop or below its low.

    signal is 1 at an entry, -1 at an exit and 0 between; gain is an exit's return on its entry. With a gate, a column pt_value
    of at least that much is asked of an entry (null: none). Bars without a full channel give no signal.
    """
    b = donchian(bars, lookback)
    ready = F.lit(True) if gate is None else F.coalesce(F.col("pt_value") >= gate, F.lit(False))
    b = b.where("close is not null").select("symbol", "day", "close", "channel_high", "channel_low", ready.alias("ready"))

    def step(state, row):
        position, entry, peak = state or (0, 0.0, 0.0)
        close, high, low, ready = row[2:6]
        if high != high or high is None:
            return (position, entry, peak), (0, position, None, None)
        if not position:
            if close > high and ready:
                return (1, close, close), (1, 1, close, None)
            return (0, 0.0, 0.0), (0, 0, None, None)
        peak = max(peak, close)
        if close <= entry * (1 - stop) or close <= peak * (1 - trail) or close < low:
            return (0, 0.0, 0.0), (-1, 0, None, close / entry - 1)
        return (1, entry, peak), (0, 1, entry, None)

    return ordered_fold(b, ["symbol"], ["day"], step, "signal int, position int, entry double, gain double").drop("channel_high", "channel_low", "ready")


def pair_trades(spreads: DataFrame, window: int = 30, enter: float = 2.0, leave: float = 0.2, stop: float = 3.5) -> DataFrame:
    """(pair, day, spread, z, signal, state, gain) for spreads (pair, day, spread): the z-score is against the window before the day.

    state is 1 (long the spread) from z of -enter or less, -1 from enter or more, until z is within `leave` of zero or beyond it,
    or past the stop; gain is the spread's move in the trade's favour.
    """
    w = Window.partitionBy("pair").orderBy("day").rowsBetween(-window, -1)
    sd = F.stddev_samp("spread").over(w)
    z = F.when(F.count("spread").over(w) >= window, F.when(sd > 0, (F.col("spread") - F.avg("spread").over(w)) / sd).otherwise(0.0))
    s = spreads.select("pair", "day", "spread", z.alias("z"))

    def step(state, row):
        side, entry = state or (0, 0.0)
        spread, z = row[2], row[3]
        if z is None or z != z:
            return (side, entry), (0, side, None)
        if not side:
            side = 1 if z <= -enter else -1 if z >= enter else 0
            return (side, spread), (side, side, None)
        toward = z * side  # from -enter up to zero
        if toward >= -leave or toward <= -stop:
            return (0, 0.0), (-side, 0, (spread - entry) * side)
        return (side, entry), (0, side, None)

    return ordered_fold(s, ["pair"], ["day"], step, "signal int, state int, gain double")


MAKER, TAKER, SLIPPAGE, TINY = 2e-4, 5e-4, 5e-5, 1e-6


def market_price(fills: DataFrame) -> DataFrame:
    """Market orders (side, bid, ask) with fill_price: the ask of a buy and the bid of a sale, worse by the slippage."""
    return fills.withColumn("fill_price", F.when(F.col("side") == "BUY", F.col("ask") * (1 + SLIPPAGE)).otherwise(F.col("bid") * (1 - SLIPPAGE)))


def positions(fills: DataFrame) -> DataFrame:
    """fills (account, symbol, seq, side, qty, fill_price, maker) with fee, realized, closing, position, avg_entry and cash_change.

    Average-cost accounting for each account and symbol. A fill against the position realizes its gain on the closed part; what
    exceeds the position opens the other side at the old average. A position below TINY is flat.
    """
    f = fills.select("account", "symbol", "seq", "side", "qty", "fill_price", "maker")

    def step(state, row):
        held, avg = state or (0.0, 0.0)
        sign = 1.0 if row[3] == "BUY" else -1.0
        qty, price = row[4], row[5]
        fee = qty * price * (MAKER if row[6] else TAKER)
        realized, closing = 0.0, held * sign < 0
        if not closing:
            avg = (abs(held) * avg + qty * price) / (abs(held) + qty)
            held += sign * qty
        else:
            realized = min(abs(held), qty) * (avg - price) * sign
            held += sign * qty
            if abs(held) < TINY:
                held = avg = 0.0
        return (held, avg), (fee, realized, closing, held, avg, -sign * qty * price - fee)

    return ordered_fold(f, ["account", "symbol"], ["seq"], step, "fee double, realized double, closing boolean, position double, avg_entry double, cash_change double")


def accounts(accounted: DataFrame, marks: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """One row an account: cash, asset_value at the marks (symbol, mark), equity, realized, trades, win_rate, profit_factor.

    The profit factor is 99.9 without losses and 1.0 without either; a symbol without a mark is valued at its last fill.
    """
    last = accounted.groupBy("account", "symbol").agg(F.max(F.struct("seq", "position", "fill_price")).alias("x"))
    value = last.join(marks.select("symbol", "mark"), "symbol", "left").groupBy("account").agg(F.sum(F.col("x.position") * F.coalesce("mark", "x.fill_price")).alias("asset_value"))
    gain, loss = F.sum(F.greatest("realized", F.lit(0.0))), -F.sum(F.least("realized", F.lit(0.0)))
    won, lost = F.count_if(F.col("realized") > 0), F.count_if(F.col("realized") < 0)
    a = accounted.groupBy("account").agg(
        (F.lit(initial) + F.sum("cash_change")).alias("cash"), (F.sum("realized") - F.sum(F.when(F.col("closing"), F.col("fee")).otherwise(0.0))).alias("realized"), F.count("*").alias("trades"),
        F.coalesce(F.try_divide(won * 100.0, won + lost), F.lit(0.0)).alias("win_rate"),
        F.when(loss > 0, gain / F.nullif(loss, F.lit(0.0))).when(gain > 0, 99.9).otherwise(1.0).alias("profit_factor"),
    )
    return a.join(value, "account").withColumn("equity", F.col("cash") + F.col("asset_value"))


def resting_fills(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """(order_id, seq, ts_us, fill_price): the first tick at or after an order's time that meets its price; orders never met give no row.

    orders: order_id, symbol, ts_us, side, type (LIMIT or STOP), price, qty. ticks: symbol, seq, ts_us, bid, ask.
    Orders and ticks are dealt by ranges of symbol and time, so one symbol goes to many tasks, and each range is walked back in
    time once. No order is joined with ticks: what grows is only the rows themselves. Orders that their range leaves open meet,
    in a second walk by symbol, the ticks of later ranges that are first to reach a price.
    """
    spark = orders.sparkSession
    r = resting.rows(orders, ticks)
    # Written, as both walks must see the same ranges.
    resting.backwards(r.repartitionByRange(*resting.KEYS), last=False).write.parquet(at := scratch(spark, "resting"))
    walked = spark.read.schema(r.schema).parquet(at)
    rest = resting.backwards(walked.where(F.col("way") <= resting.TICK).repartition("symbol"), last=True)
    fills = walked.unionByName(rest).where(F.col("way") == resting.FILL)
    first = F.min(F.struct("ts_us", "seq", F.col("x").alias("fill_price"))).alias("x")
    return fills.groupBy("order_id").agg(first).select("order_id", "x.seq", "x.ts_us", "x.fill_price")
