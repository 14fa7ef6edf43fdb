"""Strategies as an order-driven engine runs them: bars make orders, and only fills move the position."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import donchian, returns, rolling_cpt
from .fold import ordered_fold

FLAT = 1e-9


def breakout_events(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Bars as events (symbol, day, place, kind, close, high, low, cpt): the channel needs lookback - 1 closes before the bar, the
    prospect theory value of the last 2 * lookback returns needs 10 and is 0 before."""
    b = returns(donchian(bars.where("close is not null"), lookback, lookback - 1))
    b = rolling_cpt(b, ("close", "channel_high", "channel_low"), window=2 * lookback, least=10)
    return b.select(
        "symbol", "day", F.lit(0).alias("place"), F.lit("bar").alias("kind"), "close", F.col("channel_high").alias("high"), F.col("channel_low").alias("low"),
        F.coalesce("pt_value", F.lit(0.0)).alias("cpt"), F.lit(None).cast("double").alias("qty"), F.lit(None).cast("double").alias("fee"),
    )


def fills(events: DataFrame) -> DataFrame:
    """Fills (symbol, day, place, side, price, qty, fee) as events: `kind` is the side, `close` the price. On one day they come by place, from 1."""
    none = F.lit(None).cast("double")
    return events.select("symbol", "day", "place", F.col("side").alias("kind"), F.col("price").alias("close"), none.alias("high"), none.alias("low"), none.alias("cpt"), "qty", "fee")


def breakout_orders(
    events: DataFrame, gate: float = 0.02, qty: float = 1.0, stop: float = 0.03, trail: float = 0.05, fill_at_close: bool = False
) -> DataFrame:
    """Events with order_side, order_qty, position, avg_entry and realized after each.

    Flat and above the channel with a value of at least the gate, a bar orders qty; long, it orders the position sold at the stop, the
    trailing stop or below the channel. The peak follows from the bar that ordered. A sale's fill realizes its gain less its fee. With
    fill_at_close an order is filled at once, at the bar's close, without a fee; else nothing moves until a fill comes.
    """

    def filled(held, avg, peak, gain, side, price, n, fee):
        if side == "BUY":
            new = held + n
            return new, ((held * avg + n * price) / new if new > 0 else avg), peak, gain
        gain += min(held, n) * (price - avg) - fee
        held -= n
        return (0.0, 0.0, 0.0, gain) if held <= FLAT else (held, avg, peak, gain)

    def step(state, row):
        held, avg, peak, gain = state or (0.0, 0.0, 0.0, 0.0)
        kind, close, high, low, cpt, n, fee = row[3:10]
        side, amount = None, None
        if kind != "bar":
            held, avg, peak, gain = filled(held, avg, peak, gain, kind, close, n, fee or 0.0)
        elif high is not None and high == high:
            if held <= FLAT:
                if close > high and cpt >= gate:
                    side, amount, peak = "BUY", qty, close
            else:
                peak = max(peak, close)
                if close <= avg * (1 - stop) or close <= peak * (1 - trail) or close < low:
                    side, amount = "SELL", held
            if side and fill_at_close:
                held, avg, peak, gain = filled(held, avg, peak, gain, side, close, amount, 0.0)
        return (held, avg, peak, gain), (side, amount, held, avg, gain)

    e = events.select("symbol", "day", "place", "kind", "close", "high", "low", "cpt", "qty", "fee")
    return ordered_fold(e, ["symbol"], ["day", "place"], step, "order_side string, order_qty double, position double, avg_entry double, realized double")


def paired_bars(bars: DataFrame, a: str, b: str) -> DataFrame:
    """(pair, day, price_a, price_b): one row whenever both legs have had a bar since the row before; of a leg's several bars the last counts."""
    legs = bars.where(F.col("symbol").isin(a, b) & F.col("close").isNotNull())
    legs = legs.select(F.lit(f"{a}/{b}").alias("pair"), "day", (F.col("symbol") == b).cast("int").alias("leg"), "close")

    def step(state, row):
        prices, new = list(state[0]) if state else [0.0, 0.0], list(state[1]) if state else [False, False]
        prices[row[2]], new[row[2]] = row[3], True
        if all(new):
            return (tuple(prices), (False, False)), (prices[0], prices[1])
        return (tuple(prices), tuple(new)), (None, None)

    out = ordered_fold(legs, ["pair"], ["day", "leg"], step, "price_a double, price_b double")
    return out.where("price_a is not null").select("pair", "day", "price_a", "price_b")


def pair_orders(paired: DataFrame, window: int = 30, hedge: float = 1.0, enter: float = 2.0, leave: float = 0.2, stop: float = 3.5, qty: float = 1.0) -> DataFrame:
    """(pair, day, price_a, price_b, z, state, side_a, qty_a, side_b, qty_b) for paired bars: the z-score's window holds the day itself.

    An entry trades qty of the first leg against qty * hedge * price_a / price_b of the second; an exit trades back what the entry did. Rows
    with a price of 0 or less change nothing; a window without spread has a z of 0 and trades nothing.
    """

    def step(state, row):
        past, side, held = state or (deque(maxlen=window), 0, 0.0)
        a, b = row[2], row[3]
        none = (None, side, None, None, None, None)
        if a <= 0 or b <= 0:
            return (past, side, held), none
        past.append(math.log(a) - hedge * math.log(b))
        if len(past) < window:
            return (past, side, held), none
        mean = sum(past) / window
        sd = math.sqrt(sum((x - mean) ** 2 for x in past) / (window - 1))
        if sd < 1e-8:
            return (past, side, held), (0.0, side, None, None, None, None)
        z = (past[-1] - mean) / sd
        if not side:
            side = 1 if z <= -enter else -1 if z >= enter else 0
            if not side:
                return (past, 0, 0.0), (z, 0, None, None, None, None)
            held = qty * hedge * (a / b)
            names = ("BUY", "SELL") if side > 0 else ("SELL", "BUY")
            return (past, side, held), (z, side, names[0], qty, names[1], held)
        if z * side >= -leave or z * side <= -stop:
            names = ("SELL", "BUY") if side > 0 else ("BUY", "SELL")
            return (past, 0, 0.0), (z, 0, names[0], qty, names[1], held)
        return (past, side, held), (z, side, None, None, None, None)

    adds = "z double, state int, side_a string, qty_a double, side_b string, qty_b double"
    return ordered_fold(paired.select("pair", "day", "price_a", "price_b"), ["pair"], ["day"], step, adds)
