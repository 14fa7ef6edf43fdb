"""Resting orders against a plain reading, and the rows that pass through the plan."""

import math
import random

import pytest

from tidemark.operators import strategy

ORDERS = "order_id long, symbol string, ts_us long, side string, type string, price double, qty double"
TICKS = "symbol string, seq long, ts_us long, bid double, ask double"


@pytest.fixture
def small_batches(spark):
    """Many ranges, and batches of a few rows, so that symbols run through both."""
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def plain(orders, ticks):
    """{order_id: (seq, ts_us, fill_price)}; NaN is above all numbers, null meets nothing."""
    key = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
    ticks = sorted((t for t in ticks if t[0] is not None and t[2] is not None), key=lambda t: (t[2], t[1]))
    out = {}
    for i, symbol, at, side, kind, price, _ in orders:
        if symbol is None or at is None or price is None:
            continue
        for s, seq, ts, bid, ask in ticks:
            quote = ask if side == "BUY" else bid
            if s != symbol or ts < at or quote is None:
                continue
            low = (side == "BUY") == (kind == "LIMIT")
            if key(quote) <= key(price) if low else key(quote) >= key(price):
                out[i] = min(out.get(i, (ts, seq, quote)), (ts, seq, quote))
                break
    return {i: (seq, ts, repr(p + 0.0)) for i, (ts, seq, p) in out.items()}


def filled(spark, orders, ticks):
    r = strategy.resting_fills(spark.createDataFrame(orders, ORDERS), spark.createDataFrame(ticks, TICKS)).collect()
    assert len(r) == len({x.order_id for x in r})
    return {x.order_id: (x.seq, x.ts_us, repr(x.fill_price + 0.0)) for x in r}


def some(seed, n, symbols, span, price):
    """n orders and n ticks; both share times, and order numbers may come from any time."""
    g = random.Random(seed)
    orders = [(i, g.choice(symbols), g.randrange(span), g.choice(["BUY", "SELL"]), g.choice(["LIMIT", "STOP"]), price(g, g.randrange(span)), 1.0) for i in range(n)]
    at = sorted(g.randrange(span) for _ in range(n))
    return orders, [(g.choice(symbols), j, at[j], price(g, at[j]), price(g, at[j])) for j in range(n)]


CASES = {
    "few prices": (["a", "b", "c"], 200, lambda g, at: float(g.randrange(12))),
    "one time": (["a"], 1, lambda g, at: float(g.randrange(40))),
    "one symbol": (["a"], 10**7, lambda g, at: g.gauss(0, 5)),
    "falling": (["a", "b"], 5000, lambda g, at: -float(at) + g.choice([0.0, 0.5])),
    "rising": (["a"], 5000, lambda g, at: float(at)),
    "many symbols": ([f"s{i}" for i in range(150)] + [None], 10**10, lambda g, at: g.uniform(1, 9)),
    "odd prices": (["a", "b", ""], 300, lambda g, at: g.choice([None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.0, -1.0, 5e-324])),
}


@pytest.mark.parametrize("name", CASES)
def test_first_met(spark, small_batches, name):
    symbols, span, price = CASES[name]
    orders, ticks = some(name, 400, symbols, span, price)
    got, want = filled(spark, orders, ticks), plain(orders, ticks)
    assert got == want and want


def test_same_order_twice(spark, small_batches):
    orders = [(1, "a", 10, "BUY", "LIMIT", 5.0, 1.0), (1, "a", 10, "BUY", "LIMIT", 5.0, 1.0), (2, "a", 0, "SELL", "STOP", 1.0, 1.0), (2, "b", 9, "BUY", "STOP", 3.0, 1.0)]
    ticks = [("a", 1, 10, 2.0, 5.0), ("a", 1, 10, 2.0, 5.0), ("b", 2, 9, 2.0, 4.0), ("a", 3, 7, 1.0, 9.0)]
    assert filled(spark, orders, ticks) == {1: (1, 10, "5.0"), 2: (3, 7, "1.0")}
    assert filled(spark, orders, []) == filled(spark, [], ticks) == {}


def test_rows_in_proportion(spark):
    """Of orders and ticks in one hour no step makes more rows than a few times what it was given."""
    n = 3000
    orders, ticks = some(1, n, ["a"], 3_600_000_000, lambda g, at: g.uniform(1, 9))
    sc = spark.sparkContext._jsc.sc()
    store = spark._jsparkSession.sharedState().statusStore()
    begun = store.executionsCount()
    assert filled(spark, orders, ticks) == plain(orders, ticks)
    sc.listenerBus().waitUntilEmpty(30_000)
    most = 0
    ids = store.executionsList()
    assert ids.size() > begun
    for i in range(begun, ids.size()):
        at = ids.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for k in range(metrics.size()):
                m = metrics.apply(k)
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    assert n <= most <= 4 * n
