"""Engine strategies, tasks, folds and risk on cases worked out by hand."""

import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import engine, feed, fold, risk, schedule


def day(i):
    return dt.date(2026, 1, 1) + dt.timedelta(days=i)


def test_breakout_moves_on_fills_only(spark):
    closes = [102 + i / 10 for i in range(10)] + [120.0, 121.0, 110.0]
    bars = spark.createDataFrame([("X", day(i), c) for i, c in enumerate(closes)], "symbol string, day date, close double")
    events = engine.breakout_events(bars, lookback=10)
    alone = engine.breakout_orders(events, gate=-1, qty=2, stop=0.05).orderBy("day").collect()
    # Without a fill the position stays flat, so the next bar above the channel orders again.
    assert [(r.order_side, r.order_qty) for r in alone[10:]] == [("BUY", 2.0), ("BUY", 2.0), (None, None)]
    assert all(r.position == 0 for r in alone)
    fills = spark.createDataFrame([("X", day(10), 1, "BUY", 120.0, 2.0, 0.0), ("X", day(12), 1, "SELL", 109.0, 2.0, 1.5)], "symbol string, day date, place int, side string, price double, qty double, fee double")
    r = engine.breakout_orders(events.unionByName(engine.fills(fills)), gate=-1, qty=2, stop=0.05).orderBy("day", "place").collect()
    # The tenth bar already has nine closes before it and breaks out; its order is never filled.
    assert [(x.day, x.order_side, x.order_qty) for x in r if x.order_side] == [(day(9), "BUY", 2.0), (day(10), "BUY", 2.0), (day(12), "SELL", 2.0)]
    assert r[-1].position == 0 and r[-1].realized == 2 * (109 - 120) - 1.5
    assert [x.avg_entry for x in r if x.kind == "BUY"] == [120.0]


def test_pairs(spark):
    prices = [(100.0, 100.0)] * 14 + [(101.0, 100.0)] + [(80.0, 100.0)] * 3
    rows = [(s, day(i), p[k]) for i, p in enumerate(prices) for k, s in enumerate("AB")]
    o = engine.pair_orders(engine.paired_bars(spark.createDataFrame(rows, "symbol string, day date, close double"), "A", "B"), window=15, enter=1.5, qty=3.0).orderBy("day").collect()
    first = next(x for x in o if x.side_a)
    assert (first.day, first.state, first.side_a, first.side_b) == (day(14), -1, "SELL", "BUY") and first.z > 1.5
    assert first.qty_a == 3.0 and first.qty_b == pytest.approx(3.03)
    after = next(x for x in o if x.day == day(15))
    assert after.z < -1.5 and after.state == 0 and (after.side_a, after.side_b) == ("BUY", "SELL")
    uneven = spark.createDataFrame([("A", day(0), 1.0), ("A", day(1), 2.0), ("B", day(2), 5.0), ("B", day(3), 6.0), ("A", day(4), 3.0)], "symbol string, day date, close double")
    got = engine.paired_bars(uneven, "A", "B").orderBy("day").collect()
    assert [(x.day, x.price_a, x.price_b) for x in got] == [(day(2), 2.0, 5.0), (day(4), 3.0, 6.0)]


def test_waves():
    tasks, needs = {"A": 10, "B": 5, "C": 8, "D": 1}, [("B", "A"), ("C", "A"), ("D", "B"), ("D", "C")]
    assert schedule.waves(tasks, needs) == [["A"], ["C", "B"], ["D"]]
    with pytest.raises(ValueError, match="cycle"):
        schedule.waves({"a": 1, "b": 1}, [("a", "b"), ("b", "a")])
    with pytest.raises(ValueError, match="unknown"):
        schedule.waves({"a": 1}, [("a", "z")])
    ran = []
    assert schedule.execute({t: (p, lambda t=t: ran.append(t)) for t, p in tasks.items()}, needs) == ran == ["A", "C", "B", "D"]
    assert schedule.waves({}, []) == []


def test_scheduler(spark):
    t = spark.createDataFrame([("all", 0, 10, False), ("skip", 0, 10, True), ("once", 5, None, False)], "task string, first long, every long, skip_missed boolean")
    r = {(x.task, x.time): (x.due, x.next) for x in schedule.steps(t, [35, 36, 50]).collect()}
    assert [r["all", i] for i in (35, 36, 50)] == [(True, 10), (True, 20), (True, 30)]
    assert [r["skip", i] for i in (35, 36, 50)] == [(True, 40), (False, 40), (True, 60)]
    assert [r["once", i] for i in (35, 36, 50)] == [(True, None), (False, None), (False, None)]
    now = spark.createDataFrame([("a", 5), ("b", 3), ("c", 9)], "task string, next long")
    assert [x.task for x in schedule.due(now, 5).collect()] == ["b", "a"]


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 3), (7, 1)], "k long, o int")
    r = fold.ordered_fold(df, ["k"], ["o"], lambda s, row: (((s or (0,))[0] + 1,), ((s or (0,))[0] + 1,)), "n int")
    assert sorted((x.o, x.n) for x in r.where("k is null").collect()) == [(1, 1), (2, 2), (3, 3)]


def test_total_loss_and_duration(spark):
    rets = spark.createDataFrame([("X", day(i), v) for i, v in enumerate([0.1, -0.5, 0.2, 1.5, -1.0, 0.3])], "symbol string, day date, ret double")
    e = [x.equity for x in risk.drawdown(rets).orderBy("day").collect()]
    assert e == pytest.approx([1.1, 0.55, 0.66, 1.65, 0, 0])
    m = risk.max_drawdown(rets).head()
    assert (m.max_drawdown, m.max_drawdown_duration) == (1.0, 2)
    full = risk.full_report(rets.where("ret > -1")).head()
    assert full.calmar == pytest.approx(full.ann_return / 0.5) and full.n == 5


def test_normal_quantile(spark):
    p = [0.0, 1e-4, 0.01, 0.05, 0.3, 0.5, 0.9, 0.99, 1.0, 1.5]
    got = [r.z for r in spark.createDataFrame([(x,) for x in p], "p double").select(risk.normal_quantile(F.col("p")).alias("z")).collect()]
    assert got[0] == -1e9 and got[-2:] == [1e9, 1e9]
    assert got[1:-2] == pytest.approx([NormalDist().inv_cdf(x) for x in p[1:-2]], abs=1e-7)


def test_marks_of_tied_quotes(spark):
    q = spark.createDataFrame([("X", 1, 10, 1.0), ("X", 3, 10, 3.0), ("X", 2, 10, 2.0), ("X", 4, 11, 4.0)], "symbol string, seq long, ts_us long, last double")
    p = spark.createDataFrame([("X", 10, 1), ("X", 9, 2)], "symbol string, ts_us long, pos_id long")
    assert {x.pos_id: x.mark for x in feed.mark_to_market(p, q).collect()} == {1: 3.0, 2: None}


def test_feed_columns(spark):
    df = spark.createDataFrame([(123.456789,), (1.23456789,), (0.123456789,)], "p double")
    assert [x.p for x in df.select(feed.tick_price(F.col("p")).alias("p")).collect()] == [123.46, 1.2346, 0.123457]
    q = spark.createDataFrame([("X", i, i * 10, 1.0, 2.0, 1.5, i) for i in range(1, 11)], "symbol string, seq long, ts_us long, bid double, ask double, last double, latency_us long")
    assert feed.nearest_rank(q, 0.95).head().latency_us == 10 and feed.nearest_rank(q, 0.5).head().latency_us == 5
    assert feed.latest(q).head().seq == 10
    assert feed.symbols(q, ["x"]).count() == 10


def test_correlations_in_blocks(spark):
    """Many blocks of symbols give what one pair at a time gives, on days that differ from symbol to symbol."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 30)) * 0.01
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = 0.5
    rows = [(f"s{j:02d}", day(i), float(x[i, j])) for i in range(50) for j in range(30) if np.isfinite(x[i, j])]
    df = spark.createDataFrame(rows, "symbol string, day date, ret double")
    got = {(r.a, r.b): (r["corr"], r.covar) for r in risk.correlations(df, block=7).collect()}
    assert len(got) == 30 * 29 // 2
    for (a, b), (corr, covar) in got.items():
        u, v = x[:, int(a[1:])], x[:, int(b[1:])]
        both = np.isfinite(u) & np.isfinite(v)
        assert covar == pytest.approx(np.cov(u[both], v[both])[0, 1], abs=1e-12)
        if "s07" in (a, b):
            assert corr is None
        else:
            assert corr == pytest.approx(np.corrcoef(u[both], v[both])[0, 1], abs=1e-9)
