"""Literal cases: folds, models, weights, codecs, streams."""

import math
import struct
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs
from tidemark.operators import features, forest, metrics, models, portfolio, quality, risk, strategy, volatility
from tidemark.operators.fold import ordered_fold
from tidemark.sources import schemas
from tidemark.sources.errors import Corruption, InvalidArgument
from tidemark.streaming import feed, pipeline


def series(spark, values, column="ret", symbol="s"):
    return spark.createDataFrame([(symbol, date(2020, 1, 1) + timedelta(i), float(v)) for i, v in enumerate(values)], f"symbol string, day date, {column} double")


def test_fold(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = ordered_fold(df, ["k"], ["id"], lambda s, r: (((s or (0,))[0] + r[1],), ((s or (0,))[0] + r[1],)), "total long").toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = got.sort_values("id").groupby("k").id.cumsum()
    assert (got.sort_values("id").total == want).all()


def test_garch(spark):
    calm, shock = [0.01] * 50, [0.01] * 50 + [-0.08]
    last = lambda v: volatility.garch_path(series(spark, v), 1e-5, 0.09, 0.89).orderBy(F.desc("day")).first().variance
    assert last(shock) > last(calm)
    f = volatility.fit(series(spark, shock), 0.09, 0.89)
    r = volatility.forecast(f, [0, 1, 10, 100], 0.09, 0.89).toPandas().set_index("horizon").variance
    assert (r > 0).all() and r[0] == r[1] and r[100] < r[10] < r[1]
    assert volatility.fit(series(spark, shock), 0.2, 0.9).first().long_run is None
    names = spark.createDataFrame([(0.25,), (1.0,), (2.0,), (9.0,), (0.0001,)], "v double").select(volatility.regime(F.col("v"), F.lit(1.0)).alias("r")).collect()
    assert [r.r for r in names] == ["low", "normal", "elevated", "extreme", "low"]


def test_breakout(spark):
    closes = [102.0 + i / 10 for i in range(10)] + [120, 120, 110]
    r = strategy.breakout(series(spark, closes, "close"), 10, 0.05, 0.05).where("signal <> 0").orderBy("day").collect()
    assert [(x.close, x.signal) for x in r] == [(120, 1), (110, -1)] and r[1].gain == pytest.approx(110 / 120 - 1)
    gated = series(spark, closes, "close").withColumn("pt_value", F.lit(0.0))
    assert strategy.breakout(gated, 10, gate=0.02).where("signal <> 0").count() == 0


def test_pairs(spark):
    spread = [0.0] * 15 + [math.log(0.8)] * 3
    s = series(spark, np.array(spread) + np.tile([0.001, -0.001], 9), "spread").withColumnRenamed("symbol", "pair")
    r = strategy.pair_trades(s, window=15, enter=1.5).orderBy("day").collect()
    assert r[15].z < -1.5 and r[15].state == 1 and r[15].signal == 1


def test_positions(spark):
    f = spark.createDataFrame([("a", "X", 1, "BUY", 2.0, 100.0, False), ("a", "X", 2, "BUY", 2.0, 110.0, False), ("a", "X", 3, "SELL", 4.0, 120.0, True), ("a", "X", 4, "SELL", 1.0, 50.0, False)], "account string, symbol string, seq long, side string, qty double, fill_price double, maker boolean")
    p = strategy.positions(f)
    r = p.orderBy("seq").collect()
    assert [x.position for x in r] == [2, 4, 0, -1] and r[1].avg_entry == 105 and r[2].realized == 60 and r[2].fee == pytest.approx(480 * 2e-4) and r[3].avg_entry == 50
    a = strategy.accounts(p, spark.createDataFrame([("X", 40.0)], "symbol string, mark double"), 1000.0).first()
    assert a.equity == pytest.approx(1000 + 60 + 10 - sum(x.fee for x in r)) and a.win_rate == 100 and a.profit_factor == 99.9 and a.trades == 4


def test_risk(spark):
    r = risk.report(series(spark, [-0.05 - 0.001 * i for i in range(51)] + [0.001] * 949)).first()
    assert r.es >= r.hist_var > 0
    d = risk.drawdown(series(spark, [0.1, -0.5, 0.2])).agg(F.max("drawdown")).first()[0]
    assert d == pytest.approx(0.5)


def test_cpt_and_skew(spark):
    v = [0.001] * 60
    v[10], v[25], v[40] = 0.25, 0.35, -0.05
    assert features.rolling_cpt(series(spark, v)).orderBy(F.desc("day")).first().pt_value > 0
    assert features.rolling_cpt(series(spark, v[:20])).where("pt_value is not null").count() == 0
    s = series(spark, [-0.01, -0.01, 0, 0.01, 0.15]).agg(features.adjusted_skewness(F.col("ret"))).first()[0]
    assert s == pytest.approx(2.156505302229288)


def test_forest(spark):
    rows = spark.createDataFrame([(0.10, 1.5, 0.20, 0.08, 0.08), (0.01, 0.1, 0.03, 0.02, 0.01), (None,) * 5], "pt_value double, roll_skew double, roll_max double, roll_vol double, turnover double")
    a, b, c = forest.scored(rows).collect()
    assert a.probability >= 0.7 and a.predicted == 1 and a.alert and b.probability < 0.4 and b.predicted == 0 and c.probability == pytest.approx(0.09)


def test_metrics(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 40, 3000) / 40, rng.integers(0, 2, 3000)
    df = spark.createDataFrame(pd.DataFrame({"score": s, "label": y}))
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first().auc == pytest.approx(auc)
    none = metrics.roc_auc(df.limit(0)).first()
    assert none.auc is None and none.positives == 0 and metrics.confusion(df.limit(0)).first().f1 == 0
    c = metrics.roc_curve(df).orderBy("score").collect()
    assert len(c) == 40 and c[0].tpr == 1 and c[0].fpr == 1


def test_portfolio():
    x = np.array([[0.01, -0.008], [0.02, -0.018], [0.04, -0.035]]).repeat(25, 1)
    cov = np.cov(x) * (0.85 + 0.15 * np.eye(3))
    assert portfolio.equal(3).tolist() == [1 / 3] * 3
    iv = portfolio.inverse_volatility(cov)
    assert iv[0] > iv[2]
    for w in (portfolio.minimum_variance(cov), portfolio.max_sharpe(cov, np.array([0.05, 0.1, 0.18])), portfolio.risk_parity(cov)):
        assert (w >= 0).all() and w.sum() == pytest.approx(1)
    rc = portfolio.risk_parity(cov) * (cov @ portfolio.risk_parity(cov))
    assert np.ptp(rc) < 1e-6 * rc.max() + 1e-12
    assert portfolio.metrics(iv, cov, np.zeros(3))["diversification"] >= 1
    assert len(portfolio.risk_parity(np.zeros((0, 0)))) == 0


def test_codecs(spark):
    x = [100.25, 100.25, 100.5, 100.75, 100.75, 101.125, 101.125, 101.0]
    e = codecs.xor_encode(x)
    assert codecs.xor_decode(e) == x and codecs.xor_decode(codecs.xor_encode([])) == []
    with pytest.raises(InvalidArgument):
        codecs.xor_encode([1.0, float("nan")])
    with pytest.raises(Corruption):
        codecs.xor_decode(e[: len(e) // 2])
    rng = np.random.default_rng(1)
    y = rng.standard_normal(2000).tolist()
    assert codecs.xor_decode(codecs.xor_encode(y)) == y
    t0 = 17 * 10**17
    t = [t0, t0 + 10**9, t0 + 2 * 10**9, t0 + 3 * 10**9, t0 + 45 * 10**8]
    assert codecs.delta_decode(codecs.delta_encode(t)) == t
    with pytest.raises(Corruption):
        codecs.delta_encode([1000, 2000, 1500, 3000])
    assert codecs.delta_decode(codecs.delta_encode([1000, 2000, 1500], regress=True)) == [1000, 2000, 1500]
    with pytest.raises(Corruption):
        codecs.delta_encode([1, 2, 2, 4], strict=True)
    assert codecs.crc32c(b"123456789") == 0xE3069283 and codecs.crc32c(b"6789", codecs.crc32c(b"12345")) == 0xE3069283
    df = spark.createDataFrame([(x, t)], "x array<double>, t array<long>")
    r = df.select(codecs.decode_doubles(codecs.encode_doubles(F.col("x"))).alias("x"), codecs.decode_times(codecs.encode_times(F.col("t"))).alias("t")).first()
    assert (r.x, r.t) == (x, t)
    z = spark.createDataFrame([(v,) for v in (0, -1, 1, -2, 2**62)], "v long").select("v", codecs.zigzag(F.col("v")).alias("z")).select("*", codecs.unzigzag(F.col("z")).alias("u")).collect()
    assert [r.z for r in z] == [0, 1, 2, 3, r_z(2**62)] and all(r.u == r.v for r in z)
    q = spark.createDataFrame([(1, 2, 1.0, 2.0, 3.0, 4.0, 5)] * 3, schemas.QUOTE_L1)
    b = codecs.row_binary(q.coalesce(1)).collect()
    assert sum(len(r.data) for r in b) == 156 and bytes(b[0].data[:52]) == struct.pack("<qiddddq", 1, 2, 1.0, 2.0, 3.0, 4.0, 5)
    n = spark.createDataFrame([(None, True), (7, False)], "a int, b boolean").coalesce(1)
    assert b"".join(bytes(r.data) for r in codecs.row_binary(n).collect()) == b"\1\0\1" + b"\0\7\0\0\0\0\0"
    with pytest.raises(InvalidArgument):
        codecs.row_binary(spark.createDataFrame([("a",)], "s string"))
    ddl = codecs.merge_tree_ddl("q", schemas.QUOTE_L1)
    assert "PARTITION BY toYYYYMM(timestamp_ns)" in ddl and ddl.endswith("ORDER BY (`symbol_id`, `timestamp_ns`);") and "`bid_price` Float64," in ddl


def r_z(v):
    u = v << 1
    return u - 2**64 if u >= 2**63 else u


def test_feed_state():
    p = [(1, 0, 1.0, 2.0, 0.0), (2, 10, 1.0, 2.0, 0.0), (3, 20, 1.0, 2.0, 0.0), (7, 30, 1.0, 2.0, 0.0), (8, 45, 50005.0, 50000.0, 0.0), (8, 50, 1.0, 2.0, 0.0)]
    state, out = feed._changes(None, "s", p[:4])
    assert [(x[1], x[2], x[3]) for x in out] == [("gap", 7, 4)]
    state, out = feed._changes(state, "s", p[4:])
    assert [(x[1], x[6]) for x in out] == [("crossed", 5.0), ("out_of_order", 10.0)] and state == (8, 50, 5, 6)


def test_bus(spark):
    e = spark.createDataFrame([(1, 1, "a", 0), (2, 2, "b", 3), (3, 1, "b", 3)], "event_id long, topic int, type string, priority int")
    got = {}
    bus = pipeline.Bus()
    bus.subscribe("t", lambda df: got.update(t=sorted(r.event_id for r in df.collect())), topic=1)
    bus.subscribe("bad", lambda df: 1 / 0)
    bus.subscribe("p", lambda df: got.update(p=sorted(r.event_id for r in df.collect())), type="b", min_priority=2)
    bus.publish(e)
    assert got == {"t": [1, 3], "p": [2, 3]} and bus.failures == {"bad": 1}
    assert pipeline.chain(e, lambda d: d.where("priority > 0"), lambda d: d.select("event_id")).count() == 2


def test_models(spark):
    rng = np.random.default_rng(4)
    n = 1500
    x = rng.standard_normal((n, 5))
    pdf = pd.DataFrame(x, columns=models.FEATURES)
    pdf["day"] = [date(2020, 1, 1) + timedelta(i // 3) for i in range(n)]
    pdf["y"] = (x[:, 0] + 0.3 * rng.standard_normal(n) > 0.8).astype(float)
    df = spark.createDataFrame(pdf)
    train, test = models.split(df)
    assert train.agg(F.max("day")).first()[0] < test.agg(F.min("day")).first()[0] and train.count() + test.count() == n
    parts = models.folds(train)
    assert len(parts) == 5 and all(a.agg(F.max("day")).first()[0] < b.agg(F.min("day")).first()[0] for a, b in parts)
    board = models.leaderboard(df, ("logistic",), draws=1, k=2).first()
    assert board.test_auc > 0.95 and board.cv_auc > 0.9
    model = models.pipeline("logistic", {"regParam": 1e-3}).fit(models.balanced(train))
    imp = models.importance(model, test)
    assert max(imp, key=imp.get) == "pt_value"


def test_quality_counts(spark):
    b = spark.createDataFrame([(100.0, 90.0, 110.0, 105.0, 5.0), (float("nan"), 1.0, 1.0, 1.0, -1.0), (1.0, 2.0, 1.0, 1.5, 1.0)], "open double, high double, low double, close double, volume double")
    c = quality.counts(b).first()
    assert (c.high_low, c.number, c.volume, c.quarantined, c.rows) == (1, 1, 1, 2, 3)
