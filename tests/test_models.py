"""Tree models and boosting to the end on small rows; the live feed; files that fail."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import metrics, models
from tidemark.sources import bars_csv
from tidemark.streaming import live

SYMBOLS = [("BTC", 60_000.0, 0.6), ("ETH", 3000.0, 0.8), ("XRP", 0.5, 1.0), ("SOL", 90.0, 0.9)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5))
    pdf = pd.DataFrame(x, columns=models.FEATURES)
    pdf["y"] = ((x[:, 0] > 0.5) | (x[:, 1] < -1)).astype(float)
    pdf["day"] = pd.date_range("2024-01-01", periods=400).strftime("%Y-%m-%d")
    return spark.createDataFrame(pdf).repartition(2).cache()


@pytest.mark.parametrize("name, parameters", [("forest", {"numTrees": 5, "maxDepth": 4}), ("boosted", {"maxIter": 3, "maxDepth": 3}), ("ada", {"rounds": 4, "depth": 1})])
def test_tree_models(rows, name, parameters):
    train, test = models.split(rows)
    model = models.pipeline(name, parameters).fit(models.balanced(train))
    assert metrics.roc_auc(models.scores(model, test)).head().auc > 0.9


def test_ada_stops(spark):
    """A first tree without error ends the rounds; labels that no tree can tell leave an even probability."""
    sure = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "pt_value double, y double")
    m = models.AdaBoost(rounds=5, features=["pt_value"]).fit(sure)
    assert len(m.trees) == 1
    assert [round(r.score) for r in models.scores(m, sure).orderBy("pt_value").collect()] == [0] * 6 + [1] * 6
    blind = spark.createDataFrame([(1.0, float(i % 2)) for i in range(10)], "pt_value double, y double")
    m = models.AdaBoost(rounds=5, features=["pt_value"]).fit(blind)
    assert {r.score for r in models.scores(m, blind).collect()} == {0.5}


def test_live_feed(spark):
    r = live.replay(spark, 500, SYMBOLS).toPandas()
    per = r.groupby("seq").size()
    assert len(per) == 500 and per.min() >= 1 and per.max() == 3
    assert (r.bid <= r["last"]).all() and (r["last"] <= r.ask).all()
    btc = r[r.symbol == "BTC"].sort_values("seq")["last"]
    steps = np.diff(np.log(btc))
    assert np.std(steps) == pytest.approx(0.6 * np.sqrt(1 / live.YEAR), rel=0.2) and (btc.round(2) == btc).all()
    again = live.replay(spark, 500, SYMBOLS).toPandas()
    assert sorted(map(tuple, r.to_numpy())) == sorted(map(tuple, again.to_numpy()))


def test_live_stream(spark):
    """The stream's prices are the batch's."""
    q = live.live(spark, SYMBOLS, cycles_per_batch=5).writeStream.format("memory").queryName("live_ticks").outputMode("append").start()
    try:
        while not (q.lastProgress and q.lastProgress["batchId"] >= 2):
            if q.exception():
                raise q.exception()
            q.awaitTermination(1)
    finally:
        q.stop()
    got = {(r.symbol, r.seq): r["last"] for r in spark.table("live_ticks").collect()}
    want = {(r.symbol, r.seq): r["last"] for r in live.replay(spark, 1 + max(s for _, s in got), SYMBOLS).collect()}
    assert len(got) > 10 and got == {k: want[k] for k in got}


def test_files_that_fail_and_regressions(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,v\n1,a\n3,b\n2,c\n5,d\n4,e\n")
    (tmp_path / "b.csv").write_text("t,v\n1,a\n2,b\n")
    read = lambda p: spark.read.option("header", True).schema("t long, v string").csv(p)
    df, failed = bars_csv.read_each(spark, [f"file://{tmp_path}/{n}.csv" for n in "axb"], read)
    assert df.count() == 7 and list(failed) == [f"file://{tmp_path}/x.csv"]
    r = bars_csv.regressions(bars_csv.in_file_order(read(f"file://{tmp_path}")).withColumnRenamed("t", "timestamp_ns"))
    assert sorted(x.regressions for x in r.collect()) == [0, 2]
