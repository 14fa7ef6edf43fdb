"""Models of the lottery label on past features: expanding folds in time, weights for the rare class, a leaderboard by AUC.

Logistic regression, random forest and boosted trees are Spark ML's. `AdaBoost` fits shallow trees in rounds over Spark ML's decision tree.
"""

from __future__ import annotations

import itertools
import math
import random
import time
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Store, scratch
from . import metrics

FEATURES = ["pt_value", "roll_skew", "roll_max", "roll_vol", "turnover"]



class AdaBoost:
    """Discrete boosting of trees: a round's tree weighs ln((1 - err) / err) times the rate, and the rows it misses gain weight by it.

    Weights are written to the shared folder between rounds, so no plan grows with the rounds.
    """

    def __init__(self, rounds: int = 50, rate: float = 1.0, depth: int = 1, features: list[str] = FEATURES, label: str = "y", seed: int = 7):
        self.rounds, self.rate, self.depth, self.features, self.label, self.seed = rounds, rate, depth, features, label, seed

    def fit(self, rows: DataFrame) -> AdaBoostModel:
        spark = rows.sparkSession
        joined = VectorAssembler(inputCols=self.features, outputCol="joined", handleInvalid="skip")
        d = joined.transform(rows).select("joined", F.col(self.label).cast("double").alias("label"), F.col("weight").cast("double").alias("w") if "weight" in rows.columns else F.lit(1.0).alias("w"))
        at, trees = [], []
        for i in range(self.rounds):
            at.append(scratch(spark, "boost"))
            d.write.parquet(at[-1])
            d = spark.read.schema(d.schema).parquet(at[-1])
            tree = DecisionTreeClassifier(
                featuresCol="joined", labelCol="label", weightCol="w", maxDepth=self.depth, seed=self.seed, predictionCol=f"p{i}", rawPredictionCol=f"r{i}", probabilityCol=f"q{i}"
            ).fit(d)
            d = tree.transform(d).withColumn("miss", F.col(f"p{i}") != F.col("label"))
            got = d.agg(F.sum(F.when(F.col("miss"), F.col("w")).otherwise(0.0)).alias("e"), F.sum("w").alias("w")).head()
            error = got.e / got.w if got.w else 0.5
            if error >= 0.5:
                break
            alpha = self.rate * math.log((1 - error) / max(error, 1e-10))
            trees.append((alpha, tree))
            if error <= 0:
                break
            d = d.select("joined", "label", (F.col("w") * F.when(F.col("miss"), math.exp(alpha)).otherwise(1.0) / got.w).alias("w"))
        for path in at:
            Store(spark, path).remove("")
        return AdaBoostModel(joined, trees)


class AdaBoostModel:
    def __init__(self, joined: VectorAssembler, trees: list):
        self.joined, self.trees = joined, trees

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds probability: the logistic function of the trees' weighted votes, taken as a share of all their weights."""
        d = self.joined.transform(rows)
        total, votes = sum(a for a, _ in self.trees), F.lit(0.0)
        for i, (alpha, tree) in enumerate(self.trees):
            d = tree.transform(d).drop(f"r{i}", f"q{i}")
            votes = votes + alpha * (2 * F.col(f"p{i}") - 1)
        p = 1 / (1 + F.exp(-2 * votes / total)) if total else F.lit(0.5)
        return d.withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("joined", *[f"p{i}" for i in range(len(self.trees))])


#: Name: (estimator, its parameters to draw from).
MODELS = {
    "logistic": (LogisticRegression, {"regParam": [1e-4, 1e-3, 1e-2], "elasticNetParam": [0.0]}),
    "forest": (RandomForestClassifier, {"numTrees": [50, 100], "maxDepth": [5, 8], "minInstancesPerNode": [1, 5]}),
    "ada": (AdaBoost, {"rounds": [25, 50], "rate": [0.1, 0.5, 1.0], "depth": [1, 2]}),
    "boosted": (GBTClassifier, {"maxIter": [20, 40], "maxDepth": [3, 5], "stepSize": [0.05, 0.1]}),
}


def split(rows: DataFrame, share: float = 0.8, day: str = "day") -> tuple[DataFrame, DataFrame]:
    """Rows up to the exact quantile of their time, and later ones; no row lies in both."""
    number = F.unix_date(F.to_date(day))
    cut = rows.agg(F.percentile(number, share)).head()[0]
    return (rows.limit(0), rows.limit(0)) if cut is None else (rows.where(number <= cut), rows.where(number > cut))


def folds(rows: DataFrame, k: int = 5, day: str = "day") -> list[tuple[DataFrame, DataFrame]]:
    """k pairs of (all days before, the next days): days are cut into k + 1 runs of about as many rows, so a day never lies on both sides."""
    number = F.unix_date(F.to_date(day))
    cuts = rows.agg(F.percentile(number, [i / (k + 1) for i in range(1, k + 1)])).head()[0]
    if cuts is None:
        return []
    ends = [*cuts[1:], float("inf")]
    return [(rows.where(number <= a), rows.where((number > a) & (number <= b))) for a, b in zip(cuts, ends)]


def balanced(rows: DataFrame, label: str = "y") -> DataFrame:
    """Adds weight: n / (2 n of the class). A class without rows has none."""
    n = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("double")).count().collect()}
    total = sum(n.values())
    w = reduce(lambda a, b: F.when(F.col(label) == b, total / (2 * n[b])).otherwise(a), n, F.lit(1.0))
    return rows.withColumn("weight", w)


def pipeline(name: str, parameters: dict, features: list[str] = FEATURES, label: str = "y") -> Pipeline | AdaBoost:
    if name == "ada":
        return AdaBoost(features=features, label=label, **parameters)
    seed = {} if name == "logistic" else {"seed": 7}
    est = MODELS[name][0](featuresCol="scaled", labelCol=label, weightCol="weight", **parameters, **seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="joined", handleInvalid="skip"), StandardScaler(inputCol="joined", outputCol="scaled", withMean=True), est])


def scores(model, rows: DataFrame, label: str = "y") -> DataFrame:
    return model.transform(rows).select("*", vector_to_array("probability")[1].alias("score"), F.col(label).alias("label"))


def search(train: DataFrame, name: str, draws: int = 12, k: int = 5, seed: int = 7) -> tuple[dict, float | None]:
    """The best of some drawn parameter sets by mean AUC over the folds, and that AUC."""
    grid = [dict(zip(MODELS[name][1], v)) for v in itertools.product(*MODELS[name][1].values())]
    grid = random.Random(seed).sample(grid, min(draws, len(grid)))
    best, at = grid[0], None
    parts = [(balanced(a).cache(), b.cache()) for a, b in folds(train, k)]
    for p in grid:
        got = []
        for a, b in parts:
            if a.select("y").distinct().count() == 2:
                auc = metrics.roc_auc(scores(pipeline(name, p).fit(a), b)).head().auc
                got += [auc] if auc is not None else []
        if got and (at is None or sum(got) / len(got) > at):
            best, at = p, sum(got) / len(got)
    [x.unpersist() for pair in parts for x in pair]
    return best, at


def leaderboard(rows: DataFrame, names=tuple(MODELS), draws: int = 12, k: int = 5) -> DataFrame:
    """(model, cv_auc, test_auc, f1, precision, recall, accuracy, seconds), best test AUC first, on the newest fifth of the rows."""
    train, test = split(rows)
    train, test = train.cache(), test.cache()
    out = []
    for name in names:
        began = time.time()
        best, cv = search(train, name, draws, k)
        model = pipeline(name, best).fit(balanced(train))
        took = time.time() - began
        s = scores(model, test).select("score", "label").cache()
        auc, c = metrics.roc_auc(s).head().auc, metrics.confusion(s).head()
        s.unpersist()
        out.append((name, cv, auc, c.f1, c.precision, c.recall, c.accuracy, took))
    train.unpersist(), test.unpersist()
    return rows.sparkSession.createDataFrame(out, "model string, cv_auc double, test_auc double, f1 double, precision double, recall double, accuracy double, seconds double").orderBy(F.desc("test_auc"))


def importance(model, rows: DataFrame, features: list[str] = FEATURES, seed: int = 7) -> dict[str, float]:
    """Loss of AUC when a feature's values are those of other rows: the values are joined back by the rows' places in a random order."""
    from pyspark.sql.window import Window

    base = metrics.roc_auc(scores(model, rows)).head().auc
    out = {}
    for i, f in enumerate(features):
        # Values move among the rows of one block of a hash, so that no task holds all rows.
        b = rows.withColumn("__b", F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
        n = lambda s: F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64(F.lit(s), *rows.columns)))
        moved = b.withColumn("__i", n(seed + i)).select("__b", "__i", F.col(f).alias("__v"))
        mixed = b.withColumn("__i", n(0)).join(moved, ["__b", "__i"]).withColumn(f, F.col("__v")).drop("__b", "__i", "__v")
        out[f] = base - metrics.roc_auc(scores(model, mixed)).head().auc
    return out
