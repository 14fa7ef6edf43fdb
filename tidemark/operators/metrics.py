"""Quality of scores against 0/1 labels. Curves are running sums over distinct scores, in blocks of scores rather than in one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCKS = 256


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for scored (score, label): tp, fp, tn, fn, accuracy, precision, recall, f1; a share of nothing is 0. Null rows do not count."""
    yes, one = F.col("score") >= threshold, F.col("label") == 1
    c = scored.where("score is not null and label is not null").agg(F.count_if(yes & one).alias("tp"), F.count_if(yes & ~one).alias("fp"), F.count_if(~yes & ~one).alias("tn"), F.count_if(~yes & one).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    return c.select("*", share(tp + tn, tp + fp + tn + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def curve(scored: DataFrame) -> DataFrame:
    """(score, pos, neg, tp, fp) for each distinct score: its labels, and those of it and all higher scores."""
    d = scored.where("score is not null and label is not null").groupBy(F.col("score").cast("double").alias("score")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    cuts = d.agg(F.percentile_approx("score", [i / BLOCKS for i in range(1, BLOCKS)])).head()[0] or []
    cuts = sorted(set(cuts))
    d = d.withColumn("block", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("score"))) if cuts else F.lit(0))
    totals = d.groupBy("block").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))  # BLOCKS rows at most
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("block", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"))
    w = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)}).join(F.broadcast(totals), "block")
    return d.select("score", "pos", "neg", (F.col("tp") + F.col("p")).alias("tp"), (F.col("fp") + F.col("n")).alias("fp"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: auc (ties count half; null without both labels), average_precision, positives, negatives."""
    c = curve(scored)
    p, n = F.sum("pos"), F.sum("neg")
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0))
    ap = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return c.agg(F.try_divide(area, p.cast("double") * n).alias("auc"), F.try_divide(ap, p).alias("average_precision"), F.coalesce(p, F.lit(0)).alias("positives"), F.coalesce(n, F.lit(0)).alias("negatives"))


def roc_curve(scored: DataFrame) -> DataFrame:
    """(score, tpr, fpr, precision) at each distinct score."""
    c = curve(scored)
    whole = c.agg(F.max("tp").alias("p"), F.max("fp").alias("n"))
    c = c.crossJoin(F.broadcast(whole))  # one row
    return c.select("score", F.try_divide("tp", "p").alias("tpr"), F.try_divide("fp", "n").alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
