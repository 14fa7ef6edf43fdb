"""Forests of decision trees as one expression, for batch and streaming rows alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The trained trees, each (feature, threshold, tree at or below it, tree above it), with probabilities at the leaves
TREES = [
    ("pt_value", 0.05, ("roll_max", 0.08, 0.10, 0.45), ("roll_max", 0.15, 0.65, 0.95)),
    ("roll_skew", 0.75, ("pt_value", 0.02, 0.05, 0.50), ("turnover", 0.04, 0.70, 0.90)),
    ("turnover", 0.03, ("roll_max", 0.10, 0.12, 0.55), ("pt_value", 0.06, 0.75, 0.92)),
]
ALERT = 0.70


def tree(node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(node)
    name, threshold, low, high = node
    return F.when(F.coalesce(F.col(name), F.lit(0.0)) <= threshold, tree(low)).otherwise(tree(high))


def probability(trees=TREES) -> Column:
    """Mean over the trees; a missing feature counts as 0."""
    return sum((tree(t) for t in trees[1:]), tree(trees[0])) / len(trees)


def scored(rows: DataFrame, trees=TREES, threshold: float = 0.5) -> DataFrame:
    """rows with probability, predicted and alert."""
    r = rows.withColumn("probability", probability(trees))
    return r.withColumns({"predicted": (F.col("probability") >= threshold).cast("int"), "alert": F.col("probability") >= ALERT})
