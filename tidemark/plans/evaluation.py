"""Queries on scores and labels, files, time parts, unions and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.market import table
from ..operators import feed, metrics
from .registry import _round, query

SCORED = "s AS (SELECT CAST(n_chars % 997 AS DOUBLE) / 997 AS score, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)"
CURVE = f"""{SCORED}, c AS (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM s GROUP BY score),
t AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM c)"""


def _scored(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select((F.col("n_chars") % 997 / F.lit(997.0)).alias("score"), F.col("quality").alias("label"))


@query(
    f"""WITH {SCORED}, c AS (SELECT count_if(score >= 0.5 AND label = 1) AS tp, count_if(score >= 0.5 AND label <> 1) AS fp, count_if(score < 0.5 AND label <> 1) AS tn, count_if(score < 0.5 AND label = 1) AS fn FROM s)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def confusion_metrics(spark, d):
    return _round(metrics.confusion(_scored(spark, d)), "accuracy", "precision", "recall", "f1")


@query(f"WITH {CURVE} SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc, round(sum(pos * (tp / (tp + fp))) / sum(pos), 6) AS average_precision, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM t")
def roc_auc(spark, d):
    return _round(metrics.roc_auc(_scored(spark, d)), "auc", "average_precision")


@query(f"WITH {CURVE} SELECT round(score, 6) AS score, round(tp / (SELECT sum(pos) FROM c), 6) AS tpr, round(fp / (SELECT sum(neg) FROM c), 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM t")
def pr_curve(spark, d):
    return _round(metrics.roc_curve(_scored(spark, d)), "score", "tpr", "fpr", "precision")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x + x AS DOUBLE))), 6) + 0.0 AS total FROM embeddings")
def vector_add(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", feed.add(F.col("embedding"), F.col("embedding")).alias("v"))
    return _round(e.select("vec_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total")), "total")


@query("SELECT event_id AS id, event_type AS kind, NULL::VARCHAR AS status FROM events WHERE value > 100 UNION ALL BY NAME SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def union_by_name(spark, d):
    e = table(spark, d, "events").where("value > 100").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return e.unionByName(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), allowMissingColumns=True)
