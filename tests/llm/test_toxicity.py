"""Evidence and held-out accuracy of the toxicity scores."""

import numpy as np

from tidemark.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    """Nearly every text finds examples, and held-out toxic documents score above the others."""
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    r = toxicity.score(docs, labels).toPandas()
    assert (r.evidence == "").mean() < 0.05
    toxic = labels.toPandas().groupby("doc_id").toxic.max()
    held = r[r.held_out & r.doc_id.isin(toxic.index)]
    y, s = toxic[held.doc_id].to_numpy() == 1, held.score.to_numpy()
    pairs = s[y][:, None] - s[~y][None, :]
    assert ((pairs > 0) + 0.5 * (pairs == 0)).mean() > 0.9
    assert held.predicted[y].mean() > 0.7 and held.predicted[~y].mean() < 0.02


def test_odd_rows(spark):
    """Null ids and texts, very long, empty and repeated texts, extra columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300)
    text = docs.where("text is not null").head().text
    rows = [(None, None, 1), (None, text, 1), (-1, "", 1), (-2, "word " * 300_000, 1), (-3, text, 1), (-3, text, 1), (-4, text + " " + "w" * 100_000, 1)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = toxicity.score(docs.selectExpr("doc_id", "text", "1 as toxic").unionByName(extra), labels).toPandas()
    assert len(r) == 307 and r.score.between(0, 1).all() and np.isin(r.predicted, (0, 1)).all()
    assert not r[r.doc_id.isna()].held_out.any()
    assert r[r.doc_id == -3].score.nunique() == 1
