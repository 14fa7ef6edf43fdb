"""Mixing: targets are met, repeated rows, reruns, and the pipeline's stage."""

from collections import Counter

import numpy as np
import pytest

from tidemark.llm import mixing

DOC = "doc_id string, text string, source string, unit string, id int, n int"


def near(r, smallest):
    """Each source's words taken lie within half of its smallest document that may repeat, or 1 %, of its target."""
    for source, g in r.groupby("source", dropna=False):
        target = g.target.iloc[0]
        sizes = g["size"][g["size"] > 0]
        assert abs(g.taken.sum() - target) <= max(sizes.min() / 2 + 1 if len(sizes) else 0, 0.01 * target, smallest), (source, g.taken.sum(), target)
        assert (g.taken <= 3 * g["size"]).all() and (g.taken % g["size"].clip(lower=1) == 0).all()


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_targets_are_met(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    r = mixing.mixed(docs).toPandas()
    assert sorted(r.doc_id) == sorted(x.doc_id for x in docs.select("doc_id").collect())
    near(r, 0)
    want = mixing.targets([(s, int(g["size"].sum())) for s, g in r.groupby("source", dropna=False)])
    assert all(abs(want[s] - t) < 1e-6 for s, t in zip(r.source, r.target))
    again = mixing.mixed(docs.repartition(13)).toPandas()
    assert Counter(zip(r.doc_id, r.taken)) == Counter(zip(again.doc_id, again.taken))


def test_blocks(spark):
    """Several levels of blocks, with a source of two thirds of all rows and heavy tails."""
    rng = np.random.default_rng(5)
    rows = [(str(i), "w " * int(min(2000, 3 + rng.pareto(1.1) * 5)), "abc"[min(2, i % 6 // 3 * (1 + i % 2))], "u", 1, 2) for i in range(6000)]
    docs = spark.createDataFrame(rows, DOC)
    d = docs.select(mixing._unit().alias("unit"), "doc_id", "source", mixing.n_words(docs.text).alias("size")).groupBy("unit", "source", "size").count()
    m = mixing.mix(d.selectExpr("unit", "unit as id", "source", "size", "count as n"), block=150, reserve=60).toPandas()
    assert len(m) == 6000
    m["taken"] = m["size"] * (m["n"] * m["base"] + m.extra)
    near(m.assign(taken=m.taken), 1)


def test_repeated_rows(spark):
    """A third of all rows is one row, its id holds colons; its copies come near the target and differ by one at most."""
    same = ("a:b:c", "one two three", "x", "u", 1, 2)
    rows = [same] * 3000 + [(f"d:{i}", "word " * (1 + i % 50), "xyz"[i % 3], "u", 1, 2) for i in range(6000)] + [(None, None, None, None, None, None)] * 3 + [("e", "", "y", "u", 1, 2)]
    docs = spark.createDataFrame(rows, DOC)
    r = mixing.mixed(docs).toPandas()
    assert len(r) == len(rows) and (r.doc_id == "a:b:c").sum() == 3000
    near(r, 1)
    copies = r[r.doc_id == "a:b:c"].copies
    assert copies.max() - copies.min() <= 1
    out = mixing.take(docs)
    assert out.columns == docs.columns
    got = Counter(x.doc_id for x in out.collect())
    want = Counter()
    for i, c in zip(r.doc_id, r.copies):
        want[i] += c
    assert got == +want


def test_repair():
    size, p = np.array([900.0, 500, 100, 90, 10]), np.full(5, 0.5)
    q = mixing.repair(np.array([1.0, 0, 0, 0, 0]), p, size)
    assert abs(q @ size - p @ size) <= 100
    assert mixing.repair(np.array([1.0, 0]), np.array([1.0, 0.0]), np.array([5.0, 7.0])).tolist() == [1, 0]
