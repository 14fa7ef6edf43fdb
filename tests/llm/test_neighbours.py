"""The forest against brute force: ties, doubles, lengths, repeated vectors, recall."""

import numpy as np
import pytest

from tidemark.llm import neighbours


def brute(x, ids, queries, k=20):
    """Lists of (vec_id, score) by inner products added in order."""
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = neighbours.exact_scores(np.broadcast_to(x[i], x.shape), x)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(r):
    return {q: list(zip(g.sort_values("rank").vec_id, g.sort_values("rank").score)) for q, g in r.groupby("query_id")}


def frame(spark, x, ids=None, kind="float"):
    return spark.createDataFrame([(int(i), v.tolist(), "c", 1.0) for i, v in zip(range(len(x)) if ids is None else ids, x)], f"vec_id long, embedding array<{kind}>, id string, e double")


@pytest.mark.parametrize("leaf", [1000, 60])
def test_ties(spark, leaf):
    """Ternary vectors: most scores are tied. With small leaves the trees are four deep and every leaf is opened (target 1)."""
    x = np.random.default_rng(3).integers(-1, 2, (900, 12)).astype(np.float32)
    x[~x.any(1)] = 1
    r = neighbours.nearest(frame(spark, x), leaf=leaf, least=10, target=2.0).toPandas()
    assert found(r) == brute(x.astype(float), np.arange(900), range(0, 900, 20))


def test_doubles_lengths_and_cells(spark):
    """Components that differ beyond floats; two lengths, each searched apart; leaves dealt to several cells as the sample is small."""
    rng = np.random.default_rng(4)
    x = 1 + 1e-12 * rng.standard_normal((400, 6))
    y = rng.standard_normal((200, 9))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    r = found(neighbours.nearest(df, leaf=20, sample=100, least=25, target=2.0).toPandas())
    want = brute(x, np.arange(400), range(0, 400, 20)) | brute(y, np.arange(1000, 1200), range(1000, 1200, 20))
    assert r == want


def test_repeated_vectors_and_ids(spark):
    """One vector under a third of all ids, and a vec_id that two rows carry."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[100:200] = x[0]
    r = found(neighbours.nearest(frame(spark, x), leaf=40, least=10, target=2.0).toPandas())
    assert r == brute(x.astype(float), np.arange(300), range(0, 300, 20))
    twice = neighbours.nearest(frame(spark, np.vstack((x, x[7:8])), [*range(300), 7]), leaf=40, least=10, target=2.0).toPandas()
    assert found(twice) == r


def test_recall(spark):
    """10,000 vectors without structure, the hardest sort, with production parameters but for smaller leaves."""
    x = np.random.default_rng(6).standard_normal((10_000, 24)).astype(np.float32)
    r = neighbours.nearest(frame(spark, x), leaf=200).toPandas()
    got = found(r)
    s = x[::20].astype(float) @ x.T.astype(float)
    s[np.arange(500), np.arange(0, 10_000, 20)] = -np.inf
    true = np.argsort(-s, axis=1)[:, :20]
    assert all(len(v) == 20 for v in got.values()) and len(got) == 500
    recall = np.mean([len({i for i, _ in got[20 * k]} & set(t.tolist())) / 20 for k, t in enumerate(true)])
    assert recall >= 0.9
