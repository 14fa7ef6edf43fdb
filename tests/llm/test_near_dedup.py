"""Near-duplicate classes against brute force: real documents, and form letters that nearly all share buckets."""

from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import near_dedup


def brute_classes(texts):
    """The least index of each text's class, by the exact index of every two texts that share a shingle (and all equal texts)."""
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(a, b):
        a, b = sorted((top(a), top(b)))
        root[b] = a

    first = {}
    for i, t in enumerate(texts):
        if t is not None:
            join(first.setdefault(t, i), i)
    different = list(first.values())
    sets = {i: near_dedup.weighted([texts[i]])[::2] for i in different}
    holders = defaultdict(list)
    for i in different:
        for h in sets[i][0].tolist():
            holders[h].append(i)
    shared = defaultdict(int)
    for own in holders.values():
        for x in range(1, len(own)):
            for y in own[:x]:
                shared[y, own[x]] += 1
    for (a, b), n in shared.items():
        # Of texts this unlike the index is below 0.8 whatever the weights, which are 1 + ln(count) at most.
        if top(a) != top(b) and n >= 0.4 * max(len(sets[a][0]), len(sets[b][0])) and near_dedup.probability_jaccard(sets[a], sets[b]) >= near_dedup.SIMILARITY:
            join(a, b)
    return [top(i) for i in range(len(texts))]


def classes(spark, texts, parts=8):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    r = near_dedup.near_duplicates(df).toPandas().set_index("doc_id").class_id
    return [int(r[i]) for i in range(len(texts))]


def letters(n, planted, words=400, seed=7):
    """Form letters of one template: unlike ones at an index near 0.75, and `planted` near copies of the first ones at 0.82 or so."""
    rng = np.random.default_rng(seed)
    base = [f"word{i}" for i in range(words)]
    out = []
    for i in range(n - planted):
        w = list(base)
        for at in rng.choice(words // 5, 12, replace=False) * 5 + 2:
            w[at] = f"n{i}x{at}"
        out.append(w)
    for i in range(planted):
        w = list(out[i])
        for at in rng.choice(words // 5, 7, replace=False) * 5 + 4:
            w[at] = f"p{i}x{at}"
        out.append(w)
    return [" ".join(w) for w in out]


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(2000)
    texts = [r.text for r in docs.select("text").collect()]
    want = brute_classes(texts)
    assert 1 < max(np.bincount(want)) and len(set(want)) < len(texts)
    assert classes(spark, texts) == want


@pytest.mark.parametrize("n", [2000])
def test_form_letters(spark, n):
    """Every planted pair is one class, though all letters share buckets, and no two letters else are."""
    got = classes(spark, letters(n, n // 2))
    assert got == [i % (n - n // 2) for i in range(n)]


def test_parts(monkeypatch):
    """A group of texts beyond PART_CHARS is compared part by part, with the same links."""
    import pyarrow as pa

    texts = letters(60, 30)
    h = [near_dedup.weighted([t]) for t in texts]
    sig = (np.concatenate([near_dedup.prob_min_hash(*x, 1) for x in h]) >> np.uint64(40)).astype(np.uint16)
    # Band 0 is given to all, so that every likely pair that shares it is compared here.
    sig[:, : near_dedup.ROWS] = 1
    n = len(texts)
    row = {"bucket": [5] * n, "i": [0] * n, "j": [0] * n, "block": [0] * n, "node": [f"{i:02d}".encode() for i in range(n)], "root": [f"{i:02d}".encode() for i in range(n)], "sig": [s.tobytes() for s in sig], "band": [0] * n, "text": texts}
    t = pa.table({k: pa.array(v, pa.binary() if k in ("node", "root", "sig") else None) for k, v in row.items()})

    def links():
        return {tuple(sorted(p)) for b in near_dedup._join(iter(t.to_batches())) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())}

    whole = links()
    assert whole == {(f"{i:02d}".encode(), f"{i + 30:02d}".encode()) for i in range(30)}
    monkeypatch.setattr(near_dedup, "PART_CHARS", 4000)
    assert len(near_dedup._parts(texts)) > 10 and links() == whole
