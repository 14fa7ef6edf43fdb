"""Nulls, empty texts, ties, repeated rows, extra columns; and brute force on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import chat, decontaminate, html_text, language_id, mixing, near_dedup, neighbours, secrets, sharding, toxicity

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, node string, size long, hit string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and repeated rows, a text of many words, and extra columns with names that operators use."""
    long = " ".join(f"w{i % 977} The quick" for i in range(20_000))
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word60", "other")
    rows = [(1, base, "en", "a"), (2, near, "en", "a"), (3, base, "en", None), (4, None, None, "b"), (5, "", None, None), (5, "", None, None), (None, "Hi", "en", "b"), (7, long, "en", "c"), (8, "12 %%", None, "a")]
    return spark.createDataFrame([(*r, 0, "n", 1, "h") for r in rows], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_near_dedup(odd, none):
    r = near_dedup.near_duplicates(odd).toPandas()
    assert len(r) == 9
    assert set(r[r.doc_id.isin([1, 2, 3])].class_id) == {1}
    assert r[r.doc_id == 5].class_size.tolist() == [2, 2]
    assert r[r.doc_id == 4].class_id.tolist() == [4]
    kept = near_dedup.keep_one(odd).toPandas()
    assert len(kept) == 6 and list(kept.columns) == list(odd.columns)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_edited_copies(spark):
    """Copies of one text with a few edits each: many links lie between copies that no leader of a bucket is near to."""
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in range(204)]
    texts = []
    for i in range(500):
        words = list(base)
        for at in rng.choice(40, rng.integers(3, 6), replace=False) * 5 + 2:
            words[at] = f"edit{i}x{at}"
        texts.append(" ".join(words))
    sets = [near_dedup.weighted([t])[::2] for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if top(a) != top(b) and len(np.intersect1d(sets[a][0], sets[b][0])) > 150 and near_dedup.probability_jaccard(sets[a], sets[b]) >= near_dedup.SIMILARITY:
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
    want = [top(i) for i in range(len(texts))]
    assert 50 < len(set(want)) < 450
    r = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id").class_id
    assert [r[i] for i in range(len(texts))] == want


def test_probability_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(20):
        h = np.sort(rng.choice(50, 20, replace=False)).astype(np.uint64)
        g = np.sort(rng.choice(50, 25, replace=False)).astype(np.uint64)
        x, y = rng.random(20) + 0.1, rng.random(25) + 0.1
        a, b = dict(zip(h.tolist(), x)), dict(zip(g.tolist(), y))
        every = set(a) | set(b)
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in set(a) & set(b))
        assert near_dedup.probability_jaccard((h, x), (g, y)) == pytest.approx(want)


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame([(1, "WORD1 word2, word3"), (2, None), (3, " ".join(f"word{i}" for i in range(20, 35))), (3, "É x"), (4, "nothing here")], "item_id long, text string")
    r = decontaminate.contamination(odd, items).toPandas()
    assert len(r) == 9
    one = r[r.doc_id == 1].iloc[0]
    assert (one.n_words, one.n_hit, one.n_items) == (120, 18, 2)
    assert one.items_sha256 == hashlib.sha256(b"1,3").hexdigest()
    assert r.contaminated.sum() == 3
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(odd, items).count() == 6


def test_mixing(odd, none):
    r = mixing.mixed(odd).toPandas()
    assert len(r) == 9 and (r.taken <= 3 * r["size"]).all()
    assert r[r.doc_id == 4]["size"].tolist() == [0]
    assert mixing.mixed(none).count() == 0
    assert mixing.targets([("a", 10), ("b", 90), (None, 0)]) == {"a": 30.0, "b": 70.0, None: 0.0}
    p = np.full(500, 0.3)
    x = np.column_stack((np.random.default_rng(2).integers(1, 99, 500), np.ones(500)))
    q = mixing.flight(p, x, np.random.default_rng(3))
    assert ((q > 0) & (q < 1)).sum() <= 2 and np.allclose(q @ x, p @ x)


def test_sharding(odd, none):
    r = sharding.shards(odd).toPandas()
    assert len(r) == 9 and all(sorted(g.slot) == list(range(len(g))) for _, g in r.groupby("shard"))
    assert r[r.doc_id == 4][["size", "text_crc32"]].values.tolist() == [[8, 0]]
    assert r[r.doc_id == 1].text_crc32.tolist() == [zlib.crc32(" ".join(f"word{i}" for i in range(120)).encode())]
    assert sharding.shards(none).count() == 0
    sizes = {s: 100 + s % 7 for s in range(256)}
    old = sharding.plan(sizes, 4, 256)
    new = sharding.rebalance(old, sizes, 5)
    load = [sum(sizes[s] for s in range(256) if new[s] == i) for i in range(5)]
    assert max(load) < 1.03 * min(load) and all(b == 4 for a, b in zip(old, new) if a != b)


def test_language(spark, odd, none):
    r = language_id.identify(odd).toPandas()
    assert len(r) == 9 and set(r[r.doc_id.isin([4, 5, 8])].lang_pred) == {"und"} and r.score.between(0, 1).all()
    assert language_id.identify(none).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, None)], "doc_id long, quality int, toxic int")
    r = toxicity.score(odd, labels).toPandas()
    assert len(r) == 9 and r.score.between(0, 1).all()
    assert toxicity.score(none, labels).count() == 0
    # One id on many rows is one example, with its least text; other columns and the rows' order play no part.
    train = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"calm words about gardens {i}" if k % 2 else f"vile insult number {i}") for k, i in enumerate(train)]
    many = spark.createDataFrame([*rows, *[(train[0], f"vile insult again {j}") for j in range(300)]], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, 1 - k % 2) for k, i in enumerate(train)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(many, marks)
    assert sorted(model.index.ids.tolist()) == train
    low, high = [r.score for r in toxicity.score(spark.createDataFrame([(1, "calm words about gardens"), (2, "vile insult number")], "doc_id long, text string"), marks).orderBy("doc_id").collect()]
    assert low == high  # no labelled text here: the share of toxic labels
    scored = {r.doc_id: r.score for r in toxicity.score(many, marks).collect()}
    assert min(scored[i] for i in train[::2]) > 0.7 > 0.3 > max(scored[i] for i in train[1::2])
    rng = np.random.default_rng(5)
    at, example = np.divmod(rng.choice(40 * 300, 2500, replace=False), 300)
    value = rng.random(2500)
    index = toxicity.build(np.arange(40).astype(np.uint64), np.ones(40), np.arange(300), np.zeros(300), at, example, value)
    dense = np.zeros((40, 300))
    dense[at, example] = value
    for _ in range(20):
        t = np.sort(rng.choice(40, 6, replace=False))
        w = rng.random(6)
        best, score = index.nearest(t, w)
        want = w @ dense[t]
        assert best.tolist() == np.lexsort((np.arange(300), -want))[: len(best)].tolist() and np.allclose(score, want[best])


def test_secrets(spark, none):
    key = "aB3dE5gH7jK9mN1pQ4sT6vX8"
    text = f"é PassWord = 'hunter2x' token=abc AKIA{'A1' * 8} {'0a1b2c3d' * 4} key {key} 123e4567-e89b-12d3-a456-426614174000"
    r = secrets.find(spark.createDataFrame([(1, text), (2, None), (2, "")], "doc_id long, text string")).toPandas()
    one = r[r.doc_id == 1].iloc[0]
    assert (one.n_assign, one.n_access, one.n_hex, one.n_entropy) == (1, 1, 1, 1)
    found = [(k, text[int(a) : int(b)]) for k, a, b in (x.split(":") for x in one.spans.split(","))]
    assert found[0] == ("assign", "PassWord = 'hunter2x") and found[3] == ("entropy", key)
    assert r[r.doc_id == 2].base_sha256.tolist() == [hashlib.sha256(b"").hexdigest()] * 2
    assert secrets.find(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (None, 0, "user", "z")]
    r = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    assert sorted(r.conv_id.fillna(-1)) == [-1, 1, 4] and r[r.conv_id == 1].copies.tolist() == [2]
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_html(spark):
    page = "<html><body><header>Top</header><div class='cookie-notice'>ok</div><div>Same</div><article><h1>T&eacute;</h1><p>a<b>b</b>\n c<p>d<div class='comments'>no</div></article></body></html>"
    rows = [(1, "http://h/1", page), (2, None, None), (3, "x", ""), (4, "http://h/4", "<p>one<p>two &amp; <script>'</p>'</script>three")]
    r = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas().set_index("page_id").text
    assert r.to_dict() == {1: "Té ab c d", 2: "", 3: "", 4: "one two & three"}
    many = [(i, f"http://h/{i}", f"<body><div>Shared words</div><p>own {i}</p></body>") for i in range(8)]
    assert set(html_text.extract(spark.createDataFrame(many, "page_id long, url string, html string")).toPandas().text) == {f"own {i}" for i in range(8)}


def test_html_wrapper(spark):
    """A wrapper that holds the article besides a neutral text is no template, though it is alike on all pages but for the article."""
    rows = [(i, "http://h/", f"<body><div id=page><div class=brand>Site</div><{tag}><p>own {i}</p></{tag}></div></body>") for tag, i in zip(["article"] * 6 + ["main"] * 6, range(12))]
    r = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert dict(zip(r.page_id, r.text)) == {i: f"own {i}" for i in range(12)}


def test_html_slugs(spark):
    """Inside an article only a whole class token is boilerplate, no id and no part of a hyphenated token."""
    parts = "<section id=side-effects>b</section><section class='notice-period'>c</section><div id=comments>d</div><p class='note alert_levels'>e</p>"
    body = f"<body><div class=cookie-notice>no</div><article><p>a</p>{parts}<div class='box Comments'>no</div></article></body>"
    r = html_text.extract(spark.createDataFrame([(1, "http://h/", body), (2, "http://h/", body.replace("article", "main"))], "page_id long, url string, html string")).toPandas()
    assert r.text.tolist() == ["a b c d e"] * 2


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[30:40] = x[20]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(60, None, 0), (80, [0.0] * 8, 0), (100, [None] * 8, 0), (120, [float("nan")] * 8, 0), (None, x[0].tolist(), 0)]
    r = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas()
    s = x.astype(float) @ x.T.astype(float)
    for q in (0, 20, 40):
        order = [i for i in np.lexsort((np.arange(60), -s[q].round(12))) if i != q][:20]
        assert r[r.query_id == q].sort_values("rank").vec_id.tolist() == order
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_words():
    from tidemark.llm.text import word_hashes

    h, at = word_hashes(["One two, one", "", "TWO"])
    assert at.tolist() == [0, 3, 3, 4] and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 2
    assert len(re.findall(r"\w+", "One two, one")) == 3
