"""Every stage of the pipeline against plain Python over what the stage before it kept."""

import re
import zlib
from collections import Counter

import corpus_pipeline
from test_near_dedup import brute_classes
from tidemark.llm import language_id, mixing

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs
        if name != "sharding":
            assert docs.columns == kept[""].columns

    # Language: what the operator finds to be of some language
    named = {r.doc_id for r in language_id.identify(kept[""]).where("lang_pred <> 'und'").collect()}
    first = plain(kept["language_id"])
    assert sorted(r[0] for r in first) == sorted(named)
    assert {r[0] for r in plain(kept[""])} - named == {r[0] for r in plain(kept[""]) if not any(c.isalpha() for c in r[1] or "")}

    # Near-duplicates: the least doc_id of each class by brute force
    first.sort()
    roots = brute_classes([r[1] for r in first])
    second = sorted(plain(kept["near_dedup"]))
    assert second == [r for i, r in enumerate(first) if roots[i] == i]

    # Benchmark: no document that holds ten consecutive words of an item, or a short item whole
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    clean = [r for r in second for w in [words(r[1])] if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))]
    third = sorted(plain(kept["decontamination"]))
    assert third == clean and len(third) < len(second)

    # Mixing: each source near its target, of documents that were there, none above three times its size
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in third}
    fourth = plain(kept["mixing"])
    assert set(fourth) <= set(third) and max(Counter(fourth).values()) <= 3
    by_source = Counter()
    for r in third:
        by_source[r[3]] += size[r[0]]
    goal = mixing.targets(list(by_source.items()))
    taken = Counter()
    for r in fourth:
        taken[r[3]] += size[r[0]]
    for s, target in goal.items():
        assert abs(taken[s] - target) <= max(0.01 * target, min(size[r[0]] for r in third if r[3] == s) / 2 + 1)

    # Sharding: every row, shards of near equal bytes
    out = kept["sharding"].toPandas()
    assert Counter(out.doc_id) == Counter(r[0] for r in fourth)
    assert set(out.columns) == {*COLUMNS, "virtual_slot", "shard"}
    out["bytes"] = out.text.str.encode("utf-8").str.len() + 8
    load = out.groupby("shard").bytes.sum()
    assert len(load) == 24 and load.max() - load.min() <= out.groupby("virtual_slot").bytes.sum().max()
    assert out.groupby("virtual_slot").shard.nunique().max() == 1 and zlib.crc32(b"") == 0


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"palabra{i} y word{i}" for i in range(40))
    some = [(i, text + f" {i}", "en" if i % 2 else "es", "ab"[i % 2], 1) for i in range(6)] + [(None, "otro texto aqui", "es", None, None), (7, None, None, None, None), (8, "", "en", "a", 0), (8, "", "en", "a", 0), (9, "1 2 3", "en", "b", 0)]
    items = spark.createDataFrame([(1, "never seen anywhere")], "item_id long, text string")
    for k, rows in enumerate((some, [])):
        at = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
        items.limit(len(rows)).write.parquet(f"{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, at).collect()
        assert all(any(c.isalpha() for c in r.text) for r in out) and len({r.doc_id for r in out}) <= 2
        assert bool(out) == bool(rows)
