"""Sharding against plain Python: sizes, places, shards, the stored map and its versions, repeated rows."""

import zlib
from collections import Counter, defaultdict

from tidemark.llm import sharding

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, slot int, shard string"


def test_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    r = sharding.shards(docs).toPandas()
    assert sorted(r.doc_id) == sorted(texts)
    load, places, shard_of = Counter(), defaultdict(list), {}
    for x in r.itertuples():
        assert x.size == len(texts[x.doc_id].encode()) + 8 and x.text_crc32 == zlib.crc32(texts[x.doc_id].encode())
        load[x.shard] += x.size
        places[x.shard].append(x.slot)
        assert shard_of.setdefault(x.virtual_slot, x.shard) == x.shard
    assert set(load) == set(range(24)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    # The law, as near as greedy filling can: a shard ends at most one slot above another.
    most = max(r.groupby("virtual_slot")["size"].sum())
    assert max(load.values()) - min(load.values()) <= most
    assert set(r.law) == {"bytes"} and r.grown_shard.isna().all()
    plan = sharding.plan(r.groupby("virtual_slot")["size"].sum().astype(int).to_dict(), 24)
    assert all(plan[v] == s for v, s in shard_of.items())


def test_map_versions(spark, tmp_path):
    """A stored map is edited: a new version moves only what the new shard takes, and the old one stays readable."""
    sizes = {s: 50 + s % 11 for s in range(512)}
    first = sharding.plan(sizes, 4, 512)
    path = f"file://{tmp_path}/map"
    sharding.save_map(spark, path, first, 1)
    version, read = sharding.load_map(spark, path)
    assert (version, read) == (1, first)
    second = sharding.rebalance(read, sizes, 5)
    sharding.save_map(spark, path, second, 2)
    assert sharding.load_map(spark, path) == (2, second) and sharding.load_map(spark, path, 1) == (1, first)
    assert all(b == 4 for a, b in zip(first, second) if a != b)
    back = sharding.rebalance(second, sizes, 4)
    assert set(back) == {0, 1, 2, 3} and all(a == b for a, b in zip(second, back) if a != 4)


def test_repeated_rows(spark):
    """Half of all rows are one row: they are dealt over slots, and the law holds."""
    rows = [(1, "same text", 5, "x")] * 12_000 + [(i, f"text {i}", 5, "x") for i in range(2, 12_000)] + [(None, None, None, None)] * 2500 + [(3, "", 1, "y")]
    docs = spark.createDataFrame(rows, DOC)
    r = sharding.shards(docs).toPandas()
    assert len(r) == len(rows) and (r.doc_id == 1).sum() == 12_000
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in r.groupby("shard"))
    load = r.groupby("shard")["size"].sum()
    assert r[r.doc_id == 1].virtual_slot.nunique() >= 11
    assert load.max() - load.min() <= max(r.groupby("virtual_slot")["size"].sum())
    out = sharding.assign(docs.withColumnRenamed("shard", "lot"))
    assert out.columns == ["doc_id", "text", "slot", "lot", "virtual_slot", "shard"]
    a = out.toPandas()
    assert len(a) == len(rows) and a[a.doc_id == 1].virtual_slot.nunique() >= 11
    assert Counter(a.doc_id.dropna()) == Counter(r.doc_id.dropna())
    assert sharding.assign(docs.limit(0)).count() == 0
