"""Sharding by fixed virtual slots.

Records are hashed into SLOTS slots, bytes are added up per slot, and a versioned map says which shard each slot is in. A map
is made by giving the largest slots first, each to the shard with the fewest bytes. Rebalancing edits the map: it moves as few
bytes as bring the shards near their mean, and touches no other slot. Only the map, of SLOTS rows, is ever on the driver.
Rows with equal doc_id and text share a slot up to CHUNK of them; more are dealt on, CHUNK to a slot, so that no row repeated often fills one.
All work on records is DataFrame operations.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, keep

SLOTS = 8192
SHARDS = 24
ROW_BYTES = 8
CHUNK = 1000
BROADCAST_ROWS = 100_000  # repeated rows' hashes of 8 bytes; more are joined by a shuffle


def plan(slot_bytes: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: the largest slots first, each into the lightest shard; empty slots go round."""
    out = [s % shards for s in range(slots)]
    heap = [(0, i) for i in range(shards)]
    for slot in sorted(slot_bytes, key=lambda s: (-slot_bytes[s], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + slot_bytes[slot], shard))
    return out


def rebalance(shard_of: list[int], slot_bytes: dict[int, int], shards: int, tolerance: float = 0.02) -> list[int]:
    """The map with slots moved from the heaviest to the lightest shard until each is within the tolerance of the mean, or no move helps.

    With more shards than before, the new ones fill; with fewer, the slots of those gone are dealt out first.
    """
    out = list(shard_of)
    load = [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(out):
        if shard < shards:
            load[shard] += slot_bytes.get(slot, 0)
            own[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-slot_bytes.get(s, 0), s)):
        to = min(range(shards), key=lambda i: (load[i], i))
        out[slot] = to
        own[to].append(slot)
        load[to] += slot_bytes.get(slot, 0)
    mean = sum(load) / shards
    while True:
        high, low = max(range(shards), key=lambda i: (load[i], -i)), min(range(shards), key=lambda i: (load[i], i))
        if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            return out
        room = min(load[high] - mean, mean - load[low]) if load[high] > mean and load[low] < mean else 0
        fit = [s for s in own[high] if 0 < slot_bytes.get(s, 0) < load[high] - load[low]]
        if not fit or room <= 0:
            return out
        slot = min(fit, key=lambda s: (abs(slot_bytes[s] - room), s))
        out[slot] = low
        own[high].remove(slot)
        own[low].append(slot)
        load[high] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]


def map_table(spark: SparkSession, shard_of: list[int], version: int = 1) -> DataFrame:
    return spark.createDataFrame([(version, slot, shard) for slot, shard in enumerate(shard_of)], "version int, slot int, shard int").coalesce(1)


def save_map(spark: SparkSession, path: str, shard_of: list[int], version: int) -> None:
    """Adds a version to the map stored at the path; earlier versions stay readable."""
    map_table(spark, shard_of, version).drop("version").write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    rows = spark.read.schema("slot int, shard int, version int").parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).head()[0]
    return version, [r.shard for r in rows.where(F.col("version") == version).orderBy("slot").collect()]


def record_hash():
    """Hash of doc_id and text, so that rows with equal or null ids do not gather."""
    return F.xxhash64("doc_id", "text")


def slot(hashed, chunk, slots: int = SLOTS):
    """The slot of a record by its hash, for the chunk of its repeats that it is in."""
    return F.pmod(F.when(chunk == 0, hashed).otherwise(F.xxhash64(hashed, chunk)), F.lit(slots)).cast("int")


def record_bytes():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes by slot, for records (slot, size): at most as many rows as slots."""
    return {r.slot: r.size_ for r in records.groupBy("slot").agg(F.sum("size").alias("size_")).collect()}


def shards(docs: DataFrame, n_shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    The law is `bytes`: shards have near equal sizes, as near as the largest record and the largest slot allow. `slot` is the
    record's place in its shard, from 0 without gaps, by virtual slot, doc_id (null first) and checksum; equal rows take
    places in any order. A null text has size ROW_BYTES and the checksum of the empty text. grown_shard is null under this law.
    """
    d = docs.select("doc_id", record_bytes().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), record_hash().alias("h"))
    d = d.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("n"))
    d = d.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    d = d.withColumn("rows", F.least(F.lit(CHUNK).cast("long"), F.col("n") - F.col("chunk") * CHUNK)).withColumn("slot", slot(F.col("h"), F.col("chunk"), slots))
    d = keep(d, "records")
    spark = docs.sparkSession
    per = {r.slot: (r.b, r.n) for r in d.groupBy("slot").agg(F.sum(F.col("size") * F.col("rows")).alias("b"), F.sum("rows").alias("n")).collect()}
    shard_of = plan({s: b for s, (b, _) in per.items()}, n_shards, slots)
    filled, starts = [0] * n_shards, []
    for s in range(slots):
        starts.append((s, shard_of[s], filled[shard_of[s]]))
        filled[shard_of[s]] += per.get(s, (0, 0))[1]
    # One row for each slot: a fixed size
    where = F.broadcast(spark.createDataFrame(starts, "slot int, shard int, start long").coalesce(1))
    before = Window.partitionBy("slot").orderBy("doc_id", "text_crc32", "size", "h", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("place", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long"))).join(where, "slot")
    d = d.withColumn("place", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("rows") - 1)))
    return d.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot")
    )


def assign(docs: DataFrame, n_shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Pipeline stage: the documents with their virtual_slot and shard, by a map made from their bytes.

    Null and empty texts count ROW_BYTES. Of rows repeated more than CHUNK times, each goes to one of their slots by its place in the table.
    """
    mark = docs.withColumn("__tm_h", record_hash())
    many = keep(mark.groupBy("__tm_h").agg(F.count("*").alias("__tm_n")).where(F.col("__tm_n") > CHUNK), "repeated")
    heavy = many.count()
    if heavy:
        mark = mark.withColumn("__tm_id", F.monotonically_increasing_id()).join(F.broadcast(many) if heavy <= BROADCAST_ROWS else many, "__tm_h", "left")
        chunk = F.coalesce(F.pmod(F.xxhash64("__tm_id"), F.ceil(F.col("__tm_n") / CHUNK)), F.lit(0).cast("long"))
    else:
        chunk = F.lit(0).cast("long")
        discard(many)
    mark = mark.select(*docs.columns, slot(F.col("__tm_h"), chunk, slots).alias("__tm_slot"))
    shard_of = plan(slot_bytes(mark.select(F.col("__tm_slot").alias("slot"), record_bytes().alias("size"))), n_shards, slots)
    where = map_table(docs.sparkSession, shard_of).select(F.col("slot").alias("__tm_slot"), F.col("shard").alias("__tm_shard"))
    out = mark.join(F.broadcast(where), "__tm_slot")
    return out.select(*docs.columns, F.col("__tm_slot").alias("virtual_slot"), F.col("__tm_shard").alias("shard"))
