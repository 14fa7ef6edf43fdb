"""Benchmark decontamination: a hash set of the test items' word windows against all windows of the training texts.

Words are the runs of digits, a-z and anything outside ASCII, A-Z taken as a-z. A window is WINDOW consecutive words of an
item; an item of fewer words, but not none, is one window. Every document's windows are looked up by hash; for those found the
words themselves are compared. All of it is DataFrame operations: the windows of a document are generated and looked up
inside one code-generated stage, and one row per document is shuffled.

The window table is broadcast only if it has at most BROADCAST_WINDOWS rows (about 200 bytes each). Of a larger benchmark, first the
windows that occur at all are found: the distinct window hashes of the documents, 8 bytes each and collapsed before they are
shuffled, meet those of the benchmark. These windows alone go on, in parts of BROADCAST_WINDOWS, each of which is looked
up as above in one more scan. No text is shuffled on either way.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

WINDOW = 10
BROADCAST_WINDOWS = 200_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z have become a-z
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _words(text: Column, pattern: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda w: w != "")


def windows(items: DataFrame) -> DataFrame:
    """(n, words, item_ids) for each distinct window: its number of words, the words, and the items that have it."""
    w = items.select("item_id", _words(_ascii_lower(F.col("text")), NOT_WORD).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    w = w.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    return w.groupBy("n", F.slice("w", F.col("i"), F.col("n")).alias("words")).agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))


def _key(hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(hashes, at + j) for j in range(n)])


def _keyed(items: DataFrame) -> tuple[list[int], DataFrame]:
    """The numbers of words of the windows, and (key, win_n, win_text, item_ids) of each window."""
    win = windows(items)
    lengths = sorted(r.n for r in win.select("n").distinct().collect())  # at most WINDOW
    # Whether a window's words have the hash that a document's words would have: lower() joins more than A-Z, never less.
    own = F.transform("words", lambda w: F.xxhash64(F.lower(w)))
    key = F.lit(None).cast("long")
    for n in lengths:
        key = F.when(F.col("n") == n, _key(own, F.lit(0), n)).otherwise(key)
    return lengths, win.select(key.alias("key"), F.col("n").alias("win_n"), F.array_join("words", " ").alias("win_text"), "item_ids")


def _positions(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Each window of each row (row, rid, text) with its key; position -1 stands for the row itself, so that it stays without a hit."""
    d = rows.select("row", "rid", _words(F.col("text"), NOT_WORD_ANY_CASE).alias("words"))
    d = d.select("row", "rid", "words", F.transform("words", lambda w: F.xxhash64(F.lower(w))).alias("h"), F.size("words").alias("n_words"))
    d = d.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - 1, F.lit(-1)))).alias("at"))
    keys = [F.when((F.col("at") >= 0) & (F.col("at") + n <= F.col("n_words")), _key(F.col("h"), F.col("at"), n)) for n in lengths]
    if len(keys) == 1:
        d = d.withColumn("key", keys[0])
    elif keys:
        d = d.withColumn("key", F.explode(F.array(*keys)))
    else:
        d = d.where("at = -1").withColumn("key", F.lit(None).cast("long"))
    return d.where("at = -1 or key is not null")


def _looked_up(positions: DataFrame, win: DataFrame) -> DataFrame:
    """The rows themselves, and the windows that occur with the same words."""
    d = positions.join(F.broadcast(win), "key", "left").where("at = -1 or win_n is not null")
    # No lambda function up to here: it would leave the code-generated stage, and every window would carry its document.
    found = _ascii_lower(F.array_join(F.slice("words", F.greatest(F.col("at"), F.lit(0)) + 1, F.coalesce("win_n", F.lit(0))), " "))
    d = d.withColumn("hit", F.when((F.col("at") >= 0) & (found == F.col("win_text")), F.struct("at", "win_n")))
    return d.select(F.when(F.col("at") == -1, F.col("row")).alias("row"), "rid", "n_words", "hit", F.when(F.col("hit").isNotNull(), F.col("item_ids")).alias("item_ids"))


def marked(docs: DataFrame, items: DataFrame, carry: list[str], most: int = BROADCAST_WINDOWS) -> DataFrame:
    """Of every document row: row (a struct of the carried columns), n_words, hit (array of the positions of hit words, from 0), item_ids (sorted)."""
    lengths, win = _keyed(items)
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.monotonically_increasing_id().alias("rid"), "text")
    if win.limit(most + 1).count() <= most:
        d = _looked_up(_positions(rows, lengths), win)
    else:
        rows = keep(rows, "rows")  # several scans are to agree on rid
        keys = _positions(rows, lengths).where("at >= 0").select("key").distinct()
        win = keep(win.join(keys, "key", "left_semi"), "windows")
        parts = max(1, math.ceil(win.count() / most))
        part = F.pmod(F.xxhash64(F.lit(parts), "key"), parts)
        d = _looked_up(_positions(rows, lengths), win.where(part == 0))
        for i in range(1, parts):
            d = d.unionByName(_looked_up(_positions(rows, lengths), win.where(part == i)).where("hit is not null"))
    out = d.groupBy("rid").agg(
        F.max("row").alias("row"),
        F.max("n_words").alias("n_words"),
        F.collect_set("hit").alias("hits"),
        F.flatten(F.collect_set("item_ids")).alias("item_ids"),
    )
    hit = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["win_n"] - 1))))
    return out.select("row", F.col("n_words").cast("long").alias("n_words"), hit.alias("hit"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids.

    A null or empty text has no words; no item means no hit, and the digest is that of the empty string. An item of null id
    hits, but has no name to count. A window that several items share counts for each. Texts are read whole; repeated rows stay apart.
    """
    m = marked(docs, items, ["doc_id"], most)
    return m.select(
        "row.doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
        "item_ids",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: documents without a hit word, with all their columns."""
    return marked(docs, items, docs.columns).where(F.size("hit") == 0).select("row.*")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
di AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT rid, i, n, item_id FROM (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di) JOIN bw USING (n, g)),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""
