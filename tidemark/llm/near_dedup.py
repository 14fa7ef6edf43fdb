"""Near-duplicates by ProbMinHash, banding and verification.

Similarity is the probability Jaccard index of weighted shingles (runs of five words; weight 1 + ln(count)). For shingles
that occur once, it is the Jaccard index of the shingle sets. Steps:

1. Signatures. Every shingle is a Poisson process of its weight; an arrival falls on one of REGISTERS registers, and a register
   keeps the shingle of its earliest arrival. All first arrivals are made, then all second ones, and so on; a shingle ends
   early, at its first arrival later than every register of its text. Registers of two texts agree with a probability equal
   to their index.
2. Equal texts are one node from here on. Bands of ROWS registers make buckets; a pair at the threshold of 0.8 shares
   none of the BANDS buckets with a chance of about 3 in a million.
3. A node's centrality is the sum of its buckets' sizes: in a group of edited copies, the copy with the fewest edits is the
   most central, and nearest to all. Of each bucket, all nodes are compared with the most and the least central one,
   not with each other.
4. After components are known, each bucket that still holds several takes the most central node outside its largest component
   and compares it with those in other components. So far work is linear in the buckets' sizes.
   Then every pair of a shared bucket whose ends are still in different components is compared, so no link of a shared bucket is
   lost. Members of such a bucket are dealt to blocks by hash; a task holds two blocks, looks at the signatures of all pairs
   between them, and passes on members, not pairs, so rows stay linear in a bucket's size up to BLOCK. Texts are read of those
   members only, once a block pair. Pairs whose ends the links of the same task have joined meanwhile are not compared.
5. A comparison takes an estimate from the signatures (below ESTIMATE it ends; 0.8 is about 5 deviations away), then the exact index:
   from counts of shared shingles, one member against all at once, where no shingle repeats; else pair by pair, below a bound.

Texts are shuffled once, equal ones collapsed before it, and only those of nodes that share a bucket are kept for the comparisons. The plan is the
same at every size; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, keep
from .text import chunks, counted, mix, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
ESTIMATE = 0.6
PART_CHARS = 8_000_000  # of texts whose shingles a task holds, twice
BLOCK = 512  # members of a bucket of several components that meet another such block in one task

_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def weighted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, the text of each, and its weight."""
    h, text, n = counted(*shingle_hashes(texts, SHINGLE))
    return h, text, 1.0 + np.log(n)


def prob_min_hash(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures [text, register]; a row of zeros for a text without shingles."""
    first = np.full((n_texts, registers), np.inf)
    kept = np.zeros((n_texts, registers), np.uint64)
    q, s = first.ravel(), kept.ravel()
    at, state = np.zeros(len(h)), h.copy()
    while len(h):
        state = state + _GAMMA
        r = mix(state)
        at = at - np.log(((r >> np.uint64(11)) + np.uint64(1)).astype(float) * 2.0**-53) / weight
        k = text * registers + (mix(r ^ _GAMMA) >> np.uint64(32)).astype(np.int64) * registers // (1 << 32)
        np.minimum.at(q, k, at)
        won = q[k] == at
        s[k[won]] = h[won]
        on = at < first.max(1)[text]
        h, text, weight, at, state = h[on], text[on], weight[on], at[on], state[on]
    return kept


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact index of two sets of (sorted hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    h = np.union1d(ha, hb)
    if not len(h):
        return 0.0
    x, y = np.zeros(len(h)), np.zeros(len(h))
    x[np.searchsorted(h, ha)], y[np.searchsorted(h, hb)] = wa, wb
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    ratio = np.divide(y, x, out=np.full(len(h), np.inf), where=x > 0)
    order = np.argsort(ratio, kind="stable")
    r = ratio[order]
    below = np.concatenate(([0.0], np.cumsum(x[order])))
    above = np.concatenate((np.cumsum(y[order][::-1])[::-1], [0.0]))
    mine = ratio[both]
    k = np.searchsorted(r, mine, side="right")
    return float((x[both] / (below[k] + above[k] / mine)).sum())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = np.uint64(0xD1342543DE82EF95) ** np.arange(1, ROWS + 1, dtype=np.uint64)
    band = np.arange(1, BANDS + 1, dtype=np.uint64) * _GAMMA
    for b in batches:
        texts = b.column("text").to_pylist()
        for lo, hi in chunks(texts):
            h, text, w = weighted(texts[lo:hi])
            sig = prob_min_hash(h, text, w, hi - lo)
            some = np.bincount(text, minlength=hi - lo) > 0
            small = (sig >> np.uint64(40)).astype(np.uint16)
            # From the same 16 bits of a register that later tell whether two signatures share a band.
            key = mix((small.astype(np.uint64).reshape(-1, BANDS, ROWS) * steps).sum(2, dtype=np.uint64) + band).astype(np.int64)
            n = np.where(some, BANDS, 0)
            small = small.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id")[lo:hi],
                    b.column("node")[lo:hi],
                    pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.arange(hi - lo + 1, dtype=np.int32) * 2 * REGISTERS), pa.py_buffer(small)]),
                    pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(key[some].ravel())),
                ],
                names=["doc_id", "node", "sig", "buckets"],
            )


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            yield b.select(["a", "b"]).filter(pa.array((sa == sb).mean(1) >= ESTIMATE))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            ta, tb = b.column("ta").to_pylist(), b.column("tb").to_pylist()
            texts = list(dict.fromkeys(ta + tb))
            sets = dict(zip(texts, _shingle_sets(texts)))
            yield b.select(["a", "b"]).filter(pa.array([probability_jaccard(sets[x], sets[y]) >= SIMILARITY for x, y in zip(ta, tb)], pa.bool_()))


def _shingle_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for lo, hi in chunks(texts):
        h, text, w = weighted(texts[lo:hi])
        cut = np.searchsorted(text, np.arange(hi - lo + 1))
        out += [(h[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]) for i in range(hi - lo)]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (bucket, i, j) each, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("bucket", "i", "j")], 1)
        starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]))
        for lo, hi in zip(starts[:-1], starts[1:]):
            if held and tuple(key[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _members(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
    """Signatures, block and component of a group's rows, its band, and whether only rows of different blocks are to meet."""
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    root = np.unique(np.array([r.hex() for r in t["root"].to_pylist()]), return_inverse=True)[1]
    return sig, np.asarray(t["block"]), root, t["band"][0].as_py(), t["i"][0].as_py() != t["j"][0].as_py()


def _partners(x: int, sig: np.ndarray, block: np.ndarray, root: np.ndarray, band: int, apart: bool) -> np.ndarray:
    """Later rows of other components that are likely near row x, and share no earlier band with it: each pair is compared in its first."""
    y = x + 1 + np.flatnonzero((root[x + 1 :] != root[x]) & ((block[x + 1 :] != block[x]) if apart else True))
    if not len(y):
        return y
    same = sig[y] == sig[x]
    some = same.sum(1) >= ESTIMATE * REGISTERS
    y, same = y[some], same[some]
    return y[same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches):
        if t.num_rows > 1:
            held = _members(t)
            open_ = np.zeros(t.num_rows, bool)
            for x in range(t.num_rows - 1):
                y = _partners(x, *held)
                open_[y] = True
                open_[x] |= len(y) > 0
            if open_.any():
                yield from t.filter(pa.array(open_)).combine_chunks().to_batches()


class Shingles:
    """The shingles of a group's texts, coded from 0, for the index of one text with many at once."""

    def __init__(self, texts: list[str]):
        h, of, self.weight = (np.concatenate(x) for x in zip(*((h, text + lo, w) for lo, hi in chunks(texts) for h, text, w in [weighted(texts[lo:hi])])))
        self.code = np.unique(h, return_inverse=True)[1]
        self.cut = np.searchsorted(of, np.arange(len(texts) + 1))
        self.n = np.diff(self.cut)
        total = np.bincount(of, self.weight, len(texts))
        self.plain = total == self.n  # no shingle occurs twice
        self.part = self.weight / total[of]
        self.mark = np.zeros(self.code.max(initial=0) + 1)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.cut[i], self.cut[i + 1])
        return self.code[at], self.weight[at]

    def similar(self, x: int, y: np.ndarray) -> np.ndarray:
        """Those of y whose index with x is SIMILARITY or more."""
        own = slice(self.cut[x], self.cut[x + 1])
        n = self.n[y]
        at = np.repeat(self.cut[y] - np.cumsum(n) + n, n) + np.arange(n.sum())
        first = np.cumsum(n) - n
        self.mark[self.code[own]] = self.part[own]
        # Each shared shingle adds the smaller of its shares of the two texts at most: an upper bound of the index.
        bound = np.add.reduceat(np.minimum(self.mark[self.code[at]], self.part[at]), first)
        self.mark[self.code[own]] = 1.0
        both = np.add.reduceat(self.mark[self.code[at]] > 0, first)
        self.mark[self.code[own]] = 0.0
        plain = self.plain[y] & self.plain[x]
        near = np.where(plain, both >= SIMILARITY * (self.n[x] + n - both) - 1e-9, False)
        for k in np.flatnonzero(~plain & (bound >= SIMILARITY - 1e-9)):
            near[k] = probability_jaccard(self.row(x), self.row(y[k])) >= SIMILARITY
        return y[near]


def _parts(texts: list[str]) -> list[tuple[int, int]]:
    """Consecutive ranges of texts of about PART_CHARS characters; a longer text stands alone."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PART_CHARS:
            out.append((first, i))
            first, size = i, 0
        size += len(t)
    return [*out, (first, len(texts))]


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches):
        if t.num_rows < 2:
            continue
        sig, block, root, band, apart = _members(t)
        texts, node = t["text"].to_pylist(), t["node"].to_pylist()
        a, b = [], []
        # Shingles are held of two parts at a time, so that many long texts need no more memory than many short ones.
        parts = _parts(texts)
        for i, (lo, hi) in enumerate(parts):
            for first, last in parts[i:]:
                sets = Shingles(texts[lo:hi] + (texts[first:last] if first > lo else []))
                moved = first - (hi - lo) if first > lo else lo
                for x in range(lo, hi):
                    y = _partners(x, sig, block, root, band, apart)
                    y = y[(y >= first) & (y < last)]
                    for z in sets.similar(x - lo, y - moved) + moved if len(y) else y:
                        if root[x] != root[z]:
                            root[root == root[z]] = root[x]
                            a.append(node[x])
                            b.append(node[z])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


PAIR = "a binary, b binary"
MEMBER = "bucket long, i int, j int, block int, node binary, root binary, sig binary, band int"


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("node <> lead").select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).distinct()


def _confirm(pairs: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs that are similar, written to the shared folder."""
    p = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
    p = p.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    likely = keep(p.mapInArrow(_likely, PAIR), "likely")
    p = likely.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    p = p.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    out = keep(p.mapInArrow(_similar, PAIR), "links")
    discard(likely)
    return out


def _largest(wide: DataFrame) -> DataFrame:
    """(bucket, main, main_n, n) of the buckets of several components."""
    sizes = wide.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    best = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("best"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    return best.select("bucket", F.col("best.root").alias("main"), F.col("best.n").alias("main_n"), "n")


def _rest(wide: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join all components of wide (bucket, band, node, root) that a similar pair of a shared bucket joins.

    Blocks below `others` hold members outside a bucket's largest component; they meet each other and all blocks of that component.
    """
    open_ = wide.join(_largest(wide), "bucket")
    others = F.ceil((F.col("n") - F.col("main_n")) / BLOCK).cast("int")
    mains = F.ceil(F.col("main_n") / BLOCK).cast("int")
    own, spread = F.col("root") == F.col("main"), F.xxhash64("node", "bucket")
    block = F.when(own, F.col("others") + F.pmod(spread, "mains")).otherwise(F.pmod(spread, "others")).cast("int")
    open_ = open_.withColumns({"others": others, "mains": mains}).withColumn("block", block)
    met = F.explode(F.sequence(F.lit(0), F.when(own, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1))
    open_ = open_.select("bucket", "band", "node", "root", "block", met.alias("met"))
    open_ = open_.select("bucket", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"), "block", "node", "root", "band")
    key = ["bucket", "i", "j"]

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*key).sortWithinPartitions(*key)

    full = open_.join(sigs, "node").select(*key, "block", "node", "root", "sig", "band")
    likely = keep(dealt(full).mapInArrow(_open, MEMBER), "open")
    out = keep(dealt(likely.join(texts, "node")).mapInArrow(_join, PAIR), "links")
    discard(likely)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the links (a, b); the root is the least node of the component.

    Alternates large-star and small-star steps, which only join and take minima, until the links stop changing.
    """

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    links = keep(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").select("a", "b").distinct(), "star")
    seen = digest(links)
    while seen[0]:
        # a is the larger node of a link, b the smaller
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = keep(small.where("a <> b").distinct(), "star")
        discard(links)
        links, last, seen = new, seen, digest(new)
        if seen == last:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _signed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")
    return texts.select("node", "text"), keep(texts.mapInArrow(_signatures, "doc_id long, node binary, sig binary, buckets array<long>"), "signatures")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, class_id, class_node, class_size, n_texts) for each distinct text, node being the md5 of the text; and (doc_id, node) of all rows.

    class_id is the least doc_id of the class, class_node the text that carries it (the least of them, should several).
    """
    texts, signed = _signed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sigs = keep(signed.select("node", "sig", "buckets").dropDuplicates(["node"]), "nodes")
    member = sigs.select("node", F.posexplode("buckets").alias("band", "bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep(member.join(shared, "bucket"), "buckets")
    central = keep(shared.groupBy("node").agg(F.sum("n").alias("central")), "central")
    member = keep(shared.join(central, "node").select("bucket", "band", "node", F.struct("central", "node").alias("rank")), "members")
    # The one shuffle of texts. Equal ones collapse in the map tasks; min takes one of them.
    texts = keep(texts.groupBy("node").agg(F.min("text").alias("text")).join(central.select("node"), "node"), "texts")
    discard(shared, central)
    ends = member.groupBy("bucket").agg(F.max("rank").alias("top"), F.min("rank").alias("end"))
    pairs = member.join(ends, "bucket").select("node", F.explode(F.array("top.node", "end.node")).alias("lead"))
    first = _confirm(_pairs(pairs), sigs, texts)

    root = components(first)
    wide = keep(member.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "wide")
    main = _largest(wide).select("bucket", "main")
    lead = wide.join(main, "bucket").where("root <> main").groupBy("bucket").agg(F.max(F.struct("rank", "root")).alias("lead"))
    pairs = wide.join(lead, "bucket").where("root <> lead.root").select("node", F.col("lead.rank.node").alias("lead"))
    second = _confirm(_pairs(pairs), sigs, texts)
    if second.limit(1).count():
        root = components(first.unionByName(second))
        discard(wide)
        wide = keep(member.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "wide")
    third = _rest(wide.select("bucket", "band", "node", "root"), sigs, texts)
    if third.limit(1).count():
        root = components(first.unionByName(second).unionByName(third))

    node = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    node = node.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = node.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("m"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts")
    )
    whole = whole.select("root", F.col("m.doc_id").alias("class_id"), F.col("m.node").alias("class_node"), "class_size", "n_texts")
    out = keep(node.select("node", "root").join(whole, "root").drop("root"), "classes")
    discard(sigs, member, wide, first, second, third, texts)
    return out, signed.select("doc_id", "node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size (documents), n_texts (different texts), keep.

    Equal texts are one class, empty ones too; a text without words is near to no other. A null text is a class of its own:
    class_id is its doc_id. `keep` marks the documents that carry the class's id (repeated rows all do). A null doc_id comes last.
    Texts are compared whole, whatever their length.
    """
    found, signed = classes(docs)
    rows = signed.join(found, "node").select(
        "doc_id", "class_id", "class_size", "n_texts", ((F.col("doc_id").eqNullSafe(F.col("class_id"))) & (F.col("node") == F.col("class_node"))).alias("keep")
    )
    none = docs.where(F.col("text").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    one = F.lit(1).cast("long")
    return rows.unionByName(none.select("doc_id", F.col("doc_id").alias("class_id"), one.alias("class_size"), one.alias("n_texts"), F.lit(True).alias("keep")))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each class, with all its columns; documents of null text stay."""
    found, _ = classes(docs)
    best = found.select(F.col("class_id").alias("__tm_id"), F.col("class_node").alias("__tm_node")).distinct()
    own = F.unhex(F.md5(F.col("text").cast("binary")))
    some = docs.where(F.col("text").isNotNull())
    some = some.join(best, own.eqNullSafe(F.col("__tm_node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__tm_id")), "left_semi")
    w = Window.partitionBy("doc_id", F.md5(F.col("text").cast("binary"))).orderBy(F.lit(0))
    some = some.withColumn("__tm_n", F.row_number().over(w)).where("__tm_n = 1").drop("__tm_n")
    return some.unionByName(docs.where(F.col("text").isNull()))
