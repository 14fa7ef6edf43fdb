"""Approximate nearest neighbours by largest inner product, from a forest of random-projection trees.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and queries a zero: largest inner product is then
smallest angle. The trees are grown on the driver from a bounded sample (SAMPLE vectors by hash); a node splits its
sample at the median along the difference of two of its members. Every vector is put into one leaf of each tree. A query goes
down all trees through one shared priority queue: the branch not taken waits with its margin, and the nearest waiting branch of
any tree is opened next. How many leaves to open is measured, not guessed: for CALIBRATION queries the true neighbours are found
by brute force over all vectors, and the number of leaves is the least that would hold TARGET of them (clustered vectors need few;
vectors without structure need many, as in any index of this kind).

The trees are no deeper than the sample can split (LEAST of it in a leaf), so the forest has a size bound at any number of vectors; in a
larger table every leaf is dealt by hash to as many cells as keep about `leaf` vectors in each. A cell and the queries that opened its leaf meet in
one group. Their inner products are taken at once; whatever may belong to the K + 1 best, ties at the cut too, is scored again, in
double precision from the original components and in one order of addition, so that ties and order are exact.
A query's K + 1-th best in its first FIRST leaves bounds its neighbours' products from below, so few pairs leave the other leaves.

Equal vectors are one candidate: the K + 1 least ids of a vector stand for it, and no other could be among a query's nearest K. Queries
of equal vectors are searched once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fraction, keep

K = 20
TREES = 4
LEAF = 1000  # vectors in a cell, about
SAMPLE, LEAST = 60_000, 30  # vectors that the trees are grown from, and how many of them a leaf holds at least
CALIBRATION, TARGET = 100, 0.95
FIRST = 4  # leaves that give the lower bound
SEED = 20_001


def grow(sample: np.ndarray, depth: int, trees: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Planes [tree, node, dimension] and thresholds [tree, node] of complete trees; the children of node i are 2i + 1 and 2i + 2."""
    rng = np.random.default_rng(seed)
    nodes = (1 << depth) - 1
    planes = np.zeros((trees, nodes, sample.shape[1]), np.float32)
    cuts = np.zeros((trees, nodes), np.float32)
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for i in range(nodes):
            own = members.pop(i)
            d = np.zeros(sample.shape[1])
            for _ in range(8):
                if len(own) > 1:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    d = a - b
                    if np.linalg.norm(d) > 1e-9:
                        break
            if np.linalg.norm(d) <= 1e-9:
                d = rng.standard_normal(sample.shape[1])
            planes[t, i] = d / np.linalg.norm(d)
            s = sample[own] @ planes[t, i]
            cuts[t, i] = np.median(s) if len(own) else 0.0
            right = s > cuts[t, i]
            members[2 * i + 1], members[2 * i + 2] = own[~right], own[right]
    return planes, cuts


def leaves(x: np.ndarray, planes: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each vector in each tree [vector, tree], numbered over all trees."""
    trees, nodes = cuts.shape
    at = np.zeros((len(x), trees), np.int64)
    own = np.arange(trees)
    for _ in range(depth):
        for t in own:
            n = at[:, t]
            at[:, t] = 2 * n + 1 + (np.einsum("ij,ij->i", x, planes[t, n]) > cuts[t, n])
    return at - nodes + own * (nodes + 1)


def search(v: np.ndarray, planes: np.ndarray, cuts: np.ndarray) -> Iterator[int]:
    """The leaves in the order in which a query opens them, by one priority queue over all trees."""
    trees, nodes = cuts.shape
    side = (planes @ v - cuts).tolist()
    queue = [(0.0, t, 0) for t in range(trees)]
    while queue:
        far, t, n = heapq.heappop(queue)
        s = side[t]
        while n < nodes:
            m = s[n]
            near, other = (2 * n + 2, 2 * n + 1) if m > 0 else (2 * n + 1, 2 * n + 2)
            heapq.heappush(queue, (max(far, abs(m)), t, other))
            n = near
        yield n - nodes + t * (nodes + 1)


def visits_needed(queries: np.ndarray, found: list[np.ndarray], planes: np.ndarray, cuts: np.ndarray, depth: int, target: float = TARGET) -> int:
    """Leaves to open so that the given share of the queries' true neighbours (augmented vectors) is in one of them. A share above 1 opens all."""
    if target > 1:
        return cuts.shape[0] * (cuts.shape[1] + 1)
    ranks: list[int] = []
    for q, x in zip(queries, found):
        at = leaves(x, planes, cuts, depth)
        left = {i: set(row) for i, row in enumerate(at.tolist())}
        for n, leaf in enumerate(search(q, planes, cuts), 1):
            for i in [i for i, s in left.items() if leaf in s]:
                del left[i]
                ranks.append(n)
            if not left:
                break
    return sorted(ranks)[min(len(ranks) - 1, math.ceil(target * len(ranks)))] if ranks else 1


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _augment(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(0.0, most**2 - (x * x).sum(1)))[:, None])).astype(np.float32)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, added from the first component to the last."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def best_pairs(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, ties to the smaller found."""
    order = np.lexsort((found, -score, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def _meet(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One cell: its queries' K + 1 best of its vectors, those below the query's floor left out."""
    empty = pa.table({"query": pa.array([], pa.int64()), "found": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not left.num_rows or not right.num_rows:
        return empty
    ids, x = np.asarray(left["id"]), _matrix(left["e"].combine_chunks())
    k = min(K + 1, len(ids))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    q, e, floor = np.asarray(right["id"]), _matrix(right["e"].combine_chunks()), np.asarray(right["floor"])
    slack = 1e-9 * np.sqrt((e * e).sum(1)) * np.sqrt((x * x).sum(1).max())
    for at in range(0, len(q), 256):
        part = slice(at, at + 256)
        s = e[part] @ x.T
        cut = np.maximum(floor[part], np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]) - slack[part]
        r, c = np.nonzero(s >= cut[:, None])
        for lo in range(0, len(r), 1 << 17):  # ties may be many
            i, j = r[lo : lo + (1 << 17)], c[lo : lo + (1 << 17)]
            score = exact_scores(e[part][i], x[j])
            top = best_pairs(i, ids[j], score, k)
            out.append((q[part][i[top]], ids[j[top]], score[top]))
    a, b, c = (np.concatenate(z) for z in zip(*out))
    return pa.table({"query": a, "found": b, "score": c})


def _brute(reps: DataFrame, queries: np.ndarray) -> list[np.ndarray]:
    """The K vectors of largest inner product with each of a few queries, by a scan of all; the query itself is not told apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = np.zeros((len(queries), 0)), np.zeros((len(queries), 0, queries.shape[1]), np.float32)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("e"))
                s = np.hstack((best, queries @ x.T))
                k = min(K + 1, s.shape[1])
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                old = best.shape[1]
                new = np.zeros((len(queries), k, queries.shape[1]), np.float32)
                for i, t in enumerate(top):
                    new[i][t < old], new[i][t >= old] = rows[i][t[t < old]], x[t[t >= old] - old]
                best, rows = np.take_along_axis(s, top, 1), new
        if best.shape[1]:
            i, j = np.divmod(np.arange(best.size), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best.ravel()), pa.array(list(rows[i, j]), pa.list_(pa.float32()))], names=["q", "s", "e"])

    w = Window.partitionBy("q").orderBy(F.desc("s"))
    top = reps.mapInArrow(scan, "q long, s double, e array<float>").withColumn("r", F.row_number().over(w)).where(F.col("r") <= K + 1).toArrow()
    q, e = np.asarray(top["q"]), _matrix(top["e"].combine_chunks())
    return [e[q == i] for i in range(len(queries))]


def nearest(
    vectors: DataFrame, every: int = 20, trees: int = TREES, leaf: int = LEAF, target: float = TARGET, sample: int = SAMPLE, least: int = LEAST
) -> DataFrame:
    """The K nearest found of each query: query_id, rank, vec_id, score. Queries are the rows whose vec_id is divisible by `every`.

    Rows with a null vec_id take no part, nor do null or zero vectors and those that hold a null or non-finite component. A query is
    compared with vectors of its own length; each length has a forest. Ties go to the smaller vec_id; equal vectors of
    different ids are different neighbours. With no query or no candidate the result is empty. Vectors of doubles are kept as doubles.
    """
    wide = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{wide}>").alias("e"))
    v = v.where(
        F.coalesce(
            F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("e", lambda c: c != 0),
            F.lit(False),
        )
    )
    norm = F.aggregate("e", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    sizes = v.groupBy(F.size("e").alias("d")).agg(F.max(norm).alias("m")).orderBy("d").collect()  # a row for each length
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, r in enumerate(sizes):
        one = _nearest(v.where(F.size("e") == r.d), math.sqrt(r.m), wide, every, trees, leaf, target, sample, least)
        out = one if not i else out.unionByName(one)
    return out


def _nearest(v: DataFrame, most: float, wide: str, every: int, trees: int, leaf: int, target: float, sample_size: int, least: int) -> DataFrame:
    spark = v.sparkSession
    # A partial limit by vector comes before the shuffle, so copies of one vector don't gather.
    w = Window.partitionBy("e").orderBy("id")
    few = v.withColumn("k", F.row_number().over(w)).where(F.col("k") <= K + 1)
    few = keep(few.withColumn("rep", F.min("id").over(Window.partitionBy("e"))).select("id", "e", "rep").distinct(), "vectors")
    reps = few.where("id = rep").select("id", "e").distinct()
    asked = v.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "e")
    asked = keep(asked.join(few.where("id = rep").select("e", "rep"), "e").select("query_id", "rep"), "queries")
    n = reps.count()
    q = reps.join(asked.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    share = sample_size / n
    sample = reps if share >= 1 else reps.where(fraction(F.col("id"), F.lit(SEED)) < share)
    drawn = _matrix(sample.orderBy(F.xxhash64("id"), "id").select("e").toArrow()["e"].combine_chunks())  # about sample_size
    depth = max(0, min(math.ceil(math.log2(max(1, n / leaf))), math.floor(math.log2(max(1, len(drawn) / least)))))
    cells = max(1, round(n / leaf / (1 << depth)))  # of each leaf
    planes, cuts = grow(_augment(drawn, most), depth, trees)
    forest = spark.sparkContext.broadcast((planes, cuts))  # trees * 2**depth * (dimension + 2) * 4 bytes, and 2**depth is sample_size / least at most
    trial = q.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).toArrow()
    if not trial.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trial_x = _matrix(trial["e"].combine_chunks())
    true = _brute(reps, trial_x)
    flat_q = np.hstack((trial_x, np.zeros((len(trial_x), 1)))).astype(np.float32)
    visits = max(FIRST, visits_needed(flat_q, [_augment(x, most) for x in true], planes, cuts, depth, target))
    row = f"id long, e array<{wide}>"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = leaves(_augment(_matrix(b.column("e")), most), *forest.value, depth)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("e"), pa.array(list(at), pa.list_(pa.int64()))], names=["id", "e", "leaf"])

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                x = _matrix(part.column("e"))
                opened = [list(islice(search(r, *forest.value), visits)) for r in np.hstack((x, np.zeros((len(x), 1)))).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("e"), pa.array(opened, pa.list_(pa.int64()))], names=["id", "e", "leaf"])

    def met(opened: DataFrame) -> DataFrame:
        """Every cell's best for the queries (id, e, floor, leaf array)."""
        cell = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
        right = opened.select("id", "e", "floor", F.explode("leaf").alias("leaf")).select("id", "e", "floor", "leaf", cell.alias("cell"))
        got = index.groupBy("leaf", "cell").cogroup(right.groupBy("leaf", "cell")).applyInArrow(_meet, "query long, found long, score double")
        return keep(got, "met")

    def top(got: DataFrame) -> DataFrame:
        near = Window.partitionBy("query").orderBy(F.desc("score"), "found")
        return got.distinct().withColumn("r", F.row_number().over(near)).where(F.col("r") <= K + 1)

    index = reps.mapInArrow(put, f"{row}, leaf array<long>").select("id", "e", F.explode("leaf").alias("leaf"), F.pmod(F.xxhash64("id"), cells).cast("int").alias("cell"))
    opened = keep(q.repartition("id").mapInArrow(open_, f"{row}, leaf array<long>"), "opened")
    low = F.lit(float("-inf"))
    first = met(opened.select("id", "e", low.alias("floor"), F.slice("leaf", 1, FIRST).alias("leaf")))
    floor = top(first).where(F.col("r") == K + 1).select(F.col("query").alias("id"), F.col("score").alias("floor"))
    rest = opened.join(floor, "id", "left").select("id", "e", F.coalesce("floor", low).alias("floor"), F.slice("leaf", FIRST + 1, visits).alias("leaf"))
    got = top(first.unionByName(met(rest))).select("query", "found", "score")

    # All ids of the found vectors, the K + 1 nearest of a query's vector; then every query leaves out itself.
    ids = few.select(F.col("rep").alias("found"), F.col("id").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = got.join(ids, "found").withColumn("r", F.row_number().over(order)).where(F.col("r") <= K + 1)
    lists = keep(lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")), "lists")
    discard(first, opened)
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    out = asked.join(lists, asked["rep"] == lists["query"]).select("query_id", F.posexplode(F.slice(own, 1, K)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
