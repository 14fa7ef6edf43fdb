"""Mixing sources to target weights by the cube method.

Each source's target over its size is the number of copies that its documents should have; the whole part is given to all,
the rest is an inclusion probability. Equal rows are one unit: their copies together have a whole part and one such rest, so that
repeated rows are neither one block nor one task. Units to include are drawn by the cube method: a walk of the probabilities through
the null space of two totals, words and documents, which stay exact while each step settles a unit. In a block of BLOCK
units all but two are settled so. The two left over of every block make the blocks of the next level, until a source has
one block. About RESERVE units of every larger source, by hash, wait for that last block. There at most two units are landed by the
rounding nearest to both totals, and the words still missing are made up by exchanges of units drawn against units not drawn, or by
single units, as long as that brings the source nearer to its target (`repair`). A block is one task's bounded work, however large the source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fraction, keep

WEIGHTS = (1.0, 2.0, 3.0)  # of the sources by code point, repeating
MOST = 3.0  # times a source's size
BLOCK, RESERVE = 4000, 400
CHUNK = 1000  # repeated rows written by one task at a time
MAX_SOURCES = 1_000_000  # a row each on the driver; more are refused, not dropped


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Target of each source: a share of all sizes by weight, at most `most` times its size; the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = np.array([weights[i % len(weights)] for i in range(len(order))])
    cap = np.array([most * s for _, s in order], float)
    rest, full = float(sum(s for _, s in order)), np.zeros(len(order), bool)
    out = np.zeros(len(order))
    while not full.all():
        share = (rest - cap[full].sum()) * w / w[~full].sum()
        over = ~full & (share > cap)
        if not over.any():
            out[~full] = share[~full]
            break
        full |= over
    out[full] = cap[full]
    return {s: float(t) for (s, _), t in zip(order, out)}


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves the probabilities p, with the columns of x kept in balance, until at most as many as x's columns are left between 0 and 1."""
    p = p.copy()
    k = x.shape[1]
    eps = 1e-9
    waiting = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    scale = np.abs(x).max(0)
    x = x / np.where(scale > 0, scale, 1)
    draws = rng.random(len(waiting) + k + 1)
    hand, nxt, step = waiting[: k + 1], k + 1, 0
    while len(hand) == k + 1:
        a = x[hand]
        if k == 2:
            # The null space of two rows over three units is their cross product.
            (a0, b0), (a1, b1), (a2, b2) = a.tolist()
            u = [a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0]
            if max(map(abs, u)) < 1e-12:
                # The rows are parallel: keep the larger of them.
                r = [a0, a1, a2] if max(abs(a0), abs(a1), abs(a2)) > 1e-12 else [b0, b1, b2]
                i = min(range(3), key=lambda j: abs(r[j]))
                j, l = [m for m in range(3) if m != i]
                u = [0.0, 0.0, 0.0]
                if abs(r[i]) < 1e-12:
                    u[i] = 1.0
                else:
                    u[j], u[l] = r[l], -r[j]
        else:
            u = np.linalg.svd(a.T)[2][-1].tolist()
        up = down = math.inf
        for i, d in zip(hand, u):
            if d > 1e-12:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < -1e-12:
                up, down = min(up, -p[i] / d), min(down, -(1 - p[i]) / d)
        move = up if draws[step] * (up + down) < down else -down
        step += 1
        stay = []
        for i, d in zip(hand, u):
            v = p[i] + move * d
            if v < eps:
                p[i] = 0.0
            elif v > 1 - eps:
                p[i] = 1.0
            else:
                p[i] = v
                stay.append(i)
        if len(stay) == len(hand):  # rounding left all of them inside: settle the nearest
            i = min(hand, key=lambda m: min(p[m], 1 - p[m]))
            p[i] = round(p[i])
            stay.remove(i)
        hand = stay
        while len(hand) < k + 1 and nxt < len(waiting):
            hand.append(waiting[nxt])
            nxt += 1
        if step >= len(draws):
            draws = np.concatenate((draws, rng.random(len(draws))))
    return p


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The rounding of the few open probabilities that leaves the first total of x nearest to balance; the others weigh a hundredth."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    best, out = math.inf, p
    scale = np.where(np.abs(x).sum(0) > 0, np.abs(x).sum(0), 1)
    for bits in range(1 << len(open_)):
        q = p.copy()
        q[open_] = [bits >> i & 1 for i in range(len(open_))]
        miss = float((np.abs(((q - p) @ x) / scale) * np.where(np.arange(x.shape[1]) == 0, 1, 0.01)).sum())
        if miss < best - 1e-15:
            best, out = miss, q
    return out


def repair(q: np.ndarray, p: np.ndarray, size: np.ndarray, rounds: int = 100) -> np.ndarray:
    """q (0 or 1 of each unit) with units exchanged, or single ones turned, while that lessens the miss of the sizes drawn against p's.

    Only units whose p is open may change. Of equal misses an exchange is taken, as it keeps the number of units.
    """
    q = q.copy()
    open_ = (p > 1e-9) & (p < 1 - 1e-9) & (size > 0)
    for _ in range(rounds):
        miss = float(((q - p) * size).sum())
        if abs(miss) < 0.5:
            break
        best, turn = abs(miss) - 1e-6, []
        out, in_ = np.flatnonzero(open_ & (q == 0)), np.flatnonzero(open_ & (q == 1))
        if len(out) and len(in_):
            out = out[np.argsort(size[out], kind="stable")]
            # in_ j leaves and out i enters: size[i] should be near size[j] - miss
            at = np.searchsorted(size[out], size[in_] - miss)
            for k in (np.clip(at - 1, 0, len(out) - 1), np.clip(at, 0, len(out) - 1)):
                left = np.abs(miss - size[in_] + size[out[k]])
                j = int(left.argmin())
                if left[j] < best:
                    best, turn = float(left[j]), [in_[j], out[k[j]]]
        every = np.flatnonzero(open_)
        if len(every):
            left = np.abs(miss + np.where(q[every] == 0, 1, -1) * size[every])
            j = int(left.argmin())
            if left[j] < best - 0.5:
                best, turn = float(left[j]), [every[j]]
        if not turn:
            break
        q[turn] = 1 - q[turn]
    return q


UNIT = "__tm_unit string, id string, source string, size long, n long, p double"


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large units first: those left over at the end are small.
        pdf = pdf.sort_values(["size", "__tm_unit"], ascending=[False, True], kind="stable")
        size, p = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float)
        x = np.column_stack((size, np.ones(len(size))))
        seed = int(pd.util.hash_array(pdf["__tm_unit"].to_numpy(object)).sum(dtype=np.uint64))
        q = flight(p, x, np.random.default_rng(seed))
        return pdf.assign(p=repair(landing(q, x), p, size) if last else q)[["__tm_unit", "id", "source", "size", "n", "p"]]

    return run


def _settle(units: DataFrame, counts: dict[str | None, int], block: int, reserve: int) -> tuple[DataFrame, list[DataFrame]]:
    """All units with p in {0, 1}, and the tables that this reads."""
    spark = units.sparkSession
    done, made, waiting = [], [], []
    while wide := {s: n for s, n in counts.items() if n > block}:
        rows = [(s, math.ceil(n / block), reserve / n if not made else 0.0) for s, n in wide.items()]
        plan = F.broadcast(spark.createDataFrame(rows, "__tm_s string, __tm_b long, __tm_r double").coalesce(1))  # a row for each source
        u = units.join(plan, F.col("source").eqNullSafe(F.col("__tm_s")), "left").withColumn(
            "__tm_wait", F.col("__tm_b").isNull() | (fraction(F.col("__tm_unit"), F.lit("reserve")) < F.col("__tm_r"))
        )
        waiting.append(u.where("__tm_wait").select(units.columns))
        u = u.where("not __tm_wait").withColumn("__tm_block", F.pmod(F.xxhash64("__tm_unit", "size"), F.col("__tm_b")))
        flown = keep(u.groupBy("source", "__tm_block").applyInPandas(_fly(False), UNIT), "flight")
        made.append(flown)
        left = "p > 0 and p < 1"
        done.append(flown.where(f"not ({left})"))
        units = flown.where(left)
        counts = {r.source: r.n for r in units.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for w in waiting:
        units = units.unionByName(w)
    flown = keep(units.groupBy("source").applyInPandas(_fly(True), UNIT), "flight")
    out = flown
    for d in done:
        out = out.unionByName(d)
    return out, [*made, flown]


def mix(units: DataFrame, block: int = BLOCK, reserve: int = RESERVE) -> DataFrame:
    """Copies for units (unit string, id string, source, size long, n long: equal rows, each of that size).

    Adds source_size, target, base and extra: of a unit's n rows, `extra` are taken base + 1 times and the others base times.
    """
    units = keep(units.select(F.col("unit").alias("__tm_unit"), F.col("id").cast("string").alias("id"), "source", "size", "n"), "units")
    got = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets([(r.source, r["size"]) for r in got])
    rows = [(r.source, r["size"], goal[r.source], int(goal[r.source] // r["size"]) if r["size"] else 0, goal[r.source] / r["size"] % 1 if r["size"] else 0.0) for r in got]
    plan = F.broadcast(units.sparkSession.createDataFrame(rows, "__tm_s string, source_size long, target double, whole long, share double").coalesce(1))
    same = F.col("source").eqNullSafe(F.col("__tm_s"))
    rest = F.col("n") * F.col("share")
    u = units.join(plan, same).select("__tm_unit", "id", "source", "size", "n", (rest - F.floor(rest)).alias("p"))
    flown, made = _settle(u, {r.source: r.n for r in got}, block, reserve)
    total = F.col("n") * F.col("whole") + F.floor(rest) + F.round("drawn").cast("long")
    out = flown.withColumnRenamed("p", "drawn").join(plan, same).withColumn("total", total)
    base = F.floor(F.col("total") / F.col("n")).cast("long")
    out = out.select(F.col("__tm_unit").alias("unit"), "id", "source", "size", "n", "source_size", "target", base.alias("base"), (F.col("total") - base * F.col("n")).alias("extra"))
    if made:
        discard(units)
    return out


def _unit() -> Column:
    """One value for equal (doc_id, text, source)."""
    return F.md5(F.to_json(F.struct(F.col("doc_id").cast("string").alias("i"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("t"), F.col("source").cast("string").alias("s"))).cast("binary"))


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column `times` says, which goes; many repeats are dealt to several tasks."""
    few = rows.where(F.col(times).between(1, CHUNK))
    chunk = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK))
    many = rows.where(F.col(times) > CHUNK).withColumn("__tm_chunk", F.explode(chunk))
    many = many.withColumn(times, F.least(F.lit(CHUNK).cast("long"), F.col(times) - F.col("__tm_chunk") * CHUNK)).repartition("__tm_chunk").drop("__tm_chunk")
    return few.unionByName(many).withColumn("__tm_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop("__tm_copy", times)


def mixed(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken, copies, source.

    A null or empty text has size 0 and takes nothing; a source of size 0 has target 0. Null sources are one source, the last.
    The draw depends on doc_id, text and source alone, so reruns agree; of repeated rows some may be taken once more than others.
    """
    d = docs.select(_unit().alias("unit"), F.col("doc_id").cast("string").alias("id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    m = mix(d.groupBy("unit", "id", "source", "size").agg(F.count("*").alias("n")))
    kinds = F.array(F.struct(F.col("extra").alias("k"), (F.col("base") + 1).alias("c")), F.struct((F.col("n") - F.col("extra")).alias("k"), F.col("base").alias("c")))
    m = m.withColumn("kind", F.explode(kinds)).where("kind.k > 0").withColumn("__tm_times", F.col("kind.k"))
    m = _repeated(m, "__tm_times").withColumn("copies", F.col("kind.c"))
    id_ = F.col("id").cast(docs.schema["doc_id"].dataType)
    return m.select(id_.alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def take(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, with all its columns. Equal rows share their unit's copies."""
    d = docs.select(_unit().alias("unit"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    m = mix(d.groupBy("unit", "source", "size").agg(F.count("*").alias("n")).withColumn("id", F.lit(None).cast("string")))
    m = m.select(F.col("unit").alias("__tm_unit"), F.col("n").alias("__tm_n"), F.col("base").alias("__tm_base"), F.col("extra").alias("__tm_extra")).where("__tm_base + __tm_extra > 0")
    own = docs.withColumn("__tm_unit", _unit())
    one = own.join(m.where("__tm_n = 1"), "__tm_unit").withColumn("__tm_times", F.col("__tm_base") + F.col("__tm_extra")).select(*docs.columns, "__tm_times")
    # Of rows with equal doc_id, text and source, those equal in all columns are counted, and the extra copies go to the first.
    more = own.join(m.where("__tm_n > 1"), "__tm_unit").groupBy("__tm_unit", "__tm_base", "__tm_extra", *docs.columns).agg(F.count("*").alias("__tm_c"))
    before = Window.partitionBy("__tm_unit").orderBy(*docs.columns).rowsBetween(Window.unboundedPreceding, -1)
    more = more.withColumn("__tm_off", F.coalesce(F.sum("__tm_c").over(before), F.lit(0).cast("long")))
    extra = F.greatest(F.lit(0).cast("long"), F.least("__tm_c", F.col("__tm_extra") - F.col("__tm_off")))
    more = more.select(*docs.columns, (F.col("__tm_c") * F.col("__tm_base") + extra).alias("__tm_times"))
    return _repeated(one.unionByName(more), "__tm_times").select(*docs.columns)
