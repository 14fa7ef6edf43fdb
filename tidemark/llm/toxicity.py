"""Toxicity by nearest labelled examples: exact TF-IDF cosine from a block-max inverted index, distance-weighted votes, calibrated.

Examples are labelled documents outside the held-out third, about PER_CLASS of either label at most, by hash of the id;
of a repeated id the least text counts. The vocabulary has two sides: words, and their prefixes of PREFIXES letters, that
mark toxic examples (chi-square of at least CHI_SQUARE, in MIN_DF examples or more), whose weight is RELEVANCE times their IDF; and all other
words in MIN_DF examples or more, but not in over COMMON of them, by which any other text finds examples like it. At most VOCABULARY terms
are kept, the toxic ones first, then those of most examples. Document frequencies are counted over all documents.

The index keeps each term's postings in blocks of BLOCK examples with the block's largest weight; blocks are scored from the highest
upper bound down, until no bound reaches the K-th best cosine, so the K nearest are exact. Votes are weighted by 1 / (1 - cosine + 0.05).
Leaving each example out in turn gives raw votes whose isotonic fit to the labels, weighted back to the labels' true shares, turns a vote
into a probability. CHI_SQUARE, RELEVANCE, COMMON and K were chosen by five-fold cross-validation among the documents that are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fraction, keep, remainder
from .text import chunks, counted, word_and_prefix_hashes

PER_CLASS = 1500
PREFIXES = (4, 5, 6, 7)
MIN_DF, CHI_SQUARE = 4, 30.0
RELEVANCE, COMMON, VOCABULARY = 25.0, 0.05, 60_000
K, BLOCK = 25, 256
CUT = 0.7


@dataclass
class Index:
    """Examples in blocks; postings by term, then example."""

    terms: np.ndarray  # sorted hashes of the vocabulary
    idf: np.ndarray  # times the term's relevance
    ids: np.ndarray  # doc_id of each example
    toxic: np.ndarray
    example: np.ndarray  # of each posting
    value: np.ndarray
    offset: np.ndarray  # [term, block]: where the postings of a term in a block begin
    block_max: np.ndarray  # [term, block]

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = K, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine (ties to the earlier one), and the cosines."""
        bound = weight @ self.block_max[term]
        best, score, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) >= k and bound[b] < least - 1e-12):
                break
            first = self.offset[term, b]
            n = self.offset[term, b + 1] - first
            posting = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            acc = np.bincount(self.example[posting] - b * BLOCK, np.repeat(weight, n) * self.value[posting], BLOCK)
            at = np.flatnonzero(acc > 0)
            at = at[at + b * BLOCK != without]
            best, score = np.concatenate((best, at + b * BLOCK)), np.concatenate((score, acc[at]))
            if len(best) > k:
                top = np.lexsort((best, -score))[:k]
                best, score = best[top], score[top]
            least = score.min() if len(score) >= k else 0.0
        top = np.lexsort((best, -score))
        return best[top], score[top]


def vectors(h: np.ndarray, text: np.ndarray, n: np.ndarray, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term index, text and normalised weight of the texts' terms that are in the vocabulary."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    known = terms[at] == h
    at, text, w = at[known], text[known], (1 + np.log(n[known])) * idf[at[known]]
    some = w > 0
    at, text, w = at[some], text[some], w[some]
    norm = np.sqrt(np.bincount(text, w * w, minlength=int(text.max()) + 1 if len(text) else 0))
    return at, text, w / norm[text] if len(text) else w


def build(terms: np.ndarray, idf: np.ndarray, ids: np.ndarray, toxic: np.ndarray, at: np.ndarray, example: np.ndarray, value: np.ndarray) -> Index:
    blocks = max(1, -(-len(ids) // BLOCK))
    order = np.lexsort((example, at))
    at, example, value = at[order], example[order], value[order]
    cell = at * blocks + example // BLOCK
    offset = np.searchsorted(cell, np.arange(len(terms))[:, None] * blocks + np.arange(blocks + 1))
    block_max = np.zeros(len(terms) * blocks)
    np.maximum.at(block_max, cell, value)
    return Index(terms, idf, ids, toxic, example, value, offset, block_max.reshape(len(terms), blocks))


def vote(toxic: np.ndarray, cosine: np.ndarray) -> float:
    w = 1.0 / (1.0 - np.minimum(cosine, 1.0) + 0.05)
    return float((w * toxic).sum() / w.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit, one point per pool (its mean x); each pool is drawn to the mean of all by the weight of one row."""
    mean = float((y * w).sum() / w.sum())
    pools: list[list[float]] = []
    for v in np.unique(x):
        m = x == v
        pools.append([float((w[m] * y[m]).sum()), float(w[m].sum()), float((w[m] * v).sum())])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    one = float(w.sum() / len(w))
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + mean * one) / (p[1] + one) for p in pools])


@dataclass
class Model:
    index: Index | None
    x: np.ndarray
    y: np.ndarray
    blank: float  # the score of a text without a neighbour

    def score(self, term: np.ndarray, weight: np.ndarray) -> tuple[float, str]:
        if self.index is None or not len(term):
            return self.blank, ""
        best, cosine = self.index.nearest(term, weight)
        if not len(best):
            return self.blank, ""
        p = float(np.interp(vote(self.index.toxic[best], cosine), self.x, self.y)) if len(self.x) else self.blank
        return min(1.0, max(0.0, p)), ",".join(f"{self.index.ids[e]}:{self.index.toxic[e]:.0f}:{c:.3f}" for e, c in zip(best[:5], cosine[:5]))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        for lo, hi in chunks(texts):
            h, text, n = counted(*word_and_prefix_hashes(texts[lo:hi], PREFIXES))
            cut = np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")[lo:hi], b.column("toxic")[lo:hi], pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int64)))],
                names=["doc_id", "toxic", "term", "n"],
            )


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out_of: int = 3, held_out: int = 1) -> Model:
    spark = docs.sparkSession
    given = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    given = given.where(remainder(F.col("doc_id"), held_out_of) != held_out)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    # Only ids meet the labels in a shuffle, each once; the texts of the few examples drawn are found by a broadcast of their ids.
    given = keep(given.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    sizes = {r.toxic: r.n for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    rate = (sizes.get(1, 0) + 0.5) / (total + 1)
    none = Model(None, np.zeros(0), np.zeros(0), rate)
    if len(sizes) < 2:
        return none
    draw = fraction(F.col("doc_id"))
    limit = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    drawn = given.where(draw < limit)  # about per_class rows of either label
    known = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    known = keep(known.mapInArrow(_terms, "doc_id long, toxic int, term array<long>, n array<long>"), "examples")
    discard(given)
    labelled = known.select("toxic", "doc_id").orderBy("toxic", "doc_id").toArrow()  # about 2 * per_class rows
    toxic, ids = np.asarray(labelled["toxic"]).astype(float), np.asarray(labelled["doc_id"])
    if not 0 < toxic.sum() < len(toxic):
        return none
    size, pos = len(ids), toxic.sum()
    # Of the examples' terms, of which long texts have many, only the vocabulary and its postings come to the driver.
    term = known.select("toxic", F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("hit")).where(F.col("df") >= MIN_DF)
    a, b = F.col("hit"), F.col("df") - F.col("hit")
    c, d = F.lit(pos) - a, F.lit(size - pos) - b
    chi = F.lit(float(size)) * (a * d - b * c) * (a * d - b * c) / F.nullif((a + b) * (c + d) * pos * (size - pos), F.lit(0.0))
    term = term.withColumn("marks", (F.coalesce(chi, F.lit(0.0)) >= CHI_SQUARE) & (F.col("hit") * F.lit(size) > F.col("df") * F.lit(pos)))
    term = term.where(F.col("marks") | ((F.col("term").bitwiseAND(F.lit(1)) == 0) & (F.col("df") <= max(MIN_DF, COMMON * size))))
    chosen = term.orderBy(F.desc("marks"), F.desc("df"), "term").limit(VOCABULARY).select("term", "marks").toArrow()
    if not chosen.num_rows:
        return none
    terms, marks = np.asarray(chosen["term"]).view(np.uint64), np.asarray(chosen["marks"])
    order = np.argsort(terms)
    terms, relevance = terms[order], np.where(marks[order], RELEVANCE, 1.0)

    vocabulary = spark.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_, n_docs, df_ = vocabulary.value, 0, np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_docs += len(texts)
            for lo, hi in chunks(texts):
                words, text = word_and_prefix_hashes(texts[lo:hi], PREFIXES)
                i = np.minimum(np.searchsorted(known_, words), len(known_) - 1)
                ok = known_[i] == words
                pair = np.unique(text[ok] * len(known_) + i[ok])
                df_ += np.bincount(pair % len(known_), minlength=len(known_))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df_))), pa.array(np.concatenate(([n_docs], df_)))], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    count = {r.cell: r.n for r in rows}
    every = np.array([count.get(i, 0) for i in range(len(terms))], float)
    idf = np.log((1 + count.get(-1, 0)) / (1 + every)) * relevance

    posting = known.select("doc_id", F.explode(F.arrays_zip("term", "n")).alias("x")).select("doc_id", "x.term", "x.n")
    of = F.broadcast(spark.createDataFrame(pa.table({"term": terms.view(np.int64)})))  # VOCABULARY rows at most
    got = posting.join(of, "term").toArrow()
    discard(known)
    by_id = np.argsort(ids)
    h, n = np.asarray(got["term"]).view(np.uint64), np.asarray(got["n"])
    text = by_id[np.searchsorted(ids[by_id], np.asarray(got["doc_id"]))] if got.num_rows else np.zeros(0, np.int64)
    at, example, value = vectors(h, text, n, terms, idf)
    index = build(terms, idf, ids, toxic, at, example, value)
    order = np.lexsort((at, example))
    at, example, value = at[order], example[order], value[order]
    cut = np.searchsorted(example, np.arange(size + 1))
    raw = np.full(size, np.nan)
    for e in range(size):
        s = slice(cut[e], cut[e + 1])
        best, cosine = index.nearest(at[s], value[s], without=e)
        if len(best):
            raw[e] = vote(toxic[best], cosine)
    weight = np.where(toxic == 1, sizes[1] / pos, sizes[0] / (size - pos))
    far = np.isnan(raw)
    blank = float((weight * toxic)[far].sum() + rate) / float(weight[far].sum() + 1)
    x, y = isotonic(raw[~far], toxic[~far], weight[~far]) if (~far).any() else (np.zeros(0), np.zeros(0))
    return Model(index, x, y, blank)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted, evidence (nearest examples as doc_id:label:cosine).

    A null or empty text, or one without a term of the vocabulary, has the share of toxic examples among those without a neighbour, and no
    evidence. Without labels of both kinds every score is their smoothed share. Of a document labelled twice the higher label counts.
    A null doc_id is not held out. Texts are read whole.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            scores, evidence = [], []
            for lo, hi in chunks(texts):
                if m.index is None:
                    found = [(m.blank, "")] * (hi - lo)
                else:
                    words, of = word_and_prefix_hashes(texts[lo:hi], PREFIXES)
                    known = m.index.terms[np.minimum(np.searchsorted(m.index.terms, words), len(m.index.terms) - 1)] == words
                    h, text, n = counted(words[known], of[known])
                    at, text, w = vectors(h, text, n, m.index.terms, m.index.idf)
                    cut = np.searchsorted(text, np.arange(hi - lo + 1))
                    found = [m.score(at[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]) for i in range(hi - lo)]
                scores += [x for x, _ in found]
                evidence += [x for _, x in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.string())], names=["doc_id", "score", "evidence"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence string")
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")
