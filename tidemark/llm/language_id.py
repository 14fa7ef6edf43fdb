"""Language identification as a mixture: what share of a document's letters does each language explain?

Each letter gives one observation, the hashed trigram of letters around it (anything else counts as a space). The model is a
table of trigram probabilities per language, learned from labelled documents. For a document, expectation-maximisation finds
the languages' proportions; the set of languages is then chosen by the likelihood less half of log(n) for every language
beyond the first, n being the letters. The prediction is the language of the largest proportion in the chosen set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fraction, remainder
from .text import chunks, code_points

BUCKETS = 1 << 15
TRAIN_DOCS = 3000  # about so many labelled documents of each language, at most, are learned from
MAX_LANGS = 256  # a model is BUCKETS x languages x 8 bytes; more languages are refused, not dropped
UNDETERMINED = "und"
RESULT = "lang_pred string, score double, langs string"


@cache
def letter_table() -> np.ndarray:
    """Of each code point: the lower-case letter, or a space for anything that is no letter."""
    return np.fromiter((ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, range(0x110000))), np.uint32, 0x110000)


def trigrams(texts: list[str]) -> Iterator[np.ndarray]:
    """Of each text the trigram buckets, one for each letter."""
    for a, b in chunks(texts):
        cp, at = code_points(texts[a:b])
        c = letter_table()[cp]
        left = np.concatenate(([np.uint32(32)], c[:-1]))
        right = np.concatenate((c[1:], [np.uint32(32)]))
        h = (left * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77)) ^ (right * np.uint32(0xC2B2AE3D))
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
        letter = c != 32
        for i in range(b - a):
            s = slice(at[i], at[i + 1])
            yield h[s][letter[s]]


def tally(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(buckets) > 8192:
        n = np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(n)
        return at, n[at].astype(float)
    b = np.sort(buckets)
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    return b[first], np.diff(np.append(first, len(b))).astype(float)


def learn(docs: DataFrame, held_out_of: int = 4, held_out: int = 2, per_lang: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages by code point and log probabilities [bucket, language], from labelled documents that are not held out.

    The sample of a language is fixed by a hash of doc_id and text; its expected size is at most per_lang documents.
    """
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), held_out_of) != held_out)
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / sizes[lang]))])
    rows = rows.where(fraction(F.col("doc_id"), F.col("text")) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(langs), BUCKETS), np.int64)
        index = {x: i for i, x in enumerate(langs)}
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), trigrams(b.column("text").to_pylist())):
                n[index[lang]] += np.bincount(t, minlength=BUCKETS)
        at = np.flatnonzero(n.ravel())
        for i in range(0, len(at), 50_000):
            k = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.ravel()[k])], names=["cell", "n"])

    cells = rows.select("lang", "text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = cells.toPandas()  # at most languages x BUCKETS rows
    n = np.zeros(len(langs) * BUCKETS)
    n[got.cell.to_numpy(np.int64)] = got.n.to_numpy(float)
    n = n.reshape(len(langs), BUCKETS).T
    background = (n.sum(1) + 0.5) / (n.sum() + 0.5 * BUCKETS)
    weight = 200.0  # pseudo-counts, dealt by the background
    return langs, np.log((n + weight * background[:, None]) / (n.sum(0) + weight))


def proportions(p: np.ndarray, n: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """EM: proportions of the columns of p (probabilities) for observations counted by n, and the log likelihood."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        mixed = p @ share
        new = share * ((n / mixed) @ p) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    return share, float(n @ np.log(p @ share))


def infer(buckets: np.ndarray, log_p: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The chosen languages, their proportions, and the proportions under all languages."""
    at, n = tally(buckets)
    logs = log_p[at]
    alone = n @ logs
    top = logs.max(1)
    p, base = np.exp(logs - top[:, None]), float(n @ top)
    every, most = proportions(p, n)
    fee = 0.5 * np.log(max(2.0, n.sum()))
    best = int(np.argmax(alone))
    chosen, shares, value = [best], np.ones(1), float(alone[best])
    if base + most - fee > value:
        order = np.argsort(-every, kind="stable")
        for k in range(2, len(order) + 1):
            pick = order[:k]
            some, like = (every[order], most) if k == len(order) else proportions(p[:, pick], n)
            if base + like - fee * (k - 1) <= value:
                break
            chosen, shares, value = [int(i) for i in pick], some, base + like - fee * (k - 1)
    return chosen, shares, every


def classify(spark: SparkSession, model: tuple[list[str], np.ndarray]):
    """A column function: text to struct(lang_pred, score, langs)."""
    langs, log_p = model
    held = spark.sparkContext.broadcast(log_p)

    @F.pandas_udf(RESULT)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            out = []
            for t in trigrams([x if x is not None else "" for x in s.tolist()]):
                if not len(t) or not langs:
                    out.append((UNDETERMINED, 0.0, ""))
                    continue
                chosen, shares, every = infer(t, held.value)
                ranked = sorted(zip(shares, chosen), key=lambda x: (-x[0], x[1]))
                top = ranked[0][1]
                out.append((langs[top], float(min(1.0, max(0.0, every[top]))), ",".join(f"{langs[i]}:{x:.3f}" for x, i in ranked)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "langs"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, langs (the chosen languages with their proportions).

    A null text, or one without a letter, is `und` with score 0; so is every text if no document is labelled. A null doc_id
    is not held out. Texts of any length are read whole; ties go to the language first by code point; repeated rows each
    give a row.
    """
    udf = classify(docs.sparkSession, learn(docs))
    out = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), udf("text").alias("r"))
    return out.select("doc_id", "held_out", "r.lang_pred", "r.score", "r.langs")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Pipeline stage: drops the documents that have no determinable language, keeps all columns of the rest."""
    udf = classify(docs.sparkSession, learn(docs))
    return docs.withColumn("__tm_lang", udf("text")["lang_pred"]).where(F.col("__tm_lang") != UNDETERMINED).drop("__tm_lang")
