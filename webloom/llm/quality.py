"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Labels are learned from a bounded sample of labelled texts, in the order of a hash of their ids, so that the sample is
the same however the table is partitioned. Updates run one text after another, as the method wants; that takes one task
over at most ``sample`` texts. What it learns is at most ``buckets`` numbers, which every scoring task receives.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import free_name, map_texts, stored, text_of

BUCKET_BITS = 18
#: The most labelled texts that are learned from, and how many updates are made at least.
SAMPLE = 6_000
UPDATES = 12_000
#: The most passes over a small sample.
PASSES = 20
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.5, 1.0
#: Words (with letters or digits, of any case) and runs of marks, so that marks stuck to words are terms of their own.
TERM = re.compile(r"\w+|[^\w \t-\r]+")
#: Longer runs are cut into pieces of this length.
TERM_CHARS = 64
CACHE_TERMS = 500_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept apart for testing: a fifth, by a checksum of its id. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled(df: DataFrame, labels: DataFrame, label: str, sample: int, doc_id: str = "doc_id", text: str = "text"
             ) -> DataFrame:
    """``text`` and ``label`` (0 or 1) of at most ``sample`` labelled documents that are not held out.

    The ids are chosen by hash order; at most ``sample`` of them are broadcast. An id with several labels counts as 1 if
    any is 1. An id with several texts gives the least of them, so that the bound holds for texts, too; the least is
    found in each task before anything is shuffled. Rows without id or label are left out.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    rows = df.select(F.col(doc_id).alias("id"), text_of(text).alias("text")).join(F.broadcast(chosen), "id")
    most = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]  # reads no text
    if (most or 0) > 1:
        rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))
    return rows.select("id", "text", "label")


class Terms:
    """Hashed word n-grams of a text: distinct buckets, and 1 as every value."""

    def __init__(self, bits: int = BUCKET_BITS):
        from xxhash import xxh64_intdigest

        self.bits, self._hash, self.cache = bits, xxh64_intdigest, {}

    def buckets(self, text: str) -> np.ndarray:
        terms = TERM.findall(text)
        known = self.cache
        if len(known) > CACHE_TERMS:
            known.clear()
        for t in set(terms):
            if t not in known:
                known[t] = self._hash(t[:TERM_CHARS]) if len(t) <= TERM_CHARS else self._hash(t)
        one = np.fromiter(map(known.__getitem__, terms), np.uint64, len(terms))
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        shift = np.uint64(64 - self.bits)
        mixed = (np.concatenate([one, two]) * np.uint64(0xD6E8FEB86659FD93)) >> shift
        seen = np.zeros(1 << self.bits, bool)
        seen[mixed] = True
        return np.flatnonzero(seen)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for the logistic loss; most weights stay exactly zero."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.bias = size

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, buckets: np.ndarray, label: int, weight: float) -> None:
        at = np.append(buckets, self.bias)
        value = scale(len(buckets))
        x = np.full(len(at), value)
        x[-1] = 1.0
        w = self.weights(at)
        p = logistic(float(w @ x))
        g = weight * (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def scale(terms: int) -> float:
    """Texts have unit length whatever their number of terms, times a constant so that steps are large enough."""
    return 4.0 / math.sqrt(terms) if terms else 0.0


def logistic(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-min(max(x, -35.0), 35.0)))


def fit_quality(df: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, bits: int = BUCKET_BITS,
                doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights of all buckets and, last, the bias. Without labelled rows all are zero, so that every score is 0.5.

    Both labels weigh the same in total.
    """
    size = 1 << bits
    rows = stored(labelled(df, labels, label, sample, doc_id, text), "sample")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = {k: total / (len(counts) * n) for k, n in counts.items()}

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, model = Terms(bits), Ftrl(size)
        found = [(terms.buckets(t), int(y)) for p in batches for t, y in zip(p["text"], p["label"])]
        for _ in range(min(PASSES, math.ceil(UPDATES / max(len(found), 1)))):
            for b, y in found:
                model.learn(b, y, share[y])
        w = model.weights()
        at = np.flatnonzero(w)
        if len(at):
            yield pd.DataFrame({"bucket": at, "weight": w[at]})

    order = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(7), "id"), "id", "text")
    weights = np.zeros(size + 1)
    for r in order.mapInPandas(learn, "bucket bigint, weight double").collect():
        weights[r["bucket"]] = r["weight"]
    return weights


def score_quality(df: DataFrame, weights: np.ndarray, text: str = "text", score: str = "score",
                  keep: list[str] | None = None) -> DataFrame:
    """Append the probability of label 1 for each whole text. Null texts count as empty; an empty text gets what the
    bias alone gives."""
    bits = (len(weights) - 1).bit_length() - 1
    bias = float(weights[-1])
    sent = df.sparkSession.sparkContext.broadcast(weights[:-1].astype(np.float32))

    def make():
        terms, w = Terms(bits), sent.value.astype(np.float64)

        def work(texts: list[str]) -> list[tuple]:
            out = []
            for t in texts:
                b = terms.buckets(t)
                out.append((logistic(bias + scale(len(b)) * float(w[b].sum())),))
            return out

        return work

    return map_texts(df, text, [(score, "double")], make, keep)


def classify_quality(df: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id",
                     text: str = "text", label: str = "quality", sample: int = SAMPLE, keep: list[str] | None = None
                     ) -> DataFrame:
    """Fit on the labels and append ``held_out``, ``score`` and ``predicted``.

    Rows without id are held out. Columns of these names are replaced. Equal texts get equal scores.
    """
    added = ["held_out", "score", "predicted"]
    columns = [c for c in (keep or df.columns) if c not in added]
    weights = fit_quality(df, labels, label, sample, doc_id=doc_id, text=text)
    out = score_quality(df.withColumn(part := free_name(df, "part"), held_out(F.col(doc_id))), weights, text, "score",
                        [*columns, part])
    return out.select(*columns, F.col(part).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
