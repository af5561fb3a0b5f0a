"""Hard negatives by exact integer scores: matrix products in residue number systems.

Vectors become integers, ``floor(scale * x)``. The score of two rows is their integer inner product. It is computed
modulo several small primes: the residues of a block of anchors and of a block of rows are multiplied as float32
matrices, which is exact while a product's sums stay below 2^24, and the signed score is put together from its residues
by Chinese remaindering. The number of primes follows from the greatest length of a vector, so that no score can wrap.

Anchors go to the tasks in slices of bounded size, one slice after the other; every slice meets all rows where these
lie, so rows are never shuffled. A task keeps the best few of each anchor while it goes through its rows; the parts of
all tasks are ranked by a window. What a slice gives is written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import stored

#: Components of a slice of anchors; with its positives this is what a task gets by broadcast.
SLICE_COMPONENTS = 4_000_000
#: Scores of a block: rows of a block times anchors of a block.
BLOCK_SCORES = 2_000_000
#: Rows of a block, at most.
BLOCK_ROWS = 4096
#: Components multiplied at once; more are multiplied in several steps.
DEPTH = 1024
#: float32 holds all whole numbers up to here.
EXACT = 1 << 24

PAIRS = "anchor bigint, id bigint, score bigint"


def primes_for(bound: int, depth: int) -> list[int]:
    """Primes whose product exceeds ``2 * bound``, the largest for which sums of ``depth`` products are exact.

    Residues are signed, so a product is at most ``((p - 1) / 2) ** 2``.
    """
    half = math.isqrt((EXACT - 1) // max(1, min(depth, DEPTH)))
    found, p = [], 2 * half + 1
    while not found or math.prod(found) <= 2 * bound:
        if p < 3:
            raise ValueError("too few primes for scores of this size")
        if all(p % k for k in range(2, math.isqrt(p) + 1)):
            found.append(p)
        p -= 1
    return [q for q in found if q % 2]


def residues(whole: np.ndarray, prime: int) -> np.ndarray:
    """Signed residues of whole numbers given as doubles."""
    r = np.fmod(whole, prime)
    r -= prime * np.rint(r / prime)
    return r.astype(np.float32)


def signed(r: np.ndarray, prime: int) -> np.ndarray:
    """Whole numbers, as 64-bit integers, between ``-(prime - 1) / 2`` and ``(prime - 1) / 2``."""
    r = np.mod(r, prime)
    return np.where(r > prime // 2, r - prime, r)


class Residues:
    """A matrix of whole numbers as one float32 matrix per prime."""

    def __init__(self, whole: np.ndarray, primes: list[int]):
        self.primes, self.parts = primes, [residues(whole, p) for p in primes]

    def take(self, rows: np.ndarray | slice) -> Residues:
        out = object.__new__(Residues)
        out.primes, out.parts = self.primes, [x[rows] for x in self.parts]
        return out

    def scores(self, other: Residues) -> np.ndarray:
        """All inner products with the rows of ``other``, exact."""
        digits: list[np.ndarray] = []
        for k, (p, a, b) in enumerate(zip(self.primes, self.parts, other.parts)):
            r = np.zeros((len(a), len(b)), np.int64)
            for at in range(0, a.shape[1], DEPTH):
                r += (a[:, at:at + DEPTH] @ b[:, at:at + DEPTH].T).astype(np.int64)
            # The digit of this prime in the mixed system: what the earlier digits leave, divided by their primes.
            left, weight = r, 1
            for q, d in zip(self.primes[:k], digits):
                left, weight = left - d * (weight % p), weight * q
            digits.append(signed(left % p * pow(weight, -1, p), p))
        # From the last digit inwards; intermediate sums are smaller than the product of the primes used so far.
        return reduce(lambda total, pd: total * pd[0] + pd[1], zip(self.primes[-2::-1], digits[-2::-1]), digits[-1])


def whole_vectors(df: DataFrame, vector: str, label: str, row_id: str, scale: int) -> DataFrame:
    """``id, label, q``: rows that take part, their vectors as whole numbers.

    Out go rows without id, label or vector, and those with a component that is null or not finite.
    """
    x = F.col(vector).cast("array<double>")
    usable = F.col(row_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    # double arithmetic throughout: floor() would give a long
    whole = F.transform(x, lambda v: F.rint(v * scale) - (F.rint(v * scale) > v * scale).cast("double"))
    return df.where(F.coalesce(usable, F.lit(False))).select(
        F.col(row_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole.alias("q"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of lists, shorter ones filled with zeros."""
    length = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < length[:, None]] = lists.flatten().to_numpy()
    return out


@dataclass
class Slice:
    """Some anchors with all that a task needs to score against them."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: Residues
    #: For each anchor and window: least and greatest score, both included. Without windows: the same label's best.
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) of each anchor's first ``cap`` allowed rows: higher score first, then smaller id."""
    least = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, least)
    if masked.shape[1] > cap:
        limit = np.partition(masked, masked.shape[1] - cap, axis=1)[:, -cap][:, None]
        allowed = allowed & (masked >= limit)
    a, r = np.nonzero(allowed)
    order = np.lexsort((ids[r], -scores[a, r], a))
    a, r = a[order], r[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < cap], r[place < cap]


class Kept:
    """The best ``cap`` rows of each slot so far."""

    def __init__(self, cap: int):
        self.cap = cap
        self.slot, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        slot, row, score = (np.concatenate(x) for x in ((self.slot, slot), (self.id, row), (self.score, score)))
        order = np.lexsort((row, -score, slot))
        slot, row, score = slot[order], row[order], score[order]
        first = np.arange(len(slot)) - np.searchsorted(slot, slot) < self.cap
        self.slot, self.id, self.score = slot[first], row[first], score[first]


def _partial(rows: DataFrame, sent, width: int, cap: int) -> DataFrame:
    """Per task, the first ``cap`` rows of each slot: an anchor, or an anchor times the number of windows plus a window."""
    schema = T._parse_datatype_string(PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Slice = sent.value
        kept = Kept(cap)
        step = max(1, BLOCK_SCORES // BLOCK_ROWS)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(start, BLOCK_ROWS)
                ids, labels = (block.column(i).to_numpy() for i in (0, 1))
                vectors = Residues(_matrix(block.column(2), width), part.vectors.primes)
                if part.low is None:  # anchors meet the rows of their own label only
                    for label in np.intersect1d(labels, part.labels).tolist():
                        own, at = np.flatnonzero(part.labels == label), np.flatnonzero(labels == label)
                        theirs = vectors.take(at)
                        for some in (own[i:i + step] for i in range(0, len(own), step)):
                            s = part.vectors.take(some).scores(theirs)
                            a, r = _best(s, part.ids[some][:, None] != ids[at][None, :], ids[at], cap)
                            kept.add(some[a], ids[at][r], s[a, r])
                    continue
                windows = part.low.shape[1]
                for first in range(0, len(part.ids), step):
                    some = slice(first, first + step)
                    s = part.vectors.take(some).scores(vectors)
                    other = (part.labels[some][:, None] != labels[None, :]) & (part.ids[some][:, None] != ids[None, :])
                    for w in range(windows):
                        inside = other & (s >= part.low[some, w][:, None]) & (s <= part.high[some, w][:, None])
                        a, r = _best(s, inside, ids, cap)
                        kept.add((a + first) * windows + w, ids[r], s[a, r])
        if len(kept.slot):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kept.slot, kept.id, kept.score)],
                                             names=["anchor", "id", "score"])

    return rows.mapInArrow(run, schema)


def _ranked(parts: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` of each slot over all tasks, with their ``rank`` from 1."""
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def hard_negatives(
    df: DataFrame, is_anchor: Column, vector: str = "embedding", label: str = "label", row_id: str = "vec_id",
    positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100),
    scale: int = 256, slice_components: int = SLICE_COMPONENTS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its first ``positives`` other rows of the same label; for each, the first ``negatives``
    rows of another label whose score lies between ``low`` and ``high`` times the positive's score (fractions given as
    whole numbers, both ends included). Higher scores come first, ties by smaller id. ``is_anchor`` is a condition on
    ``df``.

    Rows take no part without id, label or vector, or with a component that is null or not finite. Vectors of different
    lengths are filled with zeros. Rows that share the anchor's id are no partners of it; rows that repeat an id each
    count as partners of others. A repeated anchor with the same vector and label asks once, with others once for each;
    then its rows appear once for each. An empty table, or one without anchors, gives no rows. Scores that may not fit
    64 bits raise an error. Extra columns have no effect.
    """
    spark = df.sparkSession
    # every name that the operator uses inside is its own, so that extra columns cannot clash
    named = df.select(*[F.col(c) for c in dict.fromkeys((row_id, label, vector))], is_anchor.alias("is anchor"))
    flags = whole_vectors(named, vector, label, row_id, scale)
    asked = whole_vectors(named.where(F.col("is anchor")), vector, label, row_id, scale)
    rows = stored(flags, "vectors")
    anchors = stored(asked.distinct(), "anchors")
    length = F.aggregate("q", F.lit(0.0), lambda total, v: total + v * v)
    width, longest = rows.agg(F.max(F.size("q")), F.max(length)).first()
    count = anchors.count()
    out_schema = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
                  "negative_score bigint")
    if not count:
        return spark.createDataFrame([], out_schema)
    if not longest < 1 << 60:
        raise ValueError("scores may not fit 64 bits")
    bound = math.ceil(longest * (1 + 1e-9)) + 1  # no score is beyond the greatest squared length
    width = max(width, 1)
    primes = primes_for(bound, width)
    slices = math.ceil(count * width / slice_components)
    of_slice = F.pmod(F.xxhash64("id", "label", "q"), F.lit(slices))
    results = []
    for n in range(slices):
        mine = anchors.where(of_slice == n).toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        ids, labels = (mine.column(i).to_numpy() for i in (0, 1))
        lists = mine.column(2).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        part = Slice(ids, labels, Residues(_matrix(lists, width), primes))
        sent = spark.sparkContext.broadcast(part)
        found = _ranked(_partial(rows, sent, width, positives), positives).collect()  # a few for each anchor of the slice
        if not found:
            continue
        # windows on whole numbers: low <= score <= high, rounded inwards; an anchor without a positive has none
        part.low = np.full((len(ids), positives), 1, np.int64)
        part.high = np.full((len(ids), positives), 0, np.int64)
        pairs = []
        for r in found:
            a, w, s = r["anchor"], r["rank"] - 1, r["score"]  # Python numbers: products cannot wrap
            part.low[a, w], part.high[a, w] = -(-low[0] * s // low[1]), high[0] * s // high[1]
            pairs.append((int(a) * positives + w, int(ids[a]), r["id"], s))
        sent = spark.sparkContext.broadcast(part)
        got = _ranked(_partial(rows, sent, width, negatives), negatives).withColumnsRenamed(
            {"anchor": "slot", "id": "negative_id", "score": "negative_score"})
        positive = spark.createDataFrame(pairs, "slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        results.append(stored(got.join(positive, "slot").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
    if not results:
        return spark.createDataFrame([], out_schema)
    return reduce(DataFrame.union, results)
