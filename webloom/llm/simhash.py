"""Near-duplicate groups of 64-bit SimHash fingerprints, found exactly through sharded vantage-point trees.

Fingerprints of random-looking bits all lie about 32 bits from any vantage point, so a ball of radius 3 around a whole
fingerprint meets most branches of a tree over all 64 bits. The trees here therefore stand over blocks of the bits: two
fingerprints within ``max_bits`` of each other are within ``max_bits // blocks`` on at least one block, and Hamming
distance on a block obeys the triangle inequality too. Each block has a tree whose levels split by the distance to a
vantage point; a fingerprint belongs to one leaf, its shard, and is also asked in every other leaf that its ball can
reach by the triangle bound. Inside a shard, rings around a further vantage point over all 64 bits bound which pairs
are compared. A shard whose measured count is too large is divided by trees over blocks of the bits that its own block
left out. Shards give a spanning set of links, not all pairs.
"""

from __future__ import annotations

import math
import sys
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import free_name, map_texts, stored, stored_with_key
from webloom.llm.components import connected_components

BITS = 64
#: Rows of a shard compared at once.
STEP = 2_048
#: Shards of up to so many rows are handled together.
SMALL = 64
#: Shards of more rows are divided by further blocks of bits, at most ``DEPTH`` times in a row. Comparing a row with so
#: many others costs less than shuffling it once more for each block.
SPLIT = 2_048
DEPTH = 2
#: Rows of a bucket of shards, on average.
BUCKET_ROWS = 20_000


def fingerprint(words: list[bytes], shingle: int) -> int:
    """SimHash of word shingles, repeats included: a bit is set if it is set in over half of their XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
    hashes = np.array([xxh64_intdigest(whole[i:j], 42) for i, j in spans], dtype=">u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def signed(f: int) -> int:
    return f - (1 << BITS) if f >> (BITS - 1) else f


def with_fingerprint(df: DataFrame, shingle: int = 3, text: str = "text", out: str = "simhash",
                     keep: list[str] | None = None) -> DataFrame:
    """Append the fingerprint of each whole text as a signed 64-bit integer. Null texts count as empty: zero."""
    def make():
        def work(texts: list[str]) -> list[tuple]:
            got = [fingerprint(t.encode().lower().split(), shingle) for t in texts]
            return [(signed(f),) for f in got]

        return work

    return map_texts(df, text, [(out, "bigint")], make, keep)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class BlockTrees:
    """For each block of bits a vantage-point tree that splits by distance at every level.

    The vantage points are spread over the block by a fixed rule, so that they depend on no data and every task knows
    them. ``radius`` is what the pigeonhole principle leaves for a block.
    """

    def __init__(self, blocks: int, levels: int, max_bits: int, bits: int = BITS):
        self.bits = bits
        edges = [round(i * bits / blocks) for i in range(blocks + 1)]
        self.blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
        self.radius = max_bits // blocks
        rng = np.random.default_rng(20)
        self.points = [[int(rng.integers(0, 1 << w, dtype=np.uint64)) for _ in range(levels)] for _, w in self.blocks]

    def shards(self, fp: Column) -> Column:
        """An array of (shard, whether it is the home shard, the bits of other blocks side by side)."""
        found = []
        for k, ((shift, width), points) in enumerate(zip(self.blocks, self.points)):
            mask = lambda w: F.lit(signed((1 << w) - 1)).cast("bigint")
            bits = F.shiftrightunsigned(fp, shift).bitwiseAND(mask(width))
            above = F.shiftrightunsigned(fp, shift + width) if shift + width < self.bits else F.lit(0).cast("bigint")
            rest = F.shiftleft(above, shift).bitwiseOR(fp.bitwiseAND(mask(shift)))
            away = [F.bit_count(bits.bitwiseXOR(F.lit(signed(p)).cast("bigint"))).cast("bigint") for p in points]
            # A ball around the fingerprint reaches ring d' only if |d - d'| is at most the radius.
            for steps in product(range(-self.radius, self.radius + 1), repeat=len(points)):
                leaf = F.lit(k).cast("bigint")
                inside = F.lit(True)
                for d, s in zip(away, steps):
                    ring = d + s
                    inside = inside & (ring >= 0) & (ring <= width)
                    leaf = leaf * 65 + ring
                found.append(F.when(inside, F.struct(
                    leaf.alias("shard"), F.lit(not any(steps)).alias("home"), rest.alias("rest"))))
        return F.array_compact(F.array(*found))

    @property
    def left(self) -> int:
        """The most bits that lie outside a block."""
        return self.bits - min(width for _, width in self.blocks)


def shard_links(fps: np.ndarray, home: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect all fingerprints of a shard that pairs within ``max_bits`` connect.

    Ordered by distance to a vantage point, a fingerprint is compared only with those whose distance differs by at most
    ``max_bits``. A pair is compared if one of the two is at home here. Pairs already connected give no further link.
    """
    vantage = np.uint64(0x9E3779B97F4A7C15)
    away = np.bitwise_count(fps ^ vantage).astype(np.int64)
    order = np.argsort(away, kind="stable")
    fps, home, away = fps[order], home[order], away[order]
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for start in range(0, len(fps), STEP):
        rows = fps[start:start + STEP]
        last = np.searchsorted(away, away[start + len(rows) - 1] + max_bits, "right")
        for lo in range(start, last, STEP):
            columns = fps[lo:min(lo + STEP, last)]
            near = np.bitwise_count(rows[:, None] ^ columns[None, :]) <= max_bits
            near &= home[start:start + STEP, None] | home[None, lo:lo + len(columns)]
            i, j = np.nonzero(near)
            i, j = i + start, j + lo
            ahead = i < j
            for x, y in zip(i[ahead].tolist(), j[ahead].tolist()):
                if (rx := root(x)) != (ry := root(y)):
                    parent[ry] = rx
                    links.append((x, y))
    values = fps.view(np.int64).tolist()
    return [(values[x], values[y]) for x, y in links]


def bucket_links(shard: np.ndarray, fps: np.ndarray, home: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """``shard_links`` for many shards: small ones are compared side by side, neighbour by neighbour, large ones alone."""
    order = np.argsort(shard, kind="stable")
    shard, fps, home = shard[order], fps[order], home[order]
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
    size = np.diff(edges)
    links = []
    for k in np.flatnonzero(size > SMALL).tolist():
        links += shard_links(fps[edges[k]:edges[k + 1]], home[edges[k]:edges[k + 1]], max_bits)
    small = np.repeat(size <= SMALL, size)
    shard, fps, home = shard[small], fps[small], home[small]
    parent: dict[int, int] = {}  # by row, so that links of one shard never stand for those of another

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    values = fps.view(np.int64)
    for step in range(1, SMALL):
        same = shard[step:] == shard[:-step]
        if not same.any():
            break
        near = same & (np.bitwise_count(fps[step:] ^ fps[:-step]) <= max_bits) & (home[step:] | home[:-step])
        for i in np.flatnonzero(near).tolist():
            if (x := root(i)) != (y := root(i + step)):
                parent[y] = x
                links.append((int(values[i]), int(values[i + step])))
    return links


def divided_shards(rows: DataFrame, blocks: int, levels: int, max_bits: int, split: int = SPLIT, depth: int = DEPTH
                   ) -> tuple[DataFrame, int]:
    """Shards of several fingerprints (``fp``, ``shard``, ``home`` and ``n``, the rows of the shard), and all their rows.

    A shard of more than ``split`` rows is divided by a tree over the bits that its block left out. Two fingerprints of
    one shard differ in at most ``max_bits`` of these, so they agree on one of ``max_bits`` + 1 blocks of them and meet
    again; so it goes on while shards are too large, up to ``depth`` times. Equal shard numbers of different shards only
    bring rows together that are too far from each other.
    """
    trees = BlockTrees(blocks, levels, max_bits)
    rows = rows.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("bigint").alias("within"), F.lit(True).alias("own"))
    parts, total = [], 0
    for step in range(depth + 1):
        placed = rows.select("fp", "within", "own", F.explode(trees.shards(F.col("rest"))).alias("s")).select(
            "fp", (F.xxhash64("within", "s.shard") if step else F.col("s.shard")).alias("shard"),
            (F.col("own") & F.col("s.home")).alias("home"), "s.rest")
        # Shards of one fingerprint have no pair; they are left out before anything goes to Python.
        sizes = stored(placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard_sizes")
        large = F.col("n") > (split if step < depth and trees.left else sys.maxsize)
        counts = sizes.agg(F.sum(F.when(~large, F.col("n"))).alias("done"), F.sum(F.when(large, F.col("n"))).alias("large")
                           ).first()
        total += counts.done or 0
        placed = placed.join(sizes, "shard")
        parts.append(placed.where(~large).select("fp", "shard", "home", "n"))
        if not counts.large:
            break
        rows = stored(placed.where(large).select(
            "fp", "rest", F.xxhash64(F.lit(step), "shard").alias("within"), F.col("home").alias("own")), "large_shards")
        trees = BlockTrees(max_bits + 1, levels, max_bits, trees.left)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole, total


def fingerprint_links(fps: DataFrame, fp: str, max_bits: int, blocks: int | None = None, levels: int = 8,
                      split: int = SPLIT, depth: int = DEPTH) -> DataFrame:
    """Links (``a``, ``b``) that connect different fingerprints exactly as all pairs within ``max_bits`` would.

    By default there is one block more than bits may differ, so that balls have radius 0 on a block and no fingerprint
    is asked in a second shard; fewer blocks mean wider balls, which reach neighbouring shards. Shards of more than
    ``split`` rows are divided (``divided_shards``), so that a row is compared with a bounded number of others, and
    pairs grow as the fingerprints do.
    """
    rows = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    placed, total = divided_shards(rows, blocks or max_bits + 1, levels, max_bits, split, depth)

    def linked(p: pd.DataFrame) -> pd.DataFrame:
        fps = p["fp"].to_numpy(np.int64).view(np.uint64)
        got = bucket_links(p["shard"].to_numpy(np.int64), fps, p["home"].to_numpy(bool), max_bits)
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    # Shards are mostly small; whole shards go together into buckets of bounded average size.
    buckets = max(1, math.ceil(total / BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("shard"), F.lit(buckets)).alias("bucket")
    return placed.select("fp", "shard", "home").groupBy(bucket).applyInPandas(linked, "a bigint, b bigint")


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``fingerprint`` (16 hex digits), ``component_id`` and ``stays``.

    ``component_id`` is the smallest id among all documents reachable over links of at most ``max_bits`` bits; it is
    null only where no document of the group has an id. ``stays`` is true for exactly one row of each group: the one
    with the smallest id, and among repeated rows the first in the stored table. Null and empty texts have fingerprint
    zero and are linked like any other. Columns of these names are replaced; all others stay. Texts are fingerprinted
    once, and equal fingerprints collapse before anything is compared.
    """
    added = ["fingerprint", "component_id", "stays"]
    columns = [c for c in (keep or df.columns) if c not in added]
    fp = free_name(df, "simhash")
    place = free_name(df, "row_place")
    docs = stored_with_key(with_fingerprint(df, shingle, text, fp, columns), "fingerprints", place)
    groups = docs.groupBy(F.col(fp).alias("node")).agg(
        F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(place).alias("place")))
        .alias("first"))
    groups = stored(groups, "groups")
    parts = connected_components(fingerprint_links(groups, "node", max_bits))
    placed = groups.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = placed.groupBy("component").agg(F.min("first").alias("least"))
    verdict = stored(
        placed.join(firsts, "component").select(
            F.col("node").alias(fp), F.col("least.id").alias("component_id"), F.col("least.place").alias("least_place")),
        "components")
    return docs.join(verdict, fp).select(
        *columns, hex_of(F.col(fp)).alias("fingerprint"), "component_id",
        (F.col(place) == F.col("least_place")).alias("stays"))


def drop_near_duplicates(df: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    return near_duplicates(df, **options).where("stays").select(*df.columns)
