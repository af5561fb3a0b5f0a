"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

A window with the number of shingles of a benchmark item is compared with that item. Windows that share no shingle with
an item have similarity 0, so only windows around a shared shingle are fingerprinted. Their SimHash is looked up in an
index over blocks of bits: two fingerprints within ``RADIUS`` bits are within ``RADIUS // BLOCKS`` bits on at least one
block, so no item within the radius is missed. Items found are verified by exact weighted shingle similarity.

A shingle weighs 1 / the number of different item texts of the whole benchmark that hold it; a shingle that the item
does not hold weighs as much as the item's shingles do on average. So the weights depend neither on the slice nor on how
often an item is listed. The plain similarity counts where it is higher, so no near copy is lost to the weights.

The benchmark goes to the tasks in slices of bounded size, one after the other: a slice is collected, sent, looked for
and let go before the next one, and what it finds is written. With a single slice the documents are read once and never
shuffled; with several they are written once, read once for each slice, and joined with what was found.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import free_name, map_texts, stored, stored_with_key, text_of
from webloom.plans.checkpoints import fresh_path

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 64, 8, 24
#: What one slice of the benchmark may hold.
SLICE_ITEMS, SLICE_CHARS = 5_000, 8_000_000


def words_of(text: str) -> list[bytes]:
    """Words between white space, A-Z in lower case."""
    return text.encode().lower().split()


def shingles_of(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


class BlockIndex:
    """For each block and each value of its bits, the fingerprints that may lie within the radius of such a block."""

    def __init__(self, fingerprints: np.ndarray):
        self.fps = fingerprints
        self.width = BITS // BLOCKS
        mask = np.uint64((1 << self.width) - 1)
        values = np.arange(1 << self.width, dtype=np.uint64)
        self.near = []
        for k in range(BLOCKS):
            block = (fingerprints >> np.uint64(k * self.width)) & mask
            close = np.bitwise_count(values[:, None] ^ block[None, :]) <= RADIUS // BLOCKS
            self.near.append([np.flatnonzero(row) for row in close])

    def within(self, fp: np.uint64) -> np.ndarray:
        """Places of all fingerprints within the radius of ``fp``."""
        mask = (1 << self.width) - 1
        found = np.unique(np.concatenate(
            [self.near[k][(int(fp) >> (k * self.width)) & mask] for k in range(BLOCKS)]))
        return found[np.bitwise_count(self.fps[found] ^ fp) <= RADIUS]


class Benchmark:
    """A slice of benchmark items, ready to be looked for in texts.

    ``texts`` says how many different item texts of the whole benchmark hold a shingle; those of one may be absent.
    Without it the items are the whole benchmark. With ``short_inside`` items of fewer words than a shingle are looked
    for inside texts, too.
    """

    def __init__(self, items: list[tuple], texts: dict[bytes, int] | None = None, short_inside: bool = False):
        from xxhash import xxh64_digest

        self._digest = xxh64_digest
        words = [(i, words_of(t or "")) for i, t in items]
        #: Items of fewer words than a shingle: one shingle each, found exactly.
        self.short: dict[bytes, list] = {}
        for i, w in words:
            if 0 < len(w) < SHINGLE:
                self.short.setdefault(b" ".join(w), []).append(i)
        self.short_inside = short_inside
        #: Numbers of words of the short items by their first word.
        self.short_sizes: dict[bytes, set[int]] = {}
        for t in self.short:
            w = t.split(b" ")
            self.short_sizes.setdefault(w[0], set()).add(len(w))
        long = [(i, w, shingles_of(w)) for i, w in words if len(w) >= SHINGLE]
        self.ids = [i for i, _, _ in long]
        self.counts = [Counter(s) for _, _, s in long]
        self.size = [len(s) for _, _, s in long]
        held: dict[bytes, set[int]] = {}
        for k, c in enumerate(self.counts):
            for s in c:
                held.setdefault(s, set()).add(k)
        #: Items that hold a shingle, and its weight: shingles of many different texts say less.
        self.held = held
        if texts is None:
            texts = Counter(s for w in {b" ".join(w): w for _, w, _ in long}.values() for s in set(shingles_of(w)))
        self.weight = {s: 1.0 / texts.get(s, 1) for s in held}
        self.total = [sum(self.weight[s] * n for s, n in c.items()) for c in self.counts]
        # Every shingle has its longest word as an anchor; a text is looked at only where an anchor stands.
        self.anchors: dict[bytes, set[int]] = {}
        for s in held:
            w = s.split(b" ")
            longest = max(range(SHINGLE), key=lambda j: (len(w[j]), j))
            self.anchors.setdefault(w[longest], set()).add(longest)
        by_size: dict[int, list[int]] = {}
        for k, m in enumerate(self.size):
            by_size.setdefault(m, []).append(k)
        self.index = {}
        for m, ks in by_size.items():
            fps = np.array([self.fingerprints(list(c.elements()), [0], m)[0] for c in (self.counts[k] for k in ks)],
                           np.uint64)
            self.index[m] = (ks, BlockIndex(fps))

    def fingerprints(self, shingles: list[bytes], starts: list[int], size: int) -> np.ndarray:
        """SimHash of the windows of ``size`` shingles that begin at ``starts``.

        Every shingle counts the same here: a similarity of 0.8, weighted or plain, needs three quarters of the item's
        shingles, and so many lie well within the radius.
        """
        raw = np.frombuffer(b"".join(self._digest(s) for s in shingles), np.uint8).reshape(-1, 8)
        signed = np.unpackbits(raw, axis=1).astype(np.float64) * 2 - 1
        total = np.concatenate([np.zeros((1, BITS)), np.cumsum(signed, axis=0)])
        starts = np.array(starts)
        bits = total[np.minimum(starts + size, len(shingles))] - total[starts] > 1e-9
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)

    def similarity(self, window: list[bytes], item: int) -> float:
        """Jaccard similarity of the two bags of shingles: weighted or plain, whichever is higher."""
        theirs, weight, size, total = self.counts[item], self.weight, self.size[item], self.total[item]
        shared = [(s, min(n, theirs[s])) for s, n in Counter(window).items() if s in theirs]
        count, both = sum(n for _, n in shared), sum(weight[s] * n for s, n in shared)
        other = len(window) - count
        return max(count / (size + other), both / (total + other * total / size))

    def find(self, text: str) -> list[dict]:
        """Items in a text: each once, with the highest similarity of a window and the first such window's word."""
        words = words_of(text)
        short = self.find_short(words) if self.short_inside and self.short else []
        if len(words) < SHINGLE:
            if self.short_inside:
                return short
            same = self.short.get(b" ".join(words), []) if words else []
            return [{"item": i, "similarity": 1.0, "start": 0} for i in same]
        anchors, held, n = self.anchors, self.held, len(words) - SHINGLE + 1
        shared: dict[int, set[int]] = {}  # places of shared shingles by item
        for at in [i for i, w in enumerate(words) if w in anchors]:
            for offset in anchors[words[at]]:
                if 0 <= (p := at - offset) < n:
                    for k in held.get(b" ".join(words[p:p + SHINGLE]), ()):
                        shared.setdefault(k, set()).add(p)
        best: dict[int, tuple[float, int]] = {}
        by_size: dict[int, set[int]] = {}
        for k, places in shared.items():
            size = self.size[k]
            for p in places:
                by_size.setdefault(size, set()).update(range(max(0, p - size + 1), min(p, max(0, n - size)) + 1))
        for size, starts in by_size.items():
            ks, index = self.index[size]
            for run in runs(sorted(starts)):
                first = run[0]
                shingles = [b" ".join(words[i:i + SHINGLE]) for i in range(first, min(run[-1] + size, n))]
                fps = self.fingerprints(shingles, [s - first for s in run], size)
                for s, fp in zip(run, fps):
                    for place in index.within(fp):
                        k = ks[place]
                        if k not in shared:
                            continue
                        sim = self.similarity(shingles[s - first:s - first + size], k)
                        if sim >= SIMILARITY - 1e-12 and (k not in best or (-sim, s) < (-best[k][0], best[k][1])):
                            best[k] = (sim, s)
        return [{"item": self.ids[k], "similarity": sim, "start": s} for k, (sim, s) in sorted(best.items())] + short

    def find_short(self, words: list[bytes]) -> list[dict]:
        """Short items anywhere in a text, with the first place of each."""
        first: dict[bytes, int] = {}
        for at in [i for i, w in enumerate(words) if w in self.short_sizes]:
            for n in self.short_sizes[words[at]]:
                if (t := b" ".join(words[at:at + n])) in self.short:
                    first.setdefault(t, at)
        return [{"item": i, "similarity": 1.0, "start": at} for t, at in first.items() for i in self.short[t]]


def runs(places: list[int], at_most: int = 4_096) -> list[list[int]]:
    """Neighbouring places together, in bounded pieces."""
    out: list[list[int]] = []
    for p in places:
        if out and p == out[-1][-1] + 1 and len(out[-1]) < at_most:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def _slices(benchmark: DataFrame, item_id: str, text: str
            ) -> tuple[int, Callable[[int], tuple[list[tuple], dict[bytes, int] | None]]]:
    """How many slices that each fit the bounds the items make, and a function that collects one; empty items are left
    out.

    With each slice goes how many different texts of the whole benchmark hold its shingles, where these are several; a
    single slice needs no such counts.
    """
    items = benchmark.select(F.col(item_id).alias("i"), text_of(text).alias("t")).where("length(trim(t)) > 0")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    count = max(1, math.ceil(size["n"] / SLICE_ITEMS), math.ceil(size["c"] / SLICE_CHARS))
    if count == 1:
        return 1, lambda k: ([tuple(r) for r in items.collect()], None)
    items = items.withColumn("k", F.pmod(F.xxhash64("t", "i"), F.lit(count)))
    words = map_texts(items, "t", [("w", "string")], lambda: lambda ts: [(b" ".join(words_of(t)).decode(),) for t in ts])
    shingles = stored(map_texts(
        words.groupBy("w").agg(F.collect_set("k").alias("ks")), "w", [("s", "array<binary>")],
        lambda: lambda ts: [(list(set(shingles_of(words_of(t)))),) for t in ts], ["ks"],
    ).select("ks", F.explode("s").alias("s")), "benchmark_shingles")
    several = stored(shingles.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "benchmark_counts")

    def part(k: int) -> tuple[list[tuple], dict[bytes, int]]:
        own = shingles.where(F.array_contains("ks", k)).select("s").distinct()
        texts = {bytes(r["s"]): r["n"] for r in several.join(own, "s", "left_semi").collect()}
        return [tuple(r) for r in items.where(F.col("k") == k).select("i", "t").collect()], texts

    return count, part


def find_benchmark(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", found: str = "items", keep: list[str] | None = None,
                   short_inside: bool = False) -> DataFrame:
    """Append an array of (item, similarity, start) for each whole text: all benchmark items that a window of the text
    matches with weighted or plain similarity of at least 0.8 on five-word shingles.

    Null texts and items count as empty and match nothing. An item of fewer than five words matches only a text that
    consists of it, or with ``short_inside`` any text that holds its words one after the other. Repeated items are all reported. With an empty benchmark every array is empty.
    """
    kind = f"array<struct<item:{benchmark.schema[item_id].dataType.simpleString()},similarity:double,start:bigint>>"
    count, part = _slices(benchmark, item_id, item_text)
    columns = keep or [c for c in df.columns if c != found]

    def look(rows: DataFrame, k: int, name: str, along: list[str]) -> tuple[DataFrame, Broadcast]:
        sent = df.sparkSession.sparkContext.broadcast(part(k))

        def make():
            return lambda texts, b=Benchmark(*sent.value, short_inside): [(b.find(t),) for t in texts]

        return map_texts(rows, text, [(name, kind)], make, along), sent

    if count == 1:
        name = free_name(df, "benchmark_found")
        return look(df, 0, name, columns)[0].select(*columns, F.col(name).alias(found))
    key, hit = free_name(df, "row_key"), free_name(df, "benchmark_hit")
    rows = stored_with_key(df.select(*columns, *([] if text in columns else [text])), "documents", key)
    path = fresh_path(df.sparkSession, "benchmark_hits")
    for k in range(count):
        hits, sent = look(rows, k, hit, [key])
        hits = hits.select(key, F.explode(hit).alias(hit))
        hits.write.mode("append").parquet(path)
        sent.destroy()
    hits = df.sparkSession.read.schema(hits.schema).parquet(path)
    hits = hits.groupBy(key).agg(F.sort_array(F.collect_list(hit)).alias(hit))
    return rows.join(hits, key, "left").select(
        *columns, F.coalesce(F.col(hit), F.array().cast(kind)).alias(found))


def contaminated_pairs(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row for each document and item found in it: ``doc_id``, ``item_id``, ``similarity``, ``start_word``."""
    found = find_benchmark(df, benchmark, found="items", keep=[doc_id], **options)
    return found.select(doc_id, F.explode("items").alias("i")).select(
        doc_id, F.col("i.item").alias("item_id"), F.col("i.similarity").alias("similarity"),
        F.col("i.start").alias("start_word"))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows whose text holds no benchmark item, with the columns they came with."""
    name = free_name(df, "benchmark_items")
    return find_benchmark(df, benchmark, found=name, **options).where(F.size(name) == 0).select(*df.columns)
