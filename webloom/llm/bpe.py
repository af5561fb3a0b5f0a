"""Byte-level BPE encoding and decoding by speculation and verification.

Words are split off as byte-level BPE does. For each new word, greedy longest match proposes tokens. A vectorised check
then tests every adjacent pair of proposed tokens; a word all of whose pairs hold is what the merges would give. Only
words that fail are merged exactly, lowest rank first. Words seen before come from a bounded cache, so that the work per
text is one split and one lookup per word.

Why pairs suffice: merges act within the text of one token unless some merge crosses a boundary, and a crossing merge
joins the piece that ends at the boundary with the piece that starts there. Undoing the merges of both neighbours from
the last to the first passes through all pairs that ever met at the boundary.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import map_texts

#: Words kept in a worker's cache; beyond it the cache starts anew.
CACHE_WORDS = 600_000
#: Longer words are not cached.
CACHE_CHARS = 64
#: Words of up to so many bytes are handled side by side in arrays, longer ones one by one.
SIDE_BY_SIDE = 48
NEVER = np.int64(1) << 40

# White space of the split pattern.
SPACE = r"\t-\r \x85\xa0  -     　"


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _splitters() -> tuple[re.Pattern, re.Pattern, regex.Pattern]:
    """A test for characters beyond Latin, the splitter for Latin texts, and the splitter for all others."""
    limit = 0x250
    spaces = set(re.findall(f"[{SPACE}]", "".join(map(chr, range(limit)))))
    kind = {"L": "", "N": ""}
    import unicodedata

    for c in map(chr, range(limit)):
        if (k := unicodedata.category(c)[0]) in kind:
            kind[k] += c
    letters, numbers = (re.escape(kind[k]) for k in "LN")
    other = re.escape("".join(c for c in map(chr, range(limit)) if c not in spaces and c not in kind["L"] + kind["N"]))
    endings = "'s|'t|'re|'ve|'m|'ll|'d"
    latin = f"{endings}| ?[{letters}]+| ?[{numbers}]+| ?[{other}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    wide = rf"{endings}| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    return re.compile("[^\x00-ɏ]"), re.compile(latin), regex.compile(wide)


def split_words(text: str) -> list[str]:
    beyond, latin, wide = _splitters()
    return (wide if beyond.search(text) else latin).findall(text)


class ByteBpe:
    """A vocabulary file of the ``tokenizers`` library with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_chars()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        self.id_of: dict[bytes, int] = {}
        for token, i in ids.items():
            raw = bytes(to_byte[c] for c in token)
            self.bytes_of[i] = raw
            self.id_of[raw] = i
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        a = np.array([ids[x] for x, _ in pairs], dtype=np.int64)
        b = np.array([ids[y] for _, y in pairs], dtype=np.int64)
        made = np.array([ids[x + y] for x, y in pairs], dtype=np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        self.merges = {(x, y): (r, z) for x, y, r, z in zip(a.tolist(), b.tolist(), rank.tolist(), made.tolist())}
        order = np.argsort(a << 32 | b)
        self._keys, self._ranks, self._made = (a << 32 | b)[order], rank[order], made
        # The merge that makes each token, latest first so that the earliest stays.
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)
        self.left[made[::-1]], self.right[made[::-1]], self.born[made[::-1]] = a[::-1], b[::-1], rank[::-1]
        self._find_sound(size)
        self._build_trie()
        self.cache: dict[str, bytes] = {}

    def _find_sound(self, size: int) -> None:
        """Tokens that the merges make from their own bytes; only words of such tokens are taken without merging."""
        self.sound = np.zeros(size, bool)
        self.sound[[i for t, i in self.id_of.items() if len(t) == 1]] = True
        merged = np.flatnonzero(self.born >= 0)
        l, r = self.left[merged], self.right[merged]
        holds = (self.born[l] < self.born[merged]) & (self.born[r] < self.born[merged])
        holds &= self.pairs_hold(l, r, self.born[merged])
        for t, ok in sorted(zip(merged.tolist(), holds.tolist()), key=lambda x: self.born[x[0]]):
            self.sound[t] = ok and self.sound[self.left[t]] and self.sound[self.right[t]]

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def pairs_hold(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge below rank ``before`` (default: none at all) crosses between neighbours ``a`` and ``b``."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        bound = np.full(len(x), NEVER) if before is None else before.astype(np.int64)
        hold, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            crosses = self._rank(x[live], y[live]) < bound[live]
            hold[live[crosses]] = False
            live = live[~crosses]
            bx, by = self.born[x[live]], self.born[y[live]]
            rest = (bx >= 0) | (by >= 0)
            live, bx, by = live[rest], bx[rest], by[rest]
            # The later of the two is undone. Equal merges run from left to right: one that crosses comes after an
            # equal one within the left token and before an equal one within the right token.
            undo = bx > by
            at, to = live[undo], live[~undo]
            bound[at], bound[to] = bx[undo], by[~undo] + 1
            x[at], y[to] = self.right[x[at]], self.left[y[to]]
        return hold

    def _build_trie(self) -> None:
        """All tokens as a trie: sorted keys of (node, byte), the node each leads to, and the token that ends there."""
        nodes: dict[bytes, int] = {b"": 0}
        edges = {}
        for token in self.id_of:
            for k in range(len(token)):
                if (longer := token[:k + 1]) not in nodes:
                    nodes[longer] = len(nodes)
                    edges[nodes[token[:k]] << 8 | token[k]] = nodes[longer]
        self._edges = edges
        self._edge_keys = np.array(sorted(edges), np.int64)
        self._edge_to = np.array([edges[k] for k in self._edge_keys.tolist()], np.int64)
        self._ends = np.full(len(nodes), -1, np.int64)
        for token, i in self.id_of.items():
            self._ends[nodes[token]] = i

    def propose(self, word: bytes) -> list[int]:
        """Longest token at each place."""
        out, i, n = [], 0, len(word)
        while i < n:
            node, j, best, end = 0, i, -1, i
            while j < n and (node := self._edges.get(node << 8 | word[j])) is not None:
                j += 1
                if (t := self._ends[node]) >= 0:
                    best, end = int(t), j
            out.append(best)
            i = end
        return out

    def _propose_all(self, raw: np.ndarray, length: np.ndarray) -> list[list[int]]:
        """``propose`` for many words at once; ``raw`` has a word's bytes in each row."""
        n = len(length)
        tokens, count = np.zeros_like(raw, dtype=np.int64), np.zeros(n, np.int64)
        node, at, best, end = (np.zeros(n, np.int64) for _ in range(4))
        live = np.flatnonzero(length)
        while len(live):
            i = at[live]
            key = node[live] << 8 | raw[live, np.minimum(i, raw.shape[1] - 1)]
            k = np.minimum(np.searchsorted(self._edge_keys, key), len(self._edge_keys) - 1)
            goes = (self._edge_keys[k] == key) & (i < length[live])
            on, to = live[goes], self._edge_to[k[goes]]
            node[on], at[on] = to, i[goes] + 1
            token = self._ends[to]
            best[on[token >= 0]], end[on[token >= 0]] = token[token >= 0], at[on[token >= 0]]
            stop = live[~goes]
            tokens[stop, count[stop]] = best[stop]
            count[stop] += 1
            at[stop], node[stop] = end[stop], 0
            live = np.concatenate([on, stop[end[stop] < length[stop]]])
        return [row[:c] for row, c in zip(tokens.tolist(), count.tolist())]

    def _merge_all(self, raw: np.ndarray, length: np.ndarray) -> list[list[int]]:
        """``merge`` for many words at once: each round does the next merge of every word."""
        byte_id = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        tokens, left = byte_id[raw], length.astype(np.int64)
        n, width = tokens.shape
        column = np.arange(width)
        rank = np.full((n, width), NEVER)
        rank[:, :-1] = self._rank(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width - 1)
        rank[column[None, :] >= (left - 1)[:, None]] = NEVER
        live, out = np.arange(n), [[] for _ in range(n)]
        while len(live):
            at = rank.argmin(axis=1)
            rows = np.arange(len(live))
            lowest = rank[rows, at]
            done = lowest == NEVER
            for i in np.flatnonzero(done).tolist():
                out[live[i]] = tokens[i, :left[i]].tolist()
            keep = ~done
            tokens, rank, left, live, at, lowest = (x[keep] for x in (tokens, rank, left, live, at, lowest))
            if not len(live):
                break
            rows = np.arange(len(live))
            shift = np.minimum(column[None, :] + (column[None, :] > at[:, None]), width - 1)
            tokens = np.take_along_axis(tokens, shift, 1)
            rank = np.take_along_axis(rank, shift, 1)
            rank[:, -1] = NEVER
            left -= 1
            tokens[rows, at] = self._made[lowest]
            for place in (at - 1, at):
                ok = (place >= 0) & (place < left - 1)
                r, c = rows[ok], place[ok]
                rank[r, c] = self._rank(tokens[r, c], tokens[r, c + 1])
            rank[rows[at >= left - 1], at[at >= left - 1]] = NEVER
        return out

    def merge(self, word: bytes) -> list[int]:
        """The merges themselves, lowest rank first, leftmost among equals; any length."""
        tokens = [self.id_of[word[i:i + 1]] for i in range(len(word))]
        n = len(tokens)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = []
        merges = self.merges
        for i in range(n - 1):
            if m := merges.get((tokens[i], tokens[i + 1])):
                queue.append((m[0], i, tokens[i], tokens[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (m := merges.get((tokens[k], tokens[after[k]]))):
                    heapq.heappush(queue, (m[0], k, tokens[k], tokens[after[k]], m[1]))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of different words: proposed, checked all at once, merged where the check fails."""
        raw = [w.encode() for w in words]
        if not raw:
            return []
        length = np.array([len(w) for w in raw])
        short = np.flatnonzero(length <= SIDE_BY_SIDE)
        width = int(length[short].max()) if len(short) else 1
        grid = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in short.tolist()), np.uint8)
        grid = grid.reshape(len(short), width).astype(np.int64)
        found: list[list[int]] = [[]] * len(raw)
        for i, tokens in zip(short.tolist(), self._propose_all(grid, length[short])):
            found[i] = tokens
        for i in np.flatnonzero(length > SIDE_BY_SIDE).tolist():
            found[i] = self.propose(raw[i])
        flat = np.array([t for f in found for t in f], dtype=np.int64)
        word = np.repeat(np.arange(len(found)), [len(f) for f in found])
        fails = np.zeros(len(found), bool)
        fails[word[~self.sound[flat]]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        if len(inside):
            pairs, back = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
            hold = self.pairs_hold(pairs >> 32, pairs & 0xFFFFFFFF)
            fails[word[inside[~hold[back]]]] = True
        again = np.flatnonzero(fails[short])
        for i, tokens in zip(short[again].tolist(), self._merge_all(grid[again], length[short[again]])):
            found[i] = tokens
        for i in np.flatnonzero(fails & (length > SIDE_BY_SIDE)).tolist():
            found[i] = self.merge(raw[i])
        return found

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit integers."""
        return self.encode_parts([self.parts(t) for t in texts])

    def encode_parts(self, parts: list[list[list[str] | bytes]]) -> list[bytes]:
        """As ``encode_texts``, for texts that ``parts`` has split."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        known = self.cache
        words = set().union(*(piece for p in parts for piece in p if isinstance(piece, list)))
        new = [w for w in words if w not in known]
        known.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(new, self.encode_words(new)))
        out = [
            b"".join(b"".join(map(known.__getitem__, p)) if isinstance(p, list) else p for p in pieces)
            for pieces in parts
        ]
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out

    def parts(self, text: str) -> list[list[str] | bytes]:
        """Words between special tokens, and the ids of these."""
        if self._special is None or not self._special.search(text):
            return [split_words(text)]
        parts, at = [], 0
        for m in self._special.finditer(text):
            parts += [split_words(text[at:m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return [*parts, split_words(text[at:])]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load_bpe(path: str) -> ByteBpe:
    """One codec per Python worker; it outlives tasks."""
    return ByteBpe(path)


def bpe_encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append an array of token ids for each whole text.

    Null texts count as empty, and empty texts have no tokens. Special tokens of the vocabulary are recognised in texts.
    All columns stay; an empty table gives an empty table; equal texts get equal ids.
    """
    def make():
        codec = load_bpe(vocabulary)
        return lambda texts: [(np.frombuffer(b, "<u4").astype("<i4"),) for b in codec.encode_texts(texts)]

    return map_texts(df, text, [(ids, "array<int>")], make)


def bpe_decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append the text of each array of token ids; bytes that are no UTF-8 become U+FFFD. A null array counts as empty,
    a null or unknown id gives nothing."""
    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = load_bpe(vocabulary)
        top = len(codec.bytes_of)
        for s in batches:
            yield s.map(lambda x: codec.decode(np.array(
                [i for i in ([] if x is None else x) if i == i and 0 <= i < top], "<u4").tobytes()))

    return df.withColumn(text, decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def bpe_encode_checked(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", digest: str = "decoded_sha256",
                       keep: list[str] | None = None) -> DataFrame:
    """As ``bpe_encode``, and append the SHA-256 of the text that the ids decode to; both in one pass, by one worker.
    ``keep`` names the columns that go along (default: all)."""
    from hashlib import sha256

    def make():
        codec = load_bpe(vocabulary)

        def work(texts: list[str]) -> list[tuple]:
            return [(np.frombuffer(b, "<u4").astype("<i4"), sha256(codec.decode(b).encode("utf-8", "replace")).hexdigest())
                    for b in codec.encode_texts(texts)]

        return work

    return map_texts(df, text, [(ids, "array<int>"), (digest, "string")], make, keep)


def bpe_round_trip(df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode each whole text and decode the ids again; append counts and digests instead of the ids themselves.

    ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and ``decoded_sha256`` (UTF-8 of the
    text decoded from those ids). Null texts count as empty.
    """
    from hashlib import sha256

    def make():
        codec = load_bpe(vocabulary)

        def work(texts: list[str]) -> list[tuple]:
            return [
                (len(b) // 4, sha256(b).hexdigest(), sha256(codec.decode(b).encode("utf-8", "replace")).hexdigest())
                for b in codec.encode_texts(texts)
            ]

        return work

    return map_texts(df, text, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], make,
                     keep)
