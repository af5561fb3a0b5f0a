"""Byte-level BPE encoding and decoding through a sentencepiece model written straight from a rank file.

A byte-level BPE vocabulary joins the two neighbours whose joined bytes have the lowest rank, leftmost among equals. The
sentencepiece BPE model joins the two neighbours whose joined piece has the highest score, leftmost among equals. So
with every byte written as one printable character, each token is a piece, and its score the negative rank, the model
does the same merges. The model is serialised here field by field, without any training and without normalisation:
no charsmap, no dummy prefix, no white space handling. Pre-tokens are encoded by it; ids are decoded by the inverse of
the byte mapping.

A rank file also says that a pre-token which is a token as a whole is that token, whether merges reach it or not. All
tokens are encoded once when the model is built, and those that merges do not reach are kept in a small table.

The pattern that cuts pre-tokens is matched by the ``regex`` library. Its Unicode tables may know letters and digits that
the rank file's own library does not know yet; these few are asked for once and taken out of the pattern's classes.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import map_texts

#: Pre-tokens kept in a worker's cache; beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Longer pre-tokens are not cached.
CACHE_CHARS = 64

# Field numbers and types of the sentencepiece model file, and its piece kinds.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, VOCABULARY_SIZE, BPE = 3, 4, 2
NORMAL, UNKNOWN = 1, 2


def byte_table() -> dict[int, int]:
    """Code point that stands for each byte: the byte's own where that is printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


TO_CHAR = byte_table()
TO_BYTE = {c: b for b, c in TO_CHAR.items()}


def as_piece(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_CHAR)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(at: int, value: int | float | bytes | str) -> bytes:
    """One field of a protocol buffer message: a number, a 32-bit float, or bytes with their length."""
    if isinstance(value, float):
        return _number(at << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _number(at << 3) + _number(value)
    raw = value.encode() if isinstance(value, str) else value
    return _number(at << 3 | 2) + _number(len(raw)) + raw


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base-64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a sentencepiece BPE model.

    Pieces lie in the order of their ranks; one unknown piece, which the format asks for, comes last. All 256 bytes must
    be tokens, so that nothing is unknown.
    """
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"no token for the bytes {missing[:5]}")
    pieces = [_field(PIECES, _field(1, as_piece(t)) + _field(2, -float(r)) + _field(3, NORMAL))
              for t, r in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(PIECES, _field(1, "<unknown piece>") + _field(2, 0.0) + _field(3, UNKNOWN)))
    trainer = _field(TRAINER, _field(MODEL_TYPE, BPE) + _field(VOCABULARY_SIZE, len(pieces)))
    plain = _field(1, "identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + trainer + _field(NORMALIZER, plain)


@dataclass
class Vocabulary:
    """What tasks need: the model file's bytes, the id of each piece, tokens that merges do not reach, the pattern, and
    characters that the pattern's classes of letters and numbers must not hold."""

    model: bytes
    ids: list[int]
    tokens: list[bytes]
    unreached: dict[str, int]
    pattern: str
    newer: dict[str, str] = field(default_factory=dict)
    key: str = field(init=False)

    def __post_init__(self) -> None:
        self.key = sha256(self.model + self.pattern.encode()).hexdigest()


def newer_characters() -> dict[str, str]:
    """For the classes L and N: characters that ``regex`` puts there though ``tiktoken`` does not.

    Asked are characters that one of the two may have learned of lately: those that Python itself does not know. The
    question is whether a pattern of the class alone, or of all else, takes the character.
    """
    import tiktoken

    unknown = [c for c in map(chr, range(0x250, 0x110000)) if unicodedata.category(c) == "Cn"]
    out = {}
    for kind in "LN":
        # With these ranks an "x" joins the first byte of what follows, if the pattern leaves both together.
        ranks = {bytes([b]): b for b in range(256)} | {b"x" + bytes([b]): 256 + b for b in range(256)}
        joined = tiktoken.Encoding("probe", pat_str=rf"x\p{{{kind}}}|[\s\S]", mergeable_ranks=ranks, special_tokens={})
        own = regex.compile(rf"\p{{{kind}}}")
        out[kind] = "".join(c for c in unknown if own.match(c) and joined.encode_ordinary("x" + c)[0] < 256)
    return out


def _ranges(characters: str) -> str:
    """Characters as the inside of a pattern's class."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges)


def _class(kind: str, without: str) -> str:
    """A class without some characters, as nested sets of the ``regex`` library."""
    return rf"[\p{{{kind}}}--[{_ranges(without)}]]" if without else rf"\p{{{kind}}}"


def build_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a rank file and write its model. Ids are the ranks."""
    import sentencepiece

    ranks = read_ranks(path)
    model = model_bytes(ranks)
    order = sorted(ranks, key=ranks.get)
    made = sentencepiece.SentencePieceProcessor(model_proto=model).encode([as_piece(t) for t in order], num_threads=1)
    unreached = {as_piece(t): ranks[t] for i, t in enumerate(order) if made[i] != [i]}
    return Vocabulary(model, [ranks[t] for t in order], order, unreached, pattern, newer_characters())


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        self.split = regex.compile(vocabulary.pattern)
        newer = vocabulary.newer
        exact = vocabulary.pattern
        for kind in newer:
            exact = exact.replace(rf"\p{{{kind}}}", _class(kind, newer[kind]))
        self.exact = regex.compile("(?V1)" + exact)
        some = "".join(newer.values())
        self.newer = re.compile(f"[{_ranges(some)}]" if some else "(?!)")
        self.beyond = re.compile(rf"[^\x00-{re.escape(chr(ord(min(some)) - 1))}]" if some else "(?!)")
        self.bytes_of = {str(i): t for i, t in zip(vocabulary.ids, vocabulary.tokens)}
        self.name = [str(i) for i in vocabulary.ids]
        self.unreached = {p: str(i) for p, i in vocabulary.unreached.items()}
        self.cache: dict[str, str] = {}

    def words(self, texts: list[str]) -> list[list[str]]:
        plain, exact, beyond, newer = self.split, self.exact, self.beyond, self.newer
        return [(exact if beyond.search(t) and newer.search(t) else plain).findall(t) for t in texts]

    def encode_words(self, words: list[str]) -> list[str]:
        """Decimal ids, joined by blanks, of different pre-tokens."""
        pieces = [as_piece(w.encode()) for w in words]
        name, unreached = self.name, self.unreached
        return [unreached.get(p) or " ".join([name[i] for i in ids])
                for p, ids in zip(pieces, self.model.encode(pieces, num_threads=1) if pieces else [])]

    def encode_texts(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by blanks."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        known, split = self.cache, self.words(texts)
        new = [w for w in set().union(*split) if w not in known]
        known.update(zip(new, self.encode_words(new)))
        out = [" ".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out

    def decode(self, ids: str) -> bytes:
        """Bytes of decimal ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))


#: Codecs of a Python worker, by vocabulary; they outlive tasks.
_CODECS: dict[str, Codec] = {}


def _codec(vocabulary: Vocabulary) -> Codec:
    if vocabulary.key not in _CODECS:
        while len(_CODECS) > 1:
            _CODECS.pop(next(iter(_CODECS)))
        _CODECS[vocabulary.key] = Codec(vocabulary)
    return _CODECS[vocabulary.key]


def encode_bytes(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids",
                 keep: list[str] | None = None) -> DataFrame:
    """Append an array of token ids for each whole text.

    Null texts count as empty, and empty texts have no tokens. No text has special tokens: whatever looks like one is
    ordinary text. All columns stay (or those of ``keep``); an empty table gives an empty table; equal texts get equal
    ids. A column named ``ids`` is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        codec = _codec(sent.value)
        return lambda texts: [(list(map(int, s.split())),) for s in codec.encode_texts(texts)]

    return map_texts(df, text, [(ids, "array<int>")], make, [c for c in keep or df.columns if c != ids])


def decode_bytes(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the bytes of each array of token ids. A null array counts as empty; a null or unknown id gives nothing."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _codec(sent.value).bytes_of
        for s in batches:
            yield s.map(lambda x: b"".join(known.get(str(int(i)), b"") for i in x if i == i and i is not None))

    return df.withColumn(out, decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode each whole text and decode the ids again; append counts and digests in place of the ids.

    ``n_tokens``, ``ids_sha256`` (decimal ids joined by one blank) and ``decoded_sha256`` (the bytes that those ids
    decode to). Null texts count as empty. Columns of these names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    added = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]

    def make():
        codec = _codec(sent.value)

        def work(texts: list[str]) -> list[tuple]:
            return [
                (s.count(" ") + 1 if s else 0, sha256(s.encode()).hexdigest(), sha256(codec.decode(s)).hexdigest())
                for s in codec.encode_texts(texts)
            ]

        return work

    return map_texts(df, text, added, make, [c for c in keep or df.columns if c not in dict(added)])
