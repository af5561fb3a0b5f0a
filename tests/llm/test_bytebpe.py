"""Byte-level BPE through a written sentencepiece model, against the library that the rank file belongs to."""

import base64
import random
from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from webloom.llm.bytebpe import Codec, build_vocabulary, decode_bytes, encode_bytes, model_bytes, round_trip

TEXTS = [None, "", " ", "a", "a", "The quick brown fox.\n\nIt's  over\t12 dogs!", "<|endoftext|> x <|endoftext|>", "é ß 中文 😀 \x1c \xa0\x00",
         "word " * 3000, "x" * 20_000, "▁ <unknown piece> Ġ"]


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    path = P.path(request.param)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return build_vocabulary(path, P.PATTERN), library


def test_same_ids_as_the_library(both):
    vocabulary, library = both
    codec, rng = Codec(vocabulary), random.Random(5)
    parts = ["a", "b", "aa", "the", "ing", " ", "  ", "\n", "'s", "1", "22", "é", "中", "😀", "<|endoftext|>", "!", "\x1c", "T", "HE", "er", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("abcdething") for _ in range(n)) for n in (30, 47, 500, 3000)] + [t or "" for t in TEXTS]
    texts += [f"a{c}1{c}!{c} {c}{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000, 7)])]
    for text, ids in zip(texts, codec.encode_texts(texts)):
        assert ids == " ".join(map(str, library.encode_ordinary(text))), repr(text)
        assert codec.decode(ids) == text.encode()


def test_long_word_in_little_time(both):
    codec, word = Codec(both[0]), "".join(random.Random(1).choice("abcdefgh") for _ in range(400_000))
    assert codec.decode(codec.encode_texts([word])[0]) == word.encode()


def test_token_that_merges_do_not_reach(tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"zz": 257, b"zzzz": 258}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    vocabulary = build_vocabulary(str(path), P.PATTERN)
    assert vocabulary.unreached == {"abc": 256}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcabc", "zzzzz zzzz", "abc abc"):
        assert Codec(vocabulary).encode_texts([text]) == [" ".join(map(str, library.encode_ordinary(text)))]
    with pytest.raises(ValueError):
        model_bytes({b"a": 0})


def test_columns(spark, both):
    vocabulary, library = both
    rows = [(i if i else None, t, "i", "w") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, whole_text string").repartition(20)
    out = decode_bytes(encode_bytes(df, vocabulary), vocabulary).collect()
    assert len(out) == len(rows)
    assert all(list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in out)
    for r in round_trip(df, vocabulary).collect():
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.whole_text) == (
            len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((r.text or "").encode()).hexdigest(), "i", "w")
    assert encode_bytes(df.limit(0), vocabulary).count() == round_trip(df.limit(0), vocabulary).count() == 0
    odd = spark.createDataFrame([([64, None, 10 ** 6, -1],), (None,)], "ids array<int>")
    assert [bytes(r.decoded) for r in decode_bytes(odd, vocabulary).orderBy(F.col("ids").isNull()).collect()] == [library.decode_bytes([64]), b""]
