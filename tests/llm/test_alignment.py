"""Alignment of two tokenizers against the libraries and plain counting."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from webloom.llm.alignment import FIGURES, align, load_aligner
from webloom.llm.bpe import _byte_chars
from webloom.llm.registry import BYTE_VOCABULARY, PIECE_VOCABULARY


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    to_byte = _byte_chars()

    def groups(text):
        if not text:
            return []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spell_a = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids_a]
        spell_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode():
            return []

        def ends(spelled):
            at = 0
            return [at := at + len(s) for s in spelled]

        ends_a, ends_b = ends(spell_a), ends(spell_b)
        cuts = sorted(set(ends_a) & set(ends_b))
        out, low = [], 0
        for cut in cuts:
            out.append(([i for i, e in zip(ids_a, ends_a) if low < e <= cut], [i for i, e in zip(ids_b, ends_b) if low < e <= cut]))
            low = cut
        return out

    def run(texts):
        cut = [groups(t) for t in texts]
        held = Counter()
        for g in cut:
            held.update({(x, y) for m, t in g for x in m for y in t})
        best = defaultdict(int)
        for (x, _), n in held.items():
            best[x] = max(best[x], n)
        rows = []
        for g in cut:
            links = [(x, y) for m, t in g for x in m for y in t]
            digest = sha256(";".join(",".join(map(str, m)) + "|" + ",".join(map(str, t)) for m, t in g).encode()).hexdigest() if g else ""
            rows.append((sum(len(m) for m, _ in g), sum(len(t) for _, t in g), len(g), len(links),
                         sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
        return rows, held

    return run


PARTS = ["the", "Haus", "straße", "été", "中文", "😀", " ", " ", "  ", "\n", "\n ", " \n\n  ", "\t", "\x1c ", "\xa0", " ", "12", "3", "!", "...",
         "'s", "<|endoftext|>", "<0x41>", "</s>", "a", "ing", "Q", "ñandú", "ъ", "\x00", "�", "\r\n"]
FIXED = [None, "", " ", "\n", "  ", "a", "a", "a ", " a", "a▁b", "▁", "x" * 500, "ab" * 300 + "\n" * 50, "<unk>", "word " * 200]


def texts(seed, n):
    rng = random.Random(seed)
    return FIXED + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_against_the_libraries(spark, brute):
    all_texts = texts(1, 250)
    rows = [(i if i else None, t, i, "c") for i, t in enumerate(all_texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_a int, chunk string").repartition(6)
    out, pairs = align(df, BYTE_VOCABULARY, PIECE_VOCABULARY, chunk_rows=7)
    want, held = brute(all_texts)
    got = {r.doc_id or 0: tuple(r[n] for n in [*FIGURES, "groups_sha256"]) for r in out.collect()}
    assert got == dict(enumerate(want)) and out.columns[:3] == ["doc_id", "text", "chunk"]
    assert {(r.a, r.b): r.texts for r in pairs.collect()} == held


def test_words_are_encoded_alike_alone_and_in_texts():
    aligner = load_aligner(BYTE_VOCABULARY, PIECE_VOCABULARY)
    assert aligner.b.by_word
    for text in texts(2, 400)[1:]:
        words = aligner.split(text)
        assert "".join(words) == " " + text
        assert [t for b in aligner.b.encode(words) for t in b] == aligner.b.encode([" " + text])[0]


def test_empty_and_long(spark, brute):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "doc_id bigint, text string")
    out, pairs = align(df.limit(0), BYTE_VOCABULARY, PIECE_VOCABULARY)
    assert out.count() == pairs.count() == 0
    out, pairs = align(df.select(df.text.alias("body")).repartition(8), BYTE_VOCABULARY, PIECE_VOCABULARY, text="body")
    assert out.columns == ["body", *FIGURES, "groups_sha256"] and out.count() == 2
    long = [("".join(random.Random(1).choice("abcdefgh") for _ in range(200_000)) + " é" * 100_000,)]
    r = align(spark.createDataFrame(long, "text string"), BYTE_VOCABULARY, PIECE_VOCABULARY)[0].first()
    assert r.n_groups > 100_000 and r.n_links >= r.n_a
