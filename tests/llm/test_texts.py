"""Operators on single texts against the libraries and against plain brute force."""

import random
import re
import time
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webloom.llm.bpe import ByteBpe, bpe_decode, bpe_encode, bpe_round_trip
from webloom.llm.decontam import Benchmark, drop_contaminated, find_benchmark, shingles_of, words_of
from webloom.llm.fertility import base_counts, quality_rules
from webloom.llm.pii import BASE, find_pii, redact_pii, spans_text
from webloom.llm.registry import BYTE_VOCABULARY, PIECE_VOCABULARY

TEXTS = [None, "", " ", "a", "a", "The quick brown fox.\n\nIt's  over\t12 dogs!", "<|endoftext|> x <|endoftext|>", "é ß 中文 😀 \x1c \xa0",
         "word " * 3000, "x" * 20_000]


def table(spark, texts=TEXTS, schema="doc_id bigint, text string, ids string, whole_text string, pii string"):
    """Texts with ids, one of them null, and columns whose names clash with the operators' own."""
    rows = [(i if i else None, t, "i", "w", "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def codec():
    return ByteBpe(BYTE_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTE_VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_is_what_the_library_gives(codec, library):
    rng = random.Random(5)
    parts = ["a", "b", "aa", "the", "ing", " ", "  ", "\n", "'s", "1", "22", "é", "中", "😀", "<|endoftext|>", "!", "\x1c", "T", "HE", "er"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("abcdething") for _ in range(n)) for n in (30, 47, 48, 49, 500, 3000)]
    for text, ids in zip(texts, codec.encode_texts(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_pair_check_agrees_with_merging(codec):
    rng = random.Random(3)
    tokens = [i for i in np.flatnonzero(codec.sound).tolist()]
    for a, b in [(rng.choice(tokens), rng.choice(tokens)) for _ in range(2000)]:
        merged = codec.merge(codec.bytes_of[a] + codec.bytes_of[b])
        assert codec.pairs_hold(np.array([a]), np.array([b]))[0] == (merged == [a, b])


def test_bpe_tables(spark, codec):
    df = table(spark)
    out = bpe_encode(df.drop("ids"), BYTE_VOCABULARY)
    rows = bpe_decode(out, BYTE_VOCABULARY).collect()
    assert Counter(r.decoded for r in rows) == Counter(t or "" for t in TEXTS)
    round_trip = bpe_round_trip(df, BYTE_VOCABULARY, keep=["doc_id"]).collect()
    want = Counter(sha256((t or "").encode()).hexdigest() for t in TEXTS)
    assert Counter(r.decoded_sha256 for r in round_trip) == want
    assert bpe_encode(df.limit(0), BYTE_VOCABULARY, ids="n").count() == 0


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "d", "|", "\t", "é ", "\x85", "\n"]) for _ in range(rng.randint(0, 120)))
        assert base_counts(text) == brute_counts(text)


def test_quality_rules(spark):
    prose = "The committee has published a report on the state of public libraries and asks readers to send comments on its plans soon. "
    rows = [(1, prose + prose.upper()[:10], None), (2, "zq xkcd " * 40, "en"), (3, None, "xx"), (4, prose, "en"), (4, prose, "en")]
    out = quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), BYTE_VOCABULARY, PIECE_VOCABULARY).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 5 and by[3].base_failed and not by[3].kept and by[2].base_failed and not by[4].base_failed
    assert by[4].chars_per_token > 3 and by[4].byte_fallback_share == 0 and by[4].script == "latin"
    cjk = spark.createDataFrame([(1, "图书馆 " * 3 + " ".join("发布了关于公共状态的报告并请读者意见龘龘" [i:i + 1] for i in range(19)))], "doc_id bigint, text string")
    got = quality_rules(cjk, BYTE_VOCABULARY, PIECE_VOCABULARY).first()
    assert got.script == "cjk" and got.byte_fallback_share > 0


def test_each_band_rejects(spark):
    """Usual texts make the rule; one text too far off by each measure goes, and so do few others."""
    rng = random.Random(9)
    words = "the of and to in is was for that with from this have they which their there would about other many time people year way".split()
    usual = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 200))) for _ in range(400)]
    many = " ".join(rng.choice(words) for _ in range(150))
    odd = {"chars_per_token": " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(120)),
           "byte_fallback_share": " ".join(rng.choice(words) + "龘龘龘" for _ in range(120)),
           "token_entropy": "".join(rng.choice(["the ", "the of ", "the and "]) for _ in range(300)).strip()}
    rows = [(t, "en") for t in usual] + [(many, "en")] * 900 + [(t, "en") for t in odd.values()]
    rows += [(t, None) for t in odd.values()] + [(t, "xx") for t in usual[:5]] + [(None, "en"), ("", None)]
    df = spark.createDataFrame([(t, lang, 0) for t, lang in rows], "text string, lang string, usual int").repartition(5)
    out = quality_rules(df, BYTE_VOCABULARY, PIECE_VOCABULARY).collect()
    assert len(out) == len(rows) and all(r.usual == 0 for r in out)
    by = {(r.text, r.lang): r for r in out}
    assert sum(by[t, "en"].kept for t in usual) >= 395 and by[many, "en"].kept and all(by[t, "xx"].kept == by[t, "en"].kept for t in usual[:5])
    for name, text in odd.items():
        for lang in ("en", None):
            assert by[text, lang].base_failed or not by[text, lang].kept, name
    assert not by[odd["chars_per_token"], "en"].base_failed and not by[odd["byte_fallback_share"], "en"].base_failed
    assert quality_rules(df.limit(0), BYTE_VOCABULARY, PIECE_VOCABULARY).count() == 0
    few = quality_rules(df.where(F.col("text").isin(usual[:3])), BYTE_VOCABULARY, PIECE_VOCABULARY).collect()
    assert all(r.kept for r in few)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_spans(text):
    got = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(k, m[0]))
    return ",".join(f"{k}:{a}:{z}" for a, _, z, k in got)


def test_pii_base_spans(spark):
    rng = random.Random(2)
    parts = ["a@b.c", "_d@e.f-g.h", "1.2.3.4", ".5.6", "300.1.1.1", "000255.1.1.1", "4111 1111-1111 1111", "+1 (456) 555-2186", "+12", "😀", "é", " ", "x", "-", "+", "7", "\n", "@", "."]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    rows = find_pii(table(spark, texts).drop("pii")).select("text", spans_text(F.filter("pii", lambda s: s["base"])).alias("s"),
                                                           F.size(F.filter("pii", lambda s: s["base"])).alias("n")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.s == brute_spans(r.text or "")
    assert set(BASE) == set(PATTERNS)


def test_pii_is_linear_and_redacts(spark):
    long = "1" * 200_000 + " " + "a" * 200_000 + "@b.cc " + "+1" + " 1" * 200_000
    df = table(spark, ["mail a@b.cc or +1 (456) 555-2186, ip 1.2.3.4", "\ufeffé😀 a@b.cc", None, long, "none"])
    got = [r.text for r in redact_pii(df).collect()]
    assert got[0] == "mail [EMAIL] or [PHONE], ip [IP]" and got[1] == "\ufeffé😀 [EMAIL]" and got[2] is None and got[4] == "none"
    assert redact_pii(df).columns == df.columns
    assert redact_pii(df.limit(0)).count() == 0


def test_secrets_are_found_by_the_method(spark):
    rng = random.Random(6)

    def digest(n, letters="0123456789abcdef"):
        return "".join(rng.choice(letters) for _ in range(n))

    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    kept = [f'token = "{digest(40)}"' for _ in range(20)] + [f"API_KEY: {digest(64).upper()}" for _ in range(5)] + [f"secret=ghp_{digest(36, mixed)};" for _ in range(5)]
    left = ["folder/name/with/many/parts/and-1-digit", "a" * 50, "1" * 12, "no_secret_here_at_all_in_words", None, ""]
    rows = find_pii(table(spark, kept + left).drop("pii")).select("text", "pii").collect()
    for r in rows:
        found = [r.text[s.start:s.end] for s in r.pii if s.kind == "secret" and not s.base]
        want = re.findall(r"[A-Za-z0-9_]{36,}", r.text) if r.text in kept else []
        assert found == want, r.text
    assert all(x.count("[SECRET]") == 1 for x in (r.text for r in redact_pii(table(spark, kept)).collect()))


def test_many_matches_in_one_text(spark):
    seconds = []
    for n in (10_000, 20_000):
        df = table(spark, ["a@b.cc, " * n + "😀 1.2.3.4"])
        began = time.perf_counter()
        spans = find_pii(df).first().pii
        assert len(spans) == n + 1 and [s.start for s in spans[:-1]] == list(range(0, 8 * n, 8))
        assert redact_pii(df).first().text == "[EMAIL], " * n + "😀 [IP]"
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 3 * seconds[0] + 2


def test_overlapping_spans_become_one(spark):
    rng = random.Random(8)
    parts = ["a@1.2.3.4", "+1 234 567 8901", "4111 1111-1111 1111", " ", "x", "1.2.3.4", "@b.c", "Mr Hans Peter", "token ", "0123456789abcdef" * 2]
    df = table(spark, ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(200)])
    marked = {r.text: r.pii for r in find_pii(df).select("text", "pii").collect()}
    for before, after in zip(df.collect(), redact_pii(df).collect()):
        out, at, open_end = "", 0, 0
        for s in marked[before.text]:
            if s.start >= open_end:
                out += before.text[at:s.start] if s.start > at else ""
                out += f"[{s.kind.upper()}]"
            open_end = at = max(open_end, s.end)
        assert after.text == out + before.text[at:]


def test_benchmark_windows(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(30)] + [(30, "one two"), (31, None), (32, "")]
    items.append((33, items[0][1]))
    docs = []
    for _ in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        item = rng.choice(items[:30])[1].split()
        if rng.random() < 0.7:
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        at = rng.randint(0, len(words))
        docs.append(" ".join(words[:at] + item[:rng.choice([len(item), len(item) - 1])] + words[at:]))
    docs += [None, "", "One\tTWO", "one two three"]
    bench = Benchmark(items)
    want = []
    for t in docs:
        s, found = shingles_of(words_of(t or "")), {}
        for k, counts in enumerate(bench.counts):
            m = bench.size[k]
            best = max((bench.similarity(s[i:i + m], k) for i in range(max(1, len(s) - m + 1)) if s), default=0)
            if best >= 0.8 - 1e-12:
                found[bench.ids[k]] = round(best, 9)
        want.append(found)
    want[-2] = {30: 1.0}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = find_benchmark(df, benchmark).orderBy("doc_id").collect()
    got = [{x["item"]: round(x["similarity"], 9) for x in r["items"]} for r in rows]
    assert got == want and sum(map(bool, got)) > 40
    assert drop_contaminated(df, benchmark).count() == sum(not w for w in want)
    assert find_benchmark(df, benchmark.limit(0)).where("size(items) > 0").count() == 0


def test_benchmark_slices_give_the_same(spark, monkeypatch):
    import webloom.llm.decontam as d

    items = [(i, f"alpha{i} beta gamma delta epsilon zeta{i}") for i in range(20)]
    docs = spark.createDataFrame([(i, "so " + t + " end") for i, t in items], "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(r.doc_id, x["item"]) for r in find_benchmark(docs, benchmark).collect() for x in r["items"]}
    monkeypatch.setattr(d, "SLICE_ITEMS", 6)
    cut = {(r.doc_id, x["item"]) for r in find_benchmark(docs, benchmark, keep=["doc_id"]).collect() for x in r["items"]}
    assert whole == cut == {(i, i) for i in range(20)}


def test_near_copies_of_repeated_items_in_slices(spark, monkeypatch):
    import webloom.llm.decontam as d

    rng = random.Random(8)
    base = [[f"w{rng.randrange(10 ** 6)}" for _ in range(40)] for _ in range(6)]
    texts = base + base + [b[:20] + [f"{x}z" for x in b[20:]] for b in base] + [b[:-3] + ["other"] + b[-2:] for b in base]
    texts += [["THE", *b] for b in base[:2]] + [["the", *b] for b in base[:2]]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = []
    for b in base:
        for changed in ([], [37], [20], [2, 37], [1, 38], [18]):
            near = [x if k not in changed else "new" for k, x in enumerate(b)]
            docs.append(" ".join([f"a{rng.randrange(99)}" for _ in range(30)] + near + ["end"] * 9))
    bags = {i: shingles_of(words_of(t)) for i, t in items}

    def plain(doc):
        s, found = shingles_of(words_of(doc)), set()
        for i, bag in bags.items():
            for at in range(max(1, len(s) - len(bag) + 1)):
                both = sum((Counter(s[at:at + len(bag)]) & Counter(bag)).values())
                if both >= 0.8 * (2 * len(bag) - both) - 1e-12:
                    found.add(i)
        return found

    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {}
    for size in (5_000, 7):
        monkeypatch.setattr(d, "SLICE_ITEMS", size)
        got[size] = {(r.doc_id, x["item"]): (x["similarity"], x["start"])
                     for r in find_benchmark(df, benchmark).collect() for x in r["items"]}
    assert got[7] == got[5_000]
    want = {(k, i) for k, doc in enumerate(docs) for i in plain(doc)}
    assert want <= set(got[7]) and len({k for k, _ in want}) == 18
    assert all(sim >= 0.8 - 1e-12 for sim, _ in got[7].values())
    assert round(got[7][1, 0][0], 6) == round(33 / 39, 6)


def test_one_benchmark_slice_at_a_time(spark, monkeypatch):
    import webloom.llm.decontam as d

    items = [(i, f"alpha{i} beta gamma delta epsilon zeta{i}") for i in range(20)]
    rows = [(i or None, f"so {items[i][1]} and {items[19 - i][1]}", "x") for i in range(10)] * 2 + [(50, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(str, ((r.doc_id, r.text, r.row_key, sorted(r["items"])) for r in find_benchmark(docs, benchmark).collect())))
    monkeypatch.setattr(d, "SLICE_ITEMS", 6)
    out = find_benchmark(docs, benchmark)
    assert "MapInArrow" not in out._jdf.queryExecution().toString()  # every slice has been run and let go
    got = sorted(map(str, ((r.doc_id, r.text, r.row_key, sorted(r["items"])) for r in out.collect())))
    assert got == want and len(got) == 21 and out.columns == [*docs.columns, "items"]
    assert [r.doc_id for r in drop_contaminated(docs, benchmark).collect()] == [50]


def test_short_items_inside_texts():
    items = [(0, "one two"), (1, "One\tTWO"), (2, "three"), (3, "b c d e"), (4, "one two three four five")]
    bench = Benchmark(items, short_inside=True)

    def found(text):
        return sorted((x["item"], x["similarity"], x["start"]) for x in bench.find(text))

    assert found("so ONE two\nand one two x") == [(0, 1.0, 1), (1, 1.0, 1)]
    assert found("one two") == [(0, 1.0, 0), (1, 1.0, 0)] and found("one x two") == found("") == found("a b c d") == []
    assert found("one two three four five") == [(0, 1.0, 0), (1, 1.0, 0), (2, 1.0, 2), (4, 1.0, 0)]
    assert found("a b c d e") == [(3, 1.0, 1)] and Benchmark(items).find("so one two and one two x") == []


def test_query_finds_short_items_inside_texts(spark, tmp_path):
    import __spark_entry__ as entry
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "so one two and more words"), (2, "one or two and more words")],
                                 "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "One two")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = entry.queries()["op10_decontamination"](spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.item_id, r.start_word) for r in rows] == [(1, 7, 1)]
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [2]
