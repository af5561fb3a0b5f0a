"""Operators on whole tables: groups, joins, learned models, the pipeline."""

import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import __spark_entry__ as entry
from check import TABLES, compare
from conftest import DATA
from webloom.llm.chat import RUN, START, format_chats, read_chats
from webloom.llm.components import connected_components
from webloom.llm.decontam import drop_contaminated
from webloom.llm.licenses import collision, find_licenses, template_table
from webloom.llm.quality import classify_quality, labelled
from webloom.llm.registry import RULES, SQL
from webloom.llm.simhash import divided_shards, drop_near_duplicates, fingerprint_links, near_duplicates
from webloom.llm.toxicity import Grammar, classify_toxicity, drop_toxic, term_counts
from webloom.llm.urlrules import judge_urls, rule_table


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_query_with_sql(spark, con, name):
    assert ": same, " in compare(spark, con, name, DATA)


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = groups(pairs, {x for p in pairs for x in p if p[0] != p[1]})
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("max_bits, blocks", [(3, 4), (3, 2), (2, 1), (0, 1)])
def test_links_are_exact(spark, max_bits, blocks):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for f in fps for _ in range(3)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps] + [0, -1, None]
    df = spark.createDataFrame([(f,) for f in signed], "f bigint")
    got = [(r.a, r.b) for r in fingerprint_links(df, "f", max_bits, blocks, levels=3).collect()]
    nodes = {f for f in signed if f is not None}
    pairs = [(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= max_bits]
    assert groups(got, nodes) == groups(pairs, nodes)


@pytest.mark.parametrize("max_bits, blocks, depth", [(3, 4, 0), (3, 4, 2), (3, 2, 2), (2, 3, 1), (1, 1, 2), (0, 1, 2)])
def test_divided_shards_lose_no_link(spark, max_bits, blocks, depth):
    rng = random.Random(11)
    # Blocks that a third of all fingerprints share make shards that stay large for more than one level.
    fps = [rng.getrandbits(64) & (0xFFFF_FFFF if i % 3 else 0x0FFF) for i in range(150)]
    fps = list({f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for f in fps for _ in range(6)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "f bigint")
    got = [(r.a, r.b) for r in fingerprint_links(df, "f", max_bits, blocks, 3, split=8, depth=depth).collect()]
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= max_bits]
    assert all(((a ^ b) & (2 ** 64 - 1)).bit_count() <= max_bits for a, b in got)
    assert groups(got, signed) == groups(pairs, signed)


def test_compared_pairs_grow_with_the_fingerprints(spark):
    def compared(n):
        rows = spark.range(n).select(F.xxhash64("id").alias("fp"))
        return divided_shards(rows, 4, 8, 3, split=8)[0].agg(F.sum(F.col("n") - 1) / 2).first()[0]

    few, many = compared(100_000), compared(400_000)
    assert many < 6 * few  # squares would be sixteen times as many


def brute_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base, base, base + " more", None, "", " \n", "one", "One", "x y", "long " * 50_000, "Über ß A", base.upper()]
    rows = [(i if i != 1 else None, t, i) for i, t in enumerate(texts)] + [(0, base, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int")
    out = near_duplicates(df).collect()
    assert len(out) == len(rows)
    fps = {r.text: int(r.fingerprint, 16) for r in out}
    assert all(f == brute_fingerprint(t) for t, f in fps.items())
    values = {f if f < 1 << 63 else f - (1 << 64) for f in fps.values()}
    ids = groups([(a, b) for a in values for b in values if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3], values)
    assert sum(r.stays for r in out) == len(set(ids.values()))
    assert all(r.component_id == 0 for r in out if r.text and r.text.lower() == base)
    assert [r.component_id for r in out if not (r.text or "").strip()] == [3, 3, 3]
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.where("doc_id = 0").count() == 1
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_chats_share_prefixes(spark):
    rng = random.Random(3)
    first = [("user", f"hello {i} <|im_end|>\n&lt;| &amp;") for i in range(3)]
    rows, want = [], {}
    for c in range(80):
        turns = [first[rng.choice([0, 0, 1, 2])]]
        for k in range(rng.randint(0, 4)):
            turns.append(("assistant" if k % 2 == 0 else "us\ner<|", rng.choice(["", "a", "b", "<|im_start|>assistant x"])))
        want[c] = turns
        rows += [(c, t, *x, 1) for t, x in enumerate(turns)]
    rows += [(None, None, None, None, 2), (200, 0, "assistant", None, 2)]
    want |= {None: [("", "")], 200: [("assistant", "")]}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, chunk int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks, members = format_chats(df)
        out = read_chats(chunks, members).collect()
        emitted = chunks.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == want and len(out) == len(want)
    assert all(r.answers == "".join(t for role, t in want[r.conv_id] if role == "assistant") for r in out)
    distinct = {tuple(t[:k + 1]) for t in want.values() for k in range(len(t))}
    assert sum(len(c.nodes) for c in emitted) == len(distinct)  # each node once
    for tree in {c.tree for c in emitted}:  # chunks follow each other without gap
        at = 0
        for c in sorted((c for c in emitted if c.tree == tree), key=lambda c: c.start):
            assert c.start == at and c.position == sum(s.end - s.start for s in c.attend) and all(s.end <= c.start for s in c.attend)
            at += len(c.text)
    assert read_chats(*format_chats(df.limit(0))).count() == 0


def test_a_conversation_of_many_turns(spark):
    n = 6 * RUN + 1  # states of a fold are put together from several runs, the last one short
    want = [("assistant" if i % 3 else "user", f"é {i} <|im_end|>\n") for i in range(n)]
    rows = [(c, i, *x) for c, size in ((1, n), (2, n - 1), (3, RUN), (4, RUN + 1)) for i, x in enumerate(want[:size])]
    chunks, members = format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: r for r in read_chats(chunks, members).collect()}
    for c, size in ((1, n), (2, n - 1), (3, RUN), (4, RUN + 1)):
        assert [tuple(t) for t in got[c].turns] == want[:size]
        assert got[c].answers == "".join(t for role, t in want[:size] if role == "assistant")
        assert got[c].formatted.count(START) == size
    assert sum(len(c.nodes) for c in chunks.collect()) == n


def test_conversations_in_linear_time(spark):
    def seconds(n):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                      F.concat(F.lit("some words of a turn "), F.col("id").cast("string")).alias("text"))
        begun = time.monotonic()
        assert len(read_chats(*format_chats(turns)).first().turns) == n
        return time.monotonic() - begun

    seconds(10)
    assert seconds(24_000) < 3 * seconds(8_000) + 5  # squares would take nine times as long


def test_url_rules(spark):
    urls = [None, "", "x", "http://COM/", "http://a.example.com/en/x?y=/", "http://www.example.com/en/", "http://www.example.com/EN/",
            "https://b.net/fr/", "https://net/fr", "ftp://netx/fr/", "http://a..net/es/#x", "http://u@www.Example.com/en/a", "http://com?x", "a://b://c.net/es/"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")

    def brute(u):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:n].lower(), rest[n:].split("?")[0].split("#")[0]
        fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    out = judge_urls(df, rule_table(spark, RULES)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in out] == [brute(u) for u in urls]
    assert {r.verdict for r in judge_urls(df, rule_table(spark, RULES).limit(0), default="block").collect()} == {"block"}


def test_licenses(spark):
    assert collision() > 0.999
    filler = " ".join(f"w{i}" for i in range(90))
    rows = [(1, f"{filler} Released under the MIT license {filler}"), (2, filler), (3, None), (4, "LICENSED UNDER CC BY-NC 4.0!"),
            (5, f"{filler}\nThis work is licensed under the GNU General Public License, version 2 {filler}"), (4, "nothing")]
    got = {(r.doc_id, r.license) for r in find_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), template_table(spark)).collect()}
    assert got == {(1, "MIT"), (4, "CC-BY-NC-4.0"), (5, "GPL-3.0")}


def labelled_table(spark, words, n=600):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        text = [rng.choice(["the", "of", "and", "house", "river", "stone", "field"]) + rng.choice("abcdefgh") for _ in range(40)]
        if bad:
            for k in range(3):
                text[rng.randrange(40)] = rng.choice(words)
        rows.append((i, " ".join(text), int(bad)))
    rows += [(None, "the of", None), (n, None, 0), (n + 1, "", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")


def test_toxicity_learns_words_and_stems(spark):
    words = ["idiot", "moron"] + ["lowei" + x for x in ("ab", "cd", "ef", "gh")]
    df = labelled_table(spark, words)
    labels = df.select("doc_id", F.col("label").alias("toxic"))
    out = classify_toxicity(df.withColumn("score", F.lit("x")), labels).collect()
    assert all(r.predicted == (r.label or 0) and 0 <= r.score <= 1 for r in out) and any(r.held_out and r.label for r in out)
    assert drop_toxic(df, labels).count() == df.where("coalesce(label, 0) = 0").count()
    assert drop_toxic(df, labels.limit(0)).count() == df.count()


def test_grammar():
    g = Grammar({"idiot": 6.0}, {"lowei": 6.0}, -2.0, 3.0)
    assert g.score("you idiot") > g.score("an idiot") > g.score("not an idiot") > g.score("a man") and g.score("loweixyz") > 0.9
    assert g.score("he said an idiot") < g.score("an idiot, he said") and g.score("") == g.score("kill the lights")


def test_quality_separates(spark):
    df = labelled_table(spark, ["%%%", "!!", "|"])
    labels = df.select("doc_id", (1 - F.col("label")).alias("quality"))
    out = [r for r in classify_quality(df, labels).collect() if r.held_out and r.label is not None]
    good, bad = ([r.score for r in out if r.label == k] for k in (0, 1))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95  # area under the curve
    assert {r.score for r in classify_quality(df, labels.limit(0)).collect()} == {0.5}


def test_pipeline_row_by_row(spark):
    """Every stage on its own input: what goes, what stays, and what the texts become."""
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from webloom.llm.pii import find_pii
    from webloom.llm.registry import BYTE_VOCABULARY
    from webloom.llm.toxicity import fit_grammar

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    out = entry.queries()["pipeline"](spark, DATA)
    assert out.columns == [*[c for c in docs.columns if c != "text"], "ids", "decoded_sha256"]
    got = {r.doc_id: r for r in out.collect()}
    left = {r.doc_id: r.text for r in docs.collect()}

    grammar = fit_grammar(docs, labels)  # toxicity: the walk of one text at a time
    left = {i: t for i, t in left.items() if grammar.score(t or "") < 0.5}

    bits = {i: brute_fingerprint(t) for i, t in left.items()}  # near-duplicates: all pairs
    group = groups([(a, b) for a in left for b in left if a < b and (bits[a] ^ bits[b]).bit_count() <= 3], left)
    left = {i: t for i, t in left.items() if group[i] == i}

    known = [" ".join(r.text.lower().split()) for r in items.collect() if r.text and r.text.split()]  # benchmark: exact copies go
    exact = {i for i, t in left.items() if any(k in " ".join((t or "").lower().split()) for k in known)}
    assert exact and not exact & got.keys()
    kept = drop_contaminated(docs.where(F.col("doc_id").isin(list(left))), items, short_inside=True)
    left = {r.doc_id: r.text for r in kept.collect()}
    assert left.keys() == got.keys() and len(left) < docs.count()

    spans = {r.doc_id: r.pii for r in find_pii(kept).select("doc_id", "pii").collect()}  # personal data: cut out by hand
    library = Tokenizer.from_file(BYTE_VOCABULARY)
    for i, text in left.items():
        clean, at, end = "", 0, 0
        for x in spans[i]:
            if x.start >= end:
                clean += text[at:x.start] + f"[{x.kind.upper()}]"
            at = end = max(end, x.end)
        clean += (text or "")[at:]
        ids = library.encode(clean, add_special_tokens=False).ids
        assert list(got[i].ids) == ids
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_splits_without_rows(spark):
    """Counting and fitting where most splits hold no row, and texts hold no letter."""
    rows = [(1, "you idiot", 1), (2, "a house", 0), (3, "12 !", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int").repartition(8)
    labels = df.select("doc_id", F.col("label").alias("toxic"), F.col("label").alias("quality"))
    assert {r.doc_id for r in classify_toxicity(df, labels).collect()} == {1, 2, 3}
    assert {r.doc_id for r in classify_quality(df, labels).collect()} == {1, 2, 3}
    assert term_counts(df.where("doc_id = 3")).count() == 0
    assert {r.term: (r.toxic, r.clean) for r in term_counts(df).collect()}["idiot"] == (1, 0)
    assert classify_toxicity(df.limit(0), labels).count() == classify_quality(df.limit(0), labels).count() == 0


def test_sample_holds_one_text_of_an_id(spark):
    df = spark.createDataFrame([(1, f"t{i}") for i in range(50)] + [(2, "x"), (2, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    got = {(r.id, r.text, r.label) for r in labelled(df, labels, "quality", 10).collect()}
    assert got == {t for t in [(1, "t0", 1), (2, "x", 0)] if zlib.crc32(str(t[0]).encode()) % 5}
