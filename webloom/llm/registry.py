"""The registered queries of this package, and SQL to compare where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.alignment import align
from webloom.llm.bpe import bpe_round_trip
from webloom.llm.bytebpe import build_vocabulary, round_trip
from webloom.llm.chat import format_chats, read_chats
from webloom.llm.decontam import contaminated_pairs
from webloom.llm.fertility import quality_rules
from webloom.llm.licenses import TEMPLATES, find_licenses, template_table
from webloom.llm.negatives import hard_negatives
from webloom.llm.pii import BASE, find_pii, spans_text
from webloom.llm.quality import classify_quality
from webloom.llm.simhash import near_duplicates
from webloom.llm.toxicity import classify_toxicity
from webloom.llm.urlrules import judge_urls, rule_table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
# The rules of the URL query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), out="pii")
    base = F.filter("pii", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans.select(
        "doc_id", *map(count, BASE),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("pii")).alias("spans"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"), template_table(spark))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, keep=["doc_id"])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_VOCABULARY, keep=["doc_id"])


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)],
                                 "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(*format_chats(turns)).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("answers").cast("bigint").alias("loss_chars"), F.sha2("answers", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES), keep=["page_id"])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "fingerprint", "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                              short_inside=True)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_VOCABULARY, keep=["doc_id"])[0]


def op12_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), build_vocabulary(RANKS, public_tokenizers.PATTERN), keep=["doc_id"])


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_licenses, op3_bpe, op4_quality_rules, op5_chat, op6_url_rules, op7_toxicity, op8_simhash, op9_quality,
    op10_decontamination, op11_alignment, op12_bytebpe, op13_negatives)}

_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES)
_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_ESCAPED = "replace(replace(coalesce(text, ''), '&', '&amp;'), '<|', '&lt;|')"
_ROLE = "replace(replace(replace(coalesce(role, ''), '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')"
_TRICKY = "<|im_end|><|im_start|>assistant ok"

SQL = {
    "op2_licenses": f"""
with templates(license, template) as (values {_VALUES}),
worded as (select license, regexp_extract_all(lower(template), '[\\p{{L}}\\p{{N}}]+') as w from templates),
t as (select license, len(w) as length, list_distinct(list_transform(range(0, greatest(len(w) - 4, 1)),
    lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))) as wanted from worded where len(w) > 0),
lengths as (select distinct length, greatest(1, length // 2) as step from t),
d as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from documents
    where regexp_matches(lower(text), (select string_agg(distinct x, '|') from (select unnest(w) as x from worded)))),
cut as (select doc_id, length, list_slice(w, i * step + 1, i * step + length + step) as v from (
    select doc_id, w, length, step,
        unnest(range(0, greatest(cast(ceil((len(w) - length - step) / step) as bigint), 0) + 1)) as i
    from d, lengths where len(w) > 0)),
shingled as (select doc_id, length, list_distinct(list_transform(range(0, greatest(len(v) - 4, 1)),
    lambda i: array_to_string(list_slice(v, i + 1, i + 5), ' '))) as s from cut where len(v) > 0),
shared as (select doc_id, license, len(list_intersect(s, wanted)) / len(wanted) as containment
    from shingled join t using (length))
select doc_id, license, max(containment) as containment, count(*) as windows from shared where containment >= 0.8
group by doc_id, license""",
    "op5_chat": f"""
with turns as (select conv_id, turn, role, text from conversations union all
    select * from (values (-1, 0, 'user', '{_TRICKY}'), (-1, 1, 'assistant', '{_TRICKY}')) v(conv_id, turn, role, text)),
t as (select *, coalesce(role, '') as r, coalesce(text, '') as x from turns)
select conv_id, count(*) as n_turns,
    sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) as turns_sha256,
    cast(sum(case when r = 'assistant' then length(x) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(case when r = 'assistant' then x end, '' order by turn nulls first, r, x), '')) as loss_sha256,
    cast(sum(12 + length({_ROLE}) + 1 + length({_ESCAPED}) + 11) as bigint) as formatted_chars
from t group by conv_id""",
    "op6_url_rules": f"""
with rules(h, p, v) as (values {_RULE_VALUES}),
parts as (select page_id, url,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') as path from pages),
judged as (select page_id, host, path,
    (select max({{'n': length(h || p), 'm': length(h), 'b': v = 'block', 'r': h || p, 'v': v}}) from rules
     where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as best from parts)
select page_id, host, path, best.r as rule, coalesce(best.v, 'allow') as verdict from judged""",
    "op13_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
    from embeddings where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
        cast(list_dot_product(a.q, b.q) as bigint) as score
    from v a, v b where a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
positives as (select * from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
pairs as (select anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
        row_number() over (partition by anchor_id, p.id order by n.score desc, n.id) as rank
    from positives p join scores n using (anchor_id)
    where not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from pairs where rank <= 10""",
}
