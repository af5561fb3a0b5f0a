"""Counters, summaries, line formats and the text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.fixed_values import SUMMARY_LABELS
from webloom.functions import labels as L
from webloom.functions.urls import host_of_url, registered_domain


# -- counters ---------------------------------------------------------------------------------------------------------

def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _distinct_subdomains(kind: Column, url: Column, domain: Column) -> Column:
    host = host_of_url(url)
    return F.count_distinct(F.when(L.is_subdomain_record(kind) & (host != "") & (host != domain), host))


def counters(strict: bool = False) -> dict[str, Column]:
    """The six counters of a crawl. ``strict`` counts a bucket record once for its name and once for its type."""
    kind, url = F.col("type"), F.col("url")
    buckets = _count(L.aws_class(url) == "aws_s3")
    named = L.aws_class(url).eqNullSafe("aws_s3")
    extra = _count(kind == "aws-s3") if strict else _count((kind == "aws-s3") & ~named)
    return {
        "urls": _count(L.is_url_record(kind)),
        "subdomains": _distinct_subdomains(kind, url, registered_domain(F.col("input"))),
        "javascript": _count(kind == "javascript"),
        "forms": _count(L.is_form_record(kind)),
        "aws_s3": buckets + extra,
        "aws_cloudfront": _count(L.aws_class(url) == "aws_cloudfront"),
    }


def _one_counter(records: DataFrame, name: str, strict: bool = False) -> DataFrame:
    return records.groupBy("input").agg(counters(strict)[name].alias("value"))


def count_urls(records: DataFrame) -> DataFrame:
    return _one_counter(records, "urls")


def count_subdomains(records: DataFrame) -> DataFrame:
    return _one_counter(records, "subdomains")


def count_javascript(records: DataFrame) -> DataFrame:
    return _one_counter(records, "javascript")


def count_forms(records: DataFrame) -> DataFrame:
    return _one_counter(records, "forms")


def count_aws(records: DataFrame, strict: bool = False) -> DataFrame:
    c = counters(strict)
    return records.groupBy("input").agg(c["aws_s3"].alias("aws_s3"), c["aws_cloudfront"].alias("aws_cloudfront"))


def count_by_provider(urls: DataFrame, *keys: str) -> DataFrame:
    """Rows per provider, before the records meet the output's own de-duplication."""
    return urls.groupBy(*keys, "provider").agg(F.count(F.lit(1)).alias("urls"))


def summary_by_site(records: DataFrame, strict: bool = False) -> DataFrame:
    """All counters per site."""
    return records.groupBy("input").agg(*[c.alias(n) for n, c in counters(strict).items()])


def crawl_summary(records: DataFrame, provider_counts: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Report lines per site: six counters in fixed order, then the providers that gave something, by id.

    ``provider_counts`` has ``input, provider, urls``. The result ``(input, ord, metric, value)`` sorts on
    ``input, ord, metric_key``.
    """
    wide = summary_by_site(records, strict)
    fixed = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(name).alias("metric_key"), F.lit(label).alias("metric"),
                 F.col(name).alias("value"))
        for i, (name, label) in enumerate(SUMMARY_LABELS.items())
    ])
    lines = wide.select("input", F.inline(fixed))
    if provider_counts is None:
        return lines
    extra = provider_counts.filter("urls > 0").select(
        "input", F.lit(len(SUMMARY_LABELS)).alias("ord"), F.col("provider").alias("metric_key"),
        L.provider_label(F.col("provider")).alias("metric"), F.col("urls").alias("value"),
    )
    return lines.unionByName(extra)


def summary_text(summary: DataFrame) -> DataFrame:
    """Printable summary lines; a provider's count carries a unit."""
    unit = F.when(F.col("ord") == len(SUMMARY_LABELS), " Urls").otherwise("")
    return summary.withColumn("line", F.concat("metric", F.lit(": "), F.col("value").cast("string"), unit))


def sort_providers(counts: DataFrame) -> DataFrame:
    return counts.filter("urls > 0").orderBy("provider")


# -- line formats -----------------------------------------------------------------------------------------------------

def json_line() -> Column:
    """JSON object; status, length and from are left out when missing."""
    origin = F.when(F.col("from") != "", F.col("from"))
    return F.to_json(F.struct("input", "source", "type", "url", "status", "length", origin.alias("from")))


def clean_line() -> Column:
    return F.concat(F.lit("["), L.clean_tag(F.col("type"), F.col("url")), F.lit("] "), F.col("url"))


def standard_line(show_length: bool = False) -> Column:
    def boxed(c: Column) -> Column:
        return F.concat(F.lit("["), c, F.lit("]"))

    return F.concat_ws(
        " ",
        boxed(L.source_label(F.col("source"), F.col("type"))),
        boxed(L.type_label(F.col("type"))),
        L.format_length(F.col("length")) if show_length else F.lit(None).cast("string"),
        L.from_tag(F.col("from")),
        F.col("url"),
        boxed(F.col("status").cast("string")),
    )


def _lines(records: DataFrame, line: Column) -> DataFrame:
    return records.select(line.alias("line"))


def format_json(records: DataFrame) -> DataFrame:
    return _lines(records, json_line())


def format_quiet(records: DataFrame) -> DataFrame:
    return _lines(records, F.col("url"))


def format_clean(records: DataFrame) -> DataFrame:
    return _lines(records, clean_line())


def format_standard(records: DataFrame, show_length: bool = False) -> DataFrame:
    return _lines(records, standard_line(show_length))


def sink_text(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Append one line per record to a folder of UTF-8 text files."""
    lines.select("line").write.mode(mode).text(path)
