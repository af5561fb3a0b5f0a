"""Shared inputs of the registered queries, on both sides."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import fixtures as X
from webloom.operators.dedup import union_all
from webloom.operators.extract import extract_links
from webloom.plans.discoveries import page_discoveries, with_site
from webloom.registry import sqltext as S

RECORD = ["input", "source", "type", "url", "status", "length", "seen_set", "step", "origin", "pos"]


# The two inputs below are plans that many queries start from; like a view, each is put together once per session.


@lru_cache(maxsize=8)
def rich_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML pages and script files, all fetched fine."""
    pages = X.derived(spark, sf_dir, "rich_pages")
    assets = X.derived(spark, sf_dir, "js_assets").select("page_id", "url", F.col("body").alias("html"))
    return union_all(pages, assets).withColumns({"status": F.lit(200), "source": F.lit("body")})


@lru_cache(maxsize=8)
def rich_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_discoveries(rich_captures(spark, sf_dir))


RICH_INPUTS = X.cte("rich_pages", "js_assets")
RICH_SITE = (
    f"select page_id, url, html, 'body' as source, 0 as level, 'https://' || {X.HOST} as input, {S.domain('url')} as dom "
    "from (select page_id, url, html from rich_pages union all select page_id, url, body from js_assets)"
)
RICH_RECORDS = ",\n".join([RICH_INPUTS, f"site_pages as ({RICH_SITE})", S.discoveries("disc", "site_pages")])


def over_records(select: str, *more: str) -> str:
    """SQL over ``disc``, all records of the rich captures."""
    return S.with_(RICH_RECORDS, *more) + select


@lru_cache(maxsize=8)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute links of the untouched pages."""
    return extract_links(X.table(spark, sf_dir, "pages"))


LINKS = ",\n".join([
    S.exploded("tags", "pages", S.tags("html"), "tag", "pos", "page_id, url as page, html"),
    f"anchors as (select page_id, page, pos, {S.attr('tag', 'href')} as href from tags "
    f"where regexp_matches(tag, '(?i)^<a\\b') and {S.attr('tag', 'href')} <> '')",
    S.resolved("links", "anchors", "page", "href", "url"),
])


def over_links(select: str, *more: str) -> str:
    """SQL over ``links``, the absolute links of the untouched pages."""
    return S.with_(LINKS, *more) + select


__all__ = ["F", "X", "S", "RECORD", "with_site", "rich_captures", "rich_records", "over_records", "page_links",
           "over_links", "RICH_RECORDS", "RICH_INPUTS"]
