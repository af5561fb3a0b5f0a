"""A site from its captures alone: the roots that sitemaps, robots files and archives list, and everything one run gives."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import resolve_url, strip
from webloom.operators.dedup import first_wins_printed, union_all
from webloom.operators.joins import join_status_check
from webloom.operators.report import (
    count_by_provider, crawl_summary, format_clean, format_json, format_quiet, format_standard,
)
from webloom.plans.checkpoints import written
from webloom.plans.site_report import site_records
from webloom.sources.captures import element_texts, sitemap_candidates, site_root
from webloom.sources.providers import passive_discoveries

SITEMAP_FILE, ROBOTS_FILE = "sitemap", "robots"


def listing_files(captures: DataFrame, body: str = "html") -> DataFrame:
    """What captured sitemaps and robots files list, from one scan of all bodies: ``url, locs, children, rules``.

    A body counts as a sitemap by what it holds and as a robots file by its place; responses other than 200 do not count.
    """
    text, none = F.col(body), F.array().cast("array<string>")
    good = captures.filter("coalesce(status, 200) = 200") if "status" in captures.columns else captures
    mapped = text.contains("<loc")
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).contains("llow: "))
    rules = F.transform(lines, lambda x: strip(F.regexp_replace(x, "(?is).*llow: ", "")))
    found = good.select(
        "url",
        F.when(mapped, element_texts(text, "url")).otherwise(none).alias("locs"),
        F.when(mapped, element_texts(text, "sitemap")).otherwise(none).alias("children"),
        F.when(F.col("url").endswith("/robots.txt"), rules).otherwise(none).alias("rules"),
    )
    return found.filter((F.size("locs") > 0) | (F.size("children") > 0) | (F.size("rules") > 0))


def site_roots(seeds: DataFrame, captures: DataFrame, body: str = "html") -> tuple[DataFrame, DataFrame]:
    """What sitemaps and robots files list for each of ``seeds(site)``: two tables ``input, url``, each pair once.

    Sitemaps are looked for at the well-known places; those that an index lists are read too, one level deep, and count
    for the index's site. Robots paths are resolved on the site, an empty one gives the site.
    """
    files = written(listing_files(captures, body), "listings")
    places = sitemap_candidates(seeds).select(F.col("site").alias("input"), "url").distinct()
    listed = places.join(files, "url", "inner")
    children = listed.select("input", F.explode("children").alias("url")).distinct()
    below = children.join(files, "url", "inner")
    maps = union_all(*[x.select("input", F.explode("locs").alias("url")) for x in (listed, below)]).distinct()
    root = site_root(F.col("site"))
    robots_places = seeds.select(F.col("site").alias("input"), root.alias("root"),
                                 F.concat(root, F.lit("/robots.txt")).alias("url")).distinct()
    rules = robots_places.join(files, "url", "inner").select("input", "root", F.explode("rules").alias("path"))
    robots = resolve_url(rules, "root", "path", "found").filter("found != ''")
    return maps, robots.select("input", F.col("found").alias("url")).distinct()


def passive_roots(seeds: DataFrame, payloads: dict[str, DataFrame], **options) -> DataFrame:
    """``input, url, provider``: what archives list for the domain of each of ``seeds(site, domain)``."""
    sites = seeds.select(F.col("site").alias("input"), "domain").distinct()
    return passive_discoveries(payloads, **options).join(sites, "domain", "inner").select("input", "url", "provider")


FORMATS = {"standard": format_standard, "clean": format_clean, "quiet": format_quiet, "json": format_json}


@dataclass
class SiteRun:
    """Records as printed, the lines that print them, and the summary; all from one table."""

    records: DataFrame
    lines: DataFrame
    summary: DataFrame


def site_run(
    captures: DataFrame, seeds: DataFrame, payloads: dict[str, DataFrame] | None = None, status_log: DataFrame | None = None,
    style: str = "standard", max_depth: int = 1, exts: Sequence[str] = ("js",), include: str | None = None,
    exclude: str | None = None, strict: bool = False, **passive,
) -> SiteRun:
    """Roots, crawl, records, lines and summary of ``seeds(site, host, domain)``.

    ``status_log`` fills the status of checked records, see :func:`join_status_check`. ``passive`` are the options of
    :func:`passive_discoveries`, among them ``no_subs``. ``style`` is one of ``standard``, ``clean``, ``quiet``, ``json``.
    """
    if style not in FORMATS:
        raise ValueError(f"style is one of {sorted(FORMATS)}")
    spark = captures.sparkSession
    maps, robots = (written(x, "roots") for x in site_roots(seeds, captures))
    none = spark.createDataFrame([], "input string, url string, provider string")
    archives = written(passive_roots(seeds, payloads, **passive), "passive") if payloads else none
    found = first_wins_printed(site_records(captures, seeds, maps, robots, archives, max_depth, exts, include, exclude))
    records = written(found if status_log is None else join_status_check(found, status_log), "records")
    summary = crawl_summary(records, count_by_provider(archives, "input"), strict)
    return SiteRun(records, FORMATS[style](records), summary)
