"""The whole job: roots, crawl, records, first-wins, labels and summary.

Page bodies are read once: what is in them is written as small rows, from which both the link graph and the records
are made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import url_key
from webloom.operators.dedup import first_wins_printed
from webloom.operators.extract import link_file_exts
from webloom.operators.joins import join_source_attribution
from webloom.operators.report import count_by_provider, crawl_summary
from webloom.plans.checkpoints import written
from webloom.plans.crawl import crawl, crawl_roots, link_edges
from webloom.plans.discoveries import (
    BUCKET, FIND_COLUMNS, FORM, LINK, NAME, PAGE, PASSIVE, ROBOTS, SCRIPT, SCRIPT_LINK, SITEMAP, UPLOAD, find_records,
    names_below, page_finds, root_records, union_discoveries,
)


def site_records(
    captures: DataFrame, seeds: DataFrame, sitemap_urls: DataFrame, robots_urls: DataFrame, passive_urls: DataFrame,
    max_depth: int = 1, exts: Sequence[str] = ("js",), include: str | None = None, exclude: str | None = None,
) -> DataFrame:
    """All records of the crawls of ``seeds(site, host, domain)``, before de-duplication.

    ``captures`` has ``url, html, status``; the three lists have ``input`` (the seed's site) and ``url``, the passive
    one ``provider`` as well.
    """
    exts = link_file_exts(exts)
    captures = captures.withColumn("status", F.coalesce("status", F.lit(200)))
    good = captures.filter((F.col("status") >= 100) & (F.col("status") < 400)).select(
        "url", "html", "status", F.length("html").cast("long").alias("length"))
    finds = written(page_finds(good, exts, names=True), "finds")  # the only scan of the bodies
    roots = crawl_roots(seeds, sitemap_urls, robots_urls, passive_urls)
    seen = crawl(link_edges(finds, exts), roots, max_depth, include, exclude, exts)

    # one visit per site and URL: a page visit, where there is one, also covers the link file
    visits = seen.groupBy("input", "host", "url").agg(
        F.min("level").alias("level"),
        F.min("link_file").alias("link_file"),
        F.min(F.when(~F.col("link_file"), F.col("depth"))).alias("page_depth"),
    )
    providers = passive_urls.select("input", "url", F.col("provider").alias("source"), F.lit(0).alias("rank"))
    seed_domains = seeds.select(F.col("site").alias("input"), F.col("domain").alias("seed_domain")).distinct()
    sourced = written(attribute_sources(visits, providers).join(seed_domains, "input", "inner"), "visits")
    scope = F.col("url").rlike(include) if include else F.col("url").contains(F.col("host"))
    sourced = sourced.withColumn("searched", scope)
    of_pages = find_records(_visited_finds(finds, sourced, max_depth), exts)

    def listed(urls: DataFrame, kind: str, step: int) -> DataFrame:
        return root_records(urls, F.lit(kind), F.lit(kind), step)

    of_archives = root_records(passive_urls, F.concat(F.lit("passive-"), "provider"), F.col("provider"), PASSIVE)
    return union_discoveries(of_pages, listed(sitemap_urls, "sitemap", SITEMAP), listed(robots_urls, "robots", ROBOTS),
                             of_archives)


def _visited_finds(finds: DataFrame, visits: DataFrame, max_depth: int) -> DataFrame:
    """What the visits of each site read: small rows joined by URL. Names become subdomains of the site's own domain here,
    whatever domain their page belongs to."""
    step = F.col("step")
    followed = F.col("page_depth") < max_depth if max_depth > 0 else F.col("page_depth").isNotNull()
    read_as_page = F.coalesce(followed, F.lit(False))
    wanted = (
        step.isin(PAGE, SCRIPT_LINK)
        | (step.isin(NAME, BUCKET) & F.col("searched"))
        | (step.isin(LINK, SCRIPT, FORM, UPLOAD) & read_as_page)
    )
    kept = [*FIND_COLUMNS, "status", "length", "input", "source", "level"]
    return names_below(finds.join(visits, "url", "inner").filter(wanted), F.col("seed_domain")).select(*kept)


def attribute_sources(visits: DataFrame, sources: DataFrame) -> DataFrame:
    """Per site: the provider that listed a URL, else the page or link file it was read from."""
    marked = visits.withColumn("_site_url", F.concat_ws("\n", "input", url_key(F.col("url"))))
    keyed = sources.select(F.concat_ws("\n", "input", url_key(F.col("url"))).alias("url"), "source", "rank")
    plain = marked.withColumnRenamed("url", "_url").withColumnRenamed("_site_url", "url")
    return join_source_attribution(plain, keyed).drop("url").withColumnRenamed("_url", "url")


def site_report(
    captures: DataFrame, seeds: DataFrame, sitemap_urls: DataFrame, robots_urls: DataFrame, passive_urls: DataFrame,
    max_depth: int = 1, exts: Sequence[str] = ("js",), include: str | None = None, exclude: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Summary lines ``(input, ord, metric_key, metric, value)`` of every site."""
    sites = seeds.select(F.col("site").alias("input"))
    sitemap_urls, robots_urls = (u.join(sites, "input", "left_semi") for u in (sitemap_urls, robots_urls))
    wanted = passive_urls.select("input", "url", "provider").join(sites, "input", "left_semi")
    passive_urls = written(wanted, "passive")
    records = site_records(captures, seeds, sitemap_urls, robots_urls, passive_urls, max_depth, exts, include, exclude)
    counts = count_by_provider(passive_urls, "input")
    return crawl_summary(first_wins_printed(records), counts, strict)


__all__ = ["site_records", "site_report", "attribute_sources"]
