"""Capture tables: seeds, pages, robots files and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.fixed_values import SITEMAP_PATHS
from webloom.functions.text import unescape_html
from webloom.functions.urls import ensure_scheme, hostname_of, registered_domain, resolve_url, strip
from webloom.operators.dedup import union_all


def load_seed_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Site lists: one site per line, from any number of text files or folders."""
    return union_all(*[spark.read.text(p).select(F.col("value").alias("line")) for p in paths])


def read_seeds(lines: DataFrame, line: str = "line") -> DataFrame:
    """Sites with a scheme, their host and registered domain; blank lines go."""
    text = strip(F.col(line))
    kept = [F.col(c) for c in lines.columns if c != line]
    sites = lines.filter(text != "").select(*kept, ensure_scheme(text).alias("site"))
    return sites.withColumns({"host": hostname_of(F.col("site")), "domain": registered_domain(F.col("site"))})


def read_pages(captures: DataFrame, body: str = "html") -> DataFrame:
    """Captured responses without their body: status (200 when unknown) and length in characters."""
    known = captures.columns
    status = F.coalesce(F.col("status"), F.lit(200)) if "status" in known else F.lit(200)
    source = F.coalesce(F.col("source"), F.lit("body")) if "source" in known else F.lit("body")
    kept = [c for c in known if c not in (body, "status", "source")]
    return captures.select(*kept, status.cast("int").alias("status"), F.length(body).cast("long").alias("length"),
                           source.alias("source"))


def site_root(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def _good(captures: DataFrame) -> DataFrame:
    return captures.filter("status = 200") if "status" in captures.columns else captures


def read_robots(robots: DataFrame, body: str = "body") -> DataFrame:
    """URLs named by Allow and Disallow lines, resolved on the site; an empty path gives the site itself."""
    sites = _good(robots).withColumn("site", site_root(F.col("url")))
    lines = sites.select("site", F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    rules = lines.filter(F.lower("line").contains("llow: "))
    paths = rules.withColumn("path", strip(F.regexp_replace("line", "(?is).*llow: ", "")))
    found = resolve_url(paths, "site", "path", "url").filter("url != ''")
    return found.select("site", "url", F.lit("robots").alias("type"), "pos")


def element_texts(xml: Column, element: str) -> Column:
    """Text of the first ``loc`` in each ``element`` of an XML text. An element that is never closed ends where the next
    one begins or with the text, and a ``loc`` with its element, so that a text is scanned once."""
    end = rf"(?:</{element}\s*+>|(?=<{element}[\s>])|\z)"
    blocks = F.regexp_extract_all(xml, F.lit(rf"(?s)<{element}(?:\s[^>]*+)?+>(.*?){end}"), F.lit(1))

    def loc(block: Column) -> Column:
        text = F.regexp_extract(block, r"(?s)<loc(?:\s[^>]*+)?+>(.*?)(?:</loc\s*+>|\z)", 1)
        literal = F.regexp_extract(text, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", 1)
        return F.when(literal != "", literal).otherwise(unescape_html(text))

    return F.filter(F.transform(blocks, loc), lambda t: t != "")


def read_sitemap(captures: DataFrame, body: str = "body") -> DataFrame:
    """Page URLs listed by sitemaps."""
    found = _good(captures).select(
        site_root(F.col("url")).alias("site"), F.posexplode(element_texts(F.col(body), "url")).alias("pos", "loc")
    )
    return found.select("site", F.col("loc").alias("url"), F.lit("sitemap").alias("type"), "pos")


def sitemap_children(captures: DataFrame, body: str = "body") -> DataFrame:
    """Sitemap URLs listed by sitemap indexes."""
    return _good(captures).select(
        site_root(F.col("url")).alias("site"), F.explode(element_texts(F.col(body), "sitemap")).alias("child")
    )


def read_sitemap_index(indexes: DataFrame, captures: DataFrame, body: str = "body") -> DataFrame:
    """Page URLs of the sitemaps an index lists, one level deep. They count for the index's site."""
    children = sitemap_children(indexes, body).distinct()
    bodies = _good(captures).select(F.col("url").alias("child"), body)
    listed = children.join(bodies, "child", "inner")
    found = listed.select("site", F.posexplode(element_texts(F.col(body), "url")).alias("pos", "url"))
    return found.select("site", "url", F.lit("sitemap").alias("type"), "pos")


def sitemap_candidates(seeds: DataFrame) -> DataFrame:
    """The well-known sitemap places of every site."""
    paths = F.array(*[F.lit(p) for p in SITEMAP_PATHS])
    spread = seeds.select("site", F.posexplode(paths).alias("pos", "path"))
    return resolve_url(spread, "site", "path", "url").select("site", "url", "pos")
