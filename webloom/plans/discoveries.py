"""Records of captured pages, in one pass over each page body.

Stage one, :func:`page_finds`, is narrow and knows no site: it turns a body into small rows. Stage two,
:func:`find_records`, makes the records of a crawled site from such rows, so that bodies are never joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import unescape_html
from webloom.functions.urls import bare_ext, hostname_of, pin, registered_domain, resolve_url
from webloom.operators.extract import (
    attribute_text, bucket_array, is_form, is_upload, link_file_exts, name_runs, open_tags, script_link_array, script_link_is_file,
    script_link_type, site_of, subdomain_array, tag_is,
)

# Order of a page's records
PAGE, SUBDOMAIN, BUCKET, SCRIPT_LINK, LINK, FORM, UPLOAD, SCRIPT = range(8)
PASSIVE, SITEMAP, ROBOTS = 8, 9, 10
# A dotted name as it stands in a page; a subdomain once a domain is known
NAME = 11

RECORD_COLUMNS = ["input", "source", "type", "url", "status", "length", "from", "seen_set", "level", "step", "origin",
                  "pos"]
FIND_COLUMNS = ["url", "step", "at", "text", "raw", "own"]


def with_site(pages: DataFrame) -> DataFrame:
    """Give pages that belong to no crawl the site of their own host."""
    return pages.withColumns({
        "input": site_of(F.col("url")),
        "host": hostname_of(F.col("url")),
        "domain": registered_domain(F.col("url")),
    })


def _items(step: int, texts: Column) -> Column:
    return F.transform(texts, lambda t, i: F.struct(F.lit(step).alias("step"), i.alias("at"), t.alias("text")))


def _once(step: int, condition: Column) -> Column:
    none = F.array().cast("array<struct<step:int,at:int,text:string>>")
    return F.when(condition, F.array(F.struct(F.lit(step).alias("step"), F.lit(0).alias("at"), F.lit("").alias("text")))
                  ).otherwise(none)


def page_finds(
    pages: DataFrame, exts: Sequence[str] = ("js",), html: str = "html", parse: Column | None = None,
    in_scope: Column | None = None, names: bool = False,
) -> DataFrame:
    """One row per thing found in a page; the body is dropped here.

    ``pages`` has ``url``, ``domain`` (whose subdomains are looked for), the body and any columns to keep. A row has the
    ``step`` (what it is), its place ``at``, its ``text``, and for links the link text ``raw`` and the URL ``own`` that
    it has on the page's own address. ``parse`` says which pages are read as HTML, ``in_scope`` which are searched for
    subdomains and buckets. With ``names`` no domain is asked for: every dotted name of a page is a ``NAME`` row, from
    which :func:`names_below` makes the subdomains of any domain.
    """
    none = F.array().cast("array<string>")
    body, kept = F.col(html), [c for c in pages.columns if c != html]
    link_file = bare_ext(F.col("url")).isin(link_file_exts(exts))

    def where(condition: Column | None, texts: Column) -> Column:
        return texts if condition is None else F.when(condition, texts).otherwise(none)

    texts = pages.select(
        *kept,
        where(in_scope, name_runs(body) if names else subdomain_array(body, F.col("domain"))).alias("_subs"),
        where(in_scope, bucket_array(body)).alias("_buckets"),
        where(link_file, script_link_array(body)).alias("_links"),
        where(parse, open_tags(body)).alias("_tags"),
    )
    texts = pin(texts, "_subs", "_buckets", "_links", "_tags")
    tags = F.transform(F.col("_tags"), lambda t, i: F.struct(
        F.when(tag_is(t, "a"), LINK).when(tag_is(t, "script", "link"), SCRIPT).otherwise(-1).alias("step"),
        i.alias("at"), t.alias("text")))
    found = F.concat(
        _once(PAGE, F.lit(True)),
        _items(NAME if names else SUBDOMAIN, F.col("_subs")),
        _items(BUCKET, F.col("_buckets")),
        _items(SCRIPT_LINK, F.col("_links")),
        F.filter(tags, lambda t: t["step"] >= 0),
        _once(FORM, F.exists("_tags", is_form)),
        _once(UPLOAD, F.exists("_tags", is_upload)),
    )
    step, text = F.col("step"), F.col("text")
    value = F.when(step == LINK, attribute_text(text, "href")).when(step == SCRIPT, attribute_text(text, "src"))
    finds = texts.select(*kept, F.inline(found)).withColumn("_value", value)
    raw = F.when(step == SCRIPT_LINK, text).otherwise(unescape_html(F.col("_value")))
    plain = F.when(step.isin(SUBDOMAIN, NAME, BUCKET), text)
    finds = pin(finds.select(*kept, "step", "at", plain.alias("text"), raw.alias("raw")), "raw")
    resolved = resolve_url(finds.filter((F.col("raw") != "") | F.col("raw").isNull()), "url", "raw", "own")
    wanted = (step != SCRIPT) | bare_ext(F.col("own")).isin(link_file_exts(exts))
    return resolved.filter((F.col("raw").isNull() | (F.col("own") != "")) & wanted)


def names_below(finds: DataFrame, domain: Column) -> DataFrame:
    """Rows of :func:`page_finds` with ``names``, where each ``NAME`` row gives way to the subdomains of ``domain`` that it
    holds. A page that writes a name in two ways, as part of different runs, gives it for each."""
    named = F.col("step") == NAME
    texts = F.when(named, subdomain_array(F.col("text"), domain)).otherwise(F.array("text"))
    rows = finds.withColumns({"text": F.explode(texts)})
    return rows.withColumn("step", F.when(named, SUBDOMAIN).otherwise(F.col("step")))


def find_records(
    finds: DataFrame, exts: Sequence[str] = ("js",), bare_subdomains: bool = False, with_from: bool = False
) -> DataFrame:
    """Records of :func:`page_finds` rows that belong to a site.

    Needs ``input, source, level, status, length`` next to the columns of the finds; other columns are kept.
    """
    exts = link_file_exts(exts)
    step, text, own, alt, page = (F.col(n) for n in ("step", "text", "own", "_alt", "url"))
    extra = [c for c in finds.columns if c not in FIND_COLUMNS + RECORD_COLUMNS + ["host", "domain", "link_file"]]
    on_site = finds.withColumn("_site", F.when(step == SCRIPT_LINK, F.col("input")))
    both = resolve_url(on_site, "_site", "raw", "_alt")

    nothing = F.lit(None).cast("string")
    bare = F.lit(bare_subdomains)
    own_kind = script_link_type(own, F.lit(False), exts)
    own_file = (step == SCRIPT) | ((step == SCRIPT_LINK) & bare_ext(own).isin(exts))
    first = F.struct(
        F.when(step == PAGE, "url").when(step == SUBDOMAIN, F.when(bare, "subdomain").otherwise("subdomains"))
        .when(step == BUCKET, "aws-s3").when(step == SCRIPT_LINK, own_kind).when(step == LINK, "href")
        .when(step == FORM, "form").when(step == UPLOAD, "upload-form").otherwise("javascript").alias("type"),
        F.when(step.isin(PAGE, SUBDOMAIN), F.col("source"))
        .when(step == SCRIPT_LINK, F.when(own_kind == "javascript", "javascript").otherwise(page))
        .otherwise("body").alias("source"),
        F.when(step.isin(PAGE, FORM, UPLOAD), page)
        .when(step == SUBDOMAIN, F.when(bare, text).otherwise(F.concat(F.lit("http://"), text)))
        .when(step == BUCKET, text).otherwise(own).alias("url"),
        F.when(step == PAGE, "page").when(step == SUBDOMAIN, "sub").when(step == BUCKET, "aws")
        .when(step.isin(FORM, UPLOAD), "form").when(own_file, "js").otherwise("url").alias("seen_set"),
        own_file.alias("link_file"),
        F.lit(0).alias("half"),
    )
    alt_file = script_link_is_file(alt, F.lit(True), exts)
    second = F.struct(
        F.when(step == SUBDOMAIN, "subdomains").otherwise("linkfinder").alias("type"),
        F.when(step == SUBDOMAIN, F.col("source")).otherwise(page).alias("source"),
        F.when((step == SUBDOMAIN) & ~bare, F.concat(F.lit("https://"), text))
        .when((step == SCRIPT_LINK) & (alt != own), alt).otherwise(nothing).alias("url"),
        F.when(step == SUBDOMAIN, "sub").when(alt_file, "js").otherwise("url").alias("seen_set"),
        F.coalesce(alt_file & (step == SCRIPT_LINK), F.lit(False)).alias("link_file"),
        F.lit(1).alias("half"),
    )
    rows = both.select(*extra, "input", "level", "step", "at", page.alias("origin"), F.col("status").alias("_status"),
                       F.col("length").alias("_length"), F.inline(F.array(first, second))).filter("url != ''")
    on_page = F.col("step") == PAGE
    return rows.select(
        *extra, "input", "source", "type", "url",
        F.when(on_page, F.col("_status")).cast("int").alias("status"),
        F.when(on_page, F.col("_length")).alias("length"),
        (F.when(~on_page, F.col("origin")) if with_from else nothing).alias("from"),
        "seen_set", "level", "step", "origin", (F.col("at") * 2 + F.col("half")).alias("pos"), "link_file",
    )


def page_discoveries(
    pages: DataFrame, exts: Sequence[str] = ("js",), html: str = "html", bare_subdomains: bool = False,
    parse_html: Column | None = None, in_scope: Column | None = None, with_from: bool = False,
) -> DataFrame:
    """All records of captured pages: the page, subdomains, buckets, script links, links, forms, script files.

    ``pages`` has ``url``, the body, ``status`` and ``source``; ``input``, ``host``, ``domain`` and ``level`` are
    taken from the page's own host and 0 when missing. Files with a listed extension give script links; other pages
    are read as HTML. Other columns are kept.
    """
    if "input" not in pages.columns:
        pages = with_site(pages)
    if "level" not in pages.columns:
        pages = pages.withColumn("level", F.lit(0))
    parse = ~bare_ext(F.col("url")).isin(link_file_exts(exts)) if parse_html is None else parse_html
    scope = F.col("url").contains(F.col("host")) if in_scope is None else in_scope
    status = F.coalesce("status", F.lit(200))
    usable = pages.withColumn("status", status).filter((F.col("status") >= 100) & (F.col("status") < 400))
    sized = usable.withColumn("length", F.length(html).cast("long"))
    return find_records(page_finds(sized, exts, html, parse, scope), exts, bare_subdomains, with_from)


def root_records(urls: DataFrame, kind: Column, source: Column, step: int) -> DataFrame:
    """Records for URLs that come from a list (sitemap, robots file, archive) and not from a page."""
    return urls.select(
        "input", source.alias("source"), kind.alias("type"), "url", F.lit(None).cast("int").alias("status"),
        F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("from"),
        F.lit("page").alias("seen_set"), F.lit(0).alias("level"), F.lit(step).alias("step"),
        F.lit("").alias("origin"), F.lit(0).alias("pos"),
    )


def union_discoveries(*records: DataFrame) -> DataFrame:
    """Crawl, sitemap, robots and passive records as one stream of equal columns."""
    head, *rest = [r.select(*RECORD_COLUMNS) for r in records]
    for r in rest:
        head = head.unionByName(r)
    return head
