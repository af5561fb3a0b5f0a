"""Generators: from captured text to links, script files, forms, subdomains, bucket names and script links.

All are narrow. A page is scanned once per kind of text pattern; what comes out is exploded to one row per find, and
the page body is dropped at that point, so nothing wide crosses a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.fixed_values import BUCKET_FORMS
from webloom.functions.text import (
    clean_subdomain, collapse_newlines, decode_chars, regex_quote, unescape_html,
)
from webloom.functions.urls import bare_ext, ensure_scheme, pin, resolve_url, url_ext

# Open tags of interest, as group 1. Comments, and script and style elements with their bodies, are matched whole so that
# markup inside them is passed over; group 1 is then the script's own open tag, or empty. One that is never closed ends
# with the text, so that a page is scanned once whatever it holds. A quote opens a value only right after ``=``.
_REST = r"""(?:[\s/](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)?+(?:>|\z)"""
_TAG = rf"<(?:a|form|input|script|link){_REST}"
OPEN_TAG = rf"(?is)(?=({_TAG})|<)(?:<!--.*?(?:-->|\z)|<(script|style){_REST}.*?(?:</\2\s*+>|\z)|{_TAG})"

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""


def _other_attributes(name: str) -> str:
    return rf"""(?:[\s/]*+(?!{name}[\s=/>])[^\s>/=]++(?:\s*+=\s*+{_VALUE})?+)*+[\s/]*+"""


def attribute_text(tag: Column, name: str) -> Column:
    """Text of an attribute without its quotes; empty when missing. The last of several wins."""
    pattern = rf"(?is)^<[a-z]++(?=[\s/])(?:{_other_attributes(name)}{name}\s*+=\s*+({_VALUE}))++"
    quoted = F.regexp_extract(tag, pattern, 1)
    closed = quoted.rlike(r"""(?s)^(?:"[^"]*+"|'[^']*+')$""")
    return F.when(closed, F.substr(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, character references decoded."""
    return unescape_html(attribute_text(tag, name))


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?is)^<[a-z]++(?=[\s/]){_other_attributes(name)}{name}(?=[\s=/>])")


def tag_is(tag: Column, *names: str) -> Column:
    return tag.rlike(r"(?i)^<(?:" + "|".join(names) + r")[\s/>]")


def open_tags(html: Column) -> Column:
    """Open tags of a page in order, found in one scan."""
    return F.filter(F.regexp_extract_all(html, F.lit(OPEN_TAG), F.lit(1)), lambda t: t.endswith(">"))


def is_form(tag: Column) -> Column:
    return tag_is(tag, "form") & has_attribute(tag, "action")


def is_upload(tag: Column) -> Column:
    return tag_is(tag, "input") & (attribute_text(tag, "type") == "file")


def _exploded_tags(pages: DataFrame, html: str) -> DataFrame:
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.posexplode(open_tags(F.col(html))).alias("pos", "tag"))


def _resolved(tags: DataFrame, name: str, base: str) -> DataFrame:
    """Resolve one attribute of each tag on ``base``; tags without it, or with a broken link, go."""
    found = pin(tags.withColumn("raw", attribute(F.col("tag"), name)).drop("tag"), "raw").filter("raw != ''")
    return resolve_url(found, base, "raw", "target").filter("target != ''")


def _as_records(found: DataFrame, kind: str, base: str) -> DataFrame:
    kept = [c for c in found.columns if c not in ("raw", "target", "pos", base)]
    return found.select(*kept, F.col(base).alias("origin"), F.lit(kind).alias("type"), F.col("target").alias("url"),
                        F.col("pos"))


def extract_links(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """``href`` records: every anchor with a non-empty href, absolute."""
    tags = _exploded_tags(pages, html).filter(tag_is(F.col("tag"), "a"))
    return _as_records(_resolved(tags, "href", base), "href", base)


def extract_scripts(
    pages: DataFrame, exts: Sequence[str] = ("js",), html: str = "html", base: str = "url"
) -> DataFrame:
    """``javascript`` records: ``src`` of script and link elements whose file extension is listed."""
    tags = _exploded_tags(pages, html).filter(tag_is(F.col("tag"), "script", "link"))
    found = _resolved(tags, "src", base).filter(bare_ext(F.col("target")).isin(link_file_exts(exts)))
    return _as_records(found, "javascript", base)


def _page_records(pages: DataFrame, test, kind: str, html: str, base: str) -> DataFrame:
    kept = [c for c in pages.columns if c not in (html, base)]
    hits = pages.filter(F.exists(open_tags(F.col(html)), test))
    return hits.select(*kept, F.col(base).alias("origin"), F.lit(kind).alias("type"), F.col(base).alias("url"),
                       F.lit(0).alias("pos"))


def extract_forms(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """One ``form`` record, with the page's own URL, for a page that has a form with an action."""
    return _page_records(pages, is_form, "form", html, base)


def extract_upload_forms(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """One ``upload-form`` record for a page that has a file input."""
    return _page_records(pages, is_upload, "upload-form", html, base)


def link_file_exts(exts: Sequence[str] | str | None) -> list[str]:
    """Extension list as given by a user: a comma text or a sequence; blanks, case and dots do not matter."""
    if exts is None:
        return ["js"]
    items = exts.split(",") if isinstance(exts, str) else exts
    return [x.strip().lower().lstrip(".") for x in items if x.strip()]


# A DNS label read backwards, after the dot that follows it: no hyphen at either end, 63 characters at most.
_LABEL_BACKWARDS = r"\.[a-zA-Z0-9](?:[_a-zA-Z0-9-]{0,61}[_a-zA-Z0-9])?+"


def subdomain_array(text: Column, domain: Column) -> Column:
    """Cleaned host names below ``domain`` in a text, in order, each once.

    A name is the longest chain of labels in front of the last domain of the chain. Searched forwards, nearly every
    word of a text starts a vain attempt. Searched backwards, an attempt starts with the domain itself and the chain
    simply grows to the left as far as labels reach, so the text is read backwards and the finds are turned round.
    """
    pattern = F.concat(F.lit("(?i:"), regex_quote(F.reverse(domain)), F.lit(f")(?:{_LABEL_BACKWARDS})++"))
    found = F.reverse(F.regexp_extract_all(F.reverse(text), pattern, F.lit(0)))
    names = F.transform(found, lambda s: clean_subdomain(F.reverse(s)))
    hits = F.array_distinct(F.filter(names, lambda s: (s != "") & (s != domain)))
    mentioned = (domain != "") & F.lower(text).contains(F.lower(domain))
    return F.when(mentioned, hits).otherwise(F.array().cast("array<string>"))


# What host names are written with: letters, digits, hyphen, underscore, dot, and anything beyond ASCII.
_NAME = r"[^\x00-,/:-@\[-^`{-\x7f]"
_NO_DOT = r"[^\x00-,./:-@\[-^`{-\x7f]"
#: A whole run of such characters with a dot behind a first label; it can only start where a run starts.
NAME_RUN = rf"(?<!{_NAME})\.*+{_NO_DOT}++\.{_NAME}*+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def name_runs(text: Column) -> Column:
    """Dotted names in a text as they stand, in small letters, in order, each once.

    They are what :func:`subdomain_array` needs to know of a text, whatever the domain: a name below a domain lies within
    one run. So a body is read once, before any domain is known, and each run is searched when one is.
    """
    found = F.regexp_extract_all(text, F.lit(NAME_RUN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda s: F.translate(s, _UPPER, _LOWER)))


def extract_subdomains(texts: DataFrame, text: str, domain: Column) -> DataFrame:
    """Rows ``(…, sub, pos)`` in place of the text column."""
    kept = [c for c in texts.columns if c != text]
    return texts.select(*kept, F.posexplode(subdomain_array(F.col(text), domain)).alias("pos", "sub"))


def emit_subdomains(subs: DataFrame, bare: bool = False) -> DataFrame:
    """Records for host names: the http and the https URL, or the bare name."""
    kept = [c for c in subs.columns if c not in ("sub", "pos")]
    if bare:
        return subs.select(*kept, F.lit("subdomain").alias("type"), F.col("sub").alias("url"), F.col("pos"))
    pair = F.array(
        F.struct(F.concat(F.lit("http://"), "sub").alias("url"), (F.col("pos") * 2).alias("pos")),
        F.struct(F.concat(F.lit("https://"), "sub").alias("url"), (F.col("pos") * 2 + 1).alias("pos")),
    )
    return subs.select(*kept, F.lit("subdomains").alias("type"), F.inline(pair))


def bucket_array(text: Column) -> Column:
    """Bucket names in a text, decoded, in order, each once.

    A host-form name can only start where a run of name characters starts or where the previous match ended, so the
    search is anchored there and stays linear on long runs.
    """
    start = r"(?:\G|(?<![a-z0-9.-]))"
    hosted = "|".join(BUCKET_FORMS[:3])
    pathed = "|".join(BUCKET_FORMS[3:])
    low = F.lower(text)
    mentioned = low.contains("s3.amazonaws.com") | low.contains("s3-")
    found = F.regexp_extract_all(text, F.lit(rf"(?i){start}(?:{hosted})|{pathed}"), F.lit(0))
    return F.when(mentioned, F.array_distinct(F.transform(found, decode_chars))).otherwise(
        F.array().cast("array<string>")
    )


def extract_s3(texts: DataFrame, text: str) -> DataFrame:
    kept = [c for c in texts.columns if c != text]
    return texts.select(*kept, F.posexplode(bucket_array(F.col(text))).alias("pos", "bucket"))


# Script links, in two steps. A scan from quote to quote cuts the strings of a script, each read once; a string is then
# looked at as a whole. No form below gives back a character that it has taken, so both steps are linear.
_PATH, _PART = r"[a-zA-Z0-9_\-/]", r"[a-zA-Z0-9_\-]"
_TAIL = r"(?:[?|#][^\"|']*+)?+"
_LINK_FORMS = [
    # a URL whose authority has a dot and two letters behind its first character
    r"(?:[a-zA-Z]{1,10}+:)?+//[^\"'/][^\"'/.]*+(?:\.(?![a-zA-Z]{2})[^\"'/.]*+)*+\.[a-zA-Z]{2}[^\"']*+",
    # a path from the root, from here or from the folder above
    r"(?:/|\.\./|\./)[^\"'><,;| *()%$^/\\\[\]][^\"'><,;|()]++",
    # folder/file.ext: the first slash behind the first character leaves most for the file
    rf"{_PATH}{_PART}*+/{_PATH}++\.(?:[a-zA-Z]{{1,4}}+|action){_TAIL}",
    # folder/name
    rf"{_PATH}{_PART}*+/{_PATH}{{3,}}+{_TAIL}",
    # file.ext
    rf"{_PART}++\.(?:php|aspx?+|jsp|json|action|html|js|txt|xml){_TAIL}",
]
STRING_LINK = "[\"'](" + "|".join(f"(?:{form})(?=[\"'])" for form in _LINK_FORMS) + ")[\"']"


def script_link_array(text: Column) -> Column:
    """Quoted links in a script text, line breaks collapsed, in order, each once.

    A string that is a link ends at its closing quote; one that is none leaves that quote to open the next.
    """
    found = F.regexp_extract_all(decode_chars(text), F.lit(STRING_LINK), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, collapse_newlines), lambda s: s != ""))


def extract_js_links(assets: DataFrame, text: str = "body") -> DataFrame:
    kept = [c for c in assets.columns if c != text]
    return assets.select(*kept, F.posexplode(script_link_array(F.col(text))).alias("pos", "link"))


def resolve_on_both(links: DataFrame, link: str = "link", base: str = "url", site: str = "site") -> DataFrame:
    """Make each script link absolute on the script's URL and, where that differs, on the site root too.

    Adds ``target`` and ``on_site``. Both results come from one row by ``explode``; no join is involved.
    """
    kept = links.columns
    both = resolve_url(resolve_url(links, base, link, "_own"), site, link, "_alt")
    options = F.array(
        F.struct(F.col("_own").alias("target"), F.lit(False).alias("on_site")),
        F.struct(F.when(F.col("_own") != "", F.col("_alt")).alias("target"), F.lit(True).alias("on_site")),
    )
    wanted = F.filter(options, lambda o: (o["target"] != "") & (~o["on_site"] | (o["target"] != F.col("_own"))))
    return both.select(*kept, F.inline(wanted))


SITE_SCRIPT_EXTS = [".js", ".xml", ".json", ".map"]


def script_link_type(target: Column, on_site: Column, exts: Sequence[str]) -> Column:
    own_file = ~on_site & bare_ext(target).isin(list(exts))
    return F.when(own_file, "javascript").otherwise("linkfinder")


def script_link_is_file(target: Column, on_site: Column, exts: Sequence[str]) -> Column:
    """Whether a script link goes on as a link file (its links are read) rather than as a page."""
    return F.when(on_site, url_ext(target).isin(SITE_SCRIPT_EXTS)).otherwise(bare_ext(target).isin(list(exts)))


def js_link_records(
    assets: DataFrame, exts: Sequence[str] = ("js",), text: str = "body", base: str = "url", site: str = "site"
) -> DataFrame:
    """Records for the links of script files: listed files as ``javascript``, everything else as ``linkfinder``."""
    exts = link_file_exts(exts)
    found = resolve_on_both(extract_js_links(assets, text), "link", base, site)
    kind = script_link_type(F.col("target"), F.col("on_site"), exts)
    kept = [c for c in assets.columns if c not in (text, base, site, "source")]
    return found.select(
        *kept,
        F.col(base).alias("origin"),
        kind.alias("type"),
        F.when(kind == "javascript", "javascript").otherwise(F.col(base)).alias("source"),
        F.col("target").alias("url"),
        (F.col("pos") * 2 + F.col("on_site").cast("int")).alias("pos"),
        script_link_is_file(F.col("target"), F.col("on_site"), exts).alias("link_file"),
    )


def unminified_js(records: DataFrame, url: str = "url") -> DataFrame:
    """Sibling candidates of minified script files: ``.min.js`` replaced by ``.js``."""
    hits = records.filter(F.col(url).contains(".min.js"))
    return hits.withColumn("sibling", F.replace(F.col(url), F.lit(".min.js"), F.lit(".js")))


def site_of(url: Column) -> Column:
    """Seed site of a page when none is given: its own host, as a site list would name it."""
    return ensure_scheme(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
