"""Row filters: scope, media blacklist, extension, status, date, depth and provider predicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.fixed_values import BLACKLISTED_EXTENSIONS, CENSYS_PORTS, PASSIVE_PREFIX, SUBDOMAIN_TYPES, URL_TYPES
from webloom.functions.urls import bare_ext, path_of, strip

MEDIA = r"(?i)\.(?:" + "|".join(BLACKLISTED_EXTENSIONS) + r")(?:\?|#|\n?\z)"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- predicates -------------------------------------------------------------------------------------------------------

def in_scope(url: Column, patterns: Sequence[str] = ()) -> Column:
    """Any pattern matches anywhere; no pattern lets everything through."""
    return reduce(lambda a, b: a | b, (url.rlike(p) for p in patterns)) if patterns else F.lit(True)


def is_media(url: Column) -> Column:
    return url.rlike(MEDIA)


def admitted(url: Column, host: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """A crawl may visit the URL: not media, not excluded, and in scope.

    The scope is the seed's host anywhere in the URL, unless an include pattern replaces it.
    """
    allowed = ~is_media(url)
    if exclude:
        allowed = allowed & ~url.rlike(exclude)
    return allowed & (url.rlike(include) if include else url.contains(host))


def _ext_list(exts: str | Iterable[str] | None) -> list[str]:
    items = exts.split(",") if isinstance(exts, str) else list(exts or ())
    return [x.strip().lower() for x in items if x.strip()]


def _ends_with_ext(text: Column, exts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.endswith("." + x) for x in exts))


# -- filters ----------------------------------------------------------------------------------------------------------

def filter_in_scope(urls: DataFrame, patterns: Sequence[str] = (), col: str = "url") -> DataFrame:
    return urls.filter(in_scope(F.col(col), patterns))


def filter_default_scope(urls: DataFrame, host: str | Column, col: str = "url") -> DataFrame:
    return urls.filter(F.col(col).contains(_column(host)))


def filter_include(urls: DataFrame, pattern: str, col: str = "url") -> DataFrame:
    return urls.filter(F.col(col).rlike(pattern))


def filter_exclude(urls: DataFrame, pattern: str, col: str = "url") -> DataFrame:
    return urls.filter(~F.col(col).rlike(pattern))


def filter_media_blacklist(urls: DataFrame, col: str = "url") -> DataFrame:
    return urls.filter(~is_media(F.col(col)))


def filter_should_visit(
    urls: DataFrame, visited: DataFrame, host: str | Column, include: str | None = None, exclude: str | None = None,
    col: str = "url",
) -> DataFrame:
    """URLs that a crawl would take up now: admitted, and not visited before (case matters)."""
    fresh = urls.filter(admitted(F.col(col), _column(host), include, exclude))
    return fresh.join(visited.select(F.col(col)), col, "left_anti")


def filter_link_files(urls: DataFrame, exts: Sequence[str] = ("js",), col: str = "url") -> DataFrame:
    return urls.filter(bare_ext(F.col(col)).isin(list(exts)))


def filter_ext_url(urls: DataFrame, exts: str | Iterable[str] | None, col: str = "url") -> DataFrame:
    """Drop rows whose whole URL ends with a listed extension, any case."""
    listed = _ext_list(exts)
    return urls.filter(~_ends_with_ext(F.lower(F.col(col)), listed)) if listed else urls


def filter_ext_path(urls: DataFrame, exts: str | Iterable[str] | None, col: str = "url") -> DataFrame:
    """Drop rows whose URL path ends with a listed extension, any case."""
    listed = _ext_list(exts)
    return urls.filter(~_ends_with_ext(F.lower(path_of(F.col(col))), listed)) if listed else urls


def filter_status(rows: DataFrame, col: str = "status") -> DataFrame:
    return rows.filter((F.col(col) >= 100) & (F.col(col) < 400))


def filter_date_range(
    rows: DataFrame, since: str | None = None, until: str | None = None, col: str = "timestamp"
) -> DataFrame:
    """Keep 14-digit timestamps inside the range, compared as text; a missing one passes."""
    t = F.col(col)
    inside = F.lit(True)
    if since:
        inside = inside & (t >= since)
    if until:
        inside = inside & (t <= until)
    return rows.filter(t.isNull() | (t == "") | inside) if since or until else rows


def filter_source_status(rows: DataFrame, status: str | None = "200", col: str = "statuscode") -> DataFrame:
    return rows.filter(F.col(col) == (status or "200"))


def filter_depth(rows: DataFrame, max_depth: int, col: str = "depth") -> DataFrame:
    return rows if max_depth == 0 else rows.filter(F.col(col) <= max_depth)


def filter_subdomain_of(rows: DataFrame, domain: str | Column, col: str = "host") -> DataFrame:
    d = _column(domain)
    return rows.filter((F.col(col) == d) | F.col(col).endswith(F.concat(F.lit("."), d)))


def filter_contains_domain(urls: DataFrame, domain: str | Column, col: str = "url") -> DataFrame:
    return urls.filter(F.col(col).contains(_column(domain)))


def http_service(name: Column, port: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).contains("http") | port.isin(CENSYS_PORTS)


def filter_http_service(services: DataFrame, name: str = "service_name", port: str = "port") -> DataFrame:
    return services.filter(http_service(F.col(name), F.col(port)))


def filter_not_self(subs: DataFrame, domain: str | Column, col: str = "sub") -> DataFrame:
    return subs.filter(F.col(col) != _column(domain))


def checkable(kind: Column) -> Column:
    return kind.isin(URL_TYPES + SUBDOMAIN_TYPES) | kind.startswith(PASSIVE_PREFIX)


def filter_checkable(records: DataFrame, col: str = "type") -> DataFrame:
    return records.filter(checkable(F.col(col)))


def filter_providers(rows: DataFrame, providers: Iterable[str] | None, col: str = "provider") -> DataFrame:
    return rows if providers is None else rows.filter(F.lower(F.col(col)).isin([p.lower() for p in providers]))


def filter_blank_url(urls: DataFrame, col: str = "url") -> DataFrame:
    return urls.filter(strip(F.col(col)) != "")
