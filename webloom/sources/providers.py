"""Exports of web archives and scanners.

A payload table has ``domain`` (what was asked for), ``part`` (payload number), ``page_no`` (page of a paged answer)
and ``payload`` (the answer's text). Each reader gives ``domain, provider, url, page_no, part, pos``: canonical URLs,
each once per domain, with the place it was first seen. Schemas are explicit; a payload that does not parse gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.fixed_values import (
    FALLBACK_CRAWL_INDEX, PROVIDERS, URLSCAN_PAGE_SIZE,
)
from webloom.functions.labels import bucket_url, certificate_url, service_url
from webloom.functions.urls import hostname_of, normalize_url
from webloom.operators.dedup import dedup_after_strip, first_wins, first_wins_provider, limit_per_group, union_all
from webloom.operators.filters import filter_blank_url, filter_date_range, filter_ext_url, http_service
from webloom.plans.checkpoints import written

PLACE = ["page_no", "part", "pos"]
_LINK = "STRUCT<url: STRING>"


def load_payloads(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """One payload per line of the text files at ``path``, in file order."""
    lines = spark.read.text(path).withColumn("part", F.monotonically_increasing_id())
    return lines.select(F.lit(domain).alias("domain"), "part", F.lit(0).cast("long").alias("page_no"),
                        F.col("value").alias("payload"))


def _parsed(payloads: DataFrame, schema: str) -> DataFrame:
    return payloads.select("domain", "part", "page_no", F.from_json("payload", schema).alias("j"))


def _place(*parts: Column) -> Column:
    """Place inside a payload as text of equal width per part, so that rows of all providers order alike."""
    return F.concat_ws(".", *[F.lpad(p.cast("string"), 9, "0") for p in parts])


def _raw(urls: DataFrame, provider: str, cap: int | None, *place: Column) -> DataFrame:
    """Rows ``domain, provider, raw, page_no, part, pos``, cut to the provider's cap if one is given."""
    rows = urls.select("domain", F.lit(provider).alias("provider"), "raw", "page_no", "part",
                       _place(*(place or [F.col("pos")])).alias("pos")).filter("raw IS NOT NULL")
    return rows if cap is None else limit_per_group(rows, ["domain"], [*PLACE, "raw"], cap)


def _canonical(rows: DataFrame) -> DataFrame:
    urls = normalize_url(rows, "raw", "url").select("domain", "provider", "url", *PLACE)
    return urls.filter("url != ''")


def ordered_once(rows: DataFrame) -> DataFrame:
    """Canonical URLs, the first of equal ones per provider and domain."""
    return first_wins(_canonical(rows), [F.col("domain"), F.col("provider"), F.col("url")], PLACE)


def _or_empty(c: Column, element: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{element}>"))


def wayback_rows(payloads: DataFrame) -> DataFrame:
    """CDX rows: the header names the columns, the URL is the third cell."""
    cells = payloads.select("domain", "part", "page_no", F.from_json("payload", "ARRAY<ARRAY<STRING>>").alias("t"))
    named = cells.withColumn("head", F.get("t", F.lit(0)))
    rows = named.select(
        "domain", "part", "page_no", "head",
        F.posexplode(F.filter("t", lambda r, i: (i > 0) & (F.size(r) > 2))).alias("pos", "row"),
    )

    def cell(name: str) -> Column:
        at = F.array_position("head", F.lit(name)).cast("int")
        return F.when(at > 0, F.get("row", at - 1))

    return rows.select("domain", *PLACE, F.get("row", F.lit(2)).alias("raw"), cell("timestamp").alias("timestamp"),
                       cell("statuscode").alias("statuscode"))


def wayback_urls(payloads: DataFrame, since: str | None = None, until: str | None = None, status: str | None = "200",
                 cap: int | None = None) -> DataFrame:
    rows = wayback_rows(payloads)
    kept = rows.filter(F.col("statuscode").isNull() | (F.col("statuscode") == (status or "200")))
    return _raw(filter_date_range(kept, since, until), "wayback", cap)


def commoncrawl_rows(payloads: DataFrame) -> DataFrame:
    rows = _parsed(payloads, "url STRING, timestamp STRING")
    return rows.select("domain", "part", "page_no", F.lit(0).alias("pos"), F.col("j.url").alias("raw"),
                       F.col("j.timestamp").alias("timestamp")).filter("raw IS NOT NULL")


def commoncrawl_urls(payloads: DataFrame, since: str | None = None, until: str | None = None,
                     cap: int | None = None) -> DataFrame:
    return _raw(filter_date_range(commoncrawl_rows(payloads), since, until), "commoncrawl", cap)


def pick_crawl_index(indexes: DataFrame, default: str = FALLBACK_CRAWL_INDEX) -> DataFrame:
    """Newest crawl index per list: its first entry, or a fixed one when the list is empty or unreadable."""
    first = F.get(F.from_json("payload", "ARRAY<STRUCT<id: STRING>>"), F.lit(0))["id"]
    kept = [c for c in indexes.columns if c != "payload"]
    return indexes.select(*kept, F.coalesce(first, F.lit(default)).alias("index_id"))


def virustotal_urls(payloads: DataFrame, cap: int | None = None) -> DataFrame:
    j = _parsed(payloads, f"detected_urls ARRAY<{_LINK}>, undetected_urls ARRAY<{_LINK}>")
    both = F.concat(_or_empty(F.col("j.detected_urls"), _LINK), _or_empty(F.col("j.undetected_urls"), _LINK))
    rows = j.select("domain", "part", "page_no", F.posexplode(both).alias("pos", "item"))
    return _raw(rows.withColumn("raw", F.col("item.url")), "virustotal", cap)


def otx_page_stop(payloads: DataFrame, pages: int | None = None) -> DataFrame:
    """Pages that a page-by-page reader would get to: up to the first empty page or the first without a successor, and
    no more than ``pages`` if that is given.

    Payloads are parsed once and written as such; where a domain stops is told from two narrow columns of that table.
    """
    j = _parsed(payloads, f"url_list ARRAY<{_LINK}>, has_next BOOLEAN")
    if pages is not None:
        j = j.filter(F.col("page_no") < pages)
    empty = F.coalesce(F.size("j.url_list"), F.lit(0)) <= 0
    parsed = written(j.withColumn("last", empty | ~F.coalesce("j.has_next", F.lit(False))), "otx")
    stops = parsed.filter("last").groupBy("domain").agg(F.min("page_no").alias("stop"))
    reached = parsed.join(stops, "domain", "left").filter(F.col("stop").isNull() | (F.col("page_no") <= F.col("stop")))
    return reached.drop("stop", "last")


def otx_urls(payloads: DataFrame, cap: int | None = None, pages: int | None = None) -> DataFrame:
    rows = otx_page_stop(payloads, pages).select("domain", "part", "page_no", F.posexplode("j.url_list").alias("pos", "item"))
    return _raw(rows.withColumn("raw", F.col("item.url")), "otx", cap)


def urlscan_urls(payloads: DataFrame, cap: int | None = None, pages: int | None = None) -> DataFrame:
    """Results of page 0 and, when it reports more than a page's worth, of the following pages, as many as that makes;
    no more than ``pages`` if that is given."""
    j = _parsed(payloads, "results ARRAY<STRUCT<page: STRUCT<url: STRING>>>, total BIGINT")
    total = F.min_by(F.coalesce("j.total", F.lit(0)), "part")
    first = j.filter("page_no = 0 AND j.results IS NOT NULL").groupBy("domain").agg(total.alias("total"))
    count = F.when(F.col("total") > URLSCAN_PAGE_SIZE, F.floor(F.col("total") / URLSCAN_PAGE_SIZE) + 1).otherwise(1)
    count = count if pages is None else F.least(F.lit(pages), count)
    reached = j.join(first, "domain", "inner").filter(F.col("page_no") < count)
    rows = reached.select("domain", "part", "page_no", F.posexplode("j.results").alias("pos", "item"))
    return _raw(rows.withColumn("raw", F.col("item.page.url")), "urlscan", cap)


_FILE = ("STRUCT<url: STRING, file_url: STRING, path: STRING, full_path: STRING, link: STRING, bucket: STRING, "
         "bucket_name: STRING, bucket_url: STRING, bucket_link: STRING>")


def _first_filled(item: Column, *fields: str) -> Column:
    return F.coalesce(*[F.nullif(item[f], F.lit("")) for f in fields])


def bucket_urls(payloads: DataFrame, cap: int | None = None) -> DataFrame:
    """Files in open buckets: the file's URL and its bucket's URL, those that mention the domain."""
    listing = F.from_json("payload", f"files ARRAY<{_FILE}>, results ARRAY<{_FILE}>, data ARRAY<{_FILE}>, "
                                     f"items ARRAY<{_FILE}>")
    top_level = F.ltrim(F.col("payload")).startswith("[")
    files = F.when(top_level, F.from_json("payload", f"ARRAY<{_FILE}>")).otherwise(
        F.coalesce(listing["files"], listing["results"], listing["data"], listing["items"])
    )
    items = payloads.select("domain", "part", "page_no", F.posexplode(files).alias("at", "f"))
    if cap is not None:
        items = limit_per_group(items, ["domain"], ["page_no", "part", "at"], cap)
    f = F.col("f")
    path = _first_filled(f, "url", "file_url", "path", "full_path", "link")
    found = F.array(
        bucket_url(path, _first_filled(f, "bucket", "bucket_name")), _first_filled(f, "bucket_url", "bucket_link")
    )
    rows = items.select("domain", "part", "page_no", "at", F.posexplode(found).alias("k", "raw"))
    named = rows.filter(F.col("raw").contains(F.col("domain")))
    return _raw(named, "grayhatwarfare", None, F.col("at") * 2 + F.col("k"))


def _under(host: Column, no_subs: bool) -> Column:
    d = F.col("domain")
    return (host == d) | host.endswith(F.concat(F.lit("."), d)) if no_subs else F.lit(True)


def shodan_urls(payloads: DataFrame, no_subs: bool = False, cap: int | None = None) -> DataFrame:
    """Two URLs per host name, with and without the port; the address when there is no name."""
    j = _parsed(payloads, "matches ARRAY<STRUCT<hostnames: ARRAY<STRING>, ip_str: STRING, port: INT>>")
    matches = j.select("domain", "part", "page_no", F.posexplode("j.matches").alias("m", "s"))
    port = F.coalesce(F.col("s.port"), F.lit(80))
    names = _or_empty(F.col("s.hostnames"), "string")
    with_port = lambda h: service_url(h, port, [], [443])
    without = lambda h: F.concat(F.when(port == 443, "https://").otherwise("http://"), h)
    by_name = F.flatten(F.transform(F.filter(names, lambda h: _under(h, no_subs)),
                                    lambda h: F.array(with_port(h), without(h))))
    address = F.nullif(F.col("s.ip_str"), F.lit(""))
    found = F.when(F.size(names) > 0, by_name).otherwise(F.array(with_port(address)))
    rows = matches.select("domain", "part", "page_no", "m", F.posexplode(found).alias("k", "raw"))
    return _raw(rows, "shodan", cap, F.col("m"), F.col("k"))


_CERTIFICATE = ("STRUCT<certificates: STRUCT<leaf_data: STRUCT<subject: STRUCT<common_name: ARRAY<STRING>>>>>")


def censys_urls(payloads: DataFrame, no_subs: bool = False, cap: int | None = None) -> DataFrame:
    """Web services: one URL per certificate name and one for the address."""
    j = _parsed(payloads, "result STRUCT<hits: ARRAY<STRUCT<ip: STRING, services: ARRAY<STRUCT<port: INT, "
                          f"service_name: STRING, tls: {_CERTIFICATE}>>>>>")
    hits = j.select("domain", "part", "page_no", F.posexplode("j.result.hits").alias("h", "hit"))
    if cap is not None:
        hits = limit_per_group(hits, ["domain"], ["page_no", "part", "h"], cap)
    services = hits.select("domain", "part", "page_no", "h", F.col("hit.ip").alias("ip"),
                           F.posexplode("hit.services").alias("s", "svc"))
    port = F.coalesce(F.col("svc.port"), F.lit(443))
    web = services.filter(http_service(F.col("svc.service_name"), port))
    names = _or_empty(F.col("svc.tls.certificates.leaf_data.subject.common_name"), "string")
    hosts = F.concat(F.filter(names, lambda n: _under(n, no_subs)), F.array(F.nullif(F.col("ip"), F.lit(""))))
    rows = web.select("domain", "part", "page_no", "h", "s",
                      F.posexplode(F.transform(hosts, lambda n: certificate_url(n, port))).alias("k", "raw"))
    return _raw(rows, "censys", None, F.col("h"), F.col("s"), F.col("k"))


URL_ROWS: dict[str, Callable[..., DataFrame]] = {
    "wayback": wayback_urls, "commoncrawl": commoncrawl_urls, "otx": otx_urls, "urlscan": urlscan_urls,
    "virustotal": virustotal_urls, "grayhatwarfare": bucket_urls, "shodan": shodan_urls, "censys": censys_urls,
}


def _reader(provider: str) -> Callable[..., DataFrame]:
    def read(payloads: DataFrame, **options) -> DataFrame:
        return ordered_once(URL_ROWS[provider](payloads, **options))

    read.__doc__ = f"URLs of the {provider} export; options as for its row function above."
    return read


read_wayback = _reader("wayback")
read_commoncrawl = _reader("commoncrawl")
read_otx = _reader("otx")
read_urlscan = _reader("urlscan")
read_virustotal = _reader("virustotal")
read_buckets = _reader("grayhatwarfare")
read_shodan = _reader("shodan")
read_censys = _reader("censys")
READERS = {
    "wayback": read_wayback, "commoncrawl": read_commoncrawl, "otx": read_otx, "urlscan": read_urlscan,
    "virustotal": read_virustotal, "grayhatwarfare": read_buckets, "shodan": read_shodan, "censys": read_censys,
}


def provider_rows(
    payloads: dict[str, DataFrame], providers: Iterable[str] | None = None, since: str | None = None,
    until: str | None = None, caps: dict[str, int] | None = None, pages: dict[str, int] | None = None,
    no_subs: bool = False,
) -> DataFrame:
    """Raw URL rows of the wanted providers in one table; names are not case-sensitive, unknown ones are ignored.

    ``caps`` and ``pages`` cut the exports of the providers they name to rows and pages. With ``no_subs``, scanners leave
    out names that do not belong to the domain.
    """
    wanted = PROVIDERS if providers is None else [p.lower() for p in providers]
    frames = []
    for p in PROVIDERS:
        if p in wanted and p in payloads:
            options = {"since": since, "until": until} if p in ("wayback", "commoncrawl") else {}
            if p in ("otx", "urlscan"):
                options["pages"] = (pages or {}).get(p)
            if p in ("shodan", "censys"):
                options["no_subs"] = no_subs
            frames.append(URL_ROWS[p](payloads[p], cap=(caps or {}).get(p), **options))
    return union_all(*frames)


def union_providers(payloads: dict[str, DataFrame], providers: Iterable[str] | None = None, **options) -> DataFrame:
    """URLs of the wanted providers in one table, each once per provider and domain.

    The raw rows are united before they are made canonical, so all providers share one shuffle.
    """
    return ordered_once(provider_rows(payloads, providers, **options))


def passive_discoveries(
    payloads: dict[str, DataFrame], providers: Iterable[str] | None = None, since: str | None = None,
    until: str | None = None, blacklist_ext: str | Iterable[str] | None = None, filter_params: bool = False,
    caps: dict[str, int] | None = None, pages: dict[str, int] | None = None, no_subs: bool = False,
) -> DataFrame:
    """All providers' URLs: first provider wins, extension blacklist, optional query strip and second de-dup.

    Exports are read whole. ``caps`` cuts them to a number of rows per provider and domain, as the providers' own
    answers are, and ``pages`` to a number of pages. With ``no_subs``, only URLs on the domain itself stay, whichever
    provider lists them.
    """
    # the first of all providers is also the first of its own, so one de-duplication does for both
    urls = _canonical(provider_rows(payloads, providers, since, until, caps, pages, no_subs))
    if no_subs:
        urls = urls.filter(hostname_of(F.col("url")) == F.col("domain"))
    urls = filter_ext_url(first_wins_provider(urls), blacklist_ext)
    return filter_blank_url(dedup_after_strip(urls) if filter_params else urls)
