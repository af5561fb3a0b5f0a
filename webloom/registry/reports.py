"""Registered queries over records and provider exports: de-duplication, counters, formats, joins, archives."""

from __future__ import annotations

from webloom.fixed_values import PROVIDERS
from webloom.functions import labels as L
from webloom.functions import urls as U
from webloom.operators import dedup as D
from webloom.operators import filters as P
from webloom.operators import joins as J
from webloom.operators import report as R
from webloom.operators.extract import extract_js_links, resolve_on_both
from webloom.plans.checkpoints import fresh_path
from webloom.plans.discoveries import page_discoveries, root_records, union_discoveries
from webloom.registry.common import (
    F, RECORD, S, X, over_links, over_records, page_links, rich_captures, rich_records,
)
from webloom.sources import captures as C
from webloom.sources import providers as V

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# -- provider exports -------------------------------------------------------------------------------------------------

# Named tables with the raw URLs of each provider and their place: domain, page_no, part, pos (text of equal width)
RAW = {
    "wayback": """select domain, page_no, part, lpad(cast(i - 2 as varchar), 9, '0') as pos, j[i][3] as raw,
        j[i][2] as ts, j[i][4] as st
      from (select *, cast(from_json(payload, '[["VARCHAR"]]') as varchar[][]) as j from wayback),
        (select unnest(range(2, 5)) as i) where len(j[i]) > 2 and j[i][4] = '200'""",
    "commoncrawl": """select domain, page_no, part, '000000000' as pos, payload ->> 'url' as raw,
        payload ->> 'timestamp' as ts
      from (select * from commoncrawl where json_valid(payload)) where payload ->> 'url' is not null""",
    "virustotal": """select domain, page_no, part, lpad(cast(k as varchar), 9, '0') as pos, payload ->> p as raw
      from virustotal, (values ('$.detected_urls[0].url', 0), ('$.undetected_urls[0].url', 2)) v(p, k)
      where payload ->> p is not null""",
    "otx": """select domain, page_no, part, lpad(cast(k as varchar), 9, '0') as pos, payload ->> p as raw
      from otx o, (values ('$.url_list[0].url', 0), ('$.url_list[1].url', 1)) v(p, k)
      where payload ->> p is not null and not exists (select 1 from otx b where b.domain = o.domain
        and b.page_no < o.page_no
        and (b.payload ->> '$.has_next' = 'false' or json_array_length(b.payload, '$.url_list') = 0))""",
    "urlscan": """select u.domain, page_no, part, '000000000' as pos, payload ->> '$.results[0].page.url' as raw
      from urlscan u join (select domain, arg_min(cast(payload ->> '$.total' as bigint), part) as total from urlscan
        where page_no = 0 group by 1) t on t.domain = u.domain
      where page_no < case when total > 100 then total // 100 + 1 else 1 end""",
    "grayhatwarfare": """select domain, page_no, part, lpad(cast(k as varchar), 9, '0') as pos, raw from (
        select *, case when k % 2 = 1 then coalesce(f ->> 'bucket_url', f ->> 'bucket_link') else case
            when starts_with(pth, 'http') or bkt is null then pth
            when contains(lower(bkt), 's3') or contains(lower(bkt), 'amazonaws') then 'https://' || bkt || '/' || ltrim(pth, '/')
            else 'https://' || bkt || '.s3.amazonaws.com/' || ltrim(pth, '/') end end as raw
        from (select *, coalesce(nullif(f ->> 'url', ''), nullif(f ->> 'file_url', ''), nullif(f ->> 'path', ''),
            nullif(f ->> 'full_path', ''), nullif(f ->> 'link', '')) as pth,
            coalesce(nullif(f ->> 'bucket', ''), nullif(f ->> 'bucket_name', '')) as bkt
          from (select *, json_extract(coalesce(json_extract(payload, '$.files'), json_extract(payload, '$.results'),
              json_extract(payload, '$.data'), json_extract(payload, '$.items'), cast(payload as json)),
              '$[' || (k // 2) || ']') as f
            from grayhatwarfare, (select unnest(range(0, 4)) as k)) where f is not null))
      where contains(raw, domain)""",
    "shodan": """select domain, page_no, part, pos, raw from (
        select *, lpad(cast(m as varchar), 9, '0') || '.' || lpad(cast(k as varchar), 9, '0') as pos,
          coalesce(cast(json_extract(s, '$.port') as int), 80) as port, json_array_length(s, '$.hostnames') as nh,
          case when port = 443 then 'https://' else 'http://' end as sch,
          case when nh > 0 then sch || (s ->> ('$.hostnames[' || (k // 2) || ']'))
              || case when k % 2 = 0 then ':' || port else '' end
            when k = 0 then sch || (s ->> '$.ip_str') || ':' || port end as raw
        from (select *, json_extract(payload, '$.matches[' || m || ']') as s from shodan,
          (select unnest(range(0, 4)) as m), (select unnest(range(0, 4)) as k)) where s is not null)
      where raw is not null""",
    "censys": """select domain, page_no, part, pos, raw from (
        select *, array_to_string([lpad(cast(x as varchar), 9, '0') for x in [h, s, k]], '.') as pos,
          coalesce(cast(json_extract(svc, '$.port') as int), 443) as port,
          json_array_length(svc, '$.tls.certificates.leaf_data.subject.common_name') as nc,
          case when k < coalesce(nc, 0)
            then svc ->> ('$.tls.certificates.leaf_data.subject.common_name[' || k || ']')
            when k = coalesce(nc, 0) then hit ->> '$.ip' end as name,
          case when port in (443, 8443) then 'https://' || name else 'http://' || name || ':' || port end as raw
        from (select *, json_extract(hit, '$.services[' || s || ']') as svc from (
            select *, json_extract(payload, '$.result.hits[' || h || ']') as hit from censys,
              (select unnest(range(0, 2)) as h), (select unnest(range(0, 2)) as s), (select unnest(range(0, 3)) as k)))
        where svc is not null)
      where raw is not null and (contains(lower(svc ->> '$.service_name'), 'http') or port in (80, 443, 8080, 8443))""",
}


def provider_tables(*names, where=""):
    """Named tables that end in ``<provider>_urls``: canonical URLs, each once per domain."""
    parts = []
    for n in names:
        parts.append(X.cte(n))
        parts.append(f"{n}_raw as ({RAW[n]} {where})")
        parts.append(S.normalized(f"{n}_norm", f"{n}_raw", "raw", "url"))
        parts.append(f"""{n}_urls as (select domain, '{n}' as provider, url, page_no, part, pos from {n}_norm
          where url <> '' qualify row_number() over (partition by domain, url order by page_no, part, pos) = 1)""")
    return parts


def provider_sql(n, where="", select=None):
    return S.with_(*provider_tables(n, where=where)) + (select or f"select * from {n}_urls")


def _reader(key, provider, **options):
    def run(spark, d):
        return V.READERS[provider](X.derived(spark, d, provider), **options)

    QUERIES[key] = run


_reader("read_wayback", "wayback")
SQL["read_wayback"] = provider_sql("wayback")
_reader("read_commoncrawl", "commoncrawl")
SQL["read_commoncrawl"] = provider_sql("commoncrawl")
_reader("read_virustotal", "virustotal")
SQL["read_virustotal"] = provider_sql("virustotal")
_reader("read_otx", "otx")
SQL["read_otx"] = provider_sql("otx")
_reader("read_urlscan", "urlscan")
SQL["read_urlscan"] = provider_sql("urlscan")
_reader("read_buckets", "grayhatwarfare")
SQL["read_buckets"] = provider_sql("grayhatwarfare")
_reader("read_shodan", "shodan")
SQL["read_shodan"] = provider_sql("shodan")
_reader("read_censys", "censys")
SQL["read_censys"] = provider_sql("censys")


@query("pick_crawl_index", S.with_(X.cte("crawl_indexes")) + """
    select page_id, coalesce(case when json_valid(payload) then payload ->> '$[0].id' end, 'CC-MAIN-2023-23') as index_id
    from crawl_indexes""")
def pick_crawl_index(spark, d):
    return V.pick_crawl_index(X.derived(spark, d, "crawl_indexes"))


@query("filter_date_range", S.with_(X.cte("commoncrawl"), f"cc as ({RAW['commoncrawl']})") + """
    select domain, part, raw, ts as timestamp from cc
    where ts is null or (ts >= '20240300000000' and ts <= '20240601000000')""")
def filter_date_range(spark, d):
    rows = V.commoncrawl_rows(X.derived(spark, d, "commoncrawl"))
    kept = P.filter_date_range(rows, "20240300000000", "20240601000000")
    return kept.select("domain", "part", "raw", "timestamp")


@query("filter_source_status", S.with_(X.cte("wayback")) + """
    select domain, part, url as raw from (select *, cast(from_json(payload, '[["VARCHAR"]]') as varchar[][])[2] as r,
      r[3] as url from wayback) where r[4] = '404'""")
def filter_source_status(spark, d):
    return P.filter_source_status(V.wayback_rows(X.derived(spark, d, "wayback")), "404").select("domain", "part", "raw")


@query("filter_http_service", S.with_(X.cte("censys")) + """
    select part, cast(svc ->> '$.port' as int) as port, svc ->> '$.service_name' as service_name
    from (select part, json_extract(payload, '$.result.hits[0].services[' || s || ']') as svc
          from censys, (select unnest(range(0, 2)) as s))
    where contains(lower(svc ->> '$.service_name'), 'http') or cast(svc ->> '$.port' as int) in (80, 443, 8080, 8443)""")
def filter_http_service(spark, d):
    schema = "result STRUCT<hits: ARRAY<STRUCT<services: ARRAY<STRUCT<port: INT, service_name: STRING>>>>>"
    parsed = X.derived(spark, d, "censys").select("part", F.explode(F.from_json("payload", schema)["result"]["hits"]).alias("h"))
    return P.filter_http_service(parsed.select("part", F.inline("h.services")))


@query("service_url", provider_sql("shodan", select="select raw as service, count(*) as n from shodan_raw group by 1"))
def service_url(spark, d):
    schema = "matches ARRAY<STRUCT<hostnames: ARRAY<STRING>, ip_str: STRING, port: INT>>"
    rows = X.derived(spark, d, "shodan").select(F.inline(F.from_json("payload", schema)["matches"]))
    port = F.coalesce("port", F.lit(80))
    host = F.explode_outer(F.when(F.size("hostnames") > 0, F.col("hostnames"))).alias("host")
    named = rows.select("ip_str", port.alias("port"), host)
    both = F.when(F.col("host").isNotNull(), F.array(
        L.service_url(F.col("host"), F.col("port"), [], [443]),
        F.concat(F.when(F.col("port") == 443, "https://").otherwise("http://"), "host"),
    )).otherwise(F.array(L.service_url(F.col("ip_str"), F.col("port"), [], [443])))
    return named.select(F.explode(both).alias("service")).filter("service is not null").groupBy("service").agg(
        F.count(F.lit(1)).alias("n"))


@query("bucket_url", provider_sql("grayhatwarfare", select="""
    select regexp_extract(raw, '^https?://[^/]*') as place, count(*) as n from grayhatwarfare_raw
    where cast(pos as int) % 2 = 0 and starts_with(raw, 'http') group by 1"""))
def bucket_url(spark, d):
    item = "ARRAY<STRUCT<url: STRING, file_url: STRING, path: STRING, full_path: STRING, link: STRING, bucket: STRING, bucket_name: STRING>>"
    listing = F.from_json("payload", f"files {item}, results {item}, data {item}, items {item}")
    files = F.when(F.col("payload").startswith("["), F.from_json("payload", item)).otherwise(
        F.coalesce(listing["files"], listing["results"], listing["data"], listing["items"]))
    rows = X.derived(spark, d, "grayhatwarfare").select("domain", F.inline(files))
    path = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("url", "file_url", "path", "full_path", "link")])
    full = rows.select("domain", L.bucket_url(path, F.coalesce("bucket", "bucket_name")).alias("u"))
    named = full.filter(F.col("u").contains(F.col("domain")) & F.col("u").startswith("http"))
    return named.groupBy(C.site_root(F.col("u")).alias("place")).agg(F.count(F.lit(1)).alias("n"))


_OTX_STOP = S.with_(X.cte("otx")) + """
    select domain, page_no, part from otx o where not exists (select 1 from otx b
      where b.domain = o.domain and b.page_no < o.page_no
        and (b.payload ->> '$.has_next' = 'false' or json_array_length(b.payload, '$.url_list') = 0))"""


@query("otx_page_stop", _OTX_STOP)
def otx_page_stop(spark, d):
    return V.otx_page_stop(X.derived(spark, d, "otx")).select("domain", "page_no", "part")


_ALL = provider_tables(*X.PROVIDER_TABLES)
_RANK = "case provider " + " ".join(f"when '{p}' then {i}" for i, p in enumerate(PROVIDERS)) + " end"
_UNION = "united as (" + " union all ".join(f"select * from {p}_urls" for p in X.PROVIDER_TABLES) + ")"
_FIRST = f"""firsts as (select * from united qualify row_number() over (partition by domain, lower(url)
  order by {_RANK}, page_no, part, pos) = 1)"""
_STRIPPED = f"""stripped as (select * exclude (u) from (select * exclude (url), {S.strip_query('url')} as url, url as u
  from firsts where not (lower(u) like '%.gif' or lower(u) like '%.png')) qualify row_number() over (partition by domain,
  lower(url) order by {_RANK}, page_no, part, pos) = 1)"""
PASSIVE_TABLES = [*_ALL, _UNION, _FIRST]


def passive_sql(select, *more):
    return S.with_(*PASSIVE_TABLES, *more) + select


@query("union_providers", passive_sql("select provider, domain, url, page_no, part, pos from united"))
def union_providers(spark, d):
    return V.union_providers(X.payloads(spark, d))


@query("filter_providers", passive_sql(
    "select provider, domain, url, page_no, part, pos from united where provider in ('otx', 'shodan')"))
def filter_providers(spark, d):
    return P.filter_providers(V.union_providers(X.payloads(spark, d)), ["OTX", "Shodan", "nobody"])


@query("first_wins_provider", passive_sql("select provider, domain, url, page_no, part, pos from firsts"))
def first_wins_provider(spark, d):
    return D.first_wins_provider(V.union_providers(X.payloads(spark, d)))


@query("dedup_after_strip", passive_sql(f"""
    select provider, domain, url, page_no, part, pos from (select * exclude (url), {S.strip_query('url')} as url from united)
    qualify row_number() over (partition by domain, lower(url) order by {_RANK}, page_no, part, pos, url) = 1"""))
def dedup_after_strip(spark, d):
    return D.dedup_after_strip(V.union_providers(X.payloads(spark, d)))


@query("passive_discoveries", passive_sql("select provider, domain, url, page_no, part, pos from stripped", _STRIPPED))
def passive_discoveries(spark, d):
    return V.passive_discoveries(X.payloads(spark, d), blacklist_ext="gif, PNG", filter_params=True)


@query("count_by_provider", passive_sql("select domain, provider, count(*) as urls from firsts group by 1, 2"))
def count_by_provider(spark, d):
    return R.count_by_provider(V.passive_discoveries(X.payloads(spark, d)), "domain")


@query("sort_providers", passive_sql(
    "select provider, count(*) as urls from firsts group by 1 order by provider"))
def sort_providers(spark, d):
    return R.sort_providers(R.count_by_provider(V.passive_discoveries(X.payloads(spark, d))))


@query("provider_label", passive_sql(
    f"select {S.provider_label('provider')} as label, count(*) as urls from firsts group by 1"))
def provider_label(spark, d):
    urls = V.passive_discoveries(X.payloads(spark, d))
    return urls.groupBy(L.provider_label(F.col("provider")).alias("label")).agg(F.count(F.lit(1)).alias("urls"))


@query("limit_per_source", provider_sql("virustotal", select="""
    select domain, page_no, part, pos, raw from virustotal_raw
    qualify row_number() over (partition by domain order by page_no, part, pos, raw) <= 25"""))
def limit_per_source(spark, d):
    schema = "detected_urls ARRAY<STRUCT<url: STRING>>, undetected_urls ARRAY<STRUCT<url: STRING>>"
    j = X.derived(spark, d, "virustotal").withColumn("j", F.from_json("payload", schema))
    items = F.concat(F.col("j.detected_urls"), F.coalesce("j.undetected_urls", F.array().cast("array<struct<url:string>>")))
    rows = j.select("domain", "page_no", "part", F.posexplode(items).alias("k", "i"))
    raw = rows.select("domain", "page_no", "part", F.lpad(F.col("k").cast("string"), 9, "0").alias("pos"),
                      F.col("i.url").alias("raw")).filter("raw is not null")
    return D.limit_per_group(raw, ["domain"], ["page_no", "part", "pos", "raw"], 25, sampled=10)


# -- de-duplication and unions ----------------------------------------------------------------------------------------

_COLS = ", ".join(RECORD)


@query("first_wins_global", over_records(f"""
    select {_COLS} from disc qualify row_number() over (partition by input, trim(lower(url))
      order by level, step, origin, pos, source, type, url) = 1"""))
def first_wins_global(spark, d):
    return D.first_wins_global(rich_records(spark, d)).select(*RECORD)


@query("first_wins_by_set", over_records(f"""
    select {_COLS} from disc qualify row_number() over (partition by input, seen_set, lower(url)
      order by level, step, origin, pos, source, type, url) = 1"""))
def first_wins_by_set(spark, d):
    return D.first_wins_by_set(rich_records(spark, d)).select(*RECORD)


@query("union_discoveries", over_records(f"""
    select input, source, type, url, step from disc
    union all select 'https://' || {X.HOST}, 'sitemap', 'sitemap', url, 9 from pages
    union all select 'https://' || split_part(split_part(url, '://', 2), '/', 1), 'robots', 'robots', url, 10 from rs
      where url <> ''
    union all select 'https://' || domain, provider, 'passive-' || provider, url, 8 from united""",
    X.cte("robots"), S.exploded("ls", "robots", "str_split(body, chr(10))", "line", "pos", "url as robots_url, body"),
    "ps as (select regexp_extract(robots_url, '^https?://[^/]*') as site, trim(regexp_replace(line, '(?i).*llow: ', '')) "
    "as p from ls where contains(lower(line), 'llow: '))", S.resolved("rs", "ps", "site", "p", "url"),
    *_ALL, _UNION))
def union_discoveries_(spark, d):
    maps = C.read_sitemap(X.derived(spark, d, "sitemaps")).withColumnRenamed("site", "input")
    robots = C.read_robots(X.derived(spark, d, "robots")).withColumnRenamed("site", "input")
    passive = V.union_providers(X.payloads(spark, d)).withColumn("input", F.concat(F.lit("https://"), "domain"))
    united = union_discoveries(
        rich_records(spark, d),
        root_records(maps, F.lit("sitemap"), F.lit("sitemap"), 9),
        root_records(robots, F.lit("robots"), F.lit("robots"), 10),
        root_records(passive, F.concat(F.lit("passive-"), "provider"), F.col("provider"), 8),
    )
    return united.select("input", "source", "type", "url", "step")


@query("new_urls", over_links("""
    select distinct trim(lower(url)) as url_key from links
    where trim(lower(url)) not in (select trim(lower(own)) from own_)""",
    X.cte("js_assets"), S.exploded("found", "js_assets", S.script_links("body"), "link", "place", "page_id, url, site, body"),
    S.resolved("own_", "(select url as asset, link from found)", "asset", "link", "own")))
def new_urls(spark, d):
    seen = resolve_on_both(extract_js_links(X.derived(spark, d, "js_assets"))).filter("NOT on_site")
    fresh = D.new_urls(page_links(spark, d), seen.select(F.col("target").alias("url")))
    return fresh.select(U.url_key(F.col("url")).alias("url_key")).distinct()


# -- joins ------------------------------------------------------------------------------------------------------------

# Every third page was captured again later, every fifth after the time asked for.
_CAPTURED = """captured as (
      select page_id, url, html, status, '2024010' || cast(page_id % 5 + 1 as varchar(20)) || '120000' as captured_at from captures
      union all select page_id, url, html || '<p>again</p>', status, '20240301000000' from captures where page_id % 3 = 0
      union all select page_id, url, html || '<p>too late</p>', status, '20250101000000' from captures where page_id % 5 = 0)"""


@query("join_frontier_pages", S.with_(X.cte("site_graph", "captures"), _CAPTURED) + """
    select f.to_url as url, c.status, length(c.html) as length, c.captured_at from (select distinct to_url from site_graph) f
    join (select * from captured where status < 400 and captured_at <= '20240630000000'
      qualify row_number() over (partition by url order by captured_at desc, page_id desc) = 1) c on c.url = f.to_url""")
def join_frontier_pages(spark, d):
    frontier = X.derived(spark, d, "site_graph").select(F.col("to_url").alias("url")).distinct()
    pages = X.derived(spark, d, "captures").select("page_id", "url", "html", "status")
    n, html = F.col("page_id"), F.col("html")
    first = F.concat(F.lit("2024010"), (n % 5 + 1).cast("string"), F.lit("120000"))
    captures = D.union_all(
        pages.withColumn("captured_at", first),
        pages.filter(n % 3 == 0).withColumns({"html": F.concat(html, F.lit("<p>again</p>")), "captured_at": F.lit("20240301000000")}),
        pages.filter(n % 5 == 0).withColumns({"html": F.concat(html, F.lit("<p>too late</p>")), "captured_at": F.lit("20250101000000")}))
    fetched = J.join_frontier_pages(frontier, captures, at="20240630000000")
    return fetched.select("url", "status", F.length("html").alias("length"), "captured_at")


@query("join_unvisited", S.with_(X.cte("site_graph")) + """
    select url from pages where url not in (select to_url from site_graph where to_url like '%example.com%')""")
def join_unvisited(spark, d):
    visited = X.derived(spark, d, "site_graph").filter(F.col("to_url").contains("example.com"))
    return J.join_unvisited(X.table(spark, d, "pages").select("url"), visited.select(F.col("to_url").alias("url")))


# Half of the pages were first seen to fail, by both methods.
_OBSERVED = """observed as (select url, method, status, '2' as observed_at from status_log
      union all select url, method, 503, '1' from pages, (values ('HEAD'), ('GET')) m(method) where page_id % 2 = 0),
    latest as (select * from observed qualify row_number() over (partition by url, method order by observed_at desc, status desc) = 1)"""


@query("join_status_check", over_records("""
    select d.type, d.url, coalesce(d.status, case when d.type in ('url', 'href', 'linkfinder', 'subdomains')
      then coalesce(h.status, g.status) end) as status
    from disc d left join latest h on h.url = d.url and h.method = 'HEAD'
      left join latest g on g.url = d.url and g.method = 'GET'""", X.cte("status_log"), _OBSERVED))
def join_status_check(spark, d):
    failed = X.table(spark, d, "pages").filter("page_id % 2 = 0").select(
        "url", F.explode(F.array(F.lit("HEAD"), F.lit("GET"))).alias("method"), F.lit(503).alias("status"), F.lit("1").alias("observed_at"))
    log = D.union_all(X.derived(spark, d, "status_log").withColumn("observed_at", F.lit("2")), failed)
    return J.join_status_check(rich_records(spark, d), log).select("type", "url", "status")


@query("join_source_attribution", S.with_(X.cte("captures", "site_graph")) + """
    select u.url, u.link_file, case when coalesce(c.source, 'body') = 'body' and u.link_file then 'linkfinder'
      else coalesce(c.source, 'body') end as source
    from (select distinct to_url as url, contains(to_url, '?') as link_file from site_graph) u
    left join (select url, source from captures where page_id % 4 > 1 and status < 400) c on lower(c.url) = lower(u.url)""")
def join_source_attribution(spark, d):
    urls = X.derived(spark, d, "site_graph").select(
        F.col("to_url").alias("url"), F.col("to_url").contains("?").alias("link_file")).distinct()
    known = P.filter_status(X.derived(spark, d, "captures")).filter("source <> 'body'")
    sources = known.select(F.upper("url").alias("url"), "source", F.col("page_id").alias("rank"))
    return J.join_source_attribution(urls, sources).select("url", "link_file", "source")


@query("join_scope_sites", over_links("""
    select l.url, s.site from (select url from links union all select 'https://gate.test/?to=' || url from pages
      union all select url from pages) l join (select site from seeds union all select 'example.net' union all select 'gate')
      s on contains(l.url, s.site)""", X.cte("seeds")))
def join_scope_sites(spark, d):
    p = X.table(spark, d, "pages").select("url")
    urls = D.union_all(page_links(spark, d).select("url"), p, p.select(F.concat(F.lit("https://gate.test/?to="), "url").alias("url")))
    hosts = X.derived(spark, d, "seeds").select("site")
    extra = X.table(spark, d, "pages").select(F.explode(F.array(F.lit("example.net"), F.lit("gate"))).alias("site")).distinct()
    seeds = hosts.unionByName(extra).withColumn("host", F.col("site"))
    return J.join_scope_sites(urls, seeds).select("url", "site")


@query("join_sitemap_children", S.with_(X.cte("sitemaps", "sitemap_indexes")) + """
    select url, body from sitemaps s where exists (select 1 from sitemap_indexes i
      where contains(i.body, '<loc>' || s.url || '</loc>'))""")
def join_sitemap_children(spark, d):
    children = C.sitemap_children(X.derived(spark, d, "sitemap_indexes"))
    return J.join_sitemap_children(children, X.derived(spark, d, "sitemaps")).select("url", "body")


# -- counters ---------------------------------------------------------------------------------------------------------

_DOM = S.domain("input")
_SUBHOST = S.host_of_url("url")
_CLASS = S.aws_class("url")
COUNTS = f"""count(*) filter (where {S.is_url_type('type')}) as urls,
  count(distinct case when type in ('subdomain', 'subdomains') and {_SUBHOST} not in ('', {_DOM}) then {_SUBHOST} end) as subdomains,
  count(*) filter (where type = 'javascript') as javascript, count(*) filter (where type in ('form', 'upload-form')) as forms,
  count(*) filter (where {_CLASS} = 'aws_s3' or type = 'aws-s3') as aws_s3,
  count(*) filter (where {_CLASS} = 'aws_cloudfront') as aws_cloudfront"""
COUNTED = f"counted as (select input, {COUNTS} from disc group by input)"


@query("count_urls", over_records("select input, urls as value from counted", COUNTED))
def count_urls(spark, d):
    return R.count_urls(rich_records(spark, d))


@query("count_subdomains", over_records("select input, subdomains as value from counted", COUNTED))
def count_subdomains(spark, d):
    return R.count_subdomains(rich_records(spark, d))


@query("count_javascript", over_records("select input, javascript as value from counted", COUNTED))
def count_javascript(spark, d):
    return R.count_javascript(rich_records(spark, d))


@query("count_forms", over_records("select input, forms as value from counted", COUNTED))
def count_forms(spark, d):
    return R.count_forms(rich_records(spark, d))


@query("count_aws", over_records(f"""
    select input, count(*) filter (where {_CLASS} = 'aws_s3') + count(*) filter (where type = 'aws-s3') as aws_s3,
      count(*) filter (where {_CLASS} = 'aws_cloudfront') as aws_cloudfront from disc group by input"""))
def count_aws(spark, d):
    return R.count_aws(rich_records(spark, d), strict=True)


@query("summary_by_site", over_records("select * from counted", COUNTED))
def summary_by_site(spark, d):
    return R.summary_by_site(rich_records(spark, d))


def summary_lines(source):
    lines = [("urls", "URLs discovered"), ("subdomains", "Subdomains found"), ("javascript", "JavaScript files"),
             ("forms", "Forms found"), ("aws_s3", "AWS S3 Buckets"), ("aws_cloudfront", "AWS CloudFront URLs")]
    return " union all ".join(
        f"select input, {i} as ord, '{k}' as metric_key, '{label}' as metric, {k} as value from {source}"
        for i, (k, label) in enumerate(lines))


@query("crawl_summary", over_records(f"""
    select *, metric || ': ' || value || case when ord = 6 then ' Urls' else '' end as line from (
      {summary_lines('counted')} union all select 'https://' || domain, 6, provider, {S.provider_label('provider')}, count(*)
      from united group by domain, provider)""", COUNTED, *_ALL, _UNION))
def crawl_summary(spark, d):
    passive = V.union_providers(X.payloads(spark, d)).withColumn("input", F.concat(F.lit("https://"), "domain"))
    return R.summary_text(R.crawl_summary(rich_records(spark, d), R.count_by_provider(passive, "input")))


# -- formats ----------------------------------------------------------------------------------------------------------

_JSON = """'{' || array_to_string(list_filter(['"input":' || to_json(input), '"source":' || to_json(source), '"type":' ||
  to_json(type), '"url":' || to_json(url), '"status":' || status, '"length":' || length], lambda x: x is not null), ',') || '}'"""


@query("format_json", over_records(f"select {_JSON} as line from disc"))
def format_json(spark, d):
    return R.format_json(rich_records(spark, d))


@query("format_quiet", over_records("select url as line from disc"))
def format_quiet(spark, d):
    return R.format_quiet(rich_records(spark, d))


_CLEAN = f"'[' || {S.clean_tag('type', 'url')} || '] ' || url"


@query("format_clean", over_records(f"select {_CLEAN} as line from disc"))
def format_clean(spark, d):
    return R.format_clean(rich_records(spark, d))


_STANDARD = f"""concat_ws(' ', '[' || {S.source_label('source', 'type')} || ']', '[' || {S.type_label('type')} || ']',
  '[' || format('{{:,}}', length) || ' bytes]', '[from: ' || fr || ']',
  url, '[' || status || ']')"""


@query("format_standard", over_records(
    f"select {_STANDARD} as line from (select *, case when step > 0 then origin end as fr from disc)"))
def format_standard(spark, d):
    return R.format_standard(page_discoveries(rich_captures(spark, d), with_from=True), show_length=True)


@query("sink_text", over_records(f"select {_CLEAN} as line from disc"))
def sink_text(spark, d):
    path = fresh_path(spark, "lines")
    R.sink_text(R.format_clean(rich_records(spark, d)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
