"""Registered queries over captured pages: scans, URL scalars, filters and generators."""

from __future__ import annotations

from webloom.fixed_values import SITEMAP_PATHS
from webloom.functions import labels as L
from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import dedup as D
from webloom.operators import extract as E
from webloom.operators import filters as P
from webloom.plans.discoveries import page_discoveries
from webloom.registry.common import (
    F, RECORD, S, X, over_links, over_records, page_links, rich_captures, rich_records, with_site,
)
from webloom.sources import captures as C

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def pages(spark, d):
    return X.table(spark, d, "pages")


# -- scans ------------------------------------------------------------------------------------------------------------

@query("read_seeds", S.with_(X.cte("seeds")) + f"""
    select 'https://' || site as site, site as host, {S.domain("'https://' || site")} as domain from seeds
    union all select 'http://' || site, site, {S.domain("'https://' || site")} from seeds""")
def read_seeds(spark, d):
    sites = X.derived(spark, d, "seeds")
    bare = sites.select(F.concat(F.lit(" "), "site", F.lit("\t")).alias("line"))
    full = sites.select(F.concat(F.lit("http://"), "site").alias("line"))
    blank = sites.select(F.lit("  ").alias("line"))
    return C.read_seeds(D.union_all(bare, full, blank)).select("site", "host", "domain")


@query("read_pages", S.with_(X.cte("captures")) +
       "select page_id, url, status, length(html) as length, source from captures")
def read_pages(spark, d):
    return C.read_pages(X.derived(spark, d, "captures"))


@query("page_length", f"select {S.host('url')} as host, sum(length(html)) as chars, max(length(html)) as longest "
                      "from pages group by 1")
def page_length(spark, d):
    sized = C.read_pages(pages(spark, d))
    return sized.groupBy(U.hostname_of(F.col("url")).alias("host")).agg(
        F.sum("length").alias("chars"), F.max("length").alias("longest"))


@query("read_robots", S.with_(
    X.cte("robots"),
    S.exploded("ls", "robots", "str_split(body, chr(10))", "line", "pos", "url as robots_url, body"),
    "ps as (select regexp_extract(robots_url, '^https?://[^/]*') as site, pos, "
    "trim(regexp_replace(line, '(?i).*llow: ', '')) as p from ls where contains(lower(line), 'llow: '))",
    S.resolved("rs", "ps", "site", "p", "url")) + "select site, url, 'robots' as type, pos from rs where url <> ''")
def read_robots(spark, d):
    return C.read_robots(X.derived(spark, d, "robots"))


@query("read_sitemap", S.with_(X.cte("sitemaps")) + """
    select regexp_extract(url, '^https?://[^/]*') as site,
      replace(regexp_extract(body, '<loc>(.*)</loc>', 1), '&amp;', '&') as url, 'sitemap' as type, 0 as pos
    from sitemaps""")
def read_sitemap(spark, d):
    return C.read_sitemap(X.derived(spark, d, "sitemaps"))


@query("read_sitemap_index", S.with_(X.cte("sitemaps", "sitemap_indexes")) + """
    select regexp_extract(i.url, '^https?://[^/]*') as site,
      replace(regexp_extract(s.body, '<loc>(.*)</loc>', 1), '&amp;', '&') as url, 'sitemap' as type, 0 as pos
    from sitemap_indexes i join sitemaps s on contains(i.body, '<loc>' || s.url || '</loc>')""")
def read_sitemap_index(spark, d):
    return C.read_sitemap_index(X.derived(spark, d, "sitemap_indexes"), X.derived(spark, d, "sitemaps"))


@query("sitemap_candidates", S.with_(X.cte("seeds")) + """
    select 'https://' || site as site, 'https://' || site || p.path as url, p.pos
    from seeds cross join (values """ + ", ".join(f"('{p}', {i})" for i, p in enumerate(SITEMAP_PATHS)) + ") p(path, pos)")
def sitemap_candidates(spark, d):
    return C.sitemap_candidates(C.read_seeds(X.derived(spark, d, "seeds"), "site"))


# -- URL scalars ------------------------------------------------------------------------------------------------------

@query("url_parts", over_links("""
    select u as url, n.s as scheme, n.h as netloc, n.p as path, '' as params, n.q as query, n.f as fragment, n.h as hostname
    from (select u, regexp_extract(u, '^(https?)://([^/?#]*)([^?#]*)[?]?([^#]*)#?(.*)$', ['s', 'h', 'p', 'q', 'f']) as n
          from (select url as u from pages union select url from links))"""))
def url_parts(spark, d):
    urls = pages(spark, d).select("url").unionByName(page_links(spark, d).select("url")).distinct()
    return U.url_parts(urls, "url")


@query("registered_domain", f"select {S.domain('url')} as domain, {S.host('url')} as host, count(*) as pages "
                            "from pages group by 1, 2")
def registered_domain(spark, d):
    return pages(spark, d).groupBy(
        U.registered_domain(F.col("url")).alias("domain"), U.hostname_of(F.col("url")).alias("host")
    ).agg(F.count(F.lit(1)).alias("pages"))


@query("host_of_url", f"select {S.host_of_url('url')} as host, count(*) as pages from pages group by 1")
def host_of_url(spark, d):
    return pages(spark, d).groupBy(U.host_of_url(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query("url_ext", over_records(f"select {S.ext('url')} as ext, count(*) as urls from disc group by 1"))
def url_ext(spark, d):
    return rich_records(spark, d).groupBy(U.url_ext(F.col("url")).alias("ext")).agg(F.count(F.lit(1)).alias("urls"))


@query("url_key", over_links("select trim(lower(url)) as url_key, count(*) as links from links group by 1"))
def url_key(spark, d):
    return page_links(spark, d).groupBy(U.url_key(F.col("url")).alias("url_key")).agg(F.count(F.lit(1)).alias("links"))


@query("ensure_scheme", "select 'https://' || split_part(url, '://', 2) as site, url as kept from pages")
def ensure_scheme(spark, d):
    return pages(spark, d).select(U.ensure_scheme(F.split_part("url", F.lit("://"), F.lit(2))).alias("site"),
                                  U.ensure_scheme(F.col("url")).alias("kept"))


@query("resolve_url", S.with_(
    X.cte("rich_pages"),
    S.exploded("tags", "rich_pages", S.tags("html"), "tag", "pos", "page_id, url as page, html"),
    f"""refs as (
      select page_id, page, pos, {S.attr('tag', 'href')} as raw from tags where {S.attr('tag', 'href')} <> ''
      union all select page_id, page, pos, {S.attr('tag', 'src')} from tags where {S.attr('tag', 'src')} <> ''
      union all select page_id, url, -1, page_id % 7 || '/./a//b/../' || page_id || ';k=v?d#e' from rich_pages
      union all select page_id, url, -2, '?q=' || page_id from rich_pages
      union all select page_id, url, -3, '' from rich_pages
      union all select page_id, url, -4, '//o.test/../x' from rich_pages
      union all select page_id, url, -5, '/../../' || page_id || '/..' from rich_pages)""",
    S.resolved("res", "refs", "page", "raw", "url")) + "select page_id, page, pos, raw, url from res")
def resolve_url(spark, d):
    rich = X.derived(spark, d, "rich_pages")
    tags = rich.select("page_id", F.col("url").alias("page"), F.posexplode(E.open_tags(F.col("html"))).alias("pos", "tag"))
    refs = [tags.withColumn("raw", E.attribute(F.col("tag"), a)).filter("raw != ''").drop("tag") for a in ("href", "src")]
    more = F.array(
        F.concat((F.col("page_id") % 7).cast("string"), F.lit("/./a//b/../"), F.col("page_id").cast("string"),
                 F.lit(";k=v?d#e")),
        F.concat(F.lit("?q="), F.col("page_id").cast("string")), F.lit(""), F.lit("//o.test/../x"),
        F.concat(F.lit("/../../"), F.col("page_id").cast("string"), F.lit("/..")),
    )
    made = rich.select("page_id", F.col("url").alias("page"), F.posexplode(more).alias("at", "raw")).select(
        "page_id", "page", (-F.col("at") - 1).alias("pos"), "raw")
    return U.resolve_url(D.union_all(*refs, made), "page", "raw", "url")


_CANONICAL = S.with_(
    X.cte("wayback"),
    "raws as (select url as raw from pages union all select split_part(url, '#', 1) || case when contains(url, '?') "
    "then '&' else '?' end || 'b=' || page_id || '&a=x+y%20z&&c' from pages union all select 'HTTP://' || "
    f"upper({X.HOST}) || ':80//p//' || page_id || '/?k=%C3%A9~*&k=' from pages)",
    S.normalized("norm", "raws", "raw", "canonical"))


def _raw_urls(spark, d):
    p = pages(spark, d)
    u, i = F.col("url"), F.col("page_id").cast("string")
    made = F.array(
        u,
        F.concat(F.substring_index(u, "#", 1), F.when(u.contains("?"), "&").otherwise("?"), F.lit("b="), i,
                 F.lit("&a=x+y%20z&&c")),
        F.concat(F.lit("HTTP://"), F.upper(U.netloc_of(u)), F.lit(":80//p//"), i, F.lit("/?k=%C3%A9~*&k=")),
    )
    return p.select(F.explode(made).alias("raw"))


@query("normalize_url", _CANONICAL + "select raw, canonical from norm")
def normalize_url(spark, d):
    return U.normalize_url(_raw_urls(spark, d), "raw")


@query("sort_query_params", _CANONICAL + "select regexp_extract(canonical, '[?](.*)', 1) as query, count(*) as urls "
                                         "from norm group by 1")
def sort_query_params(spark, d):
    raw = F.substring_index(F.col("raw"), "#", 1)
    query_text = F.when(raw.contains("?"), F.substr(raw, F.instr(raw, "?") + 1)).otherwise("")
    ordered = _raw_urls(spark, d).select(query_text.alias("q")).select(
        F.when(F.col("q") == "", "").otherwise(U.sort_query_params(F.col("q"))).alias("query"))
    return ordered.groupBy("query").agg(F.count(F.lit(1)).alias("urls"))


@query("strip_query", f"select {S.strip_query('url')} as url, count(*) as pages from pages group by 1")
def strip_query(spark, d):
    return pages(spark, d).groupBy(U.strip_query(F.col("url")).alias("url")).agg(F.count(F.lit(1)).alias("pages"))


# -- text helpers -----------------------------------------------------------------------------------------------------

@query("decode_chars", S.with_(X.cte("js_assets")) + f"""
    select page_id, {S.decoded('body')} as body, {S.decoded("url || '?%zz+%C3%A9%2'")} as url from js_assets""")
def decode_chars(spark, d):
    assets = X.derived(spark, d, "js_assets")
    return assets.select("page_id", T.decode_chars(F.col("body")).alias("body"),
                         T.decode_chars(F.concat("url", F.lit("?%zz+%C3%A9%2"))).alias("url"))


@query("collapse_newlines", """
    select doc_id, regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28)
      || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194)
      || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202)
      || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)), '[\\t\\r\\n]+', ' ', 'g') as text
    from documents""")
def collapse_newlines(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.collapse_newlines(F.col("text")).alias("text"))


_NAMES = ("(select page_id, url, case page_id % 5 when 0 then '2F' when 1 then '*.20' when 2 then '--.' when 3 then "
          f"'3d3A' else '.' end || {S.host('url')} || case page_id % 3 when 0 then '-' else '' end as name from pages)")


def _names(spark, d):
    k = F.col("page_id")
    front = F.when(k % 5 == 0, "2F").when(k % 5 == 1, "*.20").when(k % 5 == 2, "--.").when(k % 5 == 3, "3d3A").otherwise(".")
    return pages(spark, d).select(
        "page_id", F.concat(front, U.hostname_of(F.col("url")), F.when(k % 3 == 0, "-").otherwise("")).alias("name"))


@query("clean_name", f"select page_id, {S.clean_name('name')} as name from {_NAMES}")
def clean_name(spark, d):
    return _names(spark, d).select("page_id", T.clean_name(F.col("name")).alias("name"))


@query("clean_subdomain", f"select {S.clean_subdomain('upper(name)')} as name, count(*) as pages from {_NAMES} group by 1")
def clean_subdomain(spark, d):
    return _names(spark, d).groupBy(T.clean_subdomain(F.upper("name")).alias("name")).agg(
        F.count(F.lit(1)).alias("pages"))


# -- filters ----------------------------------------------------------------------------------------------------------

@query("filter_in_scope", over_links(
    "select page_id, url from links where regexp_matches(url, '^https://blog[.]') or regexp_matches(url, '[.]net/')"))
def filter_in_scope(spark, d):
    return P.filter_in_scope(page_links(spark, d), [r"^https://blog\.", r"\.net/"]).select("page_id", "url")


@query("filter_default_scope", over_records(
    f"select input, url from disc where contains(url, {S.host('input')})"))
def filter_default_scope(spark, d):
    return P.filter_default_scope(rich_records(spark, d), U.hostname_of(F.col("input"))).select("input", "url")


@query("filter_include", over_links("select page_id, url from links where regexp_matches(url, '(?i)/[a-f][^/]*$')"))
def filter_include(spark, d):
    return P.filter_include(page_links(spark, d), "(?i)/[a-f][^/]*$").select("page_id", "url")


@query("filter_exclude", over_links("select page_id, url from links where not regexp_matches(url, 'th|[.]org')"))
def filter_exclude(spark, d):
    return P.filter_exclude(page_links(spark, d), r"th|\.org").select("page_id", "url")


@query("filter_media_blacklist", over_records(f"select type, url from disc where not {S.media('url')}"))
def filter_media_blacklist(spark, d):
    return P.filter_media_blacklist(rich_records(spark, d)).select("type", "url")


@query("filter_should_visit", over_records(f"""
    select distinct url from disc where type = 'href' and not {S.media('url')} and not regexp_matches(url, 'mailto:')
      and regexp_matches(url, 'example[.](com|net)') and url not in (select url from pages)"""))
def filter_should_visit(spark, d):
    urls = rich_records(spark, d).filter("type = 'href'").select("url", "input").distinct()
    seen = pages(spark, d).select("url")
    fresh = P.filter_should_visit(urls, seen, U.hostname_of(F.col("input")), r"example\.(com|net)", "mailto:")
    return fresh.select("url").distinct()


@query("filter_status", S.with_(X.cte("captures")) + "select page_id, url, status from captures where status < 400")
def filter_status(spark, d):
    return P.filter_status(C.read_pages(X.derived(spark, d, "captures"))).select("page_id", "url", "status")


@query("filter_link_files", over_records(f"select type, url from disc where {S.bare_ext('url')} in ('js', 'json')"))
def filter_link_files(spark, d):
    return P.filter_link_files(rich_records(spark, d), E.link_file_exts(" .JS, json,")).select("type", "url")


@query("filter_ext_url", over_records(
    "select type, url from disc where not (lower(url) like '%.js' or lower(url) like '%.net' or lower(url) like '%.png')"))
def filter_ext_url(spark, d):
    return P.filter_ext_url(rich_records(spark, d), "JS, net,png,").select("type", "url")


@query("filter_ext_path", over_records(
    f"select type, url from disc where not regexp_matches(lower({S.path('url')}), '[.](js|html|php)$')"))
def filter_ext_path(spark, d):
    return P.filter_ext_path(rich_records(spark, d), ["js", "HTML", "php"]).select("type", "url")


@query("filter_subdomain_of", f"select page_id, {S.host('url')} as host from pages where {S.host('url')} = 'example.net' "
                              f"or {S.host('url')} like '%.example.net'")
def filter_subdomain_of(spark, d):
    hosts = pages(spark, d).select("page_id", U.hostname_of(F.col("url")).alias("host"))
    return P.filter_subdomain_of(hosts, F.lit("example.net"))


@query("filter_contains_domain", over_records("select type, url from disc where contains(url, 'example.org')"))
def filter_contains_domain(spark, d):
    return P.filter_contains_domain(rich_records(spark, d), F.lit("example.org")).select("type", "url")


@query("filter_blank_url", S.with_(
    "us as (select page_id, case page_id % 3 when 0 then url when 1 then '  ' else chr(9) || chr(10) end as url from pages)")
    + "select page_id, url from us where page_id % 3 = 0")
def filter_blank_url(spark, d):
    k = F.col("page_id") % 3
    urls = pages(spark, d).select("page_id", F.when(k == 0, F.col("url")).when(k == 1, "  ").otherwise("\t\n").alias("url"))
    return P.filter_blank_url(urls)


@query("filter_checkable", over_records(
    "select type, url from disc where type in ('url', 'href', 'linkfinder', 'subdomains')"))
def filter_checkable(spark, d):
    return P.filter_checkable(rich_records(spark, d)).select("type", "url")


@query("filter_not_self", S.with_(
    S.exploded("subs", "(select page_id, html, " + S.domain("url") + " as domain from pages)",
               S.subdomains("html", "domain"), "sub", "pos", "page_id, domain, html"),
    "both_ as (select page_id, domain, sub from subs union all select page_id, "
    f"{S.domain('url')}, {S.domain('url')} from pages)") + "select page_id, domain, sub from both_ where sub <> domain")
def filter_not_self(spark, d):
    p = with_site(pages(spark, d))
    subs = E.extract_subdomains(p.select("page_id", "domain", "html"), "html", F.col("domain")).drop("pos")
    own = p.select("page_id", "domain", F.col("domain").alias("sub"))
    return P.filter_not_self(subs.unionByName(own), "domain")


# -- generators -------------------------------------------------------------------------------------------------------

@query("extract_links", over_links("select page_id, page as origin, 'href' as type, url, pos from links where url <> ''"))
def extract_links(spark, d):
    return page_links(spark, d)


def _of_type(kind):
    return over_records(f"select page_id, origin, type, url, pos from disc where type = '{kind}' and step > 3")


@query("extract_scripts", over_records(
    "select page_id, origin, type, url, cast(pos / 2 as int) as pos from disc where step = 7"))
def extract_scripts(spark, d):
    return E.extract_scripts(X.derived(spark, d, "rich_pages"))


@query("extract_forms", _of_type("form"))
def extract_forms(spark, d):
    return E.extract_forms(X.derived(spark, d, "rich_pages"))


@query("extract_upload_forms", _of_type("upload-form"))
def extract_upload_forms(spark, d):
    return E.extract_upload_forms(X.derived(spark, d, "rich_pages"))


@query("extract_subdomains", S.with_(
    f"texts as (select 'page' as kind, page_id as id, html as text, {S.domain('url')} as domain from pages "
    "union all select 'document', doc_id, text, 'example.com' from documents)",
    S.exploded("subs", "texts", S.subdomains("text", "domain"), "sub", "pos")) + "select kind, id, domain, pos, sub from subs")
def extract_subdomains(spark, d):
    of_pages = with_site(pages(spark, d)).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                                                 F.col("html").alias("text"), "domain")
    of_docs = X.table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text",
                                                    F.lit("example.com").alias("domain"))
    return E.extract_subdomains(of_pages.unionByName(of_docs), "text", F.col("domain"))


@query("emit_subdomains", S.with_(
    S.exploded("subs", f"(select page_id, html, {S.domain('url')} as domain from pages)",
               S.subdomains("html", "domain"), "sub", "place", "page_id, domain, html")) + """
    select page_id, domain, 'subdomains' as type, p || sub as url, place * 2 + k as pos
    from subs, (values ('http://', 0), ('https://', 1)) v(p, k)
    union all select page_id, domain, 'subdomain', sub, place from subs""")
def emit_subdomains(spark, d):
    p = with_site(pages(spark, d)).select("page_id", "domain", "html")
    subs = E.extract_subdomains(p, "html", F.col("domain"))
    return E.emit_subdomains(subs).unionByName(E.emit_subdomains(subs, bare=True))


@query("extract_s3", S.with_(
    X.cte("rich_pages"), S.exploded("found", "rich_pages", S.buckets("html"), "bucket", "pos", "page_id, html"))
    + "select page_id, pos, bucket from found")
def extract_s3(spark, d):
    return E.extract_s3(X.derived(spark, d, "rich_pages").select("page_id", "html"), "html")


@query("extract_js_links", S.with_(
    X.cte("js_assets"), S.exploded("found", "js_assets", S.script_links("body"), "link", "pos", "page_id, body"))
    + "select page_id, pos, link from found")
def extract_js_links(spark, d):
    return E.extract_js_links(X.derived(spark, d, "js_assets").select("page_id", "body"))


_JS = [X.cte("js_assets"),
       S.exploded("found", "js_assets", S.script_links("body"), "link", "pos", "page_id, url, site, body"),
       S.resolved("own_", "found", "url", "link", "own"), S.resolved("both_", "own_", "site", "link", "alt")]


@query("join_dual_base", S.with_(*_JS) + """
    select page_id, url, site, pos, link, own as target, false as on_site from both_
    union all select page_id, url, site, pos, link, alt, true from both_ where alt <> own""")
def join_dual_base(spark, d):
    return E.resolve_on_both(E.extract_js_links(X.derived(spark, d, "js_assets")))


@query("js_link_records", S.with_(*_JS) + f"""
    select page_id, url as origin, case when {S.bare_ext('own')} = 'js' then 'javascript' else 'linkfinder' end as type,
      case when {S.bare_ext('own')} = 'js' then 'javascript' else url end as source, own as url, pos * 2 as pos,
      {S.bare_ext('own')} = 'js' as link_file from both_
    union all select page_id, url, 'linkfinder', url, alt, pos * 2 + 1, {S.ext('alt')} in ('.js', '.xml', '.json', '.map')
      from both_ where alt <> own""")
def js_link_records(spark, d):
    return E.js_link_records(X.derived(spark, d, "js_assets"))


@query("unminified_js", over_records(
    "select page_id, type, url, replace(url, '.min.js', '.js') as sibling from disc where contains(url, '.min.js')"))
def unminified_js(spark, d):
    return E.unminified_js(rich_records(spark, d).select("page_id", "type", "url"))


@query("page_discoveries", over_records("select page_id, " + ", ".join(RECORD) + " from disc"))
def page_discoveries_(spark, d):
    return page_discoveries(rich_captures(spark, d)).select("page_id", *RECORD)


@query("ordered_unique", S.with_(
    X.cte("rich_pages"),
    f"per_page as (select page_id, list_transform({S.tags('html')}, lambda t: {S.attr('t', 'href')}) as hrefs from rich_pages)")
    + f"select page_id, array_to_string({S.first_only('hrefs')}, ' ') as hrefs from per_page")
def ordered_unique(spark, d):
    hrefs = X.derived(spark, d, "rich_pages").select(
        "page_id", F.transform(E.open_tags(F.col("html")), lambda t: E.attribute(t, "href")).alias("hrefs"))
    return D.ordered_unique(hrefs, "hrefs").select("page_id", F.array_join("hrefs", " ").alias("hrefs"))


# -- labels -----------------------------------------------------------------------------------------------------------

@query("source_label", over_records(f"select {S.source_label('source', 'type')} as label, count(*) as n from disc group by 1"))
def source_label(spark, d):
    return rich_records(spark, d).groupBy(L.source_label(F.col("source"), F.col("type")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@query("type_label", over_records(f"select type, {S.type_label('type')} as label, count(*) as n from disc group by 1, 2"))
def type_label(spark, d):
    return rich_records(spark, d).groupBy("type", L.type_label(F.col("type")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@query("clean_tag", over_records(f"select type, {S.clean_tag('type', 'url')} as tag, count(*) as n from disc group by 1, 2"))
def clean_tag(spark, d):
    return rich_records(spark, d).groupBy("type", L.clean_tag(F.col("type"), F.col("url")).alias("tag")).agg(
        F.count(F.lit(1)).alias("n"))


@query("aws_class", over_records(f"select url, {S.aws_class('url')} as cloud from disc where {S.aws_class('url')} is not null"))
def aws_class(spark, d):
    return rich_records(spark, d).select("url", L.aws_class(F.col("url")).alias("cloud")).filter("cloud is not null")


@query("format_length", "select page_id, '[' || regexp_replace(format('{:,}', length(html)), '', '') || ' bytes]' as shown from pages")
def format_length(spark, d):
    return C.read_pages(pages(spark, d)).select("page_id", L.format_length(F.col("length")).alias("shown"))


@query("from_tag", over_links(
    "select page_id, '[from: ' || url || ']' as tag from links"))
def from_tag(spark, d):
    return page_links(spark, d).select("page_id", L.from_tag(F.col("url")).alias("tag"))
