"""Registered queries over the link graph and over streams, and the whole site report."""

from __future__ import annotations

from webloom.functions import urls as U
from webloom.operators import filters as P
from webloom.plans.checkpoints import fresh_path
from webloom.plans.crawl import crawl, crawl_depth, crawl_roots, link_edges
from webloom.plans.discoveries import page_finds
from webloom.operators.dedup import union_all
from webloom.plans.site_report import site_report
from webloom.plans.site_run import site_roots
from webloom.registry.common import F, S, X, over_records, rich_captures, with_site
from webloom.registry.reports import COUNTS, PASSIVE_TABLES, summary_lines
from webloom.sources import captures as C
from webloom.sources import providers as V
from webloom.streaming import streams as ST

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


DOM = X.DOMAIN
SITES = f"""sites as (select 'https://' || {DOM} as input, {DOM} as host, arg_min(url, page_id) as url from pages
  group by 1, 2, {X.HOST})"""


def domain_roots(spark, d):
    """One crawl per registered domain, from the lowest-numbered page of each of its hosts."""
    host, name = U.registered_domain(F.col("url")), U.hostname_of(F.col("url"))
    firsts = X.table(spark, d, "pages").groupBy(host.alias("host"), name).agg(F.min_by("url", "page_id").alias("url"))
    return firsts.select(F.concat(F.lit("https://"), "host").alias("input"), "host", "url")


def domain_seeds(spark, d):
    """One seed per registered domain."""
    hosts = X.table(spark, d, "pages").select(U.registered_domain(F.col("url")).alias("line")).distinct()
    return C.read_seeds(hosts)


def walk_sql(depth, select):
    return S.with_(X.cte("site_graph"), SITES, f"""walk as (
      select input, host, url, 0 as depth from sites where not {S.media('url')}
      union select w.input, w.host, g.to_url, w.depth + 1 from walk w join site_graph g on g.from_url = w.url
        where w.depth < {depth} and contains(g.to_url, w.host) and not {S.media('g.to_url')})""") + select


@query("crawl", walk_sql(3, "select input, host, url, false as link_file, min(depth) as depth from walk group by 1, 2, 3"))
def crawl_(spark, d):
    seen = crawl(X.derived(spark, d, "site_graph"), domain_roots(spark, d), max_depth=3)
    return seen.select("input", "host", "url", "link_file", "depth")


@query("crawl_depth", walk_sql(6, "select input, url, min(depth) as depth from walk group by 1, 2"))
def crawl_depth_(spark, d):
    return crawl_depth(X.derived(spark, d, "site_graph"), domain_roots(spark, d), max_depth=6)


@query("filter_depth", walk_sql(4, "select input, url, depth from (select input, url, min(depth) as depth from walk "
                                   "group by 1, 2) where depth <= 2"))
def filter_depth(spark, d):
    return P.filter_depth(crawl_depth(X.derived(spark, d, "site_graph"), domain_roots(spark, d), max_depth=4), 2)


# Edges of the rich captures per crawled site; script links also on the site root
EDGES = ",\n".join([
    f"asset_sites as (select distinct 'https://' || {DOM} as input, {DOM} as host from pages)",
    S.exploded("e_lnk", "js_assets", S.script_links("body"), "link", "place", "url as origin, body"),
    S.resolved("e_own", "e_lnk", "origin", "link", "own"),
    S.resolved("e_alt", "(select e.*, a.input from e_own e, asset_sites a)", "input", "link", "alt"),
    f"""edges as (
      select distinct input, origin, own as target, 'restart' as kind, {S.bare_ext('own')} = 'js' as lf from e_alt
      union select input, origin, alt, 'restart', {S.ext('alt')} in ('.js', '.xml', '.json', '.map') from e_alt where alt <> own
      union select input, origin, replace(own, '.min.js', '.js'), 'restart', true from e_alt
        where {S.bare_ext('own')} = 'js' and contains(own, '.min.js')
      union select a.input, origin, url, 'next', step = 7 from disc d, asset_sites a where step in (4, 7))""",
])


def states_sql(roots, depth, name="states"):
    return f"""{name} as (
      select input, host, url, false as lf, 0 as depth from ({roots}) where contains(url, host) and not {S.media('url')}
      union select w.input, w.host, e.target, e.lf, case e.kind when 'restart' then 0 else w.depth + 1 end
        from {name} w join edges e on e.origin = w.url and e.input = w.input
        where (e.kind = 'restart' or (not w.lf and w.depth < {depth})) and contains(e.target, w.host)
          and not {S.media('e.target')})"""


_ASSET_ROOTS = f"select 'https://' || {DOM} as input, {DOM} as host, url from js_assets"


@query("crawl_js_reset", over_records(
    "select input, url, lf as link_file, min(depth) as depth from states group by 1, 2, 3",
    EDGES, states_sql(_ASSET_ROOTS, 2)))
def crawl_js_reset(spark, d):
    host = U.registered_domain(F.col("url"))
    roots = X.derived(spark, d, "js_assets").select(F.concat(F.lit("https://"), host).alias("input"), host.alias("host"), "url")
    seen = crawl(link_edges(page_finds(with_site(rich_captures(spark, d)))), roots, max_depth=2)
    return seen.select("input", "url", "link_file", "depth")


def indexed_files(spark, d):
    """A sitemap on each host that only the host's index lists."""
    seeds = C.read_seeds(X.derived(spark, d, "seeds"), "site")
    return seeds.select(F.concat("site", F.lit("/none.xml")).alias("url"), F.concat(
        F.lit("<urlset><url><loc>"), "site", F.lit("/only-by-index</loc></url></urlset>")).alias("body"))


def listed(spark, d):
    """Sitemap, robots and archive URLs, each with the site that they belong to."""
    def of_site(urls):
        return urls.select(F.concat(F.lit("https://"), U.registered_domain(F.col("site"))).alias("input"), "url")

    maps = of_site(union_all(C.read_sitemap(X.derived(spark, d, "sitemaps")),
                             C.read_sitemap_index(X.derived(spark, d, "sitemap_indexes"), indexed_files(spark, d))))
    robots = of_site(C.read_robots(X.derived(spark, d, "robots")))
    passive = V.passive_discoveries(X.payloads(spark, d)).withColumn("input", F.concat(F.lit("https://"), "domain"))
    return maps, robots, passive


LISTED = ",\n".join([
    X.cte("sitemaps", "robots", "seeds"),
    f"maps as (select 'https://' || {DOM} as input, replace(regexp_extract(body, '<loc>(.*)</loc>', 1), '&amp;', '&') "
    f"as url from sitemaps union all select 'https://' || {DOM}, url || '/only-by-index' from "
    "(select 'https://' || site as url from seeds))",
    S.exploded("ls", "robots", "str_split(body, chr(10))", "line", "place", "url as robots_url, body"),
    "ps as (select regexp_extract(robots_url, '^https?://[^/]*') as site, trim(regexp_replace(line, '(?i).*llow: ', '')) "
    "as p from ls where contains(lower(line), 'llow: '))", S.resolved("rs_", "ps", "site", "p", "found"),
    f"rs as (select 'https://' || {DOM.replace('url', 'site')} as input, found as url from rs_ where found <> '')",
    *PASSIVE_TABLES,
    "passive as (select f.*, 'https://' || domain as input from firsts f where trim(url) <> '' and domain in "
    f"(select {DOM} from pages))",
    f"""all_roots as (select distinct input, host, url from (
      select input, host, input as url from asset_sites
      union all select m.input, host, m.url from maps m join asset_sites a on a.input = m.input
      union all select m.input, host, m.url from rs m join asset_sites a on a.input = m.input
      union all select m.input, host, m.url from passive m join asset_sites a on a.input = m.input))""",
])
_SITES_ONLY = f"asset_sites as (select distinct 'https://' || {DOM} as input, {DOM} as host from pages)"


@query("crawl_roots", S.with_(_SITES_ONLY, LISTED) + "select input, host, url from all_roots")
def crawl_roots_(spark, d):
    return crawl_roots(domain_seeds(spark, d), *listed(spark, d))


@query("site_roots", S.with_(X.cte("sitemaps", "robots", "seeds"), "sd as (select 'https://' || site as site from seeds)",
    "ls_r as (select 'https://' || site as site, unnest(['/private/' || cast(page_id as varchar(20)), '/pub', '', 'rel/../a?b#c']) as p "
    f"from (select page_id, {X.HOST} as site from pages))", S.resolved("rr", "ls_r", "site", "p", "found")) + """
    select distinct 'sitemap' as kind, m.input, m.url from (
      select regexp_extract(url, '^https://[^/]*') as input, replace(regexp_extract(body, '<loc>(.*)</loc>', 1), '&amp;', '&') as url from sitemaps
      union all select site, site || '/only-by-index' from sd) m join sd on sd.site = m.input
    union all select distinct 'robots', site, found from rr where site in (select site from sd)""")
def site_roots_(spark, d):
    def bodies(name):
        return X.derived(spark, d, name).select("url", F.col("body").alias("html"))

    seeds = C.read_seeds(X.derived(spark, d, "seeds"), "site")
    only = indexed_files(spark, d).withColumnRenamed("body", "html")
    captures = union_all(X.table(spark, d, "pages").select("url", "html"), bodies("sitemaps"), bodies("sitemap_indexes"),
                         bodies("robots"), only)
    maps, robots = site_roots(seeds, captures)
    return union_all(maps.withColumn("kind", F.lit("sitemap")), robots.withColumn("kind", F.lit("robots")))


def report_sql(depth):
    visits = f"""visits as (select input, host, url, min(depth) as depth, bool_and(lf) as lf,
        min(case when not lf then depth end) as page_depth from states group by 1, 2, 3)"""
    fetched = """fetched as (select row_number() over () as page_id, v.input, v.host as dom, v.url, c.html, 0 as level,
        coalesce(p.provider, case when v.lf then 'linkfinder' else 'body' end) as source,
        coalesce(page_depth < {depth}, false) as parse
      from visits v join (select url, html from rich_pages union all select url, body from js_assets) c on c.url = v.url
      left join (select input, lower(trim(url)) as k, arg_min(provider, page_no) as provider from passive group by 1, 2) p
        on p.input = v.input and p.k = lower(trim(v.url)))""".replace("{depth}", str(depth))
    records = f"""recs as (
      select input, source, type, url, seen_set, step, origin, pos from found where step < 4
      union all select f.input, f.source, f.type, f.url, f.seen_set, step, origin, pos from found f join fetched x on x.url = f.origin
        and x.input = f.input where f.step >= 4 and x.parse
      union all select input, 'sitemap', 'sitemap', url, 'page', 9, '', 0 from maps
      union all select input, 'robots', 'robots', url, 'page', 10, '', 0 from rs
      union all select input, provider, 'passive-' || provider, url, 'page', 8, '', 0 from passive)"""
    return visits, fetched, S.discoveries("found", "fetched"), records


@query("site_report", over_records(f"""
    {summary_lines('counted')} union all select input, 6, provider, {S.provider_label('provider')}, count(*) from passive
    group by 1, 3""", EDGES, LISTED, states_sql("select * from all_roots", 1), *report_sql(1),
    f"""winners as (select input, type, url from recs
      qualify row_number() over (partition by input, seen_set = 'form', lower(url) order by step, origin, pos, type) = 1)""",
    f"counted as (select input, {COUNTS} from winners group by input)"))
def site_report_(spark, d):
    return site_report(rich_captures(spark, d), domain_seeds(spark, d), *listed(spark, d), max_depth=1)


# -- streams ----------------------------------------------------------------------------------------------------------

def _pages_stream(spark, d):
    """The pages table as a stream of several files, taken two at a time."""
    folder = fresh_path(spark, "stream-in")
    X.table(spark, d, "pages").repartition(6, "page_id").write.parquet(folder)
    return ST.capture_stream(spark, folder, 2)


def _status_and_source(pages):
    k = F.col("page_id") % 4
    source = F.when(k == 3, "otx").when(k == 2, "wayback").otherwise("body")
    return pages.withColumns({"status": F.lit(200), "source": source})


@query("stream_first_seen", S.with_(
    S.exploded("tags", "pages", S.tags("html"), "tag", "pos", "page_id, url as page, html"),
    f"anchors as (select page, {S.attr('tag', 'href')} as href from tags where regexp_matches(tag, '(?i)^<a\\b'))",
    S.resolved("links", "anchors", "page", "href", "url")) + "select distinct trim(lower(url)) as url_key from links")
def stream_first_seen(spark, d):
    path = fresh_path(spark, "first-seen")
    ST.stream_first_seen(_pages_stream(spark, d), path, fresh_path(spark, "state")).awaitTermination()
    return spark.read.schema("url_key string").parquet(path)


PLAIN_RECORDS = ",\n".join([
    "plain as (select page_id, url, html, 0 as level, case when page_id % 4 = 3 then 'otx' when page_id % 4 = 2 then "
    f"'wayback' else 'body' end as source, 'https://' || {X.HOST} as input, {S.domain('url')} as dom from pages)",
    S.discoveries("disc", "plain")])


@query("stream_counts", S.with_(PLAIN_RECORDS) + """
    select type, case type when 'linkfinder' then 'linkfinder' else source end as source, count(*) as records
    from disc group by 1, 2""")
def stream_counts(spark, d):
    path = fresh_path(spark, "counts")
    ST.stream_counts(_status_and_source(_pages_stream(spark, d)), path, fresh_path(spark, "state")).awaitTermination()
    return ST.read_counts(spark, path)


# Each URL is observed three times: by its page's source, by a source that was there earlier, and by one that was later.
@query("stream_attribution", """
    select url_key, source from (select trim(lower(url)) as url_key, seen_at, source from (
      select url, '20240301' as seen_at, case when page_id % 4 = 3 then 'otx' when page_id % 4 = 2 then 'wayback' else 'body' end as source from pages
      union all select upper(url), '20240401', 'shodan' from pages
      union all select ' ' || url, case when page_id % 3 = 0 then '20240101' end, 'censys' from pages))
    qualify row_number() over (partition by url_key order by coalesce(seen_at, '9'), source) = 1""")
def stream_attribution(spark, d):
    pages = X.table(spark, d, "pages").select("page_id", "url")
    folder = fresh_path(spark, "stream-in")
    own = _status_and_source(pages).withColumn("captured_at", F.lit("20240301"))
    later = pages.withColumns({"url": F.upper("url"), "source": F.lit("shodan"), "captured_at": F.lit("20240401")})
    early = F.when(F.col("page_id") % 3 == 0, F.lit("20240101"))
    some = pages.withColumns({"url": F.concat(F.lit(" "), "url"), "source": F.lit("censys"), "captured_at": early})
    seen = [own, later, some]
    for rows in seen:  # the files of one source come before those of the next
        rows.select("url", "source", "captured_at").repartition(2, "url").write.mode("append").parquet(folder)
    path = fresh_path(spark, "attribution")
    ST.stream_attribution(ST.capture_stream(spark, folder, 1), path, fresh_path(spark, "state")).awaitTermination()
    return ST.read_attribution(spark, path)


@query("stream_sink", S.with_(PLAIN_RECORDS) + f"select '[' || {S.clean_tag('type', 'url')} || '] ' || url as line from disc")
def stream_sink(spark, d):
    path = fresh_path(spark, "lines")
    captures = _status_and_source(_pages_stream(spark, d))
    ST.stream_sink(captures, path, fresh_path(spark, "state")).awaitTermination()
    return spark.read.text(path).select(F.col("value").alias("line"))
