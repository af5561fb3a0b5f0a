import random

from pyspark.sql import functions as F

from webloom.plans.crawl import Crawl, LinkGraph, crawl, crawl_depth, crawl_roots, link_edges
from webloom.plans.discoveries import names_below, page_finds, with_site
from webloom.plans.site_report import site_records, site_report
from webloom.plans.site_run import listing_files, passive_roots, site_roots, site_run


def walk(edges, roots, limit):
    """Least depth per (site, url, link file), by plain search over all states."""
    seen, todo = {}, [(i, u, False, 0) for i, u in roots]
    while todo:
        site, url, lf, depth = todo.pop()
        if seen.get((site, url, lf), 10**9) <= depth:
            continue
        seen[(site, url, lf)] = depth
        for a, b, kind, to_lf in edges:
            if a == url:
                if kind in ("script_link", "sibling"):
                    todo.append((site, b, to_lf, 0))
                elif not lf and depth < limit:
                    todo.append((site, b, to_lf, depth + 1))
    return seen


def test_crawl_agrees_with_a_plain_search(spark):
    rng = random.Random(11)
    urls = [f"https://ex.com/{i}" for i in range(60)]
    kinds = ["href"] * 8 + ["script", "script_link", "sibling"]
    edges = []
    for _ in range(160):
        kind = rng.choice(kinds)
        to_lf = {"href": False, "script": True, "sibling": True}.get(kind, rng.random() < 0.5)
        edges.append((rng.choice(urls), rng.choice(urls), kind, to_lf))
    edges += [(urls[0], u, "href", False) for u in urls[:20]]  # a page that holds many of the links
    df = spark.createDataFrame(edges, "from_url string, to_url string, kind string, link_file boolean")
    roots = [("https://ex.com", urls[0]), ("https://www.ex.com", urls[5])]
    start = spark.createDataFrame([(i, "ex.com", u) for i, u in roots], "input string, host string, url string")
    sizes = []
    for limit in (1, 2, 4, 0):
        got = {(r.input, r.url, r.link_file): r.depth for r in crawl(df, start, limit).collect()}
        assert got == walk(edges, roots, limit or 10**9)
        sizes.append(len(got))
    assert sizes == sorted(sizes)


def test_scope_media_and_exclude(spark):
    rows = [("https://ex.com/", u) for u in ("https://ex.com/a", "https://o.test/a", "https://ex.com/i.png?x",
                                             "https://o.test/?r=ex.com", "https://ex.com/skip")]
    rows.append(("https://ex.com/a", "https://ex.com/b"))
    edges = spark.createDataFrame(rows, "from_url string, to_url string")
    start = spark.createDataFrame([("https://ex.com", "ex.com", "https://ex.com/")], "input string, host string, url string")
    got = {(r.url, r.depth) for r in crawl_depth(edges, start, 2, exclude="skip").collect()}
    assert got == {("https://ex.com/", 0), ("https://ex.com/a", 1), ("https://o.test/?r=ex.com", 1), ("https://ex.com/b", 2)}
    got = {r.url for r in crawl(edges, start, 1, include="(ex.com/|test/a)$").collect()}
    assert got == {"https://ex.com/", "https://o.test/a"}
    assert crawl(edges, start.limit(0), 1).count() == 0


def capture(spark, rows):
    return spark.createDataFrame([(u, h, s) for u, h, s in rows], "url string, html string, status int")


PAGES = [
    ("https://ex.com", '<a href="/a">a</a><script src="/app.min.js"></script>', 200),
    ("https://ex.com/a", '<a href="/b">b</a><form action="/f"></form> mail.ex.com bk.s3.amazonaws.com', 200),
    ("https://ex.com/b", '<a href="/c">c</a>', 200),
    ("https://ex.com/c", "deep", 200),
    ("https://ex.com/app.min.js", 'x="/api/list";y="https://static.ex.com/lib/u.min.js"', 200),
    ("https://static.ex.com/lib/u.min.js", 'z="data/load.php"', 200),
    ("https://static.ex.com/lib/u.js", "q='rel/one'", 200),
    ("https://ex.com/api/list", '<a href="/more">m</a>', 200),
    ("https://ex.com/gone", '<a href="/never">n</a>', 404),
    ("https://ex.com/old", '<a href="/gone">g</a><a href="https://o.test/?r=ex.com">o</a>', 200),
    ("https://o.test/?r=ex.com", "pay.ex.com and own.o.test", 200),
]


def lists(spark):
    maps = spark.createDataFrame([("https://ex.com", "https://ex.com/gone")], "input string, url string")
    robots = spark.createDataFrame([("https://ex.com", "https://ex.com/private")], "input string, url string")
    passive = spark.createDataFrame([("https://ex.com", "https://ex.com/old", "otx"), ("https://else.com", "https://else.com/", "otx")],
                                    "input string, url string, provider string")
    return maps, robots, passive


def seed(spark):
    return spark.createDataFrame([("https://ex.com", "ex.com", "ex.com")], "site string, host string, domain string")


def test_links_of_scripts_start_again(spark):
    got = {(r.url, r.link_file): r.depth for r in crawl(
        link_edges(page_finds(with_site(capture(spark, PAGES)))), crawl_roots(seed(spark)), max_depth=1).collect()}
    assert got[("https://ex.com/app.min.js", True)] == 1
    assert got[("https://ex.com/api/list", False)] == 0 and got[("https://ex.com/more", False)] == 1
    assert got[("https://static.ex.com/lib/u.min.js", True)] == 0
    assert got[("https://static.ex.com/lib/u.js", True)] == 0  # the plain twin of the minified file
    # a script's relative link is followed on its own address and on the crawled site
    assert got[("https://static.ex.com/lib/data/load.php", False)] == 0 and got[("https://ex.com/data/load.php", False)] == 0
    assert got[("https://static.ex.com/lib/rel/one", False)] == 0
    assert ("https://ex.com/b", False) not in got


def test_site_report(spark):
    records = site_records(capture(spark, PAGES), seed(spark), *[x.limit(1) for x in lists(spark)], max_depth=1)
    rows = {(r.type, r.url): r.source for r in records.collect()}
    assert rows[("url", "https://ex.com/old")] == "otx"
    assert rows[("url", "https://ex.com")] == "body"
    assert rows[("url", "https://ex.com/app.min.js")] == "linkfinder"
    assert ("href", "https://ex.com/b") not in rows  # the page is visited at the last depth, so its links are not read
    assert ("href", "https://ex.com/gone") in rows and ("href", "https://ex.com/never") not in rows
    assert ("subdomains", "http://pay.ex.com") in rows and ("subdomains", "http://own.o.test") not in rows
    assert ("aws-s3", "bk.s3.amazonaws.com") in rows and ("subdomains", "http://mail.ex.com") in rows
    report = site_report(capture(spark, PAGES), seed(spark), *lists(spark), max_depth=2)
    got = {(r.input, r.metric): r.value for r in report.collect()}
    assert got[("https://ex.com", "OTX")] == 1 and ("https://else.com", "OTX") not in got
    assert got[("https://ex.com", "Forms found")] == 1
    assert got[("https://ex.com", "AWS S3 Buckets")] == 1
    assert got[("https://ex.com", "Subdomains found")] == 3  # mail, static and pay
    assert report.select(F.countDistinct("metric")).first()[0] == 7


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_above(plan, relation):
    """Exchanges between the plan's root and the last scan of a relation, by the tree's indentation."""
    lines = plan.splitlines()

    def depth(line):
        return max(line.find("+- "), line.find(":- "))

    at = max(i for i, line in enumerate(lines) if "Scan parquet" in line and relation in line)
    low, found = depth(lines[at]), []
    for line in reversed(lines[:at]):
        if depth(line) < low:
            low = depth(line)
            found.append(line[low + 3:])
    return [x for x in found if "Exchange" in x]


def test_a_round_moves_neither_edges_nor_visited_urls(spark):
    rows = [(f"https://ex.com/{i}", f"https://ex.com/{i * 3 % 50}") for i in range(50)]
    edges = spark.createDataFrame(rows, "from_url string, to_url string")
    roots = spark.createDataFrame([("https://ex.com", "ex.com", "https://ex.com/1")], "input string, host string, url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    walk = Crawl(edges, 0, None, None, ["js"])
    try:
        walk.start(roots)
        walk.round()
        hop = plan_of(walk.graph.hop(walk.visited.rows().filter(F.col("level") == walk.level)))
        assert exchanges_above(hop, walk.graph.table.name) == [] and "Exchange hashpartitioning(from_url" in hop
        better = plan_of(walk.better())
        assert exchanges_above(better, walk.visited.name) == [] and "PartitionFilters: [isnotnull(level" in better
        assert "Exchange hashpartitioning(input" in better and better.count("Bucketed: true") >= 2
        assert plan_of(walk.result()).count("Exchange") == 0  # keys lie together already
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        names = [walk.graph.table.name, walk.visited.name]
        walk.forget()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_pages_with_very_many_links_are_dealt_over_parts(spark):
    urls = [f"https://ex.com/{i}" for i in range(300)]
    pairs = [(urls[0], u) for u in urls] + [(u, urls[(i * 7 + 1) % 300]) for i, u in enumerate(urls) if i % 3 == 0] + [(urls[0], urls[1])] * 50
    edges = spark.createDataFrame(pairs, "from_url string, to_url string")
    roots = spark.createDataFrame([("https://ex.com", "ex.com", urls[0])], "input string, host string, url string")
    graph = LinkGraph(edges, 4, 20)
    parts = {r.part for r in graph.table.rows().filter(F.col("from_url") == urls[0]).select("part").distinct().collect()}
    assert parts == set(range(15)) and graph.table.rows().count() == len(set(pairs))
    graph.table.forget()
    one, many = (sorted(map(tuple, crawl(edges, roots, 3, hot_page=n).collect())) for n in (10**6, 20))
    assert one == many and len(one) > 50


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "from_url string, to_url string")
    roots = spark.createDataFrame([("https://ex.com", "ex.com", "https://ex.com/")], "input string, host string, url string")
    assert [r.depth for r in crawl(edges, roots, 0).collect()] == [0]
    assert crawl(edges, roots.limit(0), 0).count() == 0


def test_site_records_scan_bodies_once(spark, tmp_path):
    path = str(tmp_path / "captures")
    capture(spark, PAGES).write.parquet(path)
    captures = spark.read.parquet(path)
    finds = plan_of(page_finds(captures, names=True))
    assert "Exchange" not in finds and finds.count("FileScan parquet") == 1
    records = plan_of(site_records(captures, seed(spark), *[x.limit(1) for x in lists(spark)], max_depth=1))
    assert "html" not in records and path not in records  # all that comes later reads the small rows


def test_names_below_any_domain(spark):
    pages = capture(spark, [("https://o.test/?r=ex.com", "pay.EX.com Pay.ex.com x.ex.community a.o.test ex.com", 200)])
    finds = page_finds(pages, names=True)
    for domain, want in (("ex.com", ["pay.ex.com", "x.ex.com"]), ("o.test", ["a.o.test"]), ("none.test", [])):
        rows = names_below(finds, F.lit(domain)).filter("text is not null").orderBy("at").collect()
        assert [r.text for r in rows] == want


def test_one_run_gives_records_lines_and_summary(spark):
    maps = "<urlset><url><loc>https://ex.com/listed?a=1&amp;b=2</loc></url></urlset>"
    files = [("https://ex.com/sitemap_index.xml", "<sitemapindex><sitemap><loc>https://ex.com/deep.xml</loc></sitemap></sitemapindex>", 200),
             ("https://ex.com/deep.xml", maps, 200), ("https://ex.com/sitemap.xml", maps.replace("listed", "lost"), 404),
             ("https://ex.com/robots.txt", "Disallow: /hidden\nallow: \nDisallow:none", 200), ("https://ex.com/hidden", '<a href="/found">f</a>', 200)]
    captures = capture(spark, PAGES + files)
    roots = [sorted((r.input, r.url) for r in x.collect()) for x in site_roots(seed(spark), captures)]
    assert roots == [[("https://ex.com", "https://ex.com/listed?a=1&b=2")], [("https://ex.com", "https://ex.com"), ("https://ex.com", "https://ex.com/hidden")]]
    pays = spark.createDataFrame([("ex.com", 0, 0, '{"url_list": [{"url": "https://ex.com/old"}, {"url": "https://s.ex.com/x"}], "has_next": true}'),
                                  ("ex.com", 1, 1, '{"url_list": [{"url": "https://ex.com/later"}], "has_next": false}')],
                                 "domain string, part bigint, page_no bigint, payload string")
    log = spark.createDataFrame([("https://ex.com/listed?a=1&b=2", "HEAD", 204)], "url string, method string, status int")
    run = site_run(captures, seed(spark), {"otx": pays}, log, style="clean", max_depth=2, no_subs=True, pages={"otx": 1})
    rows = {r.url: r for r in run.records.collect()}
    assert rows["https://ex.com/listed?a=1&b=2"].status == 204 and rows["https://ex.com/found"].type == "href"
    assert "https://s.ex.com/x" not in rows and "https://ex.com/later" not in rows and rows["https://ex.com/old"].type == "url"
    assert run.lines.count() == run.records.count() and run.lines.filter("line = '[URL] https://ex.com/found'").count() == 1
    same = site_report(captures, seed(spark), *site_roots(seed(spark), captures), passive_roots(seed(spark), {"otx": pays}, no_subs=True, pages={"otx": 1}), max_depth=2)
    assert sorted(run.summary.collect()) == sorted(same.collect())
    plan = plan_of(listing_files(captures))
    assert "Exchange" not in plan
