import random

from pyspark.sql import functions as F

from webloom.operators import dedup as D
from webloom.operators import filters as P
from webloom.operators import joins as J

URLS = ["https://a.ex.com/x.PNG?v=1", "https://a.ex.com/x.pngs", "http://b.test/?to=a.ex.com", "https://c.test/i.css#t",
        "https://a.ex.com/app.js", "HTTPS://A.EX.COM/"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def kept(df, col="url"):
    return {r[col] for r in df.collect()}


def test_url_filters(spark):
    df = frame(spark, [(u,) for u in URLS], "url string")
    assert kept(P.filter_media_blacklist(df)) == set(URLS) - {URLS[0], URLS[3]}
    assert kept(P.filter_default_scope(df, F.lit("a.ex.com"))) == {URLS[0], URLS[1], URLS[2], URLS[4]}
    assert kept(P.filter_in_scope(df)) == set(URLS)
    assert kept(P.filter_in_scope(df, ["^http:", "js$"])) == {URLS[2], URLS[4]}
    assert kept(P.filter_ext_url(df, "JS, ,pngs")) == set(URLS) - {URLS[1], URLS[4]}
    assert kept(P.filter_ext_path(df, ["png"])) == set(URLS) - {URLS[0]}
    assert kept(P.filter_ext_path(df, None)) == set(URLS)
    seen = frame(spark, [(URLS[4],)], "url string")
    assert kept(P.filter_should_visit(df, seen, F.lit("a.ex.com"))) == {URLS[1], URLS[2]}
    assert kept(P.filter_should_visit(df, seen, F.lit("a.ex.com"), include="(?i)ex", exclude="b[.]")) == {URLS[1], URLS[5]}


def test_row_filters(spark):
    status = frame(spark, [(s,) for s in (99, 100, 200, 301, 399, 400, 404, 429, 500)], "status int")
    assert kept(P.filter_status(status), "status") == {100, 200, 301, 399}
    dates = frame(spark, [("20240101000000",), ("20240601000000",), (None,), ("",)], "timestamp string")
    assert kept(P.filter_date_range(dates, "20240201", None), "timestamp") == {"20240601000000", None, ""}
    assert P.filter_date_range(dates).count() == 4
    depth = frame(spark, [(0,), (1,), (5,)], "depth int")
    assert kept(P.filter_depth(depth, 1), "depth") == {0, 1} and P.filter_depth(depth, 0).count() == 3
    hosts = frame(spark, [("ex.com",), ("a.ex.com",), ("aex.com",)], "host string")
    assert kept(P.filter_subdomain_of(hosts, F.lit("ex.com")), "host") == {"ex.com", "a.ex.com"}
    blank = frame(spark, [("　\t",), ("x",)], "url string")
    assert kept(P.filter_blank_url(blank)) == {"x"}


def records(rng, n):
    return [(rng.choice(["s1", "s2"]), rng.choice(["url", "js"]), rng.choice(["A/x", "a/X ", "b", "hot", "hot", "hot"]),
             rng.randint(0, 2), rng.randint(0, 3), rng.choice("pq"), rng.randint(0, 5), i) for i in range(n)]


def test_first_wins_agrees_with_a_plain_loop(spark):
    rows = records(random.Random(3), 600)
    df = frame(spark, rows, "input string, seen_set string, url string, level int, step int, origin string, pos int, id int")

    def first(key):
        best = {}
        for r in sorted(rows, key=lambda r: (r[3], r[4], r[5], r[6], r[0], r[1], r[2], r[7])):
            best.setdefault(key(r), r)
        return sorted(best.values())

    assert sorted(map(tuple, D.first_wins_global(df).collect())) == first(lambda r: (r[0], r[2].lower().strip()))
    assert sorted(map(tuple, D.first_wins_by_set(df).collect())) == first(lambda r: (r[0], r[1], r[2].lower()))


def test_a_url_counts_once_whatever_lists_it(spark):
    rows = [("s", k, u, 0, n, "", 0, n) for n, (k, u) in enumerate([
        ("page", "http://x/a"), ("url", "http://x/A"), ("js", "http://x/a"), ("form", "http://x/a"), ("form", "http://x/a"),
        ("url", "http://x/b")])]
    df = frame(spark, rows, "input string, seen_set string, url string, level int, step int, origin string, pos int, id int")
    assert sorted(r.id for r in D.first_wins_printed(df).collect()) == [0, 3, 5]


def test_first_wins_combines_before_the_shuffle(spark):
    rows = records(random.Random(4), 50)
    df = frame(spark, rows, "input string, seen_set string, url string, level int, step int, origin string, pos int, id int")
    plan = D.first_wins_global(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_limit_per_group_is_exact_on_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 9)}", rng.randint(0, 10**6), i) for i in range(30000)]
    rows += [(None, 3, -1), ("nulls", None, -2), ("nulls", 1, -3)]
    df = frame(spark, rows, "g string, o int, id int")
    for cap in (40, 2500):
        expected = []
        for g in {r[0] for r in rows}:
            expected += sorted(((r[1] if r[1] is not None else -1, r[2]) for r in rows if r[0] == g))[:cap]
        got = D.limit_per_group(df, ["g"], ["o", "id"], cap).collect()
        assert sorted((r.o if r.o is not None else -1, r.id) for r in got) == sorted(expected)
    places = D.group_thresholds(df, ["g"], ["o", "id"], 2500).collect()
    hot = sorted((r[1], r[2]) for r in rows if r[0] == "hot")
    assert {r.g for r in places} >= {"hot"} and all(2500 <= sum(p <= tuple(r._last) for p in hot) < 4000 for r in places if r.g == "hot")
    same = frame(spark, [("hot", 1, i % 3) for i in range(9000)], "g string, o int, id int")
    assert D.limit_per_group(same, ["g"], ["o", "id"], 2500).groupBy("id").count().collect() == [(0, 2500)]


def test_scope_join_agrees_with_all_pairs(spark):
    rng = random.Random(6)
    hosts = ["ex.com", "a.ex.com", "localhost", "x.com", "10.0.0.1", "ex.co", "m.b-c.de", "a.ex.com"]
    pieces = ["https://", "ex.com", "a.", "/", "?u=", "localhost", "b", ".com", "x", "10.0.0.1", "m.b-c.de", "#", ":8", "é"]
    urls = ["".join(rng.choices(pieces, k=rng.randint(1, 8))) for _ in range(1000)]
    got = J.join_scope_sites(frame(spark, [(u,) for u in urls], "url string"),
                             frame(spark, [(h, i) for i, h in enumerate(hosts)], "host string, n int"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    expected = sorted((u, h, i) for u in urls for i, h in enumerate(hosts) if h in u)
    assert sorted((r.url, r.host, r.n) for r in got.collect()) == expected


def test_scope_join_edges(spark):
    hosts = ["a.co.uk", "amazon.co.uk", ".x.y", "x.", "a..b", "t.co", "é.de", "h", "long-label.example.com", ""]
    urls = ["http://a.co.uk", "http://banana.co.uk.x.yz/", "x." * 40, "", None, "http://long-label.example.com.", "a..b?t.co", "sé.de", "/".join(["a.b"] * 30)]
    got = J.join_scope_sites(frame(spark, [(u, 1) for u in urls], "url string, host int").withColumnRenamed("host", "n"),
                             frame(spark, [(h,) for h in hosts], "host string"))
    assert sorted((r.url, r.host) for r in got.collect()) == sorted((u, h) for u in urls if u is not None for h in hosts if h and h in u)
    no_dots = J.join_scope_sites(frame(spark, [("http://a.b",)], "url string"), frame(spark, [], "host string"))
    assert no_dots.count() == 0


def test_one_capture_of_a_url_is_fetched(spark):
    schema = "url string, html string, status int, captured_at string, page_id int"
    captures = frame(spark, [
        ("u", "old", 200, "2024", 1), ("u", "new", 200, "2025", 2), ("u", "gone", 404, "2026", 3), ("u", "never", None, None, 4),
        ("v", "b", 200, "2025", 5), ("v", "a", 200, "2025", 5), ("v", "a", 200, "2025", 5), ("w", "x", 500, "2025", 6),
        ("n", "one", None, None, None), ("other", "o", 200, "2025", 7)], schema)
    frontier = frame(spark, [("u", 0), ("u", 1), ("v", 0), ("w", 0), ("n", 0), (None, 0)], "url string, depth int")

    def fetched(**options):
        return sorted((r.url, r.depth, r.html) for r in J.join_frontier_pages(frontier, captures, **options).collect())

    assert fetched() == [("n", 0, "one"), ("u", 0, "new"), ("u", 1, "new"), ("v", 0, "a")]
    assert fetched(at="2024") == [("n", 0, "one"), ("u", 0, "old"), ("u", 1, "old")]
    plain = J.join_frontier_pages(frontier, captures.select("url", "html", "status"))
    assert sorted(r.url for r in plain.collect()) == ["n", "u", "u", "v"]
    assert J.join_frontier_pages(frontier, captures.limit(0)).count() == 0
    places = J.join_frontier_pages(frontier, captures)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in places


def test_latest_observation_counts(spark):
    recs = frame(spark, [("url", u, None) for u in "abcde"], "type string, url string, status int")
    log = frame(spark, [("a", "HEAD", 503, "1"), ("a", "HEAD", 200, "2"), ("a", "GET", 404, "3"), ("b", "GET", 200, "1"), ("b", "GET", 500, None),
                        ("c", "HEAD", 200, "1"), ("c", "HEAD", 301, "1"), ("d", "HEAD", None, "9"), ("d", "GET", 204, "1"), ("x", None, 1, None)],
                "url string, method string, status int, observed_at string")
    got = {r.url: r.status for r in J.join_status_check(recs, log).collect()}
    assert got == {"a": 200, "b": 200, "c": 301, "d": 204, "e": None}


def test_status_and_source_lookups(spark):
    recs = frame(spark, [("url", "u1", 200), ("href", "u2", None), ("href", "u3", None), ("form", "u2", None),
                         ("passive-otx", "u4", None)], "type string, url string, status int")
    log = frame(spark, [("u1", "HEAD", 500), ("u2", "HEAD", 301), ("u2", "GET", 200), ("u3", "GET", 404)],
                "url string, method string, status int")
    got = {(r.type, r.url): r.status for r in J.join_status_check(recs, log).collect()}
    assert got == {("url", "u1"): 200, ("href", "u2"): 301, ("href", "u3"): 404, ("form", "u2"): None,
                   ("passive-otx", "u4"): None}
    urls = frame(spark, [("U1", False), ("u2", True), ("u3", False)], "url string, link_file boolean")
    known = frame(spark, [(" u1 ", "otx", 2), ("u1", "shodan", 1)], "url string, source string, rank int")
    got = {r.url: r.source for r in J.join_source_attribution(urls, known).collect()}
    assert got == {"U1": "shodan", "u2": "linkfinder", "u3": "body"}


def test_new_urls_ignore_case_and_blanks(spark):
    urls = frame(spark, [("http://A/x",), ("http://b",)], "url string")
    assert kept(D.new_urls(urls, frame(spark, [(" http://a/X",)], "url string"))) == {"http://b"}
