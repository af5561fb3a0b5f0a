import random
import re
import time
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

from pyspark.sql import functions as F

from webloom import fixtures as X
from webloom.fixed_values import BUCKET_FORMS, DNS_LABEL, SCRIPT_LINK
from webloom.functions import text as T
from webloom.operators import extract as E
from webloom.sources import captures as C
from webloom.plans.discoveries import page_discoveries

PAGE = """<!-- <a href="/no">x</a> --><script>var a='<a href="/no2">';</script><style><a href="/no3"></style>
<A data-href="/no4" title="x href=/no5 >" HREF='/yes1?a=1&amp;b=2'>1</A><a href=yes2>2</a><a href="">e</a><a name="n">n</a>
<a href = "mailto:x@y">m</a><abbr href="/no6"></abbr><a class=b href="//cdn.ex.com/é">3</a><a href="/one" href="/two">t</a>
<form method=post action="/f"><INPUT name=u TYPE=file></form><form>none</form><input type="FILE">
<script src="/js/a.min.js"></script><link href="/x.js"><link src="b.JS?x"><script src="c.css"></script>"""


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.links = []

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.links.append(href)


def pages_of(spark, *htmls):
    rows = [(i, f"https://m.ex.com/p{i}/x", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def urls(df):
    return [r.url for r in df.orderBy("page_id", "pos").collect()]


def test_tags_and_attributes(spark):
    pages = pages_of(spark, PAGE)
    base = "https://m.ex.com/p0/x"
    found = ["/yes1?a=1&b=2", "yes2", "mailto:x@y", "//cdn.ex.com/é", "/two"]
    assert urls(E.extract_links(pages)) == [urljoin(base, u) for u in found]
    assert urls(E.extract_scripts(pages)) == [urljoin(base, u) for u in ("/js/a.min.js", "b.JS?x")]
    assert urls(E.extract_scripts(pages, ["css"])) == [urljoin(base, "c.css")]
    assert urls(E.extract_forms(pages)) == [base]
    assert urls(E.extract_upload_forms(pages)) == [base]
    assert urls(E.extract_upload_forms(pages_of(spark, '<input type="FILE">'))) == []


def test_links_agree_with_an_html_parser(spark, data):
    pages = X.derived(spark, data, "rich_pages")
    got = {}
    for r in E.extract_links(pages).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.url)
    for r in pages.collect():
        parser = Anchors()
        parser.feed(r.html)
        assert got.get(r.page_id, []) == [urljoin(r.url, h) for h in parser.links]


def test_long_tag_and_long_name_do_not_overflow(spark):
    tag = "<a " + "x=1 " * 50_000 + 'href="/deep">'
    name = "ab." * 100_000 + "ex.com"
    pages = pages_of(spark, tag + name).withColumn("domain", F.lit("ex.com"))
    assert urls(E.extract_links(pages)) == ["https://m.ex.com/deep"]
    sub = E.extract_subdomains(pages.select("html", "domain"), "html", F.col("domain")).first()
    assert sub.sub == name


def test_names_are_cleaned(spark):
    pairs = [(" A.ex.com ", "a.ex.com"), ("*.b.ex.com", "b.ex.com"), ("2f2Fc.ex.com", "c.ex.com"), ("20.d.ex.com", "d.ex.com"),
             ("-e.ex.com-", "e.ex.com"), ("3ax", "x"), (".", ""), ("25-f", "f")]
    df = spark.createDataFrame(pairs, "name string, clean string")
    assert [r for r in df.select("name", "clean", T.clean_subdomain(F.col("name")).alias("got")).collect() if r.got != r.clean] == []


def test_subdomains_agree_with_a_backtracking_search(spark):
    rng = random.Random(7)
    domains = ["ex.com", "a.a", "b", "ex.com.ex"]
    tokens = ["a", "B", "_", "-", ".", ".", "ex.com", "EX.com", "x" * 30, "y" * 63, "z" * 64, "20", "2F", "*", "/", " ",
              "é", "ex", ".com", "com", "9-", "a.a", "x."]
    rows = [("".join(rng.choices(tokens, k=rng.randint(2, 14))), rng.choice(domains)) for _ in range(20000)]
    df = spark.createDataFrame(rows, "t string, d string")
    found = {(t, d): [m.group(0) for m in re.finditer(f"(?i)(?:{DNS_LABEL}[.])+" + re.escape(d), t)] for t, d in rows}
    names = spark.createDataFrame([(n,) for n in {n for ns in found.values() for n in ns}], "name string")
    clean = {r.name: r.clean for r in names.select("name", T.clean_subdomain(F.col("name")).alias("clean")).collect()}
    hits = 0
    for r in df.select("t", "d", E.subdomain_array(F.col("t"), F.col("d")).alias("s")).collect():
        expected = list(dict.fromkeys(s for n in found[r.t, r.d] if (s := clean[n]) and s != r.d))
        hits += bool(expected)
        assert r.s == expected
    assert hits > 300


def test_buckets_agree_with_an_unanchored_search(spark):
    rng = random.Random(8)
    pattern = re.compile("(?i)" + "|".join(BUCKET_FORMS))
    tokens = ["a", ".", "-", "/", "//", ".s3.amazonaws.com", ".s3-e.amazonaws.com", ".s3-website-us", ".s3-website.eu",
              "//s3.amazonaws.com/", "//s3-eu-1.amazonaws.com/", "b", " ", "%2F", "s3.amazonaws.com", "x_"]
    rows = [("".join(rng.choices(tokens, k=rng.randint(2, 10))),) for _ in range(5000)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select("t", E.bucket_array(F.col("t")).alias("b")).collect():
        assert r.b == list(dict.fromkeys(unquote(m.group(0)) for m in pattern.finditer(r.t)))


def test_script_links(spark):
    text = ("var a=\"/api/v1/users?id=1\",b='https://cdn.ex.com/app.min.js',c=\"rel/path/file.php?x=1\","
            "d=\"foo/barbaz\",e=\"main.js\",f=\"main.js\";")
    df = spark.createDataFrame([(0, "https://ex.com/js/x.js", "https://www.ex.com", text)],
                               "page_id int, url string, site string, body string")
    links = [r.link for r in E.extract_js_links(df).orderBy("pos").collect()]
    assert links == ["/api/v1/users?id=1", "https://cdn.ex.com/app.min.js", "rel/path/file.php?x=1", "foo/barbaz", "main.js"]
    got = [(r.type, r.url, r.link_file) for r in E.js_link_records(df).orderBy("pos").collect()]
    assert got == [
        ("linkfinder", "https://ex.com/api/v1/users?id=1", False),
        ("linkfinder", "https://www.ex.com/api/v1/users?id=1", False),
        ("javascript", "https://cdn.ex.com/app.min.js", True),
        ("linkfinder", "https://ex.com/js/rel/path/file.php?x=1", False),
        ("linkfinder", "https://www.ex.com/rel/path/file.php?x=1", False),
        ("linkfinder", "https://ex.com/js/foo/barbaz", False),
        ("linkfinder", "https://www.ex.com/foo/barbaz", False),
        ("javascript", "https://ex.com/js/main.js", True),
        ("linkfinder", "https://www.ex.com/main.js", True),
    ]
    siblings = E.unminified_js(spark.createDataFrame([("/a.min.js",), ("/b.js",)], "url string")).collect()
    assert [(s.url, s.sibling) for s in siblings] == [("/a.min.js", "/a.js")]


def test_one_pass_gives_what_the_single_extractors_give(spark, data):
    pages = X.derived(spark, data, "rich_pages")
    whole = page_discoveries(pages.withColumns({"status": F.lit(200), "source": F.lit("body")}))
    for kind, step, part in (("href", 4, E.extract_links(pages)), ("javascript", 7, E.extract_scripts(pages)),
                             ("form", 5, E.extract_forms(pages)), ("upload-form", 6, E.extract_upload_forms(pages))):
        mine = whole.filter(f"type = '{kind}' AND step = {step}").select("page_id", "url")
        assert sorted(mine.collect()) == sorted(part.select("page_id", "url").collect())


def test_error_pages_give_no_records(spark):
    pages = pages_of(spark, PAGE).withColumns({"status": F.lit(404), "source": F.lit("body")})
    assert page_discoveries(pages).count() == 0


def test_hostile_pages_do_no_harm(spark):
    reference = '<a href="/q?x=&#99999999999999999999999;y">x</a><a href="/z">'
    assert [u[-2:] for u in urls(E.extract_links(pages_of(spark, reference)))] == ["\ufffdy", "/z"]
    apostrophe = """<a href="/one" title=it's>x</a><a href="/two" title="it's"><a title=' href="/three">"""
    assert [u.rsplit("/", 1)[1] for u in urls(E.extract_links(pages_of(spark, apostrophe)))][:2] == ["one", "two"]
    for open_one in ("<script>", "<!--", "<style>", "<a href='", "<a x="):
        seconds = []
        for n in (20_000, 40_000):
            page = pages_of(spark, '<a href="/first">' + open_one * n)
            began = time.perf_counter()
            assert urls(E.extract_links(page))[0].endswith("/first")
            seconds.append(time.perf_counter() - began)
        assert seconds[1] < 3 * seconds[0] + 2


def test_open_sitemap_elements_are_read_once(spark):
    for element in ("<url>", "<url><loc>", "<loc>"):
        body = spark.createDataFrame([("<urlset><url><loc>http://ex.com/a</loc></url>" + element * 40_000,)], "x string")
        began = time.perf_counter()
        assert body.select(C.element_texts(F.col("x"), "url").alias("u")).first().u[0] == "http://ex.com/a"
        assert time.perf_counter() - began < 10


def test_string_links_agree_with_the_plain_pattern(spark):
    rng = random.Random(12)
    tokens = ['"', "'", "/", "//", "../", "./", "a", "Zz", "ab.cd", ".", "http://", "x:", "-", "_", "?q=1", "#", "|", ".php", ".json", ".js", "action", ".abcd",
              " ", "(", "%41", ">", "\n", "é", ";", "=", "9", "\\"]
    rows = [("".join(rng.choices(tokens, k=rng.randint(3, 16))),) for _ in range(8000)]
    rows += [(q + "".join(rng.choices(tokens[2:22], k=rng.randint(1, 6))) + q,) for q in "\"'" for _ in range(9000)]
    df, pattern = spark.createDataFrame(rows, "t string"), re.compile(SCRIPT_LINK)
    hits = 0
    for r in df.select("t", F.regexp_extract_all("t", F.lit(E.STRING_LINK), F.lit(1)).alias("b")).collect():
        want = [m.group(1) for m in pattern.finditer(r.t)]
        hits += len(want)
        assert r.b == want, r.t
    assert hits > 1500


def test_script_scan_is_linear(spark):
    for head, piece in (('"', "a/"), ('"', "a"), ('"//', "a."), ('"', "a/b?"), ('"/', "(")):
        seconds = []
        for n in (200_000, 400_000):
            asset = spark.createDataFrame([(1, head + piece * n + ">'x/index.js'")], "page_id int, body string")
            began = time.perf_counter()
            assert E.extract_js_links(asset).orderBy(F.desc("pos")).first().link == "x/index.js"
            seconds.append(time.perf_counter() - began)
        assert seconds[1] < 3 * seconds[0] + 2, piece


def test_names_of_runs_are_names_of_the_text(spark):
    rng = random.Random(5)
    tokens = ["a", "B-c", ".", "..", "ex.com", "EX.com", "x_y", "-", "/", " ", "é", "www.", "%2f", "\xa0", "ex.community", "@", ":", "1", "longer-label."]
    rows = [(i, "".join(rng.choices(tokens, k=rng.randint(2, 14)))) for i in range(9000)]
    df = spark.createDataFrame(rows, "i int, t string")
    whole = df.select("i", F.explode(E.subdomain_array(F.col("t"), F.lit("ex.com")))).distinct()
    runs = df.select("i", F.explode(E.name_runs(F.col("t"))).alias("run"))
    by_run = runs.select("i", F.explode(E.subdomain_array(F.col("run"), F.lit("ex.com")))).distinct()
    assert sorted(whole.collect()) == sorted(by_run.collect()) and whole.count() > 1000
    began = time.perf_counter()
    long = spark.createDataFrame([("a" * 2_000_000 + " " + "a." * 500_000 + " " + "." * 1_000_000,)], "t string")
    assert long.select(F.size(E.name_runs(F.col("t")))).first()[0] == 1
    assert time.perf_counter() - began < 20


def test_character_references_of_attributes(spark):
    pairs = [("a&apos;b", "a'b"), ("&colon;&sol;&sol;", "://"), ("&#150;", "\u2013"), ("&#x80;&#129;", "\u20ac\x81"), ("&copy=1&copy;&copyx&copy", "&copy=1\xa9&copyx\xa9"),
             ("?a=1&lang=en&amp=2&amp;b", "?a=1&lang=en&amp=2&b"), ("&notit;&notin;", "&notit;\u2209"), ("&NotEqualTilde;", "\u2242\u0338"), ("&#0;&#xD800;&#1114112;", "\ufffd" * 3),
             ("&", "&"), ("&;&#;&#x;", "&;&#;&#x;"), ("&bogus;&AMP;&Auml", "&bogus;&\xc4"), ("&amp&lt", "&<")]
    df = spark.createDataFrame(pairs, "t string, want string")
    for r in df.select("t", "want", T.unescape_html(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t
    names = [(n, t) for n, t in html5.items() if n.endswith(";")]
    df = spark.createDataFrame([(f"<&{n}>", f"<{t}>") for n, t in names], "t string, want string")
    assert len(names) > 2000 and df.filter(T.unescape_html(F.col("t")) != F.col("want")).count() == 0
