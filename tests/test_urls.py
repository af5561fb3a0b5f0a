import html
import os
import re
from urllib.parse import parse_qsl, unquote, urlencode, urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U

BASES = ["https://m.ex.com/a/b/c?x=1#f", "http://h", "http://h/", "https://u@h:8/a//b/;p?q", "https://h/x;k=1/y;z=2?a"]
LINKS = [
    "d", "/d", "../d", "../../../d", "//o/d", "?q=2", "#z", "", "./d", "d/./e/../f", "d;p=1", "mailto:a@b",
    "javascript:void(0)", "data:,x", "tel:1", "ftp://x/y", "HTTP://X/y", "https://X/y?#", "..", "../", "/..",
    "/../../a/..", "/x/../..//y", "a//b", "//", "///x", "http:foo", "https:foo/../b", ";p", "..;p", "d;", "a\tb\n",
    " x ", "[x", "//[x", "//[::1]/x", "?", "#", "/a/./", "a:b", "1:2", "//o/../x", "../..//a/./b/../c/",
    "/a;b/c;d?e=1;2#f?g", "%zz", "é/ü?ö#ä",
]
URLS = [
    "HTTP://Ex.COM:80//a//b/?b=2&a=1&a=0&c=#f", "https://h", "http://h:443/x", "https://h/a%20b?q=a%20b+c",
    "https://u:p@h:443/", "https://H:443", "http://h:80?x", "http://h/a;b//c;d?&&a&b=&=c&a=b=c",
    "https://h/?x=%zz&y=%C3%A9&z=é*~!'()", "ftp://H/x?b&a", "https://h/?", "https://h/#", "https://h:443:443/",
]


def one(spark, values, schema="u string"):
    return spark.createDataFrame([(v,) for v in values], schema)


def test_resolve_url_agrees_with_urljoin(spark):
    def expected(base, link):
        try:
            return urljoin(base, link)
        except ValueError:
            return ""

    pairs = [(b, link) for b in BASES for link in LINKS]
    got = U.resolve_url(spark.createDataFrame(pairs, "b string, r string"), "b", "r").collect()
    assert len(got) == len(pairs)
    assert [(g.b, g.r, g.url) for g in got if g.url != expected(g.b, g.r)] == []


def test_resolving_an_absolute_url_gives_it_back(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("url", F.lit("https://other.test/x").alias("base"))
    assert U.resolve_url(pages, "base", "url", "out").filter("out <> url AND url LIKE 'https%'").count() == 0


def canonical(url):
    p = urlparse(url)
    scheme, netloc = p.scheme.lower(), p.netloc.lower()
    host, _, port = netloc.partition(":")
    if (scheme, port) in (("https", "443"), ("http", "80")):
        netloc = host
    query = urlencode(sorted(parse_qsl(p.query, keep_blank_values=True)))
    return urlunparse((scheme, netloc, re.sub("/+", "/", p.path or "/"), p.params, query, ""))


def test_normalize_url(spark):
    rows = U.normalize_url(one(spark, URLS + ["mailto:x@y", "plain/text"]), "u").collect()
    got = {r.u: r.canonical for r in rows}
    assert got.pop("mailto:x@y") == "mailto:x@y"
    assert got.pop("plain/text") == "plain/text"
    assert got == {u: canonical(u) for u in URLS}


def test_normalize_url_is_idempotent(spark):
    twice = U.normalize_url(U.normalize_url(one(spark, URLS), "u"), "canonical", "again")
    assert twice.filter("again <> canonical").count() == 0


def test_url_parts(spark):
    names = ["scheme", "netloc", "path", "params", "query", "fragment", "hostname"]
    for r in U.url_parts(one(spark, URLS + BASES), "u").collect():
        p = urlparse(r.u)
        assert [r[n] for n in names] == [getattr(p, n) or "" for n in names]


def test_extension_and_domain(spark):
    paths = ["/a.b/c", "/x.tar.gz", "/.hidden", "/a.JS", "/a.", "/..js", "/a.js;v=1.2", "http://h/x.min.js?q=a.b#c.d"]
    for r in one(spark, paths).select("u", U.url_ext(F.col("u")).alias("e")).collect():
        assert r.e == os.path.splitext(urlparse(r.u).path)[1]
    domains = {"https://U@A.b.Example.com:8/x": "example.com", "http://a.b.co.uk": "co.uk",
               "http://localhost/": "localhost", "mailto:x@y": ""}
    rows = one(spark, domains).select("u", U.registered_domain(F.col("u")).alias("d")).collect()
    assert {r.u: r.d for r in rows} == domains


def test_decode_and_clean(spark):
    texts = ["a%2Fb+c%zz%C3%A9", "\\u002fx\\u0026y\\u002F", "%", "%4", "100%25"]
    for r in one(spark, texts).select("u", T.decode_chars(F.col("u")).alias("d")).collect():
        assert r.d == unquote(r.u).replace("\\u002f", "/").replace("\\u0026", "&")
    names = {"2fwww.example.com": "www.example.com", "20x.example.com": "x.example.com",
             "--a.example.com-": "a.example.com", ".a": "a", ".": ".", "2F3d--.q": "q"}
    rows = one(spark, names).select("u", T.clean_name(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in rows} == names
    rows = one(spark, [" \t*.X.y\n", "a\t\r\nb "]).select(
        T.clean_subdomain(F.col("u")).alias("s"), T.collapse_newlines(F.col("u")).alias("c")).collect()
    assert rows[0].s == "x.y" and rows[1].c == "a b"


def test_character_references(spark):
    texts = ["a&amp;b", "&#65;&#x1F600;x", "&lt;&gt;", "&nosuch;", "&&;", "&eacute;&#233", "plain", "&#0;&#99999999999;"]
    for r in one(spark, texts).select("u", T.unescape_html(F.col("u")).alias("x")).collect():
        assert r.x == html.unescape(r.u)
    kept = one(spark, ["?a=1&copy=2&amp=3"]).select(T.unescape_html(F.col("u")).alias("x")).first().x
    assert kept == "?a=1&copy=2&amp=3"
