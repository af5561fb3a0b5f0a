import json

from pyspark.sql import functions as F

from webloom.sources import captures as C
from webloom.sources import providers as V


def payloads(spark, *answers, domain="ex.com"):
    rows = [(domain, i, p, a if isinstance(a, str) else json.dumps(a)) for i, (p, a) in enumerate(answers)]
    return spark.createDataFrame(rows, "domain string, part long, page_no long, payload string")


def urls(df):
    return [r.url for r in df.orderBy("page_no", "part", "pos").collect()]


def test_seeds(spark, tmp_path):
    (tmp_path / "sites.txt").write_text(" ex.com \n\nhttp://A.b.Ex.com:8/x\nHTTP://q\n")
    rows = C.read_seeds(C.load_seed_lines(spark, str(tmp_path / "sites.txt"))).collect()
    assert [(r.site, r.host, r.domain) for r in rows] == [
        ("https://ex.com", "ex.com", "ex.com"), ("http://A.b.Ex.com:8/x", "a.b.ex.com", "ex.com"),
        ("https://HTTP://q", "http", "http")]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /a\r\nallow: b/../c\nDisallow:\nDISALLOW: \nx Allow: y Disallow: /z#f"
    df = spark.createDataFrame([("https://ex.com/robots.txt", body, 200), ("https://no.com/robots.txt", body, 404)],
                               "url string, body string, status int")
    got = [r.url for r in C.read_robots(df).orderBy("pos").collect()]
    assert got == ["https://ex.com/a", "https://ex.com/c", "https://ex.com", "https://ex.com/z#f"]


def test_sitemaps(spark):
    one = ("<urlset xmlns='x'><url>\n<image:loc>no</image:loc><loc>https://ex.com/a?b=1&amp;c=2</loc></url>"
           "<url><loc><![CDATA[https://ex.com/&amp;]]></loc></url><url><loc></loc></url></urlset>")
    index = ("<sitemapindex><sitemap><loc>https://ex.com/one.xml</loc></sitemap>"
             "<sitemap><loc>https://ex.com/index.xml</loc></sitemap></sitemapindex>")
    df = spark.createDataFrame([("https://ex.com/one.xml", one), ("https://ex.com/index.xml", index)], "url string, body string")
    listed = ["https://ex.com/a?b=1&c=2", "https://ex.com/&amp;"]
    assert [r.url for r in C.read_sitemap(df).orderBy("pos").collect()] == listed
    assert [r.url for r in C.read_sitemap_index(df.filter("url LIKE '%index.xml'"), df).orderBy("pos").collect()] == listed


def test_wayback(spark):
    header = ["urlkey", "timestamp", "original", "statuscode"]
    table = [header, ["k", "20240101000000", "http://EX.com:80/b", "200"], ["k", "20240201000000", "http://ex.com/b", "200"],
             ["k", "20240301000000", "http://ex.com/c", "404"], ["x", "y"], ["k", "20240401000000", "http://ex.com/a", "200"]]
    df = payloads(spark, (0, table), (0, "broken"), (0, [header]), (0, [["a", "b", "c"], ["1", "2", "http://ex.com/plain"]]))
    assert urls(V.read_wayback(df)) == ["http://ex.com/b", "http://ex.com/a", "http://ex.com/plain"]
    # a table without timestamps passes a date range
    assert urls(V.read_wayback(df, since="20240315000000", until="20240401000000")) == ["http://ex.com/a", "http://ex.com/plain"]
    assert urls(V.read_wayback(df, status="404")) == ["http://ex.com/c", "http://ex.com/plain"]
    assert urls(V.read_wayback(df, cap=2)) == ["http://ex.com/b"]


def test_otx_stops_like_a_page_reader(spark):
    def page(n, more=True, items=1):
        return {"url_list": [{"url": f"http://ex.com/{n}"}] * items, "has_next": more}

    assert urls(V.read_otx(payloads(spark, (1, page(1, False)), (0, page(0)), (2, page(2))))) == [
        "http://ex.com/0", "http://ex.com/1"]
    assert urls(V.read_otx(payloads(spark, (0, page(0)), (1, page(1, items=0)), (2, page(2))))) == ["http://ex.com/0"]
    assert urls(V.read_otx(payloads(spark, (0, page(0)), (1, "broken"), (2, page(2))))) == ["http://ex.com/0"]
    assert urls(V.read_otx(payloads(spark, (99, page(99)), (100, page(100))))) == ["http://ex.com/99", "http://ex.com/100"]


def test_urlscan_pages(spark):
    def page(n, total):
        return {"results": [{"page": {"url": f"http://ex.com/{n}"}}, {"task": {}}], "total": total}

    answers = [(n, page(n, 250)) for n in range(5)]
    assert urls(V.read_urlscan(payloads(spark, *answers))) == [f"http://ex.com/{n}" for n in range(3)]
    assert urls(V.read_urlscan(payloads(spark, *[(n, page(n, 100)) for n in range(3)]))) == ["http://ex.com/0"]
    assert len(urls(V.read_urlscan(payloads(spark, *[(n, page(n, 9999)) for n in range(15)])))) == 15
    assert urls(V.read_urlscan(payloads(spark, (1, page(1, 999))))) == []


def test_buckets(spark):
    answer = {"files": [
        {"url": "", "path": "/d/ex.com.txt", "bucket": "plain"}, {"full_path": "k/ex.com", "bucket_name": "My-S3.host"},
        {"link": "http://other.com/", "bucket_url": "http://ex.com.bucket/"}, {"file_url": "bare/ex.com"}, {"n": 1}],
        "results": [{"url": "http://ex.com/ignored"}]}
    got = urls(V.read_buckets(payloads(spark, (0, answer), (0, [{"url": "http://ex.com/top"}]))))
    assert got == ["https://plain.s3.amazonaws.com/d/ex.com.txt", "https://My-S3.host/k/ex.com".replace("My-S3", "my-s3"),
                   "http://ex.com.bucket/", "bare/ex.com", "http://ex.com/top"]


def test_shodan_and_censys(spark):
    shodan = {"matches": [{"hostnames": ["ex.com", "o.test"], "ip_str": "1.1.1.1", "port": 443},
                          {"hostnames": [], "ip_str": "2.2.2.2", "port": 8080}, {"ip_str": "3.3.3.3"}, {"port": 1}]}
    assert urls(V.read_shodan(payloads(spark, (0, shodan)))) == [
        "https://ex.com/", "https://o.test/", "http://2.2.2.2:8080/", "http://3.3.3.3/"]
    assert "https://o.test/" not in urls(V.read_shodan(payloads(spark, (0, shodan)), no_subs=True))
    names = {"certificates": {"leaf_data": {"subject": {"common_name": ["a.ex.com", "b.test"]}}}}
    censys = {"result": {"hits": [{"ip": "9.9.9.9", "services": [
        {"port": 8443, "service_name": "X", "tls": names}, {"port": 81, "service_name": "HTTP"},
        {"port": 22, "service_name": "ssh", "tls": names}, {"service_name": "z"}]}]}}
    assert urls(V.read_censys(payloads(spark, (0, censys)))) == [
        "https://a.ex.com/", "https://b.test/", "https://9.9.9.9/", "http://9.9.9.9:81/"]


def test_passive_order_filter_and_strip(spark):
    vt = {"detected_urls": [{"url": "http://ex.com/A?x=1"}, {"url": "http://ex.com/a?x=2"}, {"url": "http://ex.com/p.gif?q"}]}
    cc = payloads(spark, (0, {"url": "http://ex.com/a?x=1"}), (0, {"url": "http://ex.com/z.gif"}))
    both = {"virustotal": payloads(spark, (0, vt)), "commoncrawl": cc}
    got = {(r.url, r.provider) for r in V.passive_discoveries(both, blacklist_ext="GIF").collect()}
    assert got == {("http://ex.com/a?x=1", "commoncrawl"), ("http://ex.com/a?x=2", "virustotal"),
                   ("http://ex.com/p.gif?q=", "virustotal")}
    got = {(r.url, r.provider) for r in V.passive_discoveries(both, blacklist_ext=["gif"], filter_params=True).collect()}
    assert got == {("http://ex.com/a", "commoncrawl"), ("http://ex.com/p.gif", "virustotal")}
    assert V.union_providers(both, ["VirusTotal", "nobody"]).select("provider").distinct().collect()[0][0] == "virustotal"


def test_pick_crawl_index(spark):
    lists = spark.createDataFrame([('[{"id": "new"}, {"id": "old"}]',), ("[]",), ("oops",)], "payload string")
    assert [r.index_id for r in V.pick_crawl_index(lists).collect()] == ["new", "CC-MAIN-2023-23", "CC-MAIN-2023-23"]


def test_payload_lines(spark, tmp_path):
    (tmp_path / "cc.jsonl").write_text('{"url": "http://ex.com/b", "timestamp": "2024"}\nbad\n{"url": "http://ex.com/a"}\n')
    df = V.load_payloads(spark, str(tmp_path / "cc.jsonl"), "ex.com")
    assert urls(V.read_commoncrawl(df)) == ["http://ex.com/b", "http://ex.com/a"]
    assert df.filter(F.col("domain") == "ex.com").count() == 3


def test_caps_cut_each_provider_and_domain(spark):
    vt = [(0, {"detected_urls": [{"url": f"http://ex.com/{i}"} for i in range(9)]})]
    both = {"virustotal": payloads(spark, *vt).unionByName(payloads(spark, *vt, domain="o.com")),
            "commoncrawl": payloads(spark, (0, {"url": "http://ex.com/cc"}))}
    rows = V.passive_discoveries(both, caps={"virustotal": 4, "otx": 1}).groupBy("domain", "provider").count().collect()
    assert {(r.domain, r.provider): r["count"] for r in rows} == {
        ("ex.com", "virustotal"): 4, ("o.com", "virustotal"): 4, ("ex.com", "commoncrawl"): 1}
