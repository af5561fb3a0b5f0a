import json

from pyspark.sql import functions as F

from webloom.operators import report as R

SCHEMA = "input string, source string, type string, url string, status int, length long, `from` string"
ROWS = [
    ("https://orchard.test", "body", "url", "https://orchard.test/pears", 200, 1234567, None),
    ("https://orchard.test", "body", "subdomains", "http://trees.orchard.test", None, None, None),
    ("https://orchard.test", "body", "subdomains", "https://trees.orchard.test", None, None, None),
    ("https://orchard.test", "body", "subdomains", "http://orchard.test", None, None, None),
    ("https://orchard.test", "body", "javascript", "https://orchard.test/lib/grow.js", None, None, None),
    ("https://orchard.test", "body", "javascript", "https://orchard.test/leaf.css", None, None, None),
    ("https://orchard.test", "body", "javascript", "https://orchard.test/map.html", None, None, None),
    ("https://orchard.test", "body", "aws-s3", "https://crates.s3.amazonaws.com/file", None, None, None),
    ("https://orchard.test", "body", "href", "https://dq7.cloudfront.net/file", None, None, "x" * 60),
    ("https://orchard.test", "wayback", "passive-wayback", "https://orchard.test/autumn", None, None, None),
    ("https://orchard.test", "otx", "passive-otx", "https://orchard.test/press", None, None, ""),
    ("https://orchard.test", "https://orchard.test/a.js", "linkfinder", "https://orchard.test/é", None, None, "y"),
    ("https://orchard.test", "body", "upload-form", "https://orchard.test/up", None, None, None),
]


def records(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def lines(df):
    return [r.line for r in df.collect()]


def test_clean_lines(spark):
    tags = ["URL", "SUBDOMAIN", "SUBDOMAIN", "SUBDOMAIN", "JAVASCRIPT", "CSS", "HTML", "AWS S3", "AWS CloudFront", "URL", "URL",
            "URL", "FORM"]
    assert lines(R.format_clean(records(spark))) == [f"[{t}] {r[3]}" for t, r in zip(tags, ROWS)]


def test_standard_lines(spark):
    got = lines(R.format_standard(records(spark), show_length=True))
    assert got[0] == "[WEB] [1,234,567 bytes] https://orchard.test/pears [200]"
    assert got[1] == "[WEB] [SUBDOMAINS] http://trees.orchard.test"
    assert got[4] == "[WEB] [JAVASCRIPT] https://orchard.test/lib/grow.js"
    assert got[8] == f"[WEB] [from: {'x' * 60}] https://dq7.cloudfront.net/file"
    assert got[9] == "[Wayback Machine] https://orchard.test/autumn"
    assert got[10] == "[OTX] https://orchard.test/press"
    assert got[11] == "[HTTPS://ORCHARD.TEST/A.JS] [from: y] https://orchard.test/é"
    assert got[12] == "[WEB] [UPLOAD_FORM] https://orchard.test/up"
    assert lines(R.format_standard(records(spark)))[0] == "[WEB] https://orchard.test/pears [200]"


def test_json_and_quiet_lines(spark):
    got = [json.loads(x) for x in lines(R.format_json(records(spark)))]
    assert got[0] == {"input": "https://orchard.test", "source": "body", "type": "url", "url": "https://orchard.test/pears",
                      "status": 200, "length": 1234567}
    assert "from" not in got[10] and got[11]["from"] == "y" and "status" not in got[1]
    assert lines(R.format_quiet(records(spark))) == [r[3] for r in ROWS]


def test_summary(spark):
    counts = spark.createDataFrame([("https://orchard.test", "wayback", 50), ("https://orchard.test", "otx", 10),
                                    ("https://orchard.test", "shodan", 0), ("https://orchard.test", "mine", 1)],
                                   "input string, provider string, urls long")
    summary = R.summary_text(R.crawl_summary(records(spark), counts)).orderBy("input", "ord", "metric_key")
    assert lines(summary) == ["URLs discovered: 5", "Subdomains found: 1", "JavaScript files: 3", "Forms found: 1",
                              "AWS S3 Buckets: 1", "AWS CloudFront URLs: 1", "Mine: 1 Urls", "OTX: 10 Urls",
                              "Wayback machine: 50 Urls"]
    assert R.count_aws(records(spark), strict=True).first().aws_s3 == 2


def test_text_sink_appends(spark, tmp_path):
    path = str(tmp_path / "new" / "out")
    for _ in range(2):
        R.sink_text(R.format_quiet(records(spark).limit(3)), path)
    assert spark.read.text(path).filter(F.col("value").startswith("http")).count() == 6
