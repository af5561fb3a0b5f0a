from pyspark.sql import functions as F

from webloom.functions.urls import url_key
from webloom.operators.extract import extract_links
from webloom.plans.discoveries import page_discoveries
from webloom.streaming import streams as S


def files(spark, data, tmp_path):
    """The pages in several files, some of them twice."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    folder = str(tmp_path / "in")
    pages.repartition(3).write.parquet(folder)
    pages.filter("page_id % 2 = 0").coalesce(1).write.mode("append").parquet(folder)
    return pages, folder


def test_first_seen_over_several_batches(spark, data, tmp_path):
    pages, folder = files(spark, data, tmp_path)
    out = str(tmp_path / "out")
    query = S.stream_first_seen(S.capture_stream(spark, folder, 1), out, str(tmp_path / "state"))
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 3
    got = [r.url_key for r in spark.read.parquet(out).collect()]
    expected = {r[0] for r in extract_links(pages).select(url_key(F.col("url"))).collect()}
    assert len(got) == len(set(got)) and set(got) == expected
    again = S.stream_first_seen(S.capture_stream(spark, folder, 1), out, str(tmp_path / "state"))
    again.awaitTermination()
    assert spark.read.parquet(out).count() == len(got)


def test_counts_attribution_and_lines(spark, data, tmp_path):
    pages, folder = files(spark, data, tmp_path)

    def marked(df):
        return df.withColumns({"status": F.lit(200), "source": F.when(F.col("page_id") % 2 == 1, "otx").otherwise("body")})

    out = str(tmp_path / "counts")
    query = S.stream_counts(marked(S.capture_stream(spark, folder, 2)), out, str(tmp_path / "s1"))
    query.awaitTermination()
    both = page_discoveries(marked(spark.read.parquet(folder)))
    counts = S.read_counts(spark, out).agg(F.sum("records")).first()[0]
    assert counts == both.count() and query.lastProgress["batchId"] >= 1
    # a batch that runs again, as after a failure, replaces what it wrote
    spark.read.schema(S.COUNTS).parquet(f"{out}/batch=0").drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{out}/again")
    again = spark.read.parquet(f"{out}/again")
    again.write.mode("overwrite").parquet(f"{out}/batch=0")
    assert S.read_counts(spark, f"{out}/batch=*").agg(F.sum("records")).first()[0] == counts

    out = str(tmp_path / "attribution")
    S.stream_attribution(marked(S.capture_stream(spark, folder, 1)), out, str(tmp_path / "s2")).awaitTermination()
    got = {r.url_key: r.source for r in S.read_attribution(spark, out).collect()}
    assert got == {r[0]: r.source for r in marked(pages).select(url_key(F.col("url")), "source").collect()}

    out = str(tmp_path / "lines")
    S.stream_sink(marked(S.capture_stream(spark, folder, 2)), out, str(tmp_path / "s3")).awaitTermination()
    assert spark.read.text(out).count() == both.count()


def test_watermark_bounds_the_state(spark, data, tmp_path):
    _, folder = files(spark, data, tmp_path)
    out = str(tmp_path / "out")
    stream = S.capture_stream(spark, folder, 1).withColumn("seen_at", F.current_timestamp())
    S.stream_first_seen(stream, out, str(tmp_path / "state"), watermark=("seen_at", "1 hour")).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("url_key").distinct().count() > 0


def test_the_earliest_source_wins_whatever_the_file_order(spark, tmp_path):
    first = [("http://A/x", "otx", "2024-02", 2), ("http://a/X ", "body", "2024-02", 1), ("http://b", "shodan", None, 0), ("http://c", None, "2024", 0)]
    second = [(" http://a/x", "censys", "2024-01", 9), ("http://b", "wayback", None, 0), ("http://c", "late", "2025", 0), ("http://d", "zz", "2024", None),
              ("http://d", "aa", "2024", None)]
    schema, got = "url string, source string, captured_at string, rank int", []
    for name, order in (("ab", (first, second)), ("ba", (second, first))):
        folder, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
        for rows in order:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        query = S.stream_attribution(S.capture_stream(spark, folder, 1), out, str(tmp_path / f"{name}-state"))
        query.awaitTermination()
        assert query.lastProgress["batchId"] >= 1
        got.append({r.url_key: r.source for r in S.read_attribution(spark, out).collect()})
    assert got[0] == got[1] == {"http://a/x": "censys", "http://b": "shodan", "http://c": None, "http://d": "aa"}
