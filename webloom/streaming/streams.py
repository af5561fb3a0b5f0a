"""Online variants: first-seen URLs, running counts, source attribution and a line sink over a stream of captures.

Each function starts a query and returns it. State grows with the number of different URLs unless a watermark bounds
it: give ``watermark`` as ``(column, delay)`` to keep keys for that long only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.functions.urls import url_key
from webloom.operators.extract import extract_links
from webloom.operators.report import clean_line
from webloom.plans.discoveries import page_discoveries


def capture_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of captured pages from a growing folder of Parquet files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _once_per_key(rows: DataFrame, watermark: tuple[str, str] | None) -> DataFrame:
    if watermark is None:
        return rows.dropDuplicates(["url_key"])
    return rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(["url_key"])


def _file_sink(rows: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    return (rows.writeStream.format(kind).outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_first_seen(
    pages: DataFrame, path: str, checkpoint: str, watermark: tuple[str, str] | None = None
) -> StreamingQuery:
    """Append each link URL once, when it is first seen."""
    keyed = extract_links(pages).withColumn("url_key", url_key(F.col("url")))
    extra = [watermark[0]] if watermark else []
    return _file_sink(_once_per_key(keyed.select("url_key", *extra), watermark), path, checkpoint)


def _delta_sink(rows: DataFrame, delta: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write what each batch comes to as a folder under the batch's number.

    A batch that is run again after a failure replaces its own folder, so that it counts once. Nothing is kept by the
    driver, and no state grows in the query: what all batches come to is put together when it is read.
    """
    def write(batch: DataFrame, number: int) -> None:
        delta(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .start())


COUNTS = "type STRING, source STRING, records LONG, batch LONG"


def stream_counts(captures: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running number of records per type and source; read them with :func:`read_counts`."""
    named = F.when(F.col("type") == "linkfinder", "linkfinder").otherwise(F.col("source"))

    def counted(records: DataFrame) -> DataFrame:
        return records.groupBy("type", named.alias("source")).agg(F.count(F.lit(1)).alias("records"))

    return _delta_sink(page_discoveries(captures), counted, path, checkpoint)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all batches so far."""
    return spark.read.schema(COUNTS).parquet(path).groupBy("type", "source").agg(F.sum("records").alias("records"))


def _first_sources(rows: DataFrame) -> DataFrame:
    """The least of time, rank and source of each key; combines before it is shuffled."""
    return rows.groupBy("url_key").agg(F.min(F.struct("seen_at", "rank", "source")).alias("first")).select(
        "url_key", "first.*")


def stream_attribution(
    captures: DataFrame, path: str, checkpoint: str, time: str = "captured_at", rank: str = "rank",
) -> StreamingQuery:
    """The source that first brought each URL, by time, then rank, then name; read with :func:`read_attribution`.

    The order in which files come does not matter: a batch keeps the first of its own, and an earlier observation in a later
    batch takes the URL over. Either column may be missing; a row without a time comes after those that have one.
    """
    end = F.lit("\uffff")  # behind all times as text
    seen = F.coalesce(F.col(time).cast("string"), end) if time in captures.columns else end
    place = F.coalesce(F.col(rank).cast("long"), F.lit(2**62)) if rank in captures.columns else F.lit(0).cast("long")
    keyed = captures.select(url_key(F.col("url")).alias("url_key"), seen.alias("seen_at"), place.alias("rank"), "source")
    return _delta_sink(keyed, _first_sources, path, checkpoint)


ATTRIBUTION = "url_key STRING, seen_at STRING, rank LONG, source STRING, batch LONG"


def read_attribution(spark: SparkSession, path: str) -> DataFrame:
    """``url_key, source`` after all batches so far."""
    return _first_sources(spark.read.schema(ATTRIBUTION).parquet(path)).select("url_key", "source")


def stream_sink(captures: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append output lines to text files as records are found."""
    lines = page_discoveries(captures).select(clean_line().alias("value"))
    return _file_sink(lines, path, checkpoint, "text")
