"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from webloom.plans.checkpoints import fresh_path


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every node that has a link.

    Each round points larger neighbours at the smallest one (large star), then neighbours not larger than a node at the
    smallest of them (small star), until nothing changes; rounds grow with the logarithm of the longest chain. Links of
    a node are never gathered: a round is one minimum per node, which combines before the shuffle, and one join. Every
    round is a table. Null nodes and links of a node to itself add nothing; repeated links count once.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now, mark = _table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, _ = _table(large.distinct())
        # After a large star every link goes from a node to a smaller one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before = mark
        now, mark = _table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if mark == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _table(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table in the shared folder, and its number of rows with a sum over their hashes."""
    path, seen = fresh_path(links.sparkSession, "links"), Observation()
    links.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    ).write.parquet(path)
    mark = (seen.get["rows"], seen.get["sum"])
    return links.sparkSession.read.schema(links.schema).parquet(path), mark
