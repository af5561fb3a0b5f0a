"""Where jobs cut their lineage: tables written to the folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    ``spark.checkpoint.dir`` names one that all executors reach. Only a local session may do without it; it then gets
    a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
            named = tempfile.mkdtemp(prefix="webloom-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_counted(df: DataFrame, path: str) -> int:
    """Write a table and say how many rows it has, in one job."""
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return rows.get["rows"]


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder.

    Later steps do not repeat the work, know the size, read only the columns they use, and survive a lost executor.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class BucketedTable:
    """Rows in buckets by a key, in the shared folder, grown by appends.

    A join or aggregate by this key, over a shuffle of as many partitions, finds the rows where they lie. With a
    ``partition`` column each append is read alone by a filter on it. The catalog knows the table until :meth:`forget`;
    the files stay, as all intermediate ones do.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str], buckets: int, partition: str | None = None):
        self.spark, self.keys, self.buckets, self.partition = spark, keys, buckets, partition
        self.path = fresh_path(spark, name)
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.made = False

    def _create(self, schema: T.StructType) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = f"PARTITIONED BY (`{self.partition}`)" if self.partition else ""
        keys = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet {by} CLUSTERED BY ({keys}) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self.made = True

    def append(self, rows: DataFrame) -> int:
        """Add rows, one file per bucket, and say how many there were. The partition column must come last."""
        if not self.made:
            self._create(rows.schema)
        counted = Observation()
        rows.repartition(self.buckets, *self.keys).observe(counted, F.count(F.lit(1)).alias("rows")).write.insertInto(
            self.name)
        return counted.get["rows"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
