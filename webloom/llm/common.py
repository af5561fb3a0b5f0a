"""What several text operators share: null-safe text, row keys that hold for any table, tables that cut lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.plans.checkpoints import fresh_path

#: Texts are handled in groups of about so many characters inside a task.
GROUP_CHARS = 1_000_000


def text_of(col: str | Column) -> Column:
    """A text column as a string; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as the table has such a column already."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder, so that a lost executor repeats no earlier step."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with_key(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stored``, with a column that names each row: its file and place there. Repeated rows get different keys."""
    return stored(df, name).withColumn(
        key, F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    )


def map_texts(
    df: DataFrame, text: str, added: list[tuple[str, str]], make: Callable[[], Callable[[list[str]], list[tuple]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from each text.

    ``make()`` runs once a task and returns a function from a list of texts to one tuple per text. A null text counts
    as empty. ``keep`` names the columns that go along (default: all). Narrow: no shuffle, rows stay where they are.
    """
    df = df.select(*(keep or df.columns), text_of(text).alias(whole := free_name(df, "whole_text")))
    kept = df.drop(whole)
    schema = T.StructType(kept.schema.fields + T._parse_datatype_string(
        ", ".join(f"`{n}` {t}" for n, t in added)).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        work = None
        for batch in batches:
            if not batch.num_rows:
                continue
            work = work or make()
            column = batch.column(batch.num_columns - 1)
            rows: list[tuple] = []
            start = 0
            while start < len(column):
                end, chars = start, 0
                while end < len(column) and (end == start or chars < GROUP_CHARS):
                    chars += len(column[end].as_buffer() or b"")
                    end += 1
                rows += work(column.slice(start, end - start).to_pylist())
                start = end
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            fields = list(target)[len(arrays):]
            arrays += [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(
                [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, target)], schema=target)

    return df.mapInArrow(run, schema)
