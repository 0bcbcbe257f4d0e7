"""Shared folder, tables written to it, and small helpers of the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.shared import fresh, new_dir, quoted, spread
from corpusloom.functions.shipping import ship

#: ASCII letters only, as the contracts ask; bytes.lower() and this agree.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, lost executors do not matter, and the planner knows the size."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, in as many tasks as there are cores at least."""
    return spread(table(spark, sf_dir, name))


__all__ = ["LOWER", "UPPER", "batches", "bound_batches", "fresh", "map_rows", "materialize", "new_dir", "quoted", "release", "row_key", "rows_of", "spread", "table", "text_sha256", "texts", "utf8"]


def utf8(text_col: str):
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))


def row_key(id_column, text_sha256):
    """16 bytes that stand for a row's id and whole text (its SHA-256 as hex); a null id is unlike any other."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(id_column.cast("string"), F.lit("-")), text_sha256)))


def text_sha256(text_col: str):
    return F.sha2(utf8(text_col), 256)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most so many rows or, nearly, bytes of strings and binaries."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or weight >= max_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def release() -> None:
    """Give memory that a task has freed back to the system: a worker lives on for tasks of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bound_batches(spark: SparkSession, records: int = 2000) -> None:
    """Smaller Arrow batches than Spark's 10,000 rows, unless the session has chosen its own size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(records))


def map_rows(df: DataFrame, each, schema: str, arrow_schema: pa.Schema, size: int = 2000) -> DataFrame:
    """mapInArrow with a function from an iterator of row tuples to an iterator of row tuples."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(each(rows_of(source)), arrow_schema, size)
        release()

    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def rows_of(source: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Row tuples; Python objects exist for a few rows at a time only."""
    for b in source:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield from zip(*(c.to_pylist() for c in part.columns))
