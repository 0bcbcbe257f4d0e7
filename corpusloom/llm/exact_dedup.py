"""Exact dedup by content-defined chunk recipes.

Each whole text is cut into chunks where a rolling hash of its bytes says so; a chunk's identifier is its SHA-256. The
distinct chunks of all documents move once, pre-aggregated on the map side, to verify that no identifier stands for
two contents; where one does, its contents get numbers and the identifier carries the number. A document is then
its recipe, the ordered list of verified identifiers, and documents with equal recipes are equal byte for byte. Long
documents themselves are never shuffled, and copies meet as one row of each map task.

Null counts as the empty text. Of equal texts the row with the largest id stays (rows that repeat that id too are kept;
a null id is smaller than any other, and stays only in a group of nulls). One row per input row; an empty table gives
an empty result; only the named id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, materialize, table, utf8

#: Bytes of the smallest and largest chunk; a cut is expected every 2**CUT_BITS bytes after the smallest.
MIN_CHUNK, CUT_BITS, MAX_CHUNK = 1024, 12, 65536
WIDTH = 32  # bytes of one identifier
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. They depend on the bytes alone: the hash covers the last 32 bytes."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    marks = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    ends, start = [], 0
    for at in [*marks, n]:
        while at - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if at - start >= MIN_CHUNK or at == n and at > start:
            ends.append(at)
            start = at
    return ends


def _chunks(data: bytes):
    start = 0
    for end in cuts(data):
        yield data[start:end]
        start = end


def _identifier(chunk: bytes, width: int) -> bytes:
    return hashlib.sha256(chunk).digest()[:width]


def chunk_table(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """texts: one binary column. (identifier, content), a row for each chunk of each text."""

    def each(rows):
        for (data,) in rows:
            for chunk in _chunks(data):
                yield _identifier(chunk, width), chunk

    return map_rows(texts, each, "identifier binary, content binary", pa.schema([("identifier", pa.binary()), ("content", pa.binary())]))


def recipes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs: doc_id, content. doc_id, recipe (identifiers in order), n_chunks, text_sha256."""

    def each(rows):
        for key, data in rows:
            parts = [_identifier(c, width) for c in _chunks(data)]
            yield key, b"".join(parts), len(parts), hashlib.sha256(data).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("recipe", pa.binary()), ("n_chunks", pa.int64()), ("text_sha256", pa.string())])
    return map_rows(docs, each, "doc_id long, recipe binary, n_chunks long, text_sha256 string", schema)


def _numbered(docs: DataFrame, clashing: DataFrame, width: int) -> DataFrame:
    """Recipes where some identifiers stand for two contents or more: those get their content's number among them."""
    keyed = docs.withColumn("row", F.monotonically_increasing_id())
    keyed = materialize(keyed, "exact-rows")

    def each(rows):
        for row, key, data in rows:
            sha = hashlib.sha256(data).hexdigest()
            yield row, key, -1, b"", b"", sha
            for at, chunk in enumerate(_chunks(data)):
                yield row, key, at, _identifier(chunk, width), chunk, sha

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("identifier", pa.binary()), ("content", pa.binary()), ("text_sha256", pa.string())])
    placed = map_rows(keyed.select("row", "doc_id", "content"), each, "row long, doc_id long, at long, identifier binary, content binary, text_sha256 string", schema)
    joined = placed.join(clashing, ["identifier", "content"], "left")
    part = F.struct("at", F.concat(F.hex("identifier"), F.lit("."), F.coalesce("number", F.lit(0)).cast("string")).alias("id"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("at") >= 0, part)))
    return joined.groupBy("row", "doc_id", "text_sha256").agg(F.array_join(F.transform(ordered, lambda p: p["id"]), ",").cast("binary").alias("recipe"), F.count(F.when(F.col("at") >= 0, 1)).alias("n_chunks")).drop("row")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks; one row per input row. width: bytes of an identifier (small in tests, so that identifiers clash)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("content"))
    distinct = chunk_table(source.select("content"), width).distinct()
    clash = materialize(distinct.groupBy("identifier").agg(F.count("*").alias("n")).where("n > 1").select("identifier"), "exact-clash")
    if clash.isEmpty():
        listed = materialize(recipes(source, width=width), "exact-recipes")
    else:
        clashing = distinct.join(clash, "identifier").withColumn("number", F.row_number().over(Window.partitionBy("identifier").orderBy("content")))
        listed = materialize(_numbered(source, clashing, width), "exact-recipes")
    groups = materialize(listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "exact-groups")
    found = listed.join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(keep), F.lit(False)).alias("kept"),
        "text_sha256",
        "n_chunks",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
