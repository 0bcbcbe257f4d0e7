"""SimHash near-duplicates through multi-index hashing.

Fingerprints are cut into two segments of 32 bits. Of two fingerprints that differ in at most four bits, one segment differs
in at most two. Each segment's table holds a fingerprint under every value at most one bit away, so that values two bits apart
meet in the middle: 66 short rows a distinct fingerprint, whatever the corpus size. Equal fingerprints are one entry, so groups
of copies cost nothing.

A table's key brings fingerprints together, and their complete distances are verified there. The group gives not all its pairs
but a star for each set that links connect: its size less one rows, so a dense group costs no more than its members. A member is
compared with those that no earlier one has reached; a group over LARGE is cut by five parts of the other bits first, of which
linked members share one.

Null and empty texts have fingerprint zero and link like any other. Repeated rows and ids are rows of their own. An
empty table gives an empty result. Only the named id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.shipping import ship
from corpusloom.llm.common import bound_batches, map_rows, materialize, release, row_key, text_sha256, texts, utf8
from corpusloom.llm.components import components

SEED = 42
_BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, repeats included."""
    words = data.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - size] + 1]).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(data: bytes, size: int = 4) -> int:
    """64 bits, unsigned: a bit is 1 if more than half of the shingles' hashes have it."""
    h = shingle_hashes(data, size)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 1024):
        part = h[at : at + 255 * 1024]
        pad = np.zeros(-len(part) % 255, np.uint64)
        grid = np.concatenate([part, pad]).reshape(-1, 255)
        for s in range(8):  # eight counters of eight bits in a word: 255 fit
            sums = ((grid >> np.uint64(s)) & _BYTES).sum(axis=1)
            counts[s::8] += np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """doc_id, row (its name, as row_key gives it), fp (the fingerprint as a signed long)."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, row, data in rows:
            f = fingerprint(data, size)
            yield key, row, f - (1 << 64) if f >> 63 else f

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), text_sha256(text_col)).alias("row"), utf8(text_col).alias("data"))
    return map_rows(named, each, "doc_id long, row binary, fp long", pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("fp", pa.int64())]))


def _high(fp):
    return F.shiftrightunsigned(fp, 32)


def _low(fp):
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(value):
    """The value and the 32 values one bit away."""
    return F.concat(F.array(value), F.array(*(value.bitwiseXOR(F.lit(1 << i)) for i in range(32))))


#: Fingerprints of one key over which they are cut further; bounds of the parts of the other segment that they are cut by.
LARGE, PARTS = 4096, (0, 7, 14, 20, 26, 32)


def stars(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges (centres, members) that connect those of distinct fingerprints that links within radius connect."""
    centres, members = [], []
    while len(fps) > 1:
        centre, reached, fps = fps[0], [fps[:1]], fps[1:]
        while reached and len(fps):
            for pivot in reached.pop().tolist():
                near = np.bitwise_count(fps ^ np.uint64(pivot)) <= radius
                if near.any():
                    centres.append(np.full(int(near.sum()), centre))
                    members.append(fps[near])
                    reached.append(fps[near])
                    fps = fps[~near]
                    if not len(fps):
                        break
    return centres, members


def _group_edges(fps: np.ndarray, radius: int, other: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """other: the lowest bit of the segment that is not the key's."""
    if len(fps) <= LARGE:
        return stars(fps, radius)
    centres, members = [], []
    for low, high in zip(PARTS, PARTS[1:]):  # five parts: at most four bits differ, so one part is equal
        part = (fps >> np.uint64(other + low)) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(part, kind="stable")
        for own in np.split(fps[order], np.flatnonzero(np.diff(part[order])) + 1):
            c, m = stars(own, radius)
            centres += c
            members += m
    return centres, members


def _edges(source: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """source: key, fp, sorted by key. u, v."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def found(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(cut, len(keys)))
        twos = cut[sizes == 2]
        linked = twos[np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= radius]
        centres, members = [fps[linked]], [fps[linked + 1]]
        for at, n in zip(cut[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            c, m = _group_edges(fps[at : at + n], radius, 32 * int(keys[at] >> 32))
            centres += c
            members += m
        u, v = (np.concatenate(x).astype(np.int64) for x in (centres, members))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in source:
        keys, fps = np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([fps, b.column(1).to_numpy().astype(np.uint64)])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))  # its group may go on in the next batch
        if last:
            yield from found(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield from found(keys, fps)
    release()


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """fps: fp, distinct. u, v: edges between fingerprints at a distance of at most radius <= 4, or that such links connect; they connect all that links do."""
    if radius > 4:
        raise ValueError("two segments of 32 bits serve a radius of at most 4")
    ship(fps.sparkSession)
    bound_batches(fps.sparkSession)
    fp = F.col("fp")
    keys = F.concat(_ball(_high(fp)), F.transform(_ball(_low(fp)), lambda x: x.bitwiseOR(F.lit(1 << 32))))
    together = fps.select(F.explode(keys).alias("key"), fp).repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(lambda source: _edges(source, radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, row, fp, component (a fingerprint of it), component_id (the smallest id reachable, itself included); one row per input row."""
    rows = materialize(fingerprints(docs, id_col, text_col, size), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct.select("fp"), radius))
    labelled = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(labelled.join(least, "component").select("fp", "component", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "row", "fp", "component", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(texts(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
