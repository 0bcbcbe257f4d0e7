"""Line dedup by pairwise alignment: shared rare line hashes find overlapping documents, patience diff aligns them.

Lines are cut at line feeds and compared stripped of ASCII white space; a blank line never counts. A key is a run of lines
that is long enough to be deleted by itself: MIN_LINES lines, or fewer of BLOCK_CHARS bytes. Any long enough common block of
two documents is a union of keys that both hold, so documents without a common key have nothing to align.

Pairs: a key counts for the earliest document that holds it. A later document is paired with the earliest holder of each of its
keys, those of its rarest key first (the key that fewest texts hold), and with the next one only for lines that still stand.
So a key of n holders gives n - 1 pairs and not n squared, however frequent it is, and no partner is left out: whatever an
alignment with some other earlier document would delete is made of keys whose earliest holders are partners too.

Alignment: keys that stand once in both documents of a pair are matched in order, by a longest increasing sequence of their
places (patience diff); neighbours on one diagonal grow together to blocks. Common keys that the chain leaves out, as they stand
in another order or more often than once, are aligned afterwards, each with its first place in the partner, as moved blocks.
Aligned blocks are deleted from the later document. So a line goes if and only if it lies in a long enough run of lines that
stands in a document with a smaller id; deletions are judged on the inputs.

Equal texts are one text, held by the smallest id; its later copies align with it line by line, so a group of copies costs a row each.
What moves: keys (a hash, two numbers), then per text its keys' partners; the text itself moves once, to its deletions, by a
join that shuffles at every size. Nothing is broadcast but what Spark's own size check allows.

Null or empty text: no lines. Rows without an id have no order and are left alone. Rows that repeat an id are told apart by
text and never align with each other. Empty tables give empty results. Only the named id and text columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, materialize, texts, utf8

MIN_LINES, BLOCK_CHARS = 3, 40
_BLANK = b" \t\r\x0b\x0c"


def line_hashes(data: bytes) -> tuple[list[int], list[int]]:
    """Signed hash (0 for a blank line) and bytes of each stripped line."""
    stripped = [x.strip(_BLANK) for x in data.split(b"\n")] if data else []
    hashes = [xxhash.xxh64_intdigest(x) - (1 << 63) or 1 if x else 0 for x in stripped]
    return hashes, list(map(len, stripped))


def keys_of(hashes: list[int], sizes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, end, hash) of the runs that every long enough block is a union of."""
    raw = np.array(hashes, "<i8").tobytes()
    for i in range(len(hashes)):
        weight = 0
        for end in range(i + 1, min(i + MIN_LINES, len(hashes)) + 1):
            if not hashes[end - 1]:
                break
            weight += sizes[end - 1]
            if end - i == MIN_LINES or weight >= BLOCK_CHARS:
                yield i, end, xxhash.xxh64_intdigest(raw[8 * i : 8 * end]) - (1 << 63)


def patience(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of points (place in the earlier document, place in the later) in which both increase."""
    tails: list[int] = []
    ends: list[int] = []
    nodes: list[tuple[int, int, int | None]] = []
    for i, j in sorted(points, key=lambda p: (p[0], -p[1])):
        k = bisect.bisect_left(tails, j)
        nodes.append((i, j, ends[k - 1] if k else None))
        if k == len(tails):
            tails.append(j)
            ends.append(len(nodes) - 1)
        else:
            tails[k], ends[k] = j, len(nodes) - 1
    chain: list[tuple[int, int]] = []
    at = ends[-1] if ends else None
    while at is not None:
        chain.append(nodes[at][:2])
        at = nodes[at][2]
    return chain[::-1]


def grown(matched: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(place in the earlier, place in the later, lines) of matched keys; those that touch on one diagonal are one block."""
    out: list[list[int]] = []
    for i, j, n in sorted(matched, key=lambda m: (m[1] - m[0], m[1])):
        if out and out[-1][1] - out[-1][0] == j - i and j <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], j + n - out[-1][1])
        else:
            out.append([i, j, n])
    return [(i, j, n) for i, j, n in sorted(out, key=lambda b: b[1])]


def align(hashes: list[int], sizes: list[int], held: dict[int, tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """held: key -> earliest holder, first place there, times there, texts that hold it. Blocks (earlier, place there, place here, lines, moved)."""
    own = [k for k in keys_of(hashes, sizes) if k[2] in held]
    times = Counter(k[2] for k in own)
    partners: dict[int, list[tuple[int, int, int]]] = {}
    for k in sorted(own, key=lambda k: (held[k[2]][3], held[k[2]][0], k[0])):
        partners.setdefault(held[k[2]][0], []).append(k)
    out, gone = [], bytearray(len(hashes))
    for earlier, common in partners.items():
        standing = [k for k in common if not all(gone[k[0] : k[1]])]
        once = {(held[h][1], j, end - j) for j, end, h in standing if times[h] == 1 and held[h][2] == 1}
        chain = set(patience([(i, j) for i, j, _ in once]))
        ordered = grown([p for p in once if p[:2] in chain])
        for _, j, n in ordered:
            gone[j : j + n] = b"\1" * n
        moved = grown([(held[h][1], j, end - j) for j, end, h in standing if not all(gone[j:end])])
        for _, j, n in moved:
            gone[j : j + n] = b"\1" * n
        out += [(earlier, *b, False) for b in ordered] + [(earlier, *b, True) for b in moved]
    return out


def runs(hashes: list[int], sizes: list[int]) -> list[tuple[int, int, int]]:
    """The blocks of a text aligned with its copy."""
    return grown([(j, j, end - j) for j, end, _ in keys_of(hashes, sizes)])


_BLOCK = pa.struct([("earlier", pa.int64()), ("at_earlier", pa.int32()), ("at", pa.int32()), ("lines", pa.int32()), ("moved", pa.bool_())])
_BLOCKS = "blocks array<struct<earlier:bigint,at_earlier:int,at:int,lines:int,moved:boolean>>"
_FIELDS = ("earlier", "at_earlier", "at", "lines", "moved")


def _unpacked(hashes: bytes, sizes: bytes) -> tuple[list[int], list[int]]:
    return np.frombuffer(hashes, "<i8").tolist(), np.frombuffer(sizes, "<u4").tolist()


def _texts(known: DataFrame) -> DataFrame:
    """doc_id (the smallest that holds the text), row, hashes, sizes of each distinct text."""

    def hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, row, sha, data in rows:
            hashes, sizes = line_hashes(data)
            yield key, row, sha, np.array(hashes, "<i8").tobytes(), np.array(sizes, "<u4").tobytes()

    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("sha", pa.string()), ("hashes", pa.binary()), ("sizes", pa.binary())])
    listed = map_rows(known.select("doc_id", "row", F.sha2("data", 256).alias("sha"), "data"), hashed, "doc_id long, row long, sha string, hashes binary, sizes binary", schema)
    return materialize(listed.groupBy("sha", "row").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes")), "lines-texts")


def _blocks(texts: DataFrame) -> DataFrame:
    """doc_id, row, blocks of the distinct texts that share a key with an earlier one."""

    def listed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, row, hashes, sizes in rows:
            first: dict[int, int] = {}
            times: Counter = Counter()
            for at, _, h in keys_of(*_unpacked(hashes, sizes)):
                first.setdefault(h, at)
                times[h] += 1
            for h, at in first.items():
                yield h, key, row, at, times[h]

    key_schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("times", pa.int32())])
    keys = map_rows(texts.select("doc_id", "row", "hashes", "sizes"), listed, "key long, doc_id long, row long, at int, times int", key_schema)
    holder = F.min(F.struct("doc_id", "at", "times"))
    shared = keys.groupBy("key").agg(holder.alias("h"), F.max("doc_id").alias("last"), F.count("*").alias("texts")).where("h.doc_id < last").select("key", F.col("h.doc_id").alias("earlier"), F.col("h.at").alias("at"), F.col("h.times").alias("times"), "texts")
    # the earliest holders of all shared keys, with the keys' rarity; a frequent key is a row here, and one in each text
    shared = materialize(shared, "lines-shared")
    held = keys.select("key", "doc_id", "row").join(shared, "key").where("earlier < doc_id")
    by_text = held.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "earlier", "at", "times", "texts")).alias("held"))

    def aligned(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, row, hashes, sizes, found in rows:
            held = {x["key"]: (x["earlier"], x["at"], x["times"], x["texts"]) for x in found}
            yield key, row, [dict(zip(_FIELDS, b)) for b in align(*_unpacked(hashes, sizes), held)]

    both = by_text.join(texts.select("doc_id", "row", "hashes", "sizes"), ["doc_id", "row"]).select("doc_id", "row", "hashes", "sizes", "held")
    return map_rows(both, aligned, f"doc_id long, row long, {_BLOCKS}", pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("blocks", pa.list_(_BLOCK))]))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256, blocks, with_text also kept_text; one row per input row.

    blocks: the aligned ones in the order of partners, with the earlier document, the place there and here (lines, from 0), the
    length, and whether the block was moved. A copy of a whole text has the blocks of the alignment with its smallest holder alone.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data")).withColumn("row", F.xxhash64("data")).select("doc_id", "row", "data")
    distinct = _texts(source.where("doc_id is not null"))
    found = _blocks(distinct).select("doc_id", "row", "blocks", F.lit(None).cast("long").alias("original"))
    # a copy of its text's smallest holder: rows of (row, sha) with other ids
    groups = distinct.where("doc_id < last").select("sha", "row", F.col("doc_id").alias("original"))
    ids = source.where("doc_id is not null").select("doc_id", "row", F.sha2("data", 256).alias("sha"))
    copies = ids.join(groups, ["sha", "row"]).where("original < doc_id").select("doc_id", "row", F.lit(None).cast(found.schema["blocks"].dataType).alias("blocks"), "original").distinct()
    gone = materialize(found.unionByName(copies), "lines-gone")
    joined = source.join(gone.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "data", "blocks", "original")

    def kept(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, data, blocks, original in rows:
            lines, drop = data.split(b"\n") if data else [], set()
            if original is not None:
                blocks = [dict(zip(_FIELDS, (original, *b, False))) for b in runs(*line_hashes(data))]
            for b in blocks or ():
                drop.update(range(b["at"], b["at"] + b["lines"]))
            text = b"\n".join([x for i, x in enumerate(lines) if i not in drop])
            out = key, len(lines), len(drop), hashlib.sha256(text).hexdigest(), blocks or []
            yield (*out, text.decode("utf-8", "replace")) if with_text else out

    arrow = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("blocks", pa.list_(_BLOCK))] + [("kept_text", pa.string())] * with_text)
    return map_rows(joined, kept, f"doc_id long, n_lines long, n_removed long, kept_sha256 string, {_BLOCKS}" + ", kept_text string" * with_text, arrow)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(texts(spark, sf_dir, "documents")).drop("blocks")


#: What the alignments amount to: a line goes if it lies in a run of three lines, or of 40 bytes, that an earlier document holds.
OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE coalesce(text, '') <> ''
), s AS (
  SELECT doc_id, i, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS a FROM l
), n AS (
  SELECT *, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), keys AS (
  SELECT doc_id, i, 1 AS n, a AS k FROM n WHERE strlen(a) >= 40
  UNION ALL SELECT doc_id, i, 2, a || chr(10) || b FROM n WHERE a <> '' AND b <> '' AND strlen(a) + strlen(b) >= 40
  UNION ALL SELECT doc_id, i, 3, a || chr(10) || b || chr(10) || c FROM n WHERE a <> '' AND b <> '' AND c <> ''
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, n)) AS i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS earlier FROM keys) WHERE earlier < doc_id
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY s.i) FILTER (WHERE g.i IS NULL), '') AS t
  FROM s LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
