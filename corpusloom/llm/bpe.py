"""BPE encoding and decoding through a table of distinct words.

1. Spark splits each whole text into words, at single spaces between two characters that cannot be white space. The
   tokenizer's own pre-tokenizer always cuts there, whatever stands left or right, so a text's ids are its words' ids
   in order (a special token's string holds no space and so stays within one word).
2. Runs of documents ("blocks") get a dictionary each, cut into buckets by word hash. The dictionaries alone are
   shuffled, by bucket: equal words of all blocks stand together and each distinct word is encoded once. A word,
   however frequent, is one entry in each block, so there is no hot key. Each block gets the ids of its own words.
3. Blocks, as positions in their dictionaries, meet those answers by block. The ids of a block's distinct words are joined with
   the vocabulary's pieces by id; ids and pieces are put in the place of each position.

Steps 2 and 3 read the input once each and cut it into blocks alike. A block's name holds a digest of its content, so an
input that is not the same both times is noticed; stable=False (the default) writes it to the shared folder first.

A null text counts as empty: no ids. Repeated rows are encoded each on its own. An empty table gives an empty
result. Only the named id and text columns are read. A very long text is a block of its own.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.shipping import ship
from corpusloom.llm.common import batches, bound_batches, map_rows, materialize, release, table

#: Characters that are no white space in any version of Unicode: printable ASCII, and ranges around the spaces.
_INK = r"\x21-\x7E" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0x167F), (0x3001, 0xD7FF)))
WORD_CUT = rf"(?<=[{_INK}])(?=\x20[{_INK}])"


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer file as text; by default the public byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=2)
def _tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def vocabulary(text: str) -> pa.Table:
    """id, piece: the bytes that the decoder puts in an id's place; bounded by the vocabulary."""
    t = _tokenizer(text)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    every = sorted((i, bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()) for piece, i in t.get_vocab(with_added_tokens=True).items())
    return pa.table({"id": pa.array([i for i, _ in every], pa.uint32()), "piece": pa.array([x for _, x in every], pa.large_binary())})


def decode_words(ids: list[bytes], vocab: pa.Table) -> list[bytes]:
    """ids: of each word, as unsigned 32-bit integers. The words' pieces, by a join of all their ids with the vocabulary."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    placed = pa.table({"at": pa.array(np.arange(len(flat))), "id": pa.array(flat)})
    joined = placed.join(vocab, "id", join_type="inner", use_threads=False).sort_by("at").column("piece").combine_chunks()
    if len(joined) != len(flat):
        raise ValueError("an id is not in the vocabulary")
    if not len(flat):
        return [b""] * len(ids)
    ends = np.frombuffer(joined.buffers()[1], "<i8", len(joined) + 1, 8 * joined.offset)
    body = joined.buffers()[2].to_pybytes() if joined.buffers()[2] else b""
    bounds = ends[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])].tolist()
    return [body[a:b] for a, b in zip(bounds, bounds[1:])]


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(raw)


def _open(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _pack(parts: list[bytes]) -> bytes:
    """Byte strings with their lengths, compressed."""
    return _squeeze(np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts))


def _cut(lengths: np.ndarray, body: bytes) -> list[bytes]:
    out, start = [], 0
    for end in np.cumsum(lengths).tolist():
        out.append(body[start:end])
        start = end
    return out


def _unpack(blob: bytes) -> list[bytes]:
    raw = _open(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return _cut(np.frombuffer(raw, "<u4", n, 4), raw[4 + 4 * n :])


def _planes(codes: np.ndarray) -> bytes:
    """Numbers by the significance of their bytes, which compresses better."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _whole(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


#: Bytes of input, as stored, for each bucket of the distinct-word table.
BUCKET_BYTES = 10_000_000


def _stored_bytes(df: DataFrame) -> int:
    """What the planner knows of a scan's size; a size it does not know counts as none."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else 0


#: Words of a block, which bounds what a task holds; a longer text is a block of its own.
BLOCK_WORDS = 1_000_000


def _parts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in runs of at most BLOCK_WORDS words, one row at least."""
    for batch in source:
        ends, start = np.asarray(batch.column(1).offsets).astype(np.int64), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK_WORDS, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def _blocks(source: Iterator[pa.RecordBatch], buckets: int):
    """block, documents' ids, ends of their positions, positions, dictionary, bounds of its buckets."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    for number, batch in enumerate(_parts(source)):
        words = batch.column(1)
        ends = np.asarray(words.offsets).astype(np.int64)
        coded = pc.dictionary_encode(words.values.slice(ends[0], ends[-1] - ends[0]))
        ends = ends[1:] - ends[0]
        entries = coded.dictionary.cast(pa.binary())
        by_word = np.asarray(pc.sort_indices(entries)).astype(np.int64)
        listed = entries.take(pa.array(by_word)).to_pylist()
        home = np.fromiter(map(zlib.crc32, listed), np.int64, len(listed)) % buckets
        order = np.argsort(home, kind="stable")
        place = np.empty(len(listed), np.int64)
        place[by_word[order]] = np.arange(len(listed))
        codes = place[np.asarray(coded.indices)]
        listed = [listed[i] for i in order.tolist()]
        ids = batch.column(0).to_pylist()
        digest = hashlib.blake2b(repr(ids).encode() + codes.tobytes() + b"\0".join(listed), digest_size=12).hexdigest()
        yield f"{part}-{number}-{digest}", ids, ends, codes, listed, np.searchsorted(home[order], np.arange(buckets + 1)).tolist()


def _dictionary_rows(source: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple]:
    for block, _, _, _, listed, bounds in _blocks(source, buckets):
        for b in range(buckets):
            if bounds[b] < bounds[b + 1]:
                yield block, b, _pack(listed[bounds[b] : bounds[b + 1]])


def _position_rows(source: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple]:
    for block, ids, ends, codes, listed, _ in _blocks(source, buckets):
        keys = pa.BufferOutputStream()
        column = pa.record_batch([pa.array(ids, pa.int64()), pa.array(ends)], ["id", "end"])
        with pa.ipc.new_stream(keys, column.schema) as out:
            out.write_batch(column)
        yield block, len(listed), _squeeze(keys.getvalue().to_pybytes()), _squeeze(_planes(codes))


def _encode_bucket(rows: Iterator[tuple], text: str) -> Iterator[tuple]:
    """Rows of one bucket after another; each distinct word of a bucket is encoded once."""
    t = _tokenizer(text)
    known: dict[bytes, bytes] = {}
    now = None
    for block, bucket, body in rows:
        if bucket != now:
            known, now = {}, bucket
        words = _unpack(body)
        new = [w for w in words if w not in known]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for w, e in zip(part, t.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()
        ids = [known[w] for w in words]
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        yield block, bucket, _squeeze(np.array([len(ids)], "<u4").tobytes() + counts.astype("<u4").tobytes() + _planes(np.frombuffer(b"".join(ids), "<u4")))


def _answers(blob: bytes) -> list[bytes]:
    raw = _open(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return _cut(np.frombuffer(raw, "<u4", n, 4).astype(np.int64) * 4, _whole(raw[4 + 4 * n :]).tobytes())


def _rejoin(rows: Iterator[tuple], text: str, with_tokens: bool) -> Iterator[tuple]:
    """Rows of a block: its answers by bucket, then its documents' positions."""
    vocab = vocabulary(text)
    now, ids = None, []
    for block, size, keys, body in rows:
        if block != now:
            now, ids = block, []
        if size is None:
            ids += _answers(body)
            continue
        if len(ids) != size:
            raise RuntimeError("the input was not the same when it was read again; use stable=False")
        shown = decode_words(ids, vocab)
        codes = _whole(_open(body))
        documents = pa.ipc.open_stream(_open(keys)).read_all()
        start = 0
        for key, end in zip(documents.column(0).to_pylist(), documents.column(1).to_pylist()):
            own = codes[start:end].tolist()
            start = end
            coded = b"".join([ids[c] for c in own])
            decoded = b"".join([shown[c] for c in own]).decode("utf-8", "replace").encode()
            out = key, len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(decoded).hexdigest()
            yield (*out, np.frombuffer(coded, "<u4").tolist(), decoded.decode()) if with_tokens else out


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, buckets: int | None = None, with_tokens: bool = False, stable: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with_tokens also ids and decoded.

    buckets: groups of the distinct-word table, each held by one task at a time; by default one for BUCKET_BYTES of input, and at least one
    for each shuffle partition, so a bucket does not grow with the input.
    stable: docs is a plain scan of files, and so the same rows in the same order whenever it is read.
    """
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    text = tokenizer_text(path)
    shipped = spark.sparkContext.broadcast(text)  # one file of a fixed size
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not stable:
        source = materialize(source, "bpe-input")
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_stored_bytes(source) // BUCKET_BYTES))
    split = source.select("doc_id", F.split("text", WORD_CUT).alias("words"))

    dictionary_schema = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("body", pa.binary())])
    position_schema = pa.schema([("block", pa.string()), ("size", pa.int64()), ("keys", pa.binary()), ("body", pa.binary())])
    def whole(rows, schema):
        def run(source):
            yield from batches(rows(source, buckets), schema)
            release()

        return run

    dictionary = split.mapInArrow(whole(_dictionary_rows, dictionary_schema), "block string, bucket int, body binary")
    positions = split.mapInArrow(whole(_position_rows, position_schema), "block string, size long, keys binary, body binary")
    by_bucket = dictionary.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    answers = map_rows(by_bucket, lambda rows: _encode_bucket(rows, shipped.value), "block string, bucket int, body binary", dictionary_schema)
    both = positions.select("block", F.lit(2147483647).alias("place"), "size", "keys", "body").unionAll(answers.select("block", F.col("bucket").alias("place"), F.lit(None).cast("long"), F.lit(None).cast("binary"), "body"))
    together = both.repartition(2 * buckets, "block").sortWithinPartitions("block", "place").select("block", "size", "keys", "body")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_tokens
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int64())), ("decoded", pa.string())] * with_tokens)
    return map_rows(together, lambda rows: _rejoin(rows, shipped.value, with_tokens), schema, arrow)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), stable=True)
