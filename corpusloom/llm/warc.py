"""WARC archives: written as gzip members, read as a table of chunks.

Writing: payloads with equal SHA-256 and length form a group; the row with the largest id is a `response`, the others are
`revisit` records that refer to it. A payload reaches the writer as rows of at most `chunk` bytes, in order, and is
compressed as it comes. Each task writes files of its own into the archive folder, through the folder's own file
system, and returns their names; the manifest of names is a table that Spark commits, so a file of a failed or repeated
attempt is in no manifest and never read.

Reading: each file is a stream. A record is emitted as rows (record, chunk number) of at most `chunk` bytes with the
SHA-1 of the payload so far; the last chunk has the whole payload's. No record is held whole.

A null payload is an empty one. Records of payloads under `least` bytes are never deduplicated. Rows that repeat the
largest id of their group are all responses; a null id is smaller than any other. A url may be null; control
characters and spaces in it are percent-encoded. An empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, materialize, new_dir, table, utf8

CHUNK = 1 << 20
FILE_BYTES = 256 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_URN = "urn:corpusloom:"


def filesystem(uri: str):
    """The file system of a folder's address and the folder's path in it: file, hdfs, s3, gs and others that Arrow has."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def _head(kind: str, key: int | None, url: str | None, sha1: str, size: int, refers: int | None) -> bytes:
    body = len(_HTTP) + (size if kind == "response" else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_URN}{key}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base32(sha1)}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {body}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _write(rows: Iterator[tuple], folder: str, file_bytes: int, level: int) -> Iterator[tuple]:
    """rows: key, url, sha1, size, kind, refers, at, chunk; the chunks of a record follow one another."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    out, name, records, last = None, "", 0, None
    for key, url, sha1, size, kind, refers, at, chunk in rows:
        if at == 0:
            if out is not None and out.tell() >= file_bytes:
                out.close()
                yield name, records
                out = None
            if out is None:
                name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            gz = zlib.compressobj(level, zlib.DEFLATED, 31)
            out.write(gz.compress(_head(kind, key, url, sha1, size, refers) + _HTTP))
            records += 1
            last = max(0, -(-size // CHUNK) - 1) if kind == "response" else 0
        if chunk:
            out.write(gz.compress(chunk))
        if at == last:
            out.write(gz.compress(b"\r\n\r\n") + gz.flush())
    if out is not None:
        out.close()
        yield name, records


def plan(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """page_id, url, body, size, sha1, kind, refers: what record each page becomes."""
    body = utf8(payload_col)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("size"))
    hashed = source.withColumn("sha256", F.sha2("body", 256))
    # only groups of two or more are needed, pre-aggregated by digest; payloads meet them by a shuffle, whatever their number
    groups = hashed.where(F.col("size") >= least).groupBy("sha256", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(groups, "warc-groups")
    joined = hashed.join(groups.withColumn("grouped", F.lit(True)).hint("shuffle_hash"), ["sha256", "size"], "left")
    revisit = F.coalesce(F.col("grouped") & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select("page_id", "url", "body", "size", F.sha1("body").alias("sha1"), F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, file_bytes: int = FILE_BYTES, level: int = 4) -> DataFrame:
    """Write the archives and return their manifest: name, records. The manifest alone says which files count."""
    records = plan(pages, id_col, url_col, payload_col, least)
    chunks = F.when(F.col("kind") == "revisit", 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / CHUNK)))
    rows = records.select("*", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))).alias("at"))
    part = F.when(F.col("kind") == "response", F.substring("body", F.col("at") * CHUNK + 1, F.lit(CHUNK)))
    rows = rows.select("page_id", "url", "sha1", "size", "kind", "refers", "at", part.alias("chunk"))
    written = map_rows(rows, lambda x: _write(x, folder, file_bytes, level), "name string, records long", pa.schema([("name", pa.string()), ("records", pa.int64())]))
    return materialize(written, "warc-manifest")


class _Stream:
    """Bytes of the members of a gzip file, a buffer at a time."""

    def __init__(self, raw, size: int = 1 << 20):
        self.raw, self.size, self.held = raw, size, bytearray()
        self.gz, self.rest, self.done = zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.raw.read(self.size)
                if not self.rest:
                    return False
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            got = self.gz.decompress(self.rest, self.size)
            self.rest = self.gz.unconsumed_tail or self.gz.unused_data
            if got:
                self.held += got
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        looked = 0
        while (at := self.held.find(b"\r\n", max(0, looked - 1))) < 0:
            looked = len(self.held)
            if not self._more():
                return None
        got = bytes(self.held[:at])
        del self.held[: at + 2]
        return got

    def take(self, most: int) -> bytes:
        while not self.held:
            if not self._more():
                raise EOFError("the archive ends within a record")
        got = bytes(self.held[:most])
        del self.held[:most]
        return got


def _header(stream: _Stream) -> dict[str, str] | None:
    while (line := stream.line()) is not None and not line:
        pass
    if line is None:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    found = {}
    while line := stream.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _key(value: str | None) -> int | None:
    m = re.fullmatch(rf"<{_URN}(-?\d+)>", value or "")
    return int(m[1]) if m else None


def _read(names: Iterator[tuple], folder: str, chunk: int, with_data: bool) -> Iterator[tuple]:
    fs, path = filesystem(folder)
    for name, stated in names:
        with fs.open_input_stream(f"{path}/{name}", compression=None) as raw:
            stream, number = _Stream(raw), -1
            while (head := _header(stream)) is not None:
                number += 1
                left = int(head["content-length"])
                if "application/http" in head.get("content-type", ""):
                    while line := stream.line():
                        left -= len(line) + 2
                    left -= 2
                carried, size, at = hashlib.sha1(), 0, 0
                kind, said = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
                full = int(head.get("warc-payload-length", left))
                while True:
                    data = bytearray()
                    while left and len(data) < chunk:
                        got = stream.take(min(left, chunk - len(data)))
                        data += got
                        left -= len(got)
                    carried.update(data)
                    size += len(data)
                    if not left and kind == "response" and said and base64.b32encode(carried.digest()).decode() != said:
                        raise ValueError(f"{name}, record {number}: the payload's digest is not the header's")
                    yield name, number, at, _key(head.get("warc-record-id")), kind, _key(head.get("warc-refers-to")), head.get("warc-target-uri"), size, full, said, carried.digest(), not left, bytes(data) if with_data else None
                    at += 1
                    if not left:
                        break
        if number + 1 != stated:
            raise EOFError(f"{name} ends within a record: {number + 1} of {stated} read")


CHUNK_DDL = "file string, record long, chunk_no long, page_id long, record_type string, refers_to long, url string, bytes_so_far long, payload_bytes long, stated_digest string, digest_so_far binary, last boolean, data binary"
_CHUNK_ARROW = pa.schema([("file", pa.string()), ("record", pa.int64()), ("chunk_no", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("bytes_so_far", pa.int64()), ("payload_bytes", pa.int64()), ("stated_digest", pa.string()), ("digest_so_far", pa.binary()), ("last", pa.bool_()), ("data", pa.binary())])


def read_chunks(manifest: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the manifest's archives. A response's digest is verified as its last chunk is read, and each file's number of records."""
    return map_rows(manifest.select("name", "records"), lambda x: _read(x, folder, chunk, with_data), CHUNK_DDL, _CHUNK_ARROW)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    return chunks.where("last").select("page_id", "payload_bytes", F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to", "url", "bytes_so_far", "digest_so_far")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages"), folder)
    found = records(read_chunks(manifest, folder, with_data=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), g AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * i // 4 + 1, 2))::INT >> (3 - 5 * i % 4)) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""
