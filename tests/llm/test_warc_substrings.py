"""op1 and op3 against brute force."""

import base64
import gzip
import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import substrings, warc
from tests.llm.cases import SCHEMA, rows


def _bag(found):
    return sorted(map(repr, found))


def _records(data, least=0):
    groups = defaultdict(list)
    for key, html in data:
        groups[html or ""].append(key)
    out = []
    for key, html in data:
        body = (html or "").encode()
        same = groups[html or ""]
        first = max((k for k in same if k is not None), default=None)
        revisit = len(same) > 1 and len(body) >= least and key != first
        out.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return out


PAGES = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (5, "u", "WARC/1.1\r\n\r\n\r\n"), (6, "u", "z" * 3_500_001), (7, "u", "z" * 3_500_001), (7, "u", "z" * 3_500_001), (8, "u", "日本" * (1 << 19)), (None, "u", "<p>é</p>"), (9, "u", "x" * (1 << 20))]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame([(*p, "clash", 3) for p in PAGES], "page_id long, url string, html string, kind string, size int").repartition(3)
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(df, folder, least=least, file_bytes=2000)
    chunks = warc.read_chunks(manifest, folder, chunk=100_000)
    found = warc.records(chunks)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert _bag(map(tuple, found.select(cols).collect())) == _bag(_records([(k, h) for k, _, h in PAGES], least))
    whole = defaultdict(dict)
    for r in chunks.collect():
        whole[r.file, r.record][r.chunk_no] = r
    for parts in whole.values():
        data = b"".join(bytes(parts[i].data) for i in range(len(parts)))
        end = parts[len(parts) - 1]
        assert end.last and all(len(p.data) <= 100_000 for p in parts.values())
        assert end.digest_so_far == hashlib.sha1(data).digest() and end.bytes_so_far == len(data)
        assert parts[0].digest_so_far == hashlib.sha1(bytes(parts[0].data)).digest()
        if end.record_type == "response":
            assert len(data) == end.payload_bytes and warc.base32(hashlib.sha1(data).hexdigest()) == end.stated_digest
    names = [r.name for r in manifest.collect()]
    raw = b"".join(gzip.open(f"{tmp_path}/a/{n}").read() for n in names)
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES) and b"http://a/%20b%0D%0AX:%20y" in raw


def test_warc_files_outside_the_manifest_are_not_read(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(df, folder)
    with open(f"{tmp_path}/a/torn.warc.gz", "wb") as f:
        f.write(b"half a record")
    assert warc.records(warc.read_chunks(manifest, folder)).count() == 4
    with open(os.path.join(tmp_path, "a", manifest.first().name), "r+b") as f:
        f.truncate(60)
    with pytest.raises(Exception, match="ends within|error"):
        warc.records(warc.read_chunks(manifest, folder)).collect()


def test_warc_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.records(warc.read_chunks(manifest, folder)).count() == 0


def test_op1_on_the_pages(spark, small):
    data = [(r.page_id, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert _bag(map(tuple, warc.op1_warc(spark, small).collect())) == _bag(_records(data))


def _repeats(data, window):
    least = {}
    for key, text in data:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if key is not None:
            for s in range(len(words) - window + 1):
                w = tuple(words[s : s + window])
                least[w] = min(least.get(w, key), key)
    out = []
    for key, text in data:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        if key is not None:
            for s in range(len(words) - window + 1):
                if least[tuple(words[s : s + window])] < key:
                    gone.update(range(s, s + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _nodes(strings, window):
    """Branching common prefixes of all suffixes, by definition: depth in words, and who passes through."""
    found = {}
    every = [(k, i, tuple(x[i:])) for k, x in enumerate(strings) for i in range(len(x))]
    for _, _, a in every:
        for n in range(1, len(a) + 1):
            through = [(k, i, s) for k, i, s in every if s[:n] == a[:n]]
            ended, after = sum(len(s) == n for _, _, s in through), {s[n] for _, _, s in through if len(s) > n}
            if len(through) > 1 and ended + len(after) > 1:
                found[a[:n]] = (n + window - 1, sorted((k, i) for k, i, _ in through))
    return sorted(found.values())


def test_subtree():
    r = random.Random(6)
    for _ in range(150):
        strings = list({tuple(r.randint(0, 3) for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 6))})
        holders = [r.randint(0, 4) for _ in strings]
        tree = substrings.Subtree([np.array(x, np.uint64) for x in strings], 50)
        assert sorted(tree.nodes()) == _nodes(strings, 50)
        depth, earlier = tree.earlier_matches(np.array(holders))
        at = 0
        for k, x in enumerate(strings):
            for i in range(len(x)):
                best = max((n for j, y in enumerate(strings) if holders[j] < holders[k] for o in range(len(y)) for n in range(1, len(x) - i + 1) if y[o : o + n] == x[i : i + n]), default=0)
                assert depth[at] == best
                if best:
                    assert earlier[at] < holders[k] and any(holders[j] == earlier[at] and y[o : o + best] == x[i : i + best] for j, y in enumerate(strings) for o in range(len(y)))
                at += 1


def test_repeats_are_as_long_as_they_are(spark):
    r = random.Random(7)
    word = lambda: f"w{r.randint(0, 10**6)}"
    passage = [word() for _ in range(300)]
    data = [(i, [word() for _ in range(30)] + passage[i * 10 : 300 - i] + [word() for _ in range(20)]) for i in range(6)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string").repartition(3)
    found = {x.doc_id: x for x in substrings.remove_repeats(df).collect()}
    for i, _ in data:
        (span,) = found[i].spans if i else (None,)
        if i:
            assert (span.start, span.end) == (30, 30 + 300 - i - i * 10) and found[i].n_removed == 300 - 11 * i
            assert max(x.end - x.start for x in found[i].repeats) == 300 - 11 * i
            for x in found[i].repeats:
                own, theirs = " ".join(data[i][1][x.start : x.end]), " ".join(data[x.earlier][1])
                assert x.earlier < i and own in theirs


def test_a_text_that_repeats_itself_is_one_run():
    a, _ = substrings.suffixes(b"ab cd " * 5000, 50, 16)
    assert len(substrings._runs(a)) <= 2


def _passages():
    r = random.Random(4)
    word = lambda: f"w{r.randint(0, 400)}"
    shared = [[word() for _ in range(n)] for n in (12, 13, 40, 90)]
    data = []
    for i in range(80):
        text = [word() for _ in range(r.randint(0, 40))]
        for p in r.sample(shared, r.randint(0, 3)):
            text += p[r.randint(0, 3) :] + [word() for _ in range(r.randint(0, 8))]
        data.append((i * 3 % 80, " ".join(text)))
    return data + [(200, "a b " * 60), (201, "b a " * 70), (202, "a " * 300), (203, "a " * 200), data[5], (None, data[5][1]), (2000, data[5][1]), (3, "other text of the same id " * 9)]


@pytest.mark.parametrize("window,anchor,hot", [(12, 5, False), (12, 5, True), (12, 12, False), (50, 16, False)])
def test_substring_dedup(spark, monkeypatch, window, anchor, hot):
    if hot:  # every anchor with more than three rows is split
        monkeypatch.setattr(substrings, "LEAST", 3)
        monkeypatch.setattr(substrings, "SHARE", 0.0)
    data = _passages() + [(3000 + i, r[1]) for i, r in enumerate(rows())]
    df = spark.createDataFrame([(*x, 1, 2) for x in data], "doc_id long, text string, row int, data int").repartition(4)
    found = substrings.remove_repeats(df, window=window, anchor=anchor, with_text=True)
    assert _bag(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == _bag(_repeats(data, window))
    for r in found.collect():
        assert sum(s["end"] - s["start"] for s in r.spans) == r.n_removed and len(r.kept_text.encode().split()) == r.n_words - r.n_removed
    assert substrings.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(df, window=4, anchor=5)


def test_substring_dedup_on_the_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    found = substrings.op3_substring_dedup(spark, small).collect()
    assert _bag(map(tuple, found)) == _bag(_repeats(data, 50)) and any(r.n_removed for r in found)
    assert substrings.remove_repeats(spark.createDataFrame(rows(), SCHEMA)).count() == len(rows())
    assert docs.select(F.lit(1)).count() == len(data)
