"""op8, op9, op10, op5, op6 against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpusloom.llm import bpe, exact_dedup, langid, pii, simhash
from corpusloom.llm.components import components
from tests.llm.cases import SCHEMA, rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def _bag(found):
    return sorted(map(repr, found))


def _base(text):
    out = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.span()))
    out += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


TRICKY = [
    "a@b.c_d@e.fg x..y@-a.b-.c@d.e @x.y a@b a@@b.c é@é.com é.x@y.zz",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 1..2.3.4 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5 4 1 1 378282246310005",
    "+1 (389) 555-5010 ++44 20 7946 0958. +1 () +12 + 1234567890 +123456789012345678",
    "my iban GB82 WEST 1234 5698 7654 32 at the bank, ssn 078-05-1120; 078-05-1120",
    "1" * 4000 + ".1.1.1 " + "a" * 30000 + "@x " + "+1" + " " * 3000,
    "",
]


@pytest.mark.parametrize("text", TRICKY)
def test_pii_base_spans(text):
    found = [(k, (a, b)) for k, a, b, _ in pii.find_spans(text) if k in pii.BASE]
    assert found == _base(text)


def test_pii_added_spans_and_scores():
    found = pii.find_spans(TRICKY[4])
    assert [k for k, *_ in found if k not in pii.BASE] == ["iban", "national_id", "national_id"]
    assert pii.find_spans("078-05-1120") == []  # no context word: below the threshold
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def test_pii_frame(spark, docs):
    found = pii.detect(spark.createDataFrame([(i, t) for i, t in enumerate([None, *TRICKY])], "doc_id long, text string")).collect()
    for r in found:
        text = ["", *TRICKY][r.doc_id]
        assert [(s["kind"], (s["start"], s["end"])) for s in r.spans if s["kind"] in pii.BASE] == _base(text)
    assert pii.detect(docs).count() == len(rows())
    assert pii.detect(docs.limit(0)).count() == 0


def test_language_id(spark):
    def text(i, words):
        r = np.random.default_rng(i)
        return " ".join(r.choice(words, 30))

    sets = {"aa": ["thing", "wheth", "other", "shall"], "bb": ["ñoque", "ción", "llamas", "jardo"], "cc": ["über", "straße", "zwölf", "pferd"]}
    data = [(i, text(i, w), k) for i, (k, w) in enumerate(list(sets.items()) * 60)] + [(None, "thing", "aa"), (900, None, "aa"), (901, "12 - 3", "bb"), (902, "ción", None), (902, "ción", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    p = langid.Params(per_lang=40)
    found = langid.identify(df, p).collect()
    assert len(found) == len(data)
    by = {r.doc_id: r for r in found}
    held = [(i, k) for i, _, k in data if i is not None and i < 900 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean([by[i].lang_pred == k for i, k in held]) > 0.95
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[902].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in langid.identify(df.where("lang is null")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_language_id_does_not_see_labels_of_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    from pyspark.sql import functions as F

    poisoned = docs.withColumn("lang", F.when(langid.remainder() == 2, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    assert _bag(langid.identify(docs).collect()) == _bag(langid.identify(poisoned).collect())


def test_bpe_equals_the_library(spark, docs, small):
    from pyspark.sql import functions as F

    t = bpe._tokenizer(bpe.tokenizer_text())

    def want(key, text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        return key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # several blocks
    try:
        for df in (docs, spark.read.parquet(f"{small}/documents.parquet"), docs.limit(0), docs.select("doc_id", F.lit(None).cast("string").alias("text"))):
            held = [want(r.doc_id, r.text) for r in df.collect()]
            for stable in (False, True):
                assert _bag(map(tuple, bpe.encode_decode(df, buckets=5, stable=stable).collect())) == _bag(held)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = bpe.encode_decode(spark.createDataFrame([(1, "naïve <|endoftext|> 日本")], "doc_id long, text string"), with_tokens=True).first()
    assert kept.decoded == "naïve <|endoftext|> 日本" and list(kept.ids) == t.encode(kept.decoded).ids


def _dedup(data):
    groups = defaultdict(list)
    for key, text in data:
        groups[text or ""].append(key)
    out = []
    for key, text in data:
        same = groups[text or ""]
        keep = max((k for k in same if k is not None), default=None)
        out.append((key, keep, len(same), key == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [32, 1])
def test_exact_dedup(spark, docs, width):
    """width 1: identifiers clash, so contents are told apart by the verification."""
    data = [(r[0], r[1]) for r in rows()] + [(1000 + i, "q" * 70000 + "xyz"[i % 3]) for i in range(6)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    found = exact_dedup.deduplicate(df, width=width).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert _bag(map(tuple, found)) == _bag(_dedup(data))
    assert exact_dedup.deduplicate(df.limit(0), width=width).count() == 0


def test_chunks_cover_the_text_and_cut_by_content():
    r = np.random.default_rng(3)
    data = r.integers(97, 123, 300_000, dtype=np.uint8).tobytes()
    assert b"".join(exact_dedup._chunks(data)) == data
    moved = b"new start " + data
    assert len(set(exact_dedup._chunks(data)) & set(exact_dedup._chunks(moved))) > 0.9 * len(exact_dedup.cuts(data))
    assert max(map(len, exact_dedup._chunks(b"a" * 500_000))) <= exact_dedup.MAX_CHUNK


def _fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash(spark, docs, small):
    for df in (docs, spark.read.parquet(f"{small}/documents.parquet").limit(150)):
        data = [(r.doc_id, r.text) for r in df.collect()]
        fps = [_fp(t) for _, t in data]
        roots = _components(fps)
        least = defaultdict(lambda: None)
        for (key, _), r in zip(data, roots):
            if key is not None and (least[r] is None or key < least[r]):
                least[r] = key
        held = spark.createDataFrame(data, "doc_id long, text string")
        found = simhash.near_duplicates(held).collect()
        assert _bag((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == _bag((k, f, least[r]) for (k, _), f, r in zip(data, fps, roots))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("large", [4096, 4])
def test_links_connect_what_pairs_connect(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    r = np.random.default_rng(5)
    base = r.integers(-(1 << 63), 1 << 63, 40)
    fps = {int(b) for b in base} | {0, -1}
    for b in base:
        for _ in range(12):
            x = int(b)
            for bit in r.choice(64, r.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            fps.add(x - (1 << 64) if x >> 63 == 1 else x)
    fps = sorted(x for x in fps if -(1 << 63) <= x < 1 << 63)
    dense = [(1 << 40) ^ (1 << i) ^ (1 << j) for i in range(11) for j in range(i)] + [(3 << 50) ^ x for x in range(16)]
    fps = sorted({*fps, *dense})
    roots = _components([x % (1 << 64) for x in fps])
    keys = sorted((k, f) for f in fps for k in _keys(f % (1 << 64)))
    batches = [  # they cut groups
        pa.record_batch([pa.array([k for k, _ in keys[i : i + 50]]), pa.array([f for _, f in keys[i : i + 50]])], ["key", "fp"])
        for i in range(0, len(keys), 50)
    ]
    edges = [e for b in simhash._edges(iter(batches), 4) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    found = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert large == 4 or set(edges) == set(found)
    at = {f: i for i, f in enumerate(fps)}
    joined = list(range(len(fps)))

    def root(i):
        while joined[i] != i:
            i = joined[i]
        return i

    for u, v in edges:
        joined[root(at[u])] = root(at[v])
    assert all(roots[at[u]] == roots[at[v]] for u, v in edges)
    same = lambda x: sorted(min(i for i in range(len(x)) if x[i] == y) for y in x)
    assert same([root(i) for i in range(len(fps))]) == same(roots) and len(set(roots)) > 10


def _keys(fp):
    for side, half in ((0, fp >> 32), (1, fp & 0xFFFFFFFF)):
        yield from (side << 32 | x for x in (half, *(half ^ 1 << i for i in range(32))))


def test_stars_are_fewer_than_members():
    fps = np.array([(1 << 40) ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)], np.uint64)
    _, members = simhash.stars(fps, 4)
    assert sum(map(len, members)) == len(fps) - 1


def test_components(spark):
    r = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 200, (120, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, found)) == sorted((x, root(x)) for x in parent)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bpe_blocks_hold_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 5)
    lengths = [2, 3, 1, 0, 9, 0, 5, 1]
    batch = pa.record_batch([pa.array(range(8)), pa.array([["w"] * n for n in lengths], pa.list_(pa.string()))], ["doc_id", "words"])
    for whole in (batch, batch.slice(1, 6)):
        parts = list(bpe._parts(iter([whole])))
        assert [x for p in parts for x in p.column(0).to_pylist()] == whole.column(0).to_pylist()
        assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 5 for p in parts)
        keys = [k for _, ids, *_ in bpe._blocks(iter([whole]), 3) for k in ids]
        assert keys == whole.column(0).to_pylist()


def test_decode_words_joins_ids_with_pieces():
    t = bpe._tokenizer(bpe.tokenizer_text())
    words = ["naïve", " the", "日本語", "", "<|endoftext|>", " x1", "the"]
    ids = [np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    vocab = bpe.vocabulary(bpe.tokenizer_text())
    assert [x.decode() for x in bpe.decode_words(ids, vocab)] == words
    assert bpe.decode_words([], vocab) == [] and bpe.decode_words([b"", b""], vocab) == [b"", b""]
    with pytest.raises(ValueError):
        bpe.decode_words([np.array([1 << 30], "<u4").tobytes()], vocab)


def _ftrl_by_the_paper(sample, order, classes, alpha, beta, l1, l2):
    """FTRL-proximal coordinate by coordinate, with a softmax over the classes."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        if abs(z[i, c]) <= l1:
            return 0.0
        sign = 1.0 if z[i, c] > 0 else -1.0
        return -(z[i, c] - sign * l1) / ((beta + n[i, c] ** 0.5) / alpha + l2)

    for at in order:
        y, ids, x = sample[at]
        held = {(i, c): weight(i, c) for i in ids for c in range(classes)}
        scores = [sum(v * held[i, c] for i, v in zip(ids, x)) for c in range(classes)]
        e = [np.exp(s - max(scores)) for s in scores]
        for i, v in zip(ids, x):
            for c in range(classes):
                g = v * (e[c] / sum(e) - (c == y))
                sigma = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / alpha
                z[i, c] += g - sigma * held[i, c]
                n[i, c] += g * g
    return weight


def test_ftrl_equals_the_paper():
    r = np.random.default_rng(3)
    p = langid.Params(epochs=2, l1=0.05, l2=0.1)
    sample = []
    for _ in range(40):
        ids = np.append(np.sort(r.choice(12, 5, replace=False)), 12)
        sample.append((int(r.integers(3)), ids, np.append(r.random(5) * 2, 1.0)))
    found = langid.ftrl(sample, 3, 12, p)
    rng = np.random.default_rng(0)
    order = [i for _ in range(p.epochs) for i in rng.permutation(len(sample))]
    weight = _ftrl_by_the_paper(sample, order, 3, p.alpha, p.beta, p.l1, p.l2)
    want = np.array([[weight(i, c) for c in range(3)] for i in range(13)])
    assert np.allclose(found, want, atol=1e-9) and (want == 0).any() and (want != 0).any()


def test_language_id_on_held_out_documents(spark, small):
    found = langid.op9_language_id(spark, small).where("held_out").join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert len(found) > 20 and right >= 0.95 * len(found)


def test_language_id_beside_clashing_columns(spark):
    data = [(i, ("der die das und " if i % 2 else "the and of to ") * (i % 5 + 2), "de" if i % 2 else "en", "x", 1, "y", 0.5) for i in range(80)] + [(90, None, None, None, None, None, None), (91, "12 34", "en", None, None, None, None), (None, "the of", "en", None, None, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score long, lang_pred string, unit double")
    found = {r.doc_id: r for r in langid.identify(df).collect()}
    assert found[90].lang_pred == found[91].lang_pred == "und" and found[90].score == 0.0 and found[None].lang_pred == "en"
    assert all(found[i].lang_pred == ("de" if i % 2 else "en") for i in range(80))
