"""op4 and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import bpe, decontaminate, langid
from tests.llm.cases import SCHEMA, rows
from tests.llm.test_rowwise import _bag, _components, _fp

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _words(text):
    return WORDS.findall((text or "").translate(LOWER))


def _hits(data, items, window=10, least=1.0):
    out = []
    for key, text in data:
        words, hit, ids = _words(text), set(), set()
        for item, t in items:
            want = _words(t)
            w = min(window, len(want))
            need = -(-w * least // 1) if least < 1 else w
            for i in range(len(want) - w + 1 if w and item is not None else 0):
                for s in range(len(words) - w + 1):
                    same = [j for j in range(w) if words[s + j] == want[i + j]]
                    if len(same) >= need:
                        hit.update(s + j for j in same)
                        ids.add(item)
        joined = ",".join(sorted(map(str, ids)))
        out.append((key, len(words), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return out


def _case():
    r = random.Random(2)
    word = lambda: r.choice(["the", "of", "Ünd", "x"] + [f"w{i}" for i in range(30)])
    items = [(i, " ".join(word() for _ in range(r.choice([3, 9, 10, 11, 30])))) for i in range(12)]
    items += [(100, "the the the the the the the the the the the the"), (101, ""), (102, None), (104, "w7"), (None, "w1 w2"), (3, "another text of item three"), items[5], (103, "ÉTÉ été")]
    data = []
    for i in range(60):
        text = [word() for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 2)):
            own = (r.choice(items)[1] or "").upper().split()
            text += own[r.randint(0, 2) :] + [word() for _ in range(r.randint(0, 3))]
        data.append((i, ", ".join(text)))
    data += [(200, "the " * 40), (201, None), (202, "ÉTÉ été"), (203, "été été"), data[3], (None, data[3][1]), (3, "another text of Item three!")]
    return data + [(1000 + k, t) for k, t, *_ in rows() if k is not None], items


@pytest.mark.parametrize("least", [1.0, 0.8])
@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination(spark, monkeypatch, least, limit):
    monkeypatch.setattr(decontaminate, "TERM_LIMIT", limit)  # 0: nothing is broadcast
    data, items = _case()
    docs = spark.createDataFrame([(*x, 1, 2) for x in data], "doc_id long, text string, item_id long, row long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench, least=least).drop("row").collect()
    assert _bag(map(tuple, found)) == _bag(_hits(data, items, least=least))


@pytest.mark.parametrize("least", [1.0, 0.8])
def test_decontamination_of_identical_rows(spark, tmp_path, least):
    item = " ".join(f"term{i}" for i in range(12))
    leak = f"before it {item} after it"
    data = [(1, leak), (1, leak), (None, leak), (None, leak), (None, leak), (2, leak), (3, "nothing of it"), (3, "nothing of it")]
    docs, items = spark.createDataFrame(data, "doc_id long, text string").repartition(3), [(1, item)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = decontaminate.contamination(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), least=least).drop("row").collect()
    assert _bag(map(tuple, found)) == _bag(_hits(data, items, least=least)) and sum(r.n_hit == 12 for r in found) == 6
    if least == 1.0:
        assert [r.doc_id for r in corpus_pipeline.benchmark(spark, docs, str(tmp_path)).collect()] == [3, 3]


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    found = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(found) == len(rows()) and not any(r.contaminated for r in found)


def _brute(spark, docs, items):
    """The five stages in plain Python; the language model alone is the operator's."""
    model = langid.fit(langid.training_rows(docs))
    data = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    data = [x for x in data if (p := model.predict(x[1]))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE]
    best = {}
    for key, text in data:
        if (held := best.get(text, [None])[0]) is None or key is not None and key > held:
            best[text] = [key, text]
    data = [tuple(x) for x in best.values()]
    groups = defaultdict(list)
    for x, root in zip(data, _components([_fp(t) for _, t in data])):
        groups[root].append(x)
    data = [min(g, key=lambda x: (x[0] is None, x[0] or 0, x[1])) for g in groups.values()]
    data = [x for x, h in zip(data, _hits(data, items)) if not h[5]]
    t = bpe._tokenizer(bpe.tokenizer_text())
    out = []
    for key, text in data:
        ids = t.encode(text, add_special_tokens=False).ids
        out.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_pipeline(spark, small, tmp_path):
    found = corpus_pipeline.run(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert _bag(map(tuple, found)) == _bag(_brute(spark, docs, items)) and len(found) > 50


def test_pipeline_on_awkward_rows(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "alpha Beta"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert _bag(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == _bag(_brute(spark, read, items))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, read, str(tmp_path)).columns == read.columns
        assert stage(spark, read.limit(0), str(tmp_path)).count() == 0


def test_stages_keep_columns_and_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "benchmark", "tokens"]


def test_stages_keep_further_columns(spark, tmp_path):
    """Columns named like those that the stages add, with dots, and equal rows that differ in them only."""
    names = ["_key", "_KEY_", "_number", "_score", "_lang_pred", "row", "fp", "a.b", "kept", "component", "`x"]
    data = [(i % 50, t, "en" if i % 2 else "de", "s", 1, *(f"{n}{i % 3}" for n in names)) for i, (_, t, *_) in enumerate(rows())]
    fields = ["doc_id", "text", "lang", "source", "n_chars", *names]
    docs = spark.createDataFrame(data, fields)
    spark.createDataFrame([(1, "alpha Beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = docs.select(fields[:5])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == fields, name
        assert _bag(tuple(r)[:5] for r in found.collect()) == _bag(map(tuple, stage(spark, plain, str(tmp_path)).collect())), name
        assert {tuple(map(repr, r)) for r in found.collect()} <= {tuple(map(repr, r)) for r in docs.collect()}


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "123", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]
