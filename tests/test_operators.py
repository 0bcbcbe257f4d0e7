"""Hand-written cases of the packers, gate, plans, ledgers, tokenizer, shards and control plane."""

import hashlib
import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit, contamination, gate, ledger, mixture, packing, tokenizer
from corpusloom.plans import queries
from corpusloom.sources import lanes, shards
from corpusloom.streaming import control


# --- packing


def _concat(lengths, seq_len):
    packer, out = packing.ConcatSplit(seq_len), []
    for key, n in lengths:
        packer.add(key, n)
        while packer.ready():
            out.append(packer.emit())
    return out, packer.flush()


def test_concat_split_masks(spark):
    docs = spark.createDataFrame([("a", "web", 4), ("b", "web", 6)], "doc_key string, lane string, n_tokens int")
    spans = packing.concat_spans(docs.withColumn("order_key", F.when(F.col("doc_key") == "a", "000").otherwise("111")), 8)
    tokens = spark.createDataFrame([("a", [10, 11, 12, 257]), ("b", [20, 21, 22, 23, 24, 257])], "doc_key string, tokens array<int>")
    assert sorted(map(tuple, spans.select("seq", "doc_key", "start", "end", "place").collect())) == [(0, "a", 0, 4, 0), (0, "b", 0, 4, 4), (1, "b", 4, 6, 0)]
    rows = packing.materialize_tokens(spans, tokens, ["lane", "seq"])
    first = packing.sequence_arrays(rows, ["lane", "seq"], 8).where("seq = 0").first()
    assert "".join(map(str, first.loss)) == "11101110"
    assert "".join(map(str, first.position_id)) == "01230123" and "".join(map(str, first.segment)) == "11112222"
    last = packing.sequence_arrays(rows, ["lane", "seq"], 8).where("seq = 1").first()
    assert list(last.token) == [24, 257] + [packing.PAD] * 6 and list(last.segment) == [1, 1] + [0] * 6 and sum(last.loss) == 1
    allowed = packing.attention_allowed(list(first.segment))
    assert allowed[5] == [False] * 4 + [True, True, False, False] and packing.attention_allowed([0, 0]) == [[True, False], [False, True]]
    digests = packing.fingerprint(packing.sequence_arrays(rows, ["lane", "seq"], 8), ["lane", "seq"])
    assert digests.count() == 2 == digests.select("sequence_sha256").distinct().count()


def test_concat_split_closed_form_equals_simulation(spark):
    r = random.Random(1)
    lengths = [(f"d{i:03d}", r.choice([0, 1, 3, 8, 17, 200])) for i in range(300)]
    docs = packing.with_order(spark.createDataFrame([(k, "web", n) for k, n in lengths], "doc_key string, lane string, n_tokens int"))
    ordered = [(x.doc_key, x.n_tokens) for x in docs.orderBy("order_key").collect()]
    full, tail = _concat(ordered, 16)
    assert len(tail) <= 1
    want = [(i, s.key, s.start, s.end) for i, spans in enumerate(full + tail) for s in spans]
    for parts in (1, 7):
        spans = packing.concat_spans(docs.repartition(parts), 16)
        assert sorted(map(tuple, spans.select("seq", "doc_key", "start", "end").collect())) == sorted(want)
    assert packing.span_discontinuities(packing.concat_spans(docs, 16)).count() == 0


def test_response_only_loss(spark):
    tokens = spark.createDataFrame([("a", [258, 5, 6, 259, 7, 8, 257], 4)], "doc_key string, tokens array<int>, loss_start int")
    spans = spark.createDataFrame([("instruct", 0, "a", 0, 7, 0)], "lane string, seq long, doc_key string, start long, end long, place long")
    rows = packing.materialize_tokens(spans, tokens, ["lane", "seq"], response_only=True)
    assert "".join(map(str, packing.sequence_arrays(rows, ["lane", "seq"], 10).first().loss)) == "0001110000"


def test_best_fit(spark):
    packer = packing.BestFit(16, 2, 2)
    for i, n in enumerate([10, 9, 7, 30, 5, 3]):
        packer.add(f"d{i}", n)
    again = packing.BestFit(16, 2, 2)
    again.restore(json.loads(json.dumps(packer.state())))
    assert again.state() == packer.state()
    bins = packer.flush()
    assert bins == again.flush() and not packer.ready()
    # by hand: 10 | 9, 7 (full) | 30 cut | 5 beside 10 (one left, closed) | 3
    assert [[(s.place, s.key, s.start, s.end) for s in b] for b in bins] == [[(0, "d1", 0, 9), (9, "d2", 0, 7)], [(0, "d3", 0, 16)], [(0, "d0", 0, 10), (10, "d4", 0, 5)], [(0, "d5", 0, 3)]]
    docs = spark.createDataFrame([("code", f"d{i}", f"{i}", n) for i, n in enumerate([10, 9, 7, 30, 5, 3])], "lane string, doc_key string, order_key string, n_tokens int")
    found = packing.best_fit_spans(docs, 16).collect()
    assert sorted((r.doc_key, r.end) for r in found) == [("d0", 10), ("d1", 9), ("d2", 7), ("d3", 16), ("d4", 5), ("d5", 3)]


def _best_fit_by_definition(lengths, seq_len, max_open, residual):
    """The rules read aloud: open bins in a list, in order of opening."""
    out, bins = [], []
    for i, n in enumerate(lengths):
        n = min(n, seq_len)
        left = [seq_len - sum(b.values()) for b in bins]
        fits = [k for k, room in enumerate(left) if room >= n]
        if fits:
            k = min(fits, key=lambda x: left[x])
        else:
            if len(bins) == max_open:
                out.append(bins.pop(left.index(min(left))))
            bins.append({})
            k = len(bins) - 1
        bins[k][i] = n
        if seq_len - sum(bins[k].values()) < residual:
            out.append(bins.pop(k))
    return out + bins


def test_best_fit_equals_its_definition():
    r = random.Random(11)
    for _ in range(200):
        lengths = [r.randint(1, 40) for _ in range(r.randint(0, 60))]
        packer = packing.BestFit(32, 4, 4)
        found = []
        for i, n in enumerate(lengths):
            packer.add(i, n)
            while packer.ready() and r.random() < 0.7:
                found.append(packer.emit())
        assert [{s.key: s.end for s in b} for b in found + packer.flush()] == _best_fit_by_definition(lengths, 32, 4, 4)


def test_forged_arrays_break_the_padding_rules(spark):
    ok = (1, [1, 2, 3, 256], [2, 3, 256, 256], [1, 1, 0, 0], [0, 1, 2, 0], [1, 1, 1, 0])
    rows = [ok, (2, *ok[1:3], [1, 1, 0, 1], *ok[4:]), (3, [1, 2, 3, 7], *ok[2:]), (4, *ok[1:5], [1, 0, 1, 0]), (5, ok[1][:3], *ok[2:]), (6, *ok[1:5], [1, 3, 3, 0])]
    arrays = spark.createDataFrame(rows, "seq long, token array<int>, label array<int>, loss array<int>, position_id array<int>, segment array<int>")
    found = {(r.seq, r.rule) for r in packing.padding_violations(arrays, ["seq"], 4).collect()}
    assert found == {(2, "pad_loss"), (3, "pad_token"), (4, "pad_inside"), (4, "pad_token"), (4, "pad_loss"), (5, "length"), (6, "segments_mixed")}


def test_forged_tokens_break_the_rules(spark):
    spans = spark.createDataFrame([("instruct", 0, "a", 0, 7, 0)], "lane string, seq long, doc_key string, start long, end long, place long")
    tokens = spark.createDataFrame([("a", [258, 5, 6, 259, 7, 8, 257], 4)], "doc_key string, tokens array<int>, loss_start int")
    sound = packing.materialize_tokens(spans, tokens, ["lane", "seq"], response_only=True)
    rules = lambda rows: sorted(r.rule for r in packing.token_violations(rows, spans, tokens, ["lane", "seq"], True).collect())
    edit = lambda name, pos, value: sound.withColumn(name, F.when(F.col("pos") == pos, value).otherwise(F.col(name)))
    assert rules(sound) == [] and rules(edit("loss", 1, 1)) == ["loss_on_prompt"] and rules(edit("loss", 4, 0)) == ["loss_missing"] and rules(edit("loss", 6, 1)) == ["loss_on_last"]
    assert rules(edit("token", 2, 9)) == ["token"] and rules(edit("label", 2, 9)) == ["label"] and rules(edit("position_id", 2, 0)) == ["position"] and rules(edit("segment", 2, 2)) == ["segment"]
    assert rules(sound.where("pos <> 3")) == ["missing"] and rules(edit("pos", 3, 9)) == ["beyond_spans", "missing"] and rules(sound.unionAll(sound.where("pos = 3"))) == ["twice", "twice"]


def test_forged_spans_break_the_invariants(spark):
    docs = spark.createDataFrame([("a", "train", 9), ("b", "val", 4)], "doc_key string, split string, n_tokens int")
    rows = [(0, "a", 0, 9, 0), (1, "a", 3, 9, 0), (2, "b", 0, 4, 0), (3, "a", 0, 10, 0), (4, "a", 0, 2, 3), (5, "x", 0, 2, 0), (6, "a", 0, 9, 4)]
    spans = spark.createDataFrame([("code", *r) for r in rows], "lane string, seq long, doc_key string, start long, end long, place long")
    found = packing.invariant_violations(spans, docs, 12, ["lane", "seq"], no_split=True)
    assert sorted(r.rule for r in found.collect()) == sorted(["split_document", "not_train", "out_of_bounds", "gap_or_overlap", "unknown_document", "gap_or_overlap", "too_long"])


# --- gate, firewall, plans


def test_gate_cases(spark):
    cases = [(0.7, 0, None, False, "ACCEPT"), (0.3, 0, None, False, "REJECT"), (0.5, 0, None, False, "DEFER"), (0.5, 2, None, False, "DEFER"), (0.5, 3, None, False, "ACCEPT"), (0.41, 3, None, False, "REJECT"), (0.99, 0, "x", False, "REJECT"), (0.9, 0, None, True, "REJECT")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, q double, n int, flag string, dup boolean, want string")
    value = gate.score(F.col("q"), F.col("n"))
    decision, reason = gate.decide(F.col("flag"), F.col("dup"), value, F.col("n"), F.lit(0.6), F.lit(0.4))
    found = df.select("i", "want", decision.alias("d"), reason.alias("r")).orderBy("i").collect()
    assert [r.d for r in found] == [r.want for r in found]
    assert [r.r.split(":")[0] for r in found] == ["score_ok", "low_quality", "below_accept", "below_accept", "score_ok", "defer_expired", "eval_contamination", "duplicate_content"]
    plane = control.ControlPlane({})
    plane.admitted = {"c7"}
    judged = [plane.judge((f"k{i}", 1, round(q * 10000), f"c{i}", flag), n, 0.6, 0.4) for i, (q, n, flag, _, _) in enumerate(cases)]
    assert [d for d, _ in judged] == [c[4] for c in cases] and [r.split(":")[0] for _, r in judged] == [r.r.split(":")[0] for r in found]


def test_quality_of_short_texts(spark):
    texts = ["", "123 !", "one two three", "a a a a\na a a a\na a a a", "Été naïve Ünd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(T.quality_score(*T.quality_features(F.col("t")).values())).collect()]
    assert found[0] == found[1] == 0.0 and found[2] == 0.91 and found[3] < 0.1 < found[4]


def test_firewall_raises(spark):
    docs = spark.createDataFrame([("a", "train"), ("b", "eval")], "doc_key string, split string")
    assert contamination.assert_trainable(docs.where("split = 'train'")).count() == 1
    with pytest.raises(Exception, match="firewall: b"):
        contamination.assert_trainable(docs).collect()


def test_plan_floors_and_errors(spark):
    lane = mixture.LANES
    rows = mixture.compile_rows([mixture.Stage("s", 1, 5, {"web": 0.95, "code": 0.05, "instruct": 0.0})], steps=5)
    assert {(r[2], r[3]) for r in rows if r[2] != "web"} == {("code", 2), ("instruct", 1)} and any(r[7] for r in rows)
    with pytest.raises(mixture.PlanError):
        mixture.compile_rows([mixture.Stage("s", 1, 3, {"web": 1.0})], steps=5)
    with pytest.raises(mixture.PlanError):
        mixture.compile_rows([mixture.Stage("s", 1, 5, {"web": 0.9})], steps=5)
    with pytest.raises(mixture.PlanError, match="floors"):
        mixture.compile_rows([mixture.Stage("s", 1, 5, {"a": 1.0})], (mixture.Lane("a", "best_fit", True, 0.9), mixture.Lane("b", "best_fit", True, 0.9)), steps=5)
    bad = [mixture.Stage("s", 1, 3, {"web": 0.5}), mixture.Stage("t", 5, 4, {"web": 1.0}), mixture.Stage("u", 3, 6, {"web": 1.0})]
    assert len(mixture.problems(bad, steps=6)) == 3 and mixture.problems(mixture.STAGES) == []
    forked = mixture.fork_stages(mixture.STAGES, 26, {"web": 0.25, "code": 0.25, "instruct": 0.5})
    assert [(s.name, s.start, s.end) for s in forked] == [("warmup", 1, 20), ("main", 21, 25), ("main_fork", 26, 60), ("anneal_fork", 61, 80)]
    plain, other = mixture.compile_rows(), mixture.compile_rows(forked)
    assert plain[: 25 * 3] == other[: 25 * 3] and plain != other and mixture.plan_digest(plain) != mixture.plan_digest(other)
    bad = spark.createDataFrame([(*rows[0][:3], 1, *rows[0][4:])], mixture.PLAN_SCHEMA)
    assert mixture.violations(bad).count() == 2 and len(lane) == 3


# --- ledgers


def _ledger(spark, n=6):
    rows = spark.createDataFrame([(x, i, json.dumps({"i": i, "of": x}, sort_keys=True)) for x in ("a", "b") for i in range(n)], "ledger string, seq_key int, data string")
    return ledger.chain(rows)


def test_ledger_detects_forgeries(spark):
    rows = _ledger(spark).cache()
    heads = rows.groupBy("ledger").agg((F.max("seq") + 1).alias("records"), F.max_by("hash", "seq").alias("head"))
    heads = spark.createDataFrame([tuple(r) for r in heads.collect()], heads.schema)
    assert ledger.violations(rows, heads).count() == 0
    edited = rows.withColumn("data", F.when((F.col("ledger") == "a") & (F.col("seq") == 2), F.lit("{}")).otherwise(F.col("data")))
    assert [(r.ledger, r.seq, r.violation) for r in ledger.violations(edited, heads).collect()] == [("a", 2, "hash")]
    assert {r.violation for r in ledger.violations(rows.where("seq <> 3"), heads).collect()} == {"link", "sequence"}
    assert {r.violation for r in ledger.violations(rows.where("seq > 0"), heads).collect()} == {"link", "sequence"}  # a cut beginning
    assert [r.violation for r in ledger.violations(rows.where("seq < 5"), heads).collect()] == ["head", "head"]  # a cut end


def test_ledger_append_recover_fork(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    rows = lambda lo, hi: spark.createDataFrame([("a", i, f'{{"i":{i}}}') for i in range(lo, hi)], "ledger string, seq_key int, data string")
    heads = ledger.append(rows(0, 5), path)
    heads = spark.createDataFrame([tuple(r) for r in heads.collect()], heads.schema)
    ledger.append(rows(5, 8), path, heads, attempt=2)  # dies before it commits
    stored = spark.read.parquet(path)
    assert ledger.violations(stored).count() == 0 and stored.count() == 8
    live, orphans = ledger.recover(stored, heads, attempt=2)
    assert (live.count(), orphans.count()) == (5, 3) and ledger.violations(live, heads).count() == 0
    assert ledger.fork(live, heads, "side").select("branch").distinct().first().branch == "side"
    wrong = spark.createDataFrame([("a", 5, "x")], ledger.HEADS)
    with pytest.raises(ledger.LedgerError):
        ledger.recover(stored, wrong, attempt=2)
    with pytest.raises(ledger.LedgerError):
        ledger.fork(live, wrong, "side")
    assert ledger.committed(spark, f"{tmp_path}/commits")[0] == 0
    ledger.commit(heads, f"{tmp_path}/commits", 1)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        ledger.commit(wrong, f"{tmp_path}/commits", 1)
    ledger.commit(wrong, f"{tmp_path}/commits", 2)
    number, held = ledger.committed(spark, f"{tmp_path}/commits")
    assert (number, tuple(held.first())) == (2, ("a", 5, "x"))
    again = ledger.last_by(stored.select("ledger", "seq", "data"), "ledger", "seq").first()
    assert (again.seq, again.data) == (7, '{"i":7}')


def test_ledger_lines_with_a_torn_tail(spark, tmp_path):
    rows = _ledger(spark, 4).where("ledger = 'a'")
    ledger.write_lines(rows, f"{tmp_path}/lines")
    records, torn = ledger.read_lines(spark, f"{tmp_path}/lines")
    assert ledger.violations(records.withColumn("ledger", F.lit("a"))).count() == 0 and torn.count() == 0
    ledger.write_torn(spark, f"{tmp_path}/lines", '{"data":{"i":9},"hash":"0000000000"}')
    assert ledger.read_orphans(spark, f"{tmp_path}/lines").count() == 4
    records, torn = ledger.read_lines(spark, f"{tmp_path}/lines")
    assert (records.count(), torn.count()) == (4, 1)


# --- tokenizer and shards


def test_tokenizer_round_trip_and_lock(spark, tmp_path):
    docs = spark.createDataFrame([("web/1", "web", "the theme of the thesis, 12 é", None, None), ("instruct/2", "instruct", None, "why the?", "the ends"), ("web/3", "web", "", None, None), ("web/4", "web", None, None, None)], "doc_key string, lane string, content string, prompt string, response string")
    trained = tokenizer.train(tokenizer.word_counts(docs.where("content is not null")), 20, least=1)
    assert trained.merges[:2] == ((ord("h"), ord("e")), (ord("t"), 260))  # "he" and "th" come alike: the smaller pair
    found = {r.doc_key: r for r in tokenizer.decode(tokenizer.encode_documents(docs, trained), trained).collect()}
    assert found["web/1"].text == "the theme of the thesis, 12 é" and found["instruct/2"].text == "why the? the ends"
    assert found["web/3"].tokens == found["web/4"].tokens == [257]
    two = found["instruct/2"]
    assert two.tokens[0] == 258 and two.tokens[two.loss_start - 1] == 259 and two.tokens[-1] == 257 and found["web/1"].loss_start is None
    file, lock = tokenizer.freeze(trained)
    assert tokenizer.load_frozen(file, lock) == trained
    with pytest.raises(tokenizer.TokenizerIntegrityError):
        tokenizer.load_frozen(json.dumps({"merges": [[1, 2]]}), lock)
    ranks = trained.ranks()
    for word in ("the", "thesis", " theme", "zzz", ""):
        ids = tokenizer.encode_word(word.encode(), ranks)
        assert b"".join(trained.pieces()[i] for i in ids).decode() == word


def test_shards_are_written_once_and_verified(spark, tmp_path):
    docs = spark.createDataFrame([("web", "train", f"web/{i}", f"c{i}", [i, i + 1, 257], None, 0.5) for i in range(300)], "lane string, split string, doc_key string, content_sha256 string, tokens array<int>, loss_start int, quality double")
    path = f"{tmp_path}/shards"
    shards.write_shards(shards.assign_shards(docs), path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        shards.write_shards(shards.assign_shards(docs), path)
    manifests = shards.manifest(spark, path, "t").cache()
    assert sorted((r.shard_id, r.num_docs, r.num_tokens) for r in manifests.collect()) == [("web-train-000", 128, 384), ("web-train-001", 128, 384), ("web-train-002", 44, 132)]
    shards.verify(spark, path, manifests)
    assert shards.shards_where(manifests, lane="web", split="val").count() == 0 and shards.catalog_digest(manifests).first().num_shards == 3
    assert [d.offset for d in manifests.where("shard_id = 'web-train-002'").first().docs][:3] == [0, 3, 6]
    digest = shards.write_catalog(manifests, f"{tmp_path}/catalog")
    catalog = shards.load_catalog(spark, f"{tmp_path}/catalog")
    assert shards.catalog_digest(catalog).first().catalog_sha256 == digest and shards.pin_mismatches(catalog, manifests).count() == 0
    other = manifests.where("shard_id <> 'web-train-000'").withColumn("manifest_sha256", F.when(F.col("shard_id") == "web-train-001", "x").otherwise(F.col("manifest_sha256")))
    assert sorted(map(tuple, shards.pin_mismatches(catalog, other).collect())) == [("web-train-000", "missing"), ("web-train-001", "differs")]
    with open(next((tmp_path / "catalog" / "digest").glob("*.json")), "w") as f:
        f.write('{"catalog_sha256":"x"}')
    for crc in (tmp_path / "catalog" / "digest").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(shards.ShardIntegrityError):
        shards.load_catalog(spark, f"{tmp_path}/catalog")
    files = shards.file_hashes(spark, path, "*.parquet").collect()
    assert files and all(hashlib.sha256(open(r.path.removeprefix("file:"), "rb").read()).hexdigest() == r.sha256 for r in files)

    shards.verify(spark, path, manifests)
    held = shards.assign_shards(docs).withColumn("tokens", F.when(F.col("doc_key") == "web/7", F.array(F.lit(1))).otherwise(F.col("tokens")))
    assert shards.retokenized_differently(spark.read.parquet(path), docs).count() == 0
    assert [r.doc_key for r in shards.retokenized_differently(spark.read.parquet(path), held).collect()] == ["web/7"]
    shards.write_shards(held, f"{tmp_path}/forged")
    assert shards.damaged(spark, f"{tmp_path}/forged", manifests).count() == 1
    with pytest.raises(shards.ShardIntegrityError):
        shards.verify(spark, f"{tmp_path}/forged", manifests)


def test_shard_numbers_have_more_than_three_digits(spark):
    docs = spark.range(130_000).select(F.lit("web").alias("lane"), F.lit("train").alias("split"), F.concat(F.lit("web/"), F.col("id")).alias("doc_key"))
    found = shards.assign_shards(docs).select("shard_id", "doc_idx")
    assert found.distinct().count() == 130_000 and found.select("shard_id").distinct().count() == 1016
    assert found.agg(F.max("doc_idx")).first()[0] == 127 and found.where("shard_id = 'web-train-1015'").count() == 130_000 - 1015 * 128


def test_raw_documents(spark, tmp_path):
    with open(f"{tmp_path}/raw.jsonl", "w") as f:
        f.write('{"doc_id":"a","lane":"web","split":"train","text":"x"}\n\n{"doc_id":"b","lane":"instruct","split":"val","prompt":"p","response":"r"}\n')
    raw = lanes.read_raw(spark, f"{tmp_path}/raw.jsonl")
    assert raw.count() == 2
    texts = {r.doc_id: r.t for r in raw.select("doc_id", T.document_text(F.col("lane"), F.col("text"), F.col("prompt"), F.col("response")).alias("t")).collect()}
    assert texts == {"a": "x", "b": '{"prompt":"p","response":"r"}'}
    written = lanes.write_raw(raw, f"{tmp_path}/out")
    assert written.count() == 2 and written.where("length(sha256) = 64").count() == 2
    assert lanes.read_raw(spark, f"{tmp_path}/nothing.jsonl").count() == 0
    assert spark.read.json(f"{tmp_path}/out").where("lane = 'web'").count() == 1
    with open(f"{tmp_path}/one.json", "w") as f:
        f.write('{\n "a": 1\n}')
    assert lanes.read_json(spark, f"{tmp_path}/one.json").first().a == 1


# --- control plane


def _sources(seed=5, n=400):
    r = random.Random(seed)
    out = {}
    for lane in ("code", "instruct", "web"):
        out[lane] = [(f"{lane}/{i}", r.randint(5, 90), r.randint(4000, 9000), f"{lane}-{r.randint(0, 3 * n)}", "eval_exact_match" if r.random() < 0.02 else None) for i in range(n * (4 if lane == "web" else 1))]
    return out


def _run(plane, steps, first, last):
    return list(control.step_events(plane, steps, first, last))


def test_control_plane_is_deterministic_and_resumes():
    steps = control.steps_of(mixture.compile_rows())
    whole = _run(control.ControlPlane(_sources()), steps, 1, 40)
    plane = control.ControlPlane(_sources())
    first = _run(plane, steps, 1, 20)
    ahead = _run(plane.clone(), steps, 21, 21)
    resumed = control.ControlPlane(_sources()).restore(plane.state())
    rest = _run(resumed, steps, 21, 40)
    assert whole == first + rest and rest[: len(ahead)] == ahead
    with pytest.raises(RuntimeError):
        resumed.run_step(43, steps[43])
    with pytest.raises(control.OrderMismatch):
        control.ControlPlane({k: v[::-1] for k, v in _sources().items()}).restore(plane.state())
    with pytest.raises(control.OrderMismatch):
        control.ControlPlane(_sources(), mixture.LANES[:2]).restore(plane.state())
    decisions = [json.loads(b) for k, _, _, _, b in whole if k == "decision"]
    assert {d[10] for d in decisions} == {"ACCEPT", "REJECT", "DEFER", "ACCEPT_FLOOR_OVERRIDE"}
    spans = [json.loads(b) for k, _, _, _, b in whole if k == "span"]
    report = [json.loads(b) for k, _, _, _, b in whole if k == "lane"]
    flagged = {d[0] for docs in _sources().values() for d in docs if d[4]}
    assert not flagged & {s[4] for s in spans}
    assert all(r[3] >= r[6] for r in report) and all(sum(r[3] for r in report if r[0] == s) == 8 for s in range(1, 41))


def test_control_plane_runs_out():
    steps = control.steps_of(mixture.compile_rows())
    with pytest.raises(control.DataExhausted):
        _run(control.ControlPlane({k: v[:5] for k, v in _sources().items()}), steps, 1, 20)


def test_control_plane_runs_the_whole_plan_or_reports_its_end(spark):
    assert queries.STEPS == 80 and {r[1] for r in mixture.compile_rows()} == {"warmup", "main", "anneal"}
    rows = [(k, lane, "train", f"{i:04d}", n, q / 10000, c) for lane, docs in _sources().items() for i, (k, n, q, c, _) in enumerate(docs[:60])]
    facts = spark.createDataFrame(rows, "doc_key string, lane string, split string, order_key string, n_tokens int, quality double, content_sha256 string")
    flags = spark.createDataFrame([], "doc_key string, flag string")
    events = control.run_batch(facts, flags, mixture.compile_rows(), queries.STEPS)
    last, reason = queries.ended(events)
    assert 0 < last < 80 and "lane" in reason
    assert control.unfold(events, "exhausted").first()["step"] == last + 1
    assert {r.step for r in control.unfold(events, "lane").collect()} == set(range(1, last + 1))


def test_run_on_a_share_of_the_documents_equals_the_run_on_all(spark, monkeypatch):
    rows = [(k, lane, "train", f"{i:05d}", n, q / 10000, c) for lane, docs in _sources(n=1500).items() for i, (k, n, q, c, _) in enumerate(docs)]
    facts = spark.createDataFrame(rows, "doc_key string, lane string, split string, order_key string, n_tokens int, quality double, content_sha256 string")
    flagged = spark.createDataFrame([(d[0], d[4]) for docs in _sources(n=1500).values() for d in docs if d[4]], "doc_key string, flag string")
    asked = []

    def flags(chosen):
        asked.append(chosen.count())
        return flagged.join(chosen.select("doc_key"), "doc_key", "left_semi")

    plan = mixture.compile_rows()[: 20 * 3]
    bag = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = _run(control.ControlPlane(_sources(n=1500)), control.steps_of(plan), 1, 20)
    assert bag(control.run_batch(facts, flags, plan, 20)) == sorted(want, key=repr)
    assert len(asked) == 1 and asked[0] < len(rows)
    monkeypatch.setattr(control, "TOKENS", 100_000)  # too few at first
    assert bag(control.run_batch(facts, flags, plan, 20)) == sorted(want, key=repr) and len(asked) > 2


def test_stream_equals_batch(spark, tmp_path):
    rows, sources = mixture.compile_rows(), _sources()
    want = _run(control.ControlPlane(sources), control.steps_of(rows), 1, 6)
    for i, part in enumerate([[2, 1], [3, 6], [4, 5]]):
        spark.createDataFrame([("main", s) for s in part], "run string, step int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("run string, step int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, control.STATE_STORE)
    stream = control.run_stream(source, sources, rows)
    started = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    started.awaitTermination(180)
    spark.conf.set(provider, before)
    found = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def _audited(spark, events):
    facts = spark.createDataFrame([(k, lane, "train", n, q / 10000, c) for lane, docs in _sources().items() for k, n, q, c, _ in docs], "doc_key string, lane string, split string, n_tokens int, quality double, content_sha256 string")
    flags = spark.createDataFrame([(d[0], d[4]) for docs in _sources().values() for d in docs if d[4]], "doc_key string, flag string")
    frame = spark.createDataFrame(events, control.EVENT)
    return {name for name, passed, _ in audit.run_audit(queries.run_checks(spark, frame, facts, flags, mixture.compile_rows()[: 15 * 3], 15)) if not passed}


def test_audit_notices_forgeries(spark):
    events = _run(control.ControlPlane(_sources()), control.steps_of(mixture.compile_rows()), 1, 15)
    assert _audited(spark, events) == set()
    decisions = [e for e in events if e[0] == "decision"]
    spans = [e for e in events if e[0] == "span"]
    body = lambda e, at, v: (*e[:4], json.dumps([v if i == at else x for i, x in enumerate(json.loads(e[4]))]))
    swap = lambda old, new: [new if e is old else e for e in events]
    accepted = next(e for e in decisions if json.loads(e[4])[10] == "ACCEPT")
    assert "decisions_follow_from_documents_and_plan" in _audited(spark, swap(accepted, body(accepted, 10, "REJECT")))
    assert "decisions_follow_from_documents_and_plan" in _audited(spark, swap(accepted, body(accepted, 6, 0.9999)))
    held = next(d[0] for docs in _sources().values() for d in docs if d[4])
    assert "no_flagged_document_consumed" in _audited(spark, swap(spans[3], body(spans[3], 4, held)))
    assert {"spans_follow_one_another"} <= _audited(spark, [*events, spans[0]])
    assert {"every_step_once", "plan_reconciles"} <= _audited(spark, [e for e in events if e[1] != 7])
    lane = next(e for e in events if e[0] == "lane")
    assert "plan_reconciles" in _audited(spark, swap(lane, body(lane, 3, 99)))
    with pytest.raises(ValueError):
        audit.run_audit({})


def test_rows_only_queries(spark, small):
    assert all(r.passed for r in queries.QUERIES["control_plane_audit"](spark, small).collect())
    assert tuple(queries.QUERIES["replay_from_snapshot"](spark, small).first())[1] == 0
    facts = {r.doc_key: r.n_tokens for r in lanes.facts(spark, small).collect()}
    packed = queries.QUERIES["pack_best_fit"](spark, small).collect()
    assert {r.doc_key: r.end for r in packed} == {k: min(n, 128) for k, n in facts.items() if k in {r.doc_key for r in packed}}
    assert queries.QUERIES["bpe_encode"](spark, small).count() == len(facts)


def test_segment_losses_and_helpers(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0, 2), (1, 0, 2, 5, 8)], "step int, row int, place long, start long, end long")
    losses = spark.createDataFrame([(1, 0, [0.5, 1.0, 2.0, 3.0, 4.0])], "step int, row int, values array<float>")
    assert sorted(r.loss_sum for r in audit.segment_losses(spans, losses).collect()) == [1.5, 9.0]
    assert [r[0] for r in spark.range(1).select(F.size(T.ngrams(F.array(F.lit("a")), 2))).collect()] == [0]
    assert spark.range(1).select(*T.split_key(F.lit("x/y/12"))).first() == ("x/y", 12)


def test_tokenizer_counts_every_word(spark):
    data = [("ab", 3), ("xyz", 1), ("xyw", 1), ("xyv", 1), ("xyu", 1), ("q", 9)]
    words = spark.createDataFrame(data, "word string, n long").repartition(2)
    trained = tokenizer.train(words, 6)
    assert trained.merges[0] == (ord("x"), ord("y")) and trained.merges[1] == (ord("a"), ord("b"))
    assert tokenizer.train(words, 6, limit=3) == trained  # over the limit words stay distributed
    assert tokenizer.train(words.limit(0), 6, limit=-1).merges == ()


def test_distributed_training_makes_many_merges_a_round(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(letters[i] * (i % 3 + 1) + letters[(i * 7 + 3) % 26] + letters[(i * 11 + 5) % 26], 10 * i + 7) for i in range(26)]
    words = spark.createDataFrame(rows, "word string, n long").coalesce(1)
    spark.sparkContext.setJobGroup("training", "distributed")
    found = tokenizer.train(words, 40, limit=3)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("training"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    split, merges = [(list(w.encode()), n) for w, n in rows], []
    while len(merges) < 40:
        counts = {}
        for ids, n in split:
            for p in zip(ids, ids[1:]):
                counts[p] = counts.get(p, 0) + n
        merges.append(min(counts, key=lambda p: (-counts[p], p)))
        split = [(tokenizer._replace(ids, merges[-1], tokenizer.FIRST_MERGE + len(merges) - 1), n) for ids, n in split]
    assert list(found.merges) == merges == list(tokenizer.train(words, 40).merges)
    assert jobs < 40


def test_documents_are_encoded_where_they_are(spark):
    docs = spark.createDataFrame([("a", None, None, None), ("b", "é\u2003x 12\x0b\n\x1f", None, None), ("c", "{}", "no", "yes no"), ("d", "half", "no", None)], "doc_key string, content string, prompt string, response string")
    encoded = tokenizer.encode_documents(docs, tokenizer.Tokenizer(((110, 111),)))
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    found = {r.doc_key: (r.tokens, r.loss_start) for r in encoded.collect()}
    assert found["a"] == ([257], None)
    assert found["b"] == ([*"é\u2003x 12\x0b\n\x1f".encode(), 257], None)
    assert found["c"] == ([258, 260, 259, *b" yes ", 260, 257], 3)
    assert found["d"] == ([*b"half", 257], None)
    memo = tokenizer._Memo(tokenizer.Tokenizer(((97, 98), (260, 97), (261, 261))), 2)
    for words in ({b"aba", b"b"}, {b"abaabaab"}, {b"b", b""}):
        memo.meet(words)
        assert {w: memo[w] for w in words} == {w: b"".join(i.to_bytes(4, "little") for i in tokenizer.encode_word(w, {(97, 98): 0, (260, 97): 1, (261, 261): 2})) for w in words}
    assert len(memo) <= 3



def test_words_are_split_merged_and_digested_together(spark, monkeypatch):
    rng, alphabet = random.Random(5), [b" ", b" ", b"\n", b"\x0b", b"\x1c", b"a", b"b", b"Z", b"0", b"9", b".", b"\xc3\xa9", b"\xe2\x80\x83"]
    texts = [b"".join(rng.choices(alphabet, k=rng.randrange(9))) for _ in range(2000)] + [b"ab" * 500, b" " + b"a" * 101]
    found = re.compile(T.PRETOKEN.encode()).findall
    monkeypatch.setattr(tokenizer, "PIECE", 100)
    pieces = list(tokenizer._pieces(pa.array([b"left out", *texts], pa.binary()).slice(1)))
    assert [x[0] for x in pieces] == [0, *(x[1] for x in pieces[:-1])] and pieces[-1][1] == len(texts) and len(pieces) > 50
    for start, end, data, bounds in pieces:
        words, which = tokenizer._distinct(data, tokenizer.split_words(data, bounds))
        assert [words[i].as_py() for i in which] == [w for x in texts[start:end] for w in found(x)]
    merges = ((97, 97), (97, 98), (260, 97), (261, 261), (32, 97), (98, 90), (263, 263), (264, 260))
    words = sorted({w for x in texts for w in found(x)})
    for longest in (tokenizer.DENSE, 0):  # side by side, and in a line
        monkeypatch.setattr(tokenizer, "DENSE", longest)
        ids, n, place = tokenizer._Merger(tokenizer.Tokenizer(merges)).ids(pa.array(words, pa.binary()))
        ends = n.cumsum()
        ranks = tokenizer.Tokenizer(merges).ranks()
        assert [ids[ends[i] - n[i] : ends[i]].tolist() for i in place] == [tokenizer.encode_word(w, ranks) for w in words]

    rows = [(f"{i}", x.decode(), None, None) for i, x in enumerate(texts[:50] + texts[-2:])] + [("p", "{}", "", "b "), ("q", "{}", " ab ", " ab"), ("r", None, "ab", None)]
    docs = spark.createDataFrame(rows, "doc_key string, content string, prompt string, response string").repartition(2)
    tokens = {r.doc_key: r for r in tokenizer.encode_documents(docs, tokenizer.Tokenizer(merges)).collect()}
    digests = tokenizer.token_digests(docs, tokenizer.Tokenizer(merges))
    assert {r.doc_key: (r.n_tokens, r.loss_start, r.token_sha256) for r in digests.collect()} == {k: (len(r.tokens), r.loss_start, hashlib.sha256(",".join(map(str, r.tokens)).encode()).hexdigest()) for k, r in tokens.items()}
    assert tokens["p"].tokens == [258, 259, 32, 98, 32, 257] and tokens["p"].loss_start == 2 and tokens["r"].tokens == [257]
    assert tokens["q"].tokens == [258, 32, 261, 32, 259, 32, 32, 261, 257] and tokens["q"].loss_start == 5
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (digests, tokenizer.word_counts(docs))]
    assert not any(x in p for p in plans for x in ("transform(", "array_join", "regexp", "Generate"))


def test_spans_of_one_place_are_held_to_the_rules_in_one_order(spark):
    docs = spark.createDataFrame([(k, "train", 9) for k in "abc"], "doc_key string, split string, n_tokens int")
    rows = [("web", 0, "a", 0, 1, 1), ("web", 0, "b", 0, 5, 1), ("web", 0, "c", 0, 2, 6)]
    for given in (rows, rows[::-1]):
        spans = spark.createDataFrame(given, "lane string, seq long, doc_key string, start long, end long, place long").coalesce(1)
        found = packing.invariant_violations(spans, docs, 12, ["lane", "seq"], no_split=False)
        assert sorted(map(tuple, found.collect())) == [("gap_or_overlap", "a"), ("gap_or_overlap", "b")]


def test_containment_moves_no_train_words(spark):
    rng = random.Random(5)
    texts = [[rng.choice(["a", "b", "é", "dd"]) for _ in range(rng.randint(0, 40))] for _ in range(120)]
    held = [t[rng.randint(0, len(t)) :][: rng.randint(0, 30)] for t in texts[:60]] + [["a"], ["a", "b"], ["b"] * 8, []] + [["x", "y"]]
    train = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "doc_key string, tokens array<string>")
    out = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(held)], "doc_key string, tokens array<string>")
    want = {(f"t{i}", f"h{j}") for i, t in enumerate(texts) for j, h in enumerate(held) if h and any(t[k : k + len(h)] == h for k in range(len(t)))}
    for found in (contamination.containments(train, out), contamination.containments(train, out, anchors=7)):
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    plan = contamination.containments(train, out)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "explode" not in plan  # no row for a word


def test_token_rules_move_each_token_once(spark):
    spans = spark.createDataFrame([("web", 0, "a", 0, 3, 0)], "lane string, seq long, doc_key string, start long, end long, place long")
    tokens = spark.createDataFrame([("a", [1, 2, 3])], "doc_key string, tokens array<int>")
    sound = packing.materialize_tokens(spans, tokens, ["lane", "seq"])
    rows = sound.unionByName(sound.where("pos = 1")).unionByName(sound.where("pos = 2").withColumn("pos", F.lit(7).cast("long"))).unionByName(sound.where("pos = 2").withColumn("pos", F.lit(7).cast("long")))
    found = packing.token_violations(rows, spans, tokens, ["lane", "seq"])
    assert sorted((r.rule, r.pos) for r in found.collect()) == [("beyond_spans", 7), ("beyond_spans", 7), ("twice", 1), ("twice", 1), ("twice", 7), ("twice", 7)]
    with_sides = found._jdf.queryExecution().sparkPlan().toString()
    tree = with_sides[: with_sides.index("SortMergeJoin")] if "SortMergeJoin" in with_sides else with_sides
    assert "Window" not in tree  # none over the joined rows, which would move them again
