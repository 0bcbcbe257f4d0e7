"""A run that crashes, goes on, is replayed and forks."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import audit, checkpoint, ledger, mixture
from corpusloom.streaming import requirements
from corpusloom.streaming import run as runs

STAGES = (mixture.Stage("warmup", 1, 5, {"web": 0.6, "code": 0.25, "instruct": 0.15}), mixture.Stage("main", 6, 12, {"web": 0.45, "code": 0.3, "instruct": 0.25}, 0.56))


def _inputs(spark, plan):
    r = random.Random(5)
    rows, tokens = [], []
    for lane in ("code", "instruct", "web"):
        for i in range(500 if lane == "web" else 200):
            key, n = f"{lane}/{i}", r.randint(5, 60)
            rows.append((key, lane, "train", f"{i:05d}", n, r.randint(4500, 9000) / 10000, f"{lane}-{r.randint(0, 900)}"))
            tokens.append((key, [r.randint(0, 255) for _ in range(n - 1)] + [257], 3 if lane == "instruct" else None))
    facts = spark.createDataFrame(rows, "doc_key string, lane string, split string, order_key string, n_tokens int, quality double, content_sha256 string")
    frame = spark.createDataFrame(tokens, "doc_key string, tokens array<int>, loss_start int")
    flags = spark.createDataFrame([("web/3", "eval_exact_match")], "doc_key string, flag string")
    return runs.Inputs(facts.cache(), flags, frame.cache(), plan, _losses, lanes=mixture.LANES, seq_len=64)


def _losses(batches):
    cells = batches.select("step", F.posexplode("sequences").alias("at", "q"))
    return cells.select("step", "at", F.transform("q.token", lambda t: t % 7 / 8.0).alias("values"))


class Crash(RuntimeError):
    pass


def _crash(point, step):
    def fault(now, at):
        if (now, at) == (point, step):
            raise Crash

    return fault


@pytest.fixture(scope="module")
def plan():
    return mixture.compile_rows(STAGES, steps=12)


@pytest.fixture(scope="module")
def world(spark, plan, tmp_path_factory):
    """An uninterrupted run, and one that died while it wrote its second interval and went on."""
    root, inputs = str(tmp_path_factory.mktemp("runs")), _inputs(spark, plan)
    whole = runs.Run(spark, f"{root}/whole")
    assert whole.advance(inputs, 12, 4) == 12
    broken = runs.Run(spark, f"{root}/broken")
    with pytest.raises(Crash):
        broken.advance(inputs, 12, 4, _crash("written_ahead", 8))
    assert broken.snapshot().step == 4 and broken.split()[1].count() > 0
    assert broken.advance(inputs, 12, 4) == 12
    return inputs, whole, broken


def _stream(run):
    return [tuple(r) for r in run.records("consumption").orderBy("step").select("step", "batch_id", "batch_sha256", "state_sha256").collect()]


def test_a_resumed_run_is_the_uninterrupted_one(world):
    inputs, whole, broken = world
    assert _stream(whole) == _stream(broken) and [s[0] for s in _stream(broken)] == list(range(1, 13))
    live, orphans = broken.split()
    assert ledger.violations(live.drop("attempt"), broken.heads()).count() == 0
    dead, now = broken.records("consumption", orphans), broken.records("consumption", live)
    again = ledger.orphans_against_live(dead, now, "step", ["batch_id", "batch_sha256"]).collect()
    assert sorted((r.step, r.identical) for r in again) == [(s, True) for s in range(5, 9)]
    assert [r.attempt for r in now.orderBy("step").collect()] == [1] * 4 + [2] * 8
    events = [(r.event, r.step) for r in broken.records("lifecycle", live).orderBy("record").collect()]
    assert events == [("attempt_started", 0), ("checkpoint_saved", 4), ("attempt_started", 0), ("crash_recovered", 4), ("checkpoint_saved", 8), ("checkpoint_saved", 12)]
    assert checkpoint.head_mismatches(broken.spark.read.schema(checkpoint.SCHEMA).parquet(broken.snapshots), live).count() == 0


def test_losses_of_documents_add_up_to_those_of_steps(world):
    inputs, whole, _ = world
    tokens = {r.doc_key: r.tokens for r in inputs.tokens.collect()}
    for r in whole.records("learning").collect():
        total = 0.0
        for s in r.segments:
            first = 0 if s.lane != "instruct" else 2  # a prompt's tokens bear none: the label must be at 3 or later
            own = [t % 7 / 8.0 for i, t in enumerate(tokens[s.doc_key][s.start : s.end - 1]) if s.start + i >= first]
            assert s.loss_tokens == len(own) and abs(sum(own) - s.loss_sum) < 1e-9
            total += s.loss_sum
        assert abs(total / r.loss_tokens - r.loss) < 1e-9 and r.loss_tokens == sum(s.loss_tokens for s in r.segments)
    consumed = {r.step: r for r in whole.records("consumption").collect()}
    for r in whole.records("learning").collect():
        assert (r.batch_id, r.loss_tokens) == (consumed[r.step].batch_id, consumed[r.step].loss_tokens)


def test_replays(world):
    inputs, whole, broken = world
    assert all(r.identical for r in runs.replay_from_ledger(broken, inputs).collect())
    assert [tuple(r) for r in runs.replay_from_snapshot(broken, inputs, 4, 9).orderBy("step").collect()] == [(s, True) for s in range(5, 10)]
    other = runs.Inputs(inputs.facts, inputs.flags, inputs.tokens.withColumn("tokens", F.transform("tokens", lambda t: F.pmod(t + 1, F.lit(256)))), inputs.plan, lanes=inputs.lanes, seq_len=64)
    assert not any(r.identical for r in runs.replay_from_ledger(broken, other).collect())


def test_a_fork_shares_its_past(spark, world, plan):
    inputs, whole, broken = world
    forked = mixture.compile_rows(mixture.fork_stages(STAGES, 11, {"web": 0.2, "code": 0.4, "instruct": 0.4}), steps=12)
    before = broken.split()[0].agg(F.sha2(F.to_json(F.array_sort(F.collect_list("hash"))), 256)).first()[0]
    side = broken.fork("side", 8, runs.Inputs(inputs.facts, inputs.flags, inputs.tokens, forked, inputs.losses, seq_len=64), plan)
    assert side.advance(runs.Inputs(inputs.facts, inputs.flags, inputs.tokens, forked, inputs.losses, seq_len=64), 12, 4) == 12
    ours, theirs = _stream(side), _stream(broken)
    assert ours[:10] == theirs[:10] and all(a[2] != b[2] for a, b in zip(ours[10:], theirs[10:]))
    assert broken.split()[0].agg(F.sha2(F.to_json(F.array_sort(F.collect_list("hash"))), 256)).first()[0] == before
    lineage = spark.read.json(f"{broken.root}/side/lineage").first()
    assert (lineage.parent_branch, lineage.fork_step, lineage.diverge_at_step) == ("main", 8, 11) and set(lineage.prefixes.asDict()) == set(runs.LEDGERS)
    own = runs.Inputs(inputs.facts, inputs.flags, inputs.tokens, forked, inputs.losses, seq_len=64)
    assert _failed(requirements.fork_checks(broken, side, own)) == set()
    assert "fork.follows_its_own_plan" in _failed(requirements.fork_checks(broken, side, inputs))
    with pytest.raises(runs.ResumeError):
        broken.fork("late", 12, runs.Inputs(inputs.facts, inputs.flags, inputs.tokens, forked, seq_len=64), plan)


def test_a_run_refuses_other_inputs(spark, world, plan, tmp_path):
    inputs, whole, broken = world
    other = mixture.compile_rows(STAGES[:1] + (mixture.Stage("main", 6, 12, {"web": 0.5, "code": 0.25, "instruct": 0.25}, 0.56),), steps=12)
    with pytest.raises(checkpoint.CheckpointError, match="plan_sha256"):
        broken.advance(runs.Inputs(inputs.facts, inputs.flags, inputs.tokens, other, seq_len=64), 12)
    short = runs.Run(spark, str(tmp_path))
    with pytest.raises(Crash):
        short.advance(inputs, 12, 4, _crash("committed", 4))
    assert short.snapshot().next_step == 5
    changed = runs.Inputs(inputs.facts, inputs.flags, inputs.tokens.withColumn("tokens", F.transform("tokens", lambda t: F.pmod(t + 1, F.lit(256)))), plan, inputs.losses, seq_len=64)
    with pytest.raises(runs.ResumeError):
        short.advance(changed, 12, 4)


def test_a_run_ends_where_a_lane_does(spark, plan, tmp_path):
    inputs = _inputs(spark, plan)
    few = runs.Inputs(inputs.facts.where("lane <> 'code' or order_key < '00040'"), inputs.flags, inputs.tokens, plan, inputs.losses, seq_len=64)
    short = runs.Run(spark, str(tmp_path))
    last = short.advance(few, 12, 8)
    assert 0 < last < 12 and short.snapshot().step == last and [s[0] for s in _stream(short)] == list(range(1, last + 1))


def _failed(checks):
    return {name for name, passed, _ in audit.run_audit(checks) if not passed}


def test_requirements_hold(spark, world, plan):
    inputs, whole, broken = world
    checks = requirements.run_checks(broken, inputs, inputs.flags) | requirements.recovery_checks(broken, whole) | requirements.replay_checks(broken, inputs, 4, 8)
    assert len(checks) == 38 and _failed(checks) == set()


class Forged(runs.Run):
    """A run whose stored rows have been tampered with."""

    def __init__(self, run, change):
        super().__init__(run.spark, run.root, run.branch)
        self.change = change

    def stored(self):
        return self.change(super().stored())


def _edited(ledger_name, pattern, new, where="true"):
    return lambda rows: rows.withColumn("data", F.when((F.col("ledger") == ledger_name) & F.expr(where), F.regexp_replace("data", pattern, new)).otherwise(F.col("data")))


@pytest.mark.parametrize(
    "change,flips",
    [
        (lambda rows: rows.where("not (ledger = 'consumption' and seq = 6)"), {"end_to_end.every_step_to_the_last_snapshot_once", "ledgers.chains_end_in_their_heads"}),
        (lambda rows: rows.unionAll(rows.where("ledger = 'consumption' and seq = 6").withColumn("seq", F.lit(5).cast("long"))), {"end_to_end.every_step_to_the_last_snapshot_once", "ledgers.batch_ids_unique"}),
        (_edited("decisions", '"decision":"ACCEPT"', '"decision":"REJECT"', "seq = 3 or seq = 4 or seq = 0 or seq = 1 or seq = 2"), {"gate.decisions_follow", "ledgers.chains_end_in_their_heads"}),
        (_edited("learning", '"loss":[0-9.]+', '"loss":9.5', "seq = 2"), {"learning_trace.losses_add_up", "ledgers.chains_end_in_their_heads"}),
        (_edited("learning", '"batch_id":"B', '"batch_id":"C', "seq = 2"), {"ledgers.learning_binds_to_consumption"}),
        (_edited("consumption", '"spans":\\["web/[0-9]+:', '"spans":["held/1:', "seq = 7"), {"eval_firewall.only_train_documents_in_any_stream", "packing.spans_sound", "learning_trace.segments_are_the_consumed_spans"}),
        (_edited("consumption", '"spans":\\["web/[0-9]+:', '"spans":["web/3:', "seq = 7"), {"eval_firewall.no_flagged_document_in_any_stream", "gate.admitted_before_consumed"}),
        (_edited("consumption", '"shortfall":[0-9]+', '"shortfall":3', "seq = 7"), {"mixture.planned_less_shortfall_and_backfill"}),
    ],
)
def test_forgeries_flip_checks(world, change, flips):
    inputs, whole, broken = world
    checks = requirements.run_checks(Forged(whole, change), inputs, inputs.flags)
    assert _failed({name: checks[name] for name in flips}) == flips


def test_another_stream_is_noticed(world):
    inputs, whole, broken = world
    other = Forged(whole, _edited("consumption", '"batch_id":"B', '"batch_id":"C', "seq = 2"))
    assert _failed(requirements.recovery_checks(broken, other)) == {"crash_recovery.stream_is_the_uninterrupted_one"}
    assert {"crash_recovery.recorded", "crash_recovery.orphans_kept"} <= _failed(requirements.recovery_checks(whole, broken))
    assert "replay.batches_from_the_ledger" in _failed(requirements.replay_checks(other, inputs, 4, 8))
