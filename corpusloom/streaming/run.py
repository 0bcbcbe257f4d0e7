"""A training run: intervals of steps that are planned, written ahead, learned from, and closed by a snapshot.

An interval is a few Spark jobs whatever its number of steps. Its order is fixed: the control plane's decisions and the batches'
records go to the ledgers, then the losses, then the snapshot, which holds the ledgers' heads and so is the commit: rows beyond the
last snapshot are orphans of an attempt that died. Every snapshot names the batch that comes next; the attempt that goes on from it
must make that batch. What a run writes is bounded by its plan; documents are read as the control plane and the batches need them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import checkpoint, ledger, packing
from corpusloom.operators.mixture import LANES, SEQ_LEN, Lane, plan_digest
from corpusloom.streaming import control

LEDGERS = ("consumption", "decisions", "learning", "lifecycle")
STORED = "ledger string, seq long, prev string, data string, hash string, attempt int"
CONSUMPTION = "attempt int, batch_id string, batch_sha256 string, branch string, lanes array<struct<backfill:int,emitted:int,floor:int,lane:string,overrides:int,planned:int,scanned_tokens:bigint,shortfall:int>>, layout_sha256 string, loss_tokens int, pad_tokens int, real_tokens int, sequences array<struct<lane:string,policy:string,spans:array<string>>>, stage string, state_sha256 string, step int"
SEGMENT = "struct<at:int,doc_key:string,end:bigint,lane:string,loss_sum:double,loss_tokens:int,segment:int,start:bigint>"
LEARNING = f"attempt int, batch_id string, batch_sha256 string, branch string, loss double, loss_tokens int, segments array<{SEGMENT}>, step int"
LIFECYCLE = "attempt int, branch string, event string, step int"
DECISION = "attempt int, branch string, content_sha256 string, decision string, defers int, doc_key string, lane string, quality double, reason string, score double, seq long, source string, stage string, step int, tokens long"
SCHEMAS = {"consumption": CONSUMPTION, "decisions": DECISION, "learning": LEARNING, "lifecycle": LIFECYCLE}


class ResumeError(RuntimeError):
    """The run does not go on as its snapshot said it would."""


@dataclass(frozen=True)
class Inputs:
    facts: DataFrame  # as control.run_batch takes them
    flags: object
    tokens: DataFrame  # doc_key, tokens, loss_start
    plan: list[tuple]
    losses: Callable[[DataFrame], DataFrame] | None = None  # batches -> step, at (place in the batch), values
    pins: tuple[tuple[str, str], ...] = ()
    lanes: tuple[Lane, ...] = LANES
    seq_len: int = SEQ_LEN

    def pinned(self) -> dict[str, str]:
        return {p: "" for p in checkpoint.PINS} | dict(self.pins) | {"plan_sha256": plan_digest(self.plan)}

    def batches(self, spans: DataFrame) -> DataFrame:
        return packing.batches(spans, self.tokens, [(x.name, x.policy) for x in self.lanes], self.seq_len, self.facts.select("doc_key", "split"))


def _json(*names: str):
    """Canonical JSON of the columns: alphabetical, nulls written."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def spans_of(consumption: DataFrame) -> DataFrame:
    """step, lane, row, place, doc_key, start, end of consumption records (step, sequences)."""
    rows = consumption.select("step", F.posexplode("sequences").alias("at", "q"))
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("step", "q.lane").orderBy("at")) - 1)
    parts = rows.select("step", F.col("q.lane").alias("lane"), "row", F.posexplode("q.spans").alias("k", "s"))
    cut = lambda i: F.regexp_extract("s", r"^(.*):(\d+):(\d+)$", i)
    parts = parts.select("step", "lane", "row", "k", cut(1).alias("doc_key"), cut(2).cast("long").alias("start"), cut(3).cast("long").alias("end"))
    before = Window.partitionBy("step", "lane", "row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("place", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0))).drop("k")


def learned(batches: DataFrame, losses: DataFrame) -> DataFrame:
    """step, loss, loss_tokens, segments: the loss of a step and what each span of a document has of it, added in order."""
    rows = batches.select("step", F.posexplode("sequences").alias("at", "q")).join(losses, ["step", "at"])
    cells = F.arrays_zip(F.col("q.segment").alias("segment"), F.col("q.loss").alias("bears"), F.col("values").alias("value"))

    def of(k):
        own = F.filter(F.col("cells"), lambda x: x["segment"] == k + 1)
        span = F.col("q.spans")[k]
        cut = lambda i: F.regexp_extract(span, r"^(.*):(\d+):(\d+)$", i)
        return F.struct(
            F.col("at").cast("int").alias("at"),
            cut(1).alias("doc_key"),
            cut(3).cast("long").alias("end"),
            F.col("q.lane").alias("lane"),
            F.aggregate(own, F.lit(0.0), lambda a, x: a + x["bears"] * x["value"].cast("double")).alias("loss_sum"),
            F.aggregate(own, F.lit(0), lambda a, x: a + x["bears"]).alias("loss_tokens"),
            (k + 1).cast("int").alias("segment"),
            cut(2).cast("long").alias("start"),
        )

    per = rows.withColumn("cells", cells).select("step", "at", F.transform(F.sequence(F.lit(0), F.size("q.spans") - 1), of).alias("s"))
    steps = per.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("x")).select("step", F.flatten(F.transform("x", lambda y: y["s"])).alias("segments"))
    total, n = F.aggregate("segments", F.lit(0.0), lambda a, x: a + x["loss_sum"]), F.aggregate("segments", F.lit(0), lambda a, x: a + x["loss_tokens"])
    return steps.select("step", (total / F.greatest(n, F.lit(1))).alias("loss"), n.alias("loss_tokens"), "segments")


class Run:
    """One branch of a run under root, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, branch: str = "main"):
        self.spark, self.root, self.branch = spark, root, branch
        self.ledgers, self.snapshots = f"{root}/{branch}/ledgers", f"{root}/{branch}/snapshots"

    # --- what is stored

    def stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(STORED).parquet(self.ledgers)
        except Exception as e:  # the first append makes the folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], STORED)

    def snapshot(self, step: int | None = None):
        return checkpoint.load(self.spark, self.snapshots, self.branch, step) if checkpoint.listed(self.spark, self.snapshots, self.branch) else None

    def heads(self, snapshot=None) -> DataFrame:
        snapshot = snapshot or self.snapshot()
        rows = [(k, v["records"], v["head"]) for k, v in snapshot.heads.items()] if snapshot else []
        return self.spark.createDataFrame(rows, ledger.HEADS)

    def split(self) -> tuple[DataFrame, DataFrame]:
        """(live, orphans): committed rows, of several attempts' the last one's; and all others."""
        marked = self.stored().join(self.heads().select("ledger", "records"), "ledger", "left")
        newest = F.max(F.when(F.col("seq") < F.col("records"), F.col("attempt"))).over(Window.partitionBy("ledger", "seq"))
        marked = marked.withColumn("live", F.coalesce((F.col("seq") < F.col("records")) & (F.col("attempt") == newest), F.lit(False)))
        columns = ["ledger", "seq", "prev", "data", "hash", "attempt"]
        return marked.where("live").select(columns), marked.where("not live").select(columns)

    def records(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        rows = self.split()[0] if rows is None else rows
        return rows.where(F.col("ledger") == name).select(F.from_json("data", SCHEMAS[name]).alias("r"), "seq").select("r.*", F.col("seq").alias("record"))

    # --- writing

    def advance(self, inputs: Inputs, last_step: int, every: int = 20, fault: Callable[[str, int], None] = lambda point, step: None) -> int:
        """Go on from the last snapshot to last_step, or as far as the documents reach; returns the last step. fault is called at each point of an interval, to try crashes with."""
        snapshot, attempt = self.snapshot(), (self.stored().agg(F.max("attempt")).first()[0] or 0) + 1
        step, state, expected, heads = 0, None, None, self.heads(snapshot)
        events = [("attempt_started", 0)]
        if snapshot is not None:
            checkpoint.verify_pins(snapshot, inputs.pinned())
            live, orphans = self.split()
            ledger._held_to(live, heads, "recovery")
            step, state, expected = snapshot.step, snapshot.state, snapshot.next_sha256
            if not orphans.where(F.col("attempt") == attempt - 1).isEmpty():
                events.append(("crash_recovered", step))
        while step < last_step:
            done, state, heads, expected = self._interval(inputs, step, min(step + every, last_step), last_step, state, expected, heads, attempt, events, fault)
            if done == step:
                break
            step, events = done, []
        return step

    def _interval(self, inputs: Inputs, step: int, to: int, last_step: int, state, expected, heads: DataFrame, attempt: int, events: list, fault):
        ahead = min(to + 1, last_step)
        while True:
            found = control.run_batch(inputs.facts, inputs.flags, inputs.plan, ahead, state, inputs.lanes, inputs.seq_len, [to])
            reached = found.where("kind = 'state'").agg(F.max("step")).first()[0] or step
            if reached >= to or reached == step:
                break
            to, ahead = reached, reached + 1  # a lane runs out; the interval ends before that step
            found.unpersist()
        if reached == step:
            return step, state, heads, expected
        batches = inputs.batches(control.unfold(found, "span")).persist()
        first, following = (batches.where(F.col("step") == s).select("batch_sha256").first() for s in (step + 1, to + 1))
        if expected is not None and first["batch_sha256"] != expected:
            raise ResumeError(f"step {step + 1} is not the batch that the snapshot of step {step} names")
        mine = [F.lit(attempt).alias("attempt"), F.lit(self.branch).alias("branch")]
        now = F.col("step") <= to
        keys = control.unfold(found, "state").where(now)
        lanes = control.unfold(found, "lane").where(now).groupBy("step").agg(F.array_sort(F.collect_list(F.struct("backfill", "emitted", "floor", "lane", "overrides", "planned", "scanned_tokens", "shortfall"))).alias("lanes"))
        stages = self.spark.createDataFrame(sorted({(r[0], r[1]) for r in inputs.plan}), "step int, stage string")
        plain = F.transform("sequences", lambda q: F.struct(q["lane"].alias("lane"), q["policy"].alias("policy"), q["spans"].alias("spans"))).alias("sequences")
        consumed = batches.where(now).select("step", "batch_id", "batch_sha256", "layout_sha256", "loss_tokens", "pad_tokens", "real_tokens", plain).join(keys, "step").join(lanes, "step").join(stages, "step").select("*", *mine)
        fields = [f.split(" ")[0] for f in ("attempt", "batch_id", "batch_sha256", "branch", "lanes", "layout_sha256", "loss_tokens", "pad_tokens", "real_tokens", "sequences", "stage", "state_sha256", "step")]
        rows = consumed.select(F.lit("consumption").alias("ledger"), F.col("step").cast("long").alias("seq_key"), _json(*fields).alias("data"))
        decided = control.unfold(found, "decision").where(now).select("*", *mine)
        rows = rows.unionByName(decided.select(F.lit("decisions").alias("ledger"), F.col("seq").alias("seq_key"), _json(*decided.columns).alias("data")))
        heads = self._append(rows, heads, attempt)
        fault("written_ahead", to)
        rows = self.spark.createDataFrame([(i, e, s) for i, (e, s) in enumerate([*events, ("checkpoint_saved", to)])], "seq_key long, event string, step int").select("*", *mine)
        rows = rows.select(F.lit("lifecycle").alias("ledger"), "seq_key", _json("attempt", "branch", "event", "step").alias("data"))
        if inputs.losses is not None:
            some = batches.where(now)
            trained = learned(some, inputs.losses(some)).join(some.select("step", "batch_id", "batch_sha256"), "step").select("*", *mine)
            rows = rows.unionByName(trained.select(F.lit("learning").alias("ledger"), F.col("step").cast("long").alias("seq_key"), _json(*trained.columns).alias("data")))
        heads = self._append(rows, heads, attempt)
        fault("learned", to)
        taken = control.unfold(found, "snapshot").where(F.col("step") == to).first()
        held = {r["ledger"]: (r["records"], r["head"]) for r in heads.collect()}
        checkpoint.save(self.spark, self.snapshots, self.branch, to, attempt, taken["state"], inputs.pinned(), held, to + 1 if following else None, following["batch_sha256"] if following else None)
        fault("committed", to)
        batches.unpersist()
        found.unpersist()
        return to, taken["state"], heads, following["batch_sha256"] if following else None

    def _append(self, rows: DataFrame, heads: DataFrame, attempt: int) -> DataFrame:
        """The heads as a table of a few rows that no longer depends on the files."""
        found = ledger.append(rows, self.ledgers, heads, attempt).collect()
        return self.spark.createDataFrame([(r["ledger"], r["records"], r["head"]) for r in found], ledger.HEADS)

    def fork(self, branch: str, step: int, inputs: Inputs, parent_plan: list[tuple]) -> Run:
        """A branch from the snapshot of a step, under another plan; it shares the ledgers' prefix, verified, and may differ from the step on where the plans do."""
        diverge = min(({r[0] for r in set(inputs.plan) ^ set(parent_plan)}), default=step + 1)
        if diverge <= step:
            raise ResumeError(f"the plans part at step {diverge}, before the snapshot of step {step}")
        taken, child = self.snapshot(step), Run(self.spark, self.root, branch)
        heads = self.heads(taken)
        kept = ledger.fork(self.split()[0], heads, branch).drop("branch")
        kept.write.mode("errorifexists").partitionBy("attempt").parquet(child.ledgers)
        ledger.lineage(heads, branch, self.branch, step, diverge, plan_digest(inputs.plan), plan_digest(parent_plan)).coalesce(1).write.mode("errorifexists").json(f"{self.root}/{branch}/lineage")
        held = {k: (v["records"], v["head"]) for k, v in taken.heads.items()}
        same = diverge > step + 1
        checkpoint.save(self.spark, child.snapshots, branch, step, taken.attempt, taken.state, inputs.pinned(), held, taken.next_step if same else None, taken.next_sha256 if same else None)
        return child


def replay_from_ledger(run: Run, inputs: Inputs) -> DataFrame:
    """step, batch_id, replayed, identical: every batch made again from its record's spans alone."""
    records = run.records("consumption")
    again = inputs.batches(spans_of(records)).select("step", F.col("batch_id").alias("replayed"), F.col("batch_sha256").alias("_sha"), F.col("layout_sha256").alias("_layout"))
    same = (F.col("batch_sha256") == F.col("_sha")) & (F.col("layout_sha256") == F.col("_layout")) & (F.col("batch_id") == F.col("replayed"))
    return records.select("step", "batch_id", "batch_sha256", "layout_sha256").join(again, "step", "left").select("step", "batch_id", "replayed", F.coalesce(same, F.lit(False)).alias("identical"))


def replay_from_snapshot(run: Run, inputs: Inputs, step: int, to: int) -> DataFrame:
    """step, identical: batches, decisions and state digests made again from the snapshot of a step, against the ledgers."""
    events = control.run_batch(inputs.facts, inputs.flags, inputs.plan, to, run.snapshot(step).state, inputs.lanes, inputs.seq_len)
    made = inputs.batches(control.unfold(events, "span")).select("step", "batch_sha256").join(control.unfold(events, "state"), "step")
    order = lambda df: df.groupBy("step").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "lane", "doc_key", "defers", "score", "decision", "reason", "source")))), 256).alias("d"))
    made = made.join(order(control.unfold(events, "decision")), "step")
    said = run.records("consumption").where((F.col("step") > step) & (F.col("step") <= to)).select("step", "batch_sha256", "state_sha256").join(order(run.records("decisions")), "step", "left")
    differing = {(r["step"]) for r in said.exceptAll(made.select(said.columns)).collect()} | {r["step"] for r in made.select(said.columns).exceptAll(said).collect()}
    events.unpersist()
    return run.spark.createDataFrame([(s, s not in differing) for s in range(step + 1, to + 1)], "step int, identical boolean")
