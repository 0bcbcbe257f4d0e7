"""What an audited run must show: named checks, each a frame of violations, grouped by requirement ("requirement.check").

Every check derives what it holds the run to from something else than what it looks at: ledgers against documents and plan, losses
against consumption, a resumed run against an uninterrupted one, snapshots against ledgers, replays against records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import audit, checkpoint, ledger, mixture, packing, tokenizer
from corpusloom.sources import shards
from corpusloom.streaming import run as runs


def _rows(spark, found: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in found], "what string")


def _once(records: DataFrame, last: int) -> DataFrame:
    return audit.missing_steps(records.select("step"), 1, last)


def run_checks(run: runs.Run, inputs: runs.Inputs, flags: DataFrame) -> dict[str, DataFrame]:
    """A run's own ledgers, snapshots and records. flags: doc_key, flag."""
    spark, (live, orphans) = run.spark, run.split()
    live, orphans = live.cache(), orphans.cache()
    consumed, decisions, learned, events = (run.records(n, live).cache() for n in runs.LEDGERS)
    dead = run.records("consumption", orphans)
    snapshots = spark.read.schema(checkpoint.SCHEMA).parquet(run.snapshots).where(F.col("branch") == run.branch)
    last = run.snapshot().step
    spans = runs.spans_of(consumed).cache()
    every = audit.all_streams(live=spans, orphans=runs.spans_of(dead))
    plan = spark.createDataFrame([r for r in inputs.plan if r[0] <= last], mixture.PLAN_SCHEMA)
    lanes = consumed.select("step", F.explode("lanes").alias("x")).select("step", "x.*")
    protected = [x.name for x in inputs.lanes if x.protected]
    whole = [x.name for x in inputs.lanes if x.policy != "concat_split"]
    facts, key = inputs.facts, ["step", "lane", "row"]
    admitted = decisions.where(F.col("decision").isin(*audit.ADMITTED))
    deferred = decisions.withColumnRenamed("seq", "_s").withColumn("seq", F.col("_s"))
    per_doc = learned.select("step", F.explode("segments").alias("s")).select("step", "s.*")
    at_of = spans.select(*key).distinct()
    position = F.lit(len(inputs.lanes))
    for i, x in enumerate(inputs.lanes):
        position = F.when(F.col("lane") == x.name, i).otherwise(position)
    order = Window.partitionBy("step").orderBy(position, "row")
    placed = packing.segments(spans.join(at_of.withColumn("at", F.row_number().over(order) - 1), key), key)
    sums = per_doc.groupBy("step").agg(F.sum("loss_sum").alias("s"), F.sum("loss_tokens").alias("n"))
    by_step = learned.join(sums, "step", "left")
    packed = spans.groupBy("step").agg(F.sum(F.col("end") - F.col("start")).alias("real"), F.countDistinct("lane", "row").alias("rows"))
    stats = consumed.join(packed, "step", "left").where(~((F.col("real") == F.col("real_tokens")) & (F.col("rows") * inputs.seq_len == F.col("real_tokens") + F.col("pad_tokens"))))
    naive = spans.groupBy("doc_key").agg(F.sum(F.col("end") - F.col("start")).alias("n")).select(F.ceil(F.col("n") / inputs.seq_len).alias("naive"), F.lit(0).alias("rows"))
    packs = naive.unionByName(spans.select("step", *key[1:]).distinct().select(F.lit(0).alias("naive"), F.lit(1).alias("rows"))).agg(F.sum("naive").alias("naive"), F.sum("rows").alias("rows"))
    shares = audit.stage_shares(lanes, plan)
    return {
        "end_to_end.every_step_to_the_last_snapshot_once": _once(consumed, last),
        "end_to_end.phases_logged": _rows(spark, ["attempt_started", "checkpoint_saved"]).join(events.select(F.col("event").alias("what")), "what", "left_anti"),
        "eval_firewall.only_train_documents_in_any_stream": every.join(facts.select("doc_key", "split"), "doc_key", "left").where("split is null or split <> 'train'"),
        "eval_firewall.no_flagged_document_in_any_stream": audit.rejected_and_consumed(flags, every, "doc_key"),
        "eval_firewall.every_flagged_candidate_rejected": decisions.join(flags.select("doc_key"), "doc_key", "left_semi").where("decision <> 'REJECT' or not startswith(reason, 'eval_contamination')"),
        "eval_firewall.held_out_documents_never_offered": decisions.join(facts.where("split <> 'train'").select("doc_key"), "doc_key", "left_semi"),
        "packing.spans_sound": packing.invariant_violations(spans, facts, inputs.seq_len, key, False),
        "packing.whole_documents_in_best_fit_lanes": spans.where(F.col("lane").isin(*whole) & (F.col("start") != 0)),
        "packing.documents_continue_where_they_stopped": packing.span_discontinuities(spans),
        "packing.counts_are_those_of_the_spans": stats,
        "mixture.plan_sound": mixture.violations(plan, sum(r[3] for r in inputs.plan if r[0] == 1)),
        "mixture.planned_less_shortfall_and_backfill": audit.plan_differences(lanes, plan),
        "mixture.shares_within_a_tenth": audit.share_deviation(shares).where("max_deviation > 0.1"),
        "gate.decisions_follow": audit.decision_mismatches(deferred, facts, plan, flags, protected),
        "gate.defer_counts": audit.defer_discontinuities(deferred),
        "gate.admitted_before_consumed": audit.not_admitted_before(spans.select("doc_key", "step"), admitted, "doc_key", "step"),
        "gate.rejected_not_consumed": audit.rejected_and_consumed(decisions.where("decision = 'REJECT'"), spans, "doc_key"),
        "gate.overrides_in_protected_lanes_only": decisions.where((F.col("decision") == "ACCEPT_FLOOR_OVERRIDE") & ~F.col("lane").isin(*protected)),
        "ledgers.chains_end_in_their_heads": ledger.violations(live.drop("attempt"), run.heads()),
        "ledgers.learning_once": _once(learned, last),
        "ledgers.learning_binds_to_consumption": audit.unequal_segments(consumed, learned, ["step"], ["batch_id", "batch_sha256"]),
        "ledgers.batch_ids_unique": consumed.groupBy("batch_id").agg(F.count("*").alias("n")).where("n > 1"),
        "ledgers.snapshots_hold_the_heads": checkpoint.head_mismatches(snapshots, live),
        "ledgers.snapshots_stand_at_their_step": snapshots.select("step", (F.col("heads")["consumption"]["records"] - 1).alias("record")).join(consumed.select(F.col("step").alias("_s"), "record"), "record", "left").where("_s is null or _s <> step"),
        "ledgers.every_snapshot_logged": snapshots.select("step").join(events.where("event = 'checkpoint_saved'").select("step"), "step", "left_anti"),
        "learning_trace.segments_are_the_consumed_spans": audit.unequal_segments(placed.select("step", "at", "segment", "doc_key", "start", "end"), per_doc.select("step", "at", "segment", "doc_key", "start", "end"), ["step", "at", "segment"], ["doc_key", "start", "end"]),
        "learning_trace.losses_add_up": by_step.where("n is null or n <> loss_tokens or abs(s / greatest(n, 1) - loss) > 1e-9 * greatest(1, loss)"),
        "learning_trace.loss_tokens_are_the_batches": consumed.select("step", F.col("loss_tokens").alias("_n")).join(learned.select("step", "loss_tokens"), "step", "left").where("loss_tokens is null or loss_tokens <> _n"),
        "throughput.packing_beats_a_document_a_sequence": packs.where("rows >= naive"),
    }


def recovery_checks(run: runs.Run, reference: runs.Run) -> dict[str, DataFrame]:
    """A run that died and went on, against one that did not."""
    live, orphans = run.split()
    events, consumed = run.records("lifecycle", live), run.records("consumption", live)
    again = [ledger.orphans_against_live(run.records(n, orphans), run.records(n, live), key, columns) for n, key, columns in (("consumption", "step", ["batch_id", "batch_sha256"]), ("decisions", "seq", ["doc_key", "decision", "reason"]), ("learning", "step", ["loss", "loss_tokens"]))]
    lost = run.records("consumption", orphans).join(consumed.select("step"), "step", "left_anti")
    parted = F.lit(False)
    for r in events.where("event = 'crash_recovered'").select("attempt", "step").collect():  # a row for each crash
        parted = parted | ((F.col("step") <= r["step"]) != (F.col("attempt") < r["attempt"]))
    names = ["step", "batch_id", "batch_sha256", "state_sha256"]
    snapshots = run.spark.read.schema(checkpoint.SCHEMA).parquet(run.snapshots).where(F.col("branch") == run.branch)
    return {
        "crash_recovery.recorded": _rows(run.spark, ["crash_recovered"]).join(events.select(F.col("event").alias("what")), "what", "left_anti"),
        "crash_recovery.orphans_kept": _rows(run.spark, [] if not orphans.isEmpty() else ["no orphans"]),
        "crash_recovery.nothing_lost": lost,
        "crash_recovery.orphans_written_again_alike": again[0].where("not identical").select("identical").unionAll(again[1].where("not identical").select("identical")).unionAll(again[2].where("not identical").select("identical")),
        "crash_recovery.next_batch_as_named": snapshots.where("next_step is not null").select(F.col("next_step").alias("step"), "next_sha256").join(consumed.select("step", "batch_sha256"), "step").where("batch_sha256 <> next_sha256"),
        "crash_recovery.stream_is_the_uninterrupted_one": audit.differences(consumed.select(names), reference.records("consumption").select(names)),
        "crash_recovery.attempts_part_at_the_snapshot": consumed.where(parted),
    }


def replay_checks(run: runs.Run, inputs: runs.Inputs, step: int, to: int) -> dict[str, DataFrame]:
    return {
        "replay.batches_from_the_ledger": runs.replay_from_ledger(run, inputs).where("not identical"),
        "replay.batches_decisions_and_states_from_a_snapshot": runs.replay_from_snapshot(run, inputs, step, to).where("not identical"),
    }


def fork_checks(parent: runs.Run, child: runs.Run, inputs: runs.Inputs) -> dict[str, DataFrame]:
    """A branch against its parent and its own plan."""
    spark = parent.spark
    line = spark.read.json(f"{parent.root}/{child.branch}/lineage").first()
    ours, theirs = child.records("consumption"), parent.records("consumption")
    heads = {k: v["records"] for k, v in child.snapshot(line["fork_step"]).heads.items()}
    limit = spark.createDataFrame(list(heads.items()), "ledger string, records long")
    prefix = lambda r: r.split()[0].join(limit, "ledger").where("seq < records").select("ledger", "seq", "hash")
    last = child.snapshot().step
    both = ours.select("step", "batch_sha256").join(theirs.select("step", F.col("batch_sha256").alias("_theirs")), "step")
    plan = spark.createDataFrame([r for r in inputs.plan if line["fork_step"] < r[0] <= last], mixture.PLAN_SCHEMA)
    lanes = ours.where(F.col("step") > line["fork_step"]).select("step", F.explode("lanes").alias("x")).select("step", "x.*")
    return {
        "fork.shares_the_verified_past": audit.unequal_segments(prefix(child), prefix(parent), ["ledger", "seq"], ["hash"]),
        "fork.same_batches_before_the_plans_part": both.where((F.col("step") < line["diverge_at_step"]) & (F.col("batch_sha256") != F.col("_theirs"))),
        "fork.other_batches_after_it": both.where((F.col("step") >= line["diverge_at_step"]) & (F.col("batch_sha256") == F.col("_theirs"))),
        "fork.every_step_once": _once(ours, last),
        "fork.follows_its_own_plan": audit.plan_differences(lanes, plan),
        "fork.snapshot_saved": _rows(spark, [] if last >= line["fork_step"] else ["no snapshot"]),
    }


def tokenizer_checks(spark, file: str, lock: str, trained_on: list[str], manifests: DataFrame, stored: DataFrame, encoded: DataFrame, texts: DataFrame) -> dict[str, DataFrame]:
    """file, lock: as freeze gives them. stored: documents of shards; encoded: doc_key, tokens made again from raw texts; texts: doc_key, text."""
    try:
        frozen = tokenizer.load_frozen(file, lock)
        wrong: list[str] = []
    except tokenizer.TokenizerIntegrityError as e:
        return {"tokenizer_integrity.digest_is_the_locks": _rows(spark, [str(e)])}
    back = tokenizer.decode(stored.select("doc_key", "tokens"), frozen).select("doc_key", "text").join(texts.select("doc_key", F.col("text").alias("_raw")), "doc_key")
    return {
        "tokenizer_integrity.digest_is_the_locks": _rows(spark, wrong),
        "tokenizer_integrity.trained_on_train_only": _rows(spark, [x for x in trained_on if x != "train"]),
        "tokenizer_integrity.manifests_pin_it": manifests.where(F.col("tokenizer_sha256") != frozen.digest),
        "tokenizer_integrity.raw_texts_give_the_stored_tokens": shards.retokenized_differently(stored, encoded),
        "tokenizer_integrity.round_trip": back.where(~F.col("text").eqNullSafe(F.col("_raw"))),
    }


def shard_checks(spark, path: str, catalog_path: str, manifests: DataFrame) -> dict[str, DataFrame]:
    try:
        catalog = shards.load_catalog(spark, catalog_path)
    except shards.ShardIntegrityError as e:
        return {"shards_manifests.catalog_is_what_it_says": _rows(spark, [str(e)])}
    again = shards.manifest(spark, path, manifests.select("tokenizer_sha256").first()[0])
    return {
        "shards_manifests.catalog_is_what_it_says": _rows(spark, []),
        "shards_manifests.catalog_pins_the_manifests": shards.pin_mismatches(catalog, manifests),
        "shards_manifests.stored_tokens_are_the_manifests": shards.damaged(spark, path, manifests),
        "shards_manifests.manifests_made_again_are_the_same": audit.differences(again.select("shard_id", "manifest_sha256"), manifests.select("shard_id", "manifest_sha256")),
    }
