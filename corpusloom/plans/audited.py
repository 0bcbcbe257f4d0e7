"""Queries of batches, token rules, containment, small audit operators, and whole audited runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.shared import new_dir
from corpusloom.operators import audit, contamination, gate, ledger, mixture, packing, reports, tokenizer
from corpusloom.plans import queries as q
from corpusloom.plans.queries import BATCH, SEQ, query
from corpusloom.sources import lanes, shards
from corpusloom.streaming import control, requirements
from corpusloom.streaming import run as runs

# --- batches and token rules


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_key, tokens, loss_start: a number for each pre-token (a hash below 50,000) and the end of text; a response begins after its prompt."""
    docs = lanes.documents_by_lane(spark, sf_dir)
    ids = F.transform(T.pretokens(F.col("content")), lambda w: (F.crc32(w.cast("binary")) % 50_000).cast("int") + 260)
    return docs.select("doc_key", F.concat(ids, F.array(F.lit(257))).alias("tokens"), F.when(F.col("lane") == "instruct", F.size(T.pretokens(F.coalesce("prompt", F.lit("")))) + 4).alias("loss_start"))


@query(f"""WITH {q.SPANS_SQL}, rows AS (
  SELECT seq // {BATCH} + 1 AS step, seq % {BATCH} AS row, sum("end" - start) AS real, sum("end" - start - 1) AS loss, '{{"lane":"web","spans":[' || string_agg('"' || doc_key || ':' || start || ':' || "end" || '"', ',' ORDER BY place) || ']}}' AS j FROM spans GROUP BY ALL
) SELECT step::INTEGER AS step, sha256('[' || string_agg(j, ',' ORDER BY row) || ']') AS layout_sha256, (count(*) * {SEQ})::INTEGER AS slots, sum(real)::INTEGER AS real_tokens, (count(*) * {SEQ} - sum(real))::INTEGER AS pad_tokens, sum(loss)::INTEGER AS loss_tokens FROM rows GROUP BY 1""")
def batch_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the packed prose, eight sequences each: the layout's digest and what the arrays hold."""
    spans = q._web_spans(spark, sf_dir).withColumn("step", (F.floor(F.col("seq") / BATCH) + 1).cast("int")).withColumn("row", F.pmod("seq", F.lit(BATCH)).cast("int")).drop("seq")
    found = packing.batches(spans, token_table(spark, sf_dir), [("web", "concat_split")], SEQ, lanes.documents_by_lane(spark, sf_dir).select("doc_key", "split"))
    return found.select("step", "layout_sha256", "slots", "real_tokens", "pad_tokens", "loss_tokens")


@query(f"""WITH {q._TOKENS_SQL}, f AS (
  SELECT *, (seq * {SEQ} + pos) % 997 = 0 AS no_loss, (seq * {SEQ} + pos) % 1009 = 0 AS more_loss, (seq * {SEQ} + pos) % 1013 = 0 AS moved, (seq * {SEQ} + pos) % 1019 = 0 AS relabelled, (seq * {SEQ} + pos) % 1021 = 0 AS gone FROM tokens
) SELECT 'missing' AS rule, count(*) AS n FROM f WHERE gone
UNION ALL SELECT 'loss_missing', count(*) FROM f WHERE NOT gone AND no_loss AND loss = 1
UNION ALL SELECT 'loss_on_last', count(*) FROM f WHERE NOT gone AND NOT no_loss AND more_loss AND label IS NULL
UNION ALL SELECT 'position', count(*) FROM f WHERE NOT gone AND moved
UNION ALL SELECT 'label', count(*) FROM f WHERE NOT gone AND relabelled""")
def token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations that the rules find in forged token rows of the packed prose, by rule, for each kind of forgery."""
    at = F.col("seq") * SEQ + F.col("pos")
    rows = q._web_tokens(spark, sf_dir).where(at % 1021 != 0)
    forged = rows.withColumns(
        {
            "loss": F.when(at % 997 == 0, 0).when(at % 1009 == 0, 1).otherwise(F.col("loss")),
            "position_id": F.col("position_id") + F.when(at % 1013 == 0, 1).otherwise(0),
            "label": F.when(at % 1019 == 0, "\x00").otherwise(F.col("label")),
        }
    )
    docs = lanes.documents_by_lane(spark, sf_dir).where("lane = 'web' and split = 'train'")
    tokens = docs.select("doc_key", F.concat(T.pretokens(F.col("content")), F.array(F.lit("<eos>"))).alias("tokens"))
    found = packing.token_violations(forged, q._web_spans(spark, sf_dir), tokens, ["lane", "seq"]).groupBy("rule").agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([(x,) for x in ("missing", "loss_missing", "loss_on_last", "position", "label")], "rule string")
    return kinds.join(found, "rule", "full").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


# --- containment


@query(f"WITH {q.CONTAMINATION_SQL} SELECT t.doc_key, h.doc_key AS eval_key FROM tr t JOIN held h ON len(h.ws) > 0 AND contains(chr(31) || array_to_string(t.ws, chr(31)) || chr(31), chr(31) || array_to_string(h.ws, chr(31)) || chr(31))")
def contamination_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.containments(*q._scanned(spark, sf_dir))


# --- small audit operators on the tables that have their shape


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS every, bool_or(o_orderstatus = 'F') AS some FROM orders GROUP BY 1")
def every_and_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.every_and_some(q._table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F")


@query("SELECT max(abs(l_tax - l_discount)) AS max_abs_diff FROM lineitem")
def largest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.largest_difference(q._table(spark, sf_dir, "lineitem"), "l_tax", "l_discount")


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS members FROM lineitem GROUP BY 1")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.set_union(q._table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey")
    return found.select("l_orderkey", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT 'live' AS stream, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'orphans', o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'branch', o_orderkey FROM orders WHERE o_totalprice > 100000")
def all_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = q._table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    streams = {"live": "o_orderstatus = 'F'", "orphans": "o_orderstatus = 'P'", "branch": "o_totalprice > 100000"}
    return audit.all_streams(**{k: orders.where(w).select("o_orderkey") for k, w in streams.items()}).select("stream", "o_orderkey")


@query(f"WITH {q.SPANS_SQL} SELECT lane, seq, count(*) AS segments FROM spans GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY lane, seq LIMIT 3")
def packed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's three examples."""
    return audit.packed_samples(q._web_spans(spark, sf_dir), ["lane", "seq"])


@query(f"WITH {q.FACTS_SQL} SELECT doc_key FROM facts WHERE split NOT IN ('val', 'eval')")
def held_out_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lanes.documents_by_lane(spark, sf_dir).select("doc_key", "split")
    return audit.not_held_out(docs.select("doc_key"), docs).select("doc_key")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1 OR o_totalprice > 200000")
def unequal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as they are against orders of which a third is taken out and the larger ones are changed."""
    orders = q._table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    got = orders.where("o_orderkey % 3 <> 1").withColumn("o_custkey", F.when(F.col("o_totalprice") > 200000, -1).otherwise(F.col("o_custkey")))
    return audit.unequal_segments(orders, got, ["o_orderkey"], ["o_custkey"])


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P') AS rewritten FROM o GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'P') > 0""")
def orphans_against_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a dead attempt (pending orders) that a live stream has again, by customer; all are identical."""
    orders = q._table(spark, sf_dir, "orders")
    found = ledger.orphans_against_live(orders.where("o_orderstatus = 'P'"), orders, "o_orderkey", ["o_custkey", "o_totalprice"]).where("identical")
    return found.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("rewritten"))


@query(f"""WITH {q.FACTS_SQL}, g AS (SELECT doc_key, length(doc_key) % 5 AS defers, floor((quality + 0.04::DOUBLE * (length(doc_key) % 5)) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score FROM facts)
SELECT doc_key, score, CASE WHEN score < {q.REJECT} THEN 'REJECT' WHEN score >= {q.ACCEPT} THEN 'ACCEPT' WHEN defers >= 3 THEN 'REJECT' ELSE 'DEFER' END AS decision,
       CASE WHEN score < {q.REJECT} THEN 'low_quality' WHEN score >= {q.ACCEPT} THEN 'score_ok' WHEN defers >= 3 THEN 'defer_expired' ELSE 'below_accept' END AS reason FROM g""")
def gate_with_defers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's rule for documents that have been put off some times already."""
    facts = lanes.facts(spark, sf_dir).select("doc_key", "quality", (F.length("doc_key") % 5).alias("defers"))
    scored = facts.withColumn("score", gate.score(F.col("quality"), F.col("defers")))
    decision, reason = gate.decide(F.lit(None).cast("string"), F.lit(False), F.col("score"), F.col("defers"), F.lit(q.ACCEPT), F.lit(q.REJECT))
    return scored.select("doc_key", "score", decision.alias("decision"), reason.alias("reason"))


@query(q.ORACLES["ledger_heads"])
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads after two appends, the second one from the heads that the first one committed."""
    events = q._table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").cast("string").alias("ledger"), F.col("event_id").alias("seq_key"), F.to_json(F.struct("event_id", "event_type", "user_id")).alias("data"))
    path = new_dir(spark, "ledger")
    half = events.agg(F.max("event_id") / 2).first()[0] or 0
    ledger.commit(ledger.append(rows.where(F.col("seq_key") <= half), f"{path}/rows", None, 1), f"{path}/commits", 1)
    heads = ledger.append(rows.where(F.col("seq_key") > half), f"{path}/rows", ledger.committed(spark, f"{path}/commits")[1], 2)
    return heads.select(F.col("ledger").cast("long").alias("user_id"), "records", "head")


@query("SELECT l_returnflag AS lane, sum(l_quantity) / greatest(1, sum(l_linenumber)) AS loss, sum(l_linenumber)::BIGINT AS tokens FROM lineitem GROUP BY 1")
def lane_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = q._table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("lane"), F.col("l_quantity").alias("loss_sum"), F.col("l_linenumber").alias("loss_tokens"))
    return reports.lane_losses(segments, ["lane"])


@query("SELECT (SELECT avg(o_custkey) FROM (SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 10)) AS first_mean, (SELECT avg(o_custkey) FROM (SELECT o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 10)) AS last_mean")
def first_and_last_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_and_last_mean(q._table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


@query(f"WITH {q.LANES_SQL} SELECT doc_key AS doc_id, lane, split, sha256(content) AS content_sha256, sha256(content) AS stored_sha256 FROM docs")
def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines by lane and split, and read again."""
    docs = lanes.documents_by_lane(spark, sf_dir)
    none = F.lit(None).cast("string")
    raw = docs.select(F.col("doc_key").alias("doc_id"), "lane", "split", none.alias("origin"), T.sha256(F.col("content")).alias("content_sha256"), F.col("content").alias("text"), none.alias("prompt"), none.alias("response"))
    path = new_dir(spark, "raw")
    lanes.write_raw(raw, path)
    return lanes.read_raw(spark, path).select("doc_id", "lane", "split", "content_sha256", T.sha256(F.col("text")).alias("stored_sha256"))


@query(f"WITH {q.FACTS_SQL} SELECT lane, split, ceil(count(*) / 128.0)::BIGINT AS shards, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens, 0::BIGINT AS damaged FROM facts GROUP BY 1, 2")
def shard_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards written, described by manifests, pinned by a catalog, and read against both: sizes by lane and split, and documents that differ."""
    facts = lanes.facts(spark, sf_dir).select("doc_key", "lane", "split", "content_sha256", "quality")
    docs = facts.join(token_table(spark, sf_dir), "doc_key")
    path = new_dir(spark, "shards")
    shards.write_shards(shards.assign_shards(docs), f"{path}/tokens")
    manifests = shards.manifest(spark, f"{path}/tokens", "hashed")
    shards.write_catalog(manifests, f"{path}/catalog")
    catalog = shards.load_catalog(spark, f"{path}/catalog")
    off = shards.damaged(spark, f"{path}/tokens", manifests).select("shard_id").unionAll(shards.pin_mismatches(catalog, manifests).select("shard_id")).groupBy("shard_id").agg(F.count("*").alias("off"))
    joined = catalog.join(off, "shard_id", "left")
    return joined.groupBy("lane", "split").agg(F.count("*").alias("shards"), F.sum("num_docs").cast("long").alias("docs"), F.sum("num_tokens").cast("long").alias("tokens"), F.coalesce(F.sum("off"), F.lit(0)).cast("long").alias("damaged"))


@query(f"WITH {q.LANES_SQL} SELECT 'instruct/' || (conv_id * 1000 + turn) AS doc_key, sha256(prompt || ' ' || response) AS text_sha256 FROM pairs UNION ALL SELECT doc_key, sha256(content) FROM docs WHERE lane <> 'instruct'")
def decode_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each document's tokens decode to; special tokens leave no trace."""
    trained = q.trained(spark, sf_dir)
    found = tokenizer.decode(tokenizer.encode_documents(lanes.documents_by_lane(spark, sf_dir), trained), trained)
    return found.select("doc_key", T.sha256(F.col("text")).alias("text_sha256"))


# --- whole runs


def _losses(batches: DataFrame) -> DataFrame:
    """A stand-in for training: a loss for each place that follows from its token, the same in every attempt."""
    cells = batches.select("step", F.posexplode("sequences").alias("at", "s"))
    return cells.select("step", "at", F.transform("s.token", lambda t: t % 97 / 64.0).alias("values"))


def inputs_of(spark: SparkSession, sf_dir: str, plan: list[tuple] | None = None) -> runs.Inputs:
    facts = packing.with_order(lanes.facts(spark, sf_dir))
    return runs.Inputs(facts, lambda chosen: q._flags(spark, sf_dir, chosen), token_table(spark, sf_dir), mixture.compile_rows() if plan is None else plan, _losses)


def _held(inputs: runs.Inputs, chosen: DataFrame) -> runs.Inputs:
    """The same inputs of the run's candidates alone, kept, since a run asks for them in each interval."""
    facts = inputs.facts.join(chosen, "doc_key", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    tokens = inputs.tokens.join(chosen, "doc_key", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    return replace(inputs, facts=facts, tokens=tokens, flags=inputs.flags(chosen).persist(StorageLevel.MEMORY_AND_DISK))


@query()
def training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch of the default plan, as far as the documents reach: its id, digests and counts."""
    inputs = inputs_of(spark, sf_dir)
    events = q.control_events(spark, sf_dir)
    return inputs.batches(control.unfold(events, "span")).drop("sequences")


class _Died(RuntimeError):
    pass


@query()
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requirement, check, passed, violations of a run of the default plan that dies once and goes on, replayed, forked, and held to an uninterrupted one."""
    root, every = new_dir(spark, "run"), inputs_of(spark, sf_dir)
    # twice what the plan asks for: a run that needs more ends where a lane does, and both runs alike
    chosen = control._candidates(every.facts.where("split = 'train'"), every.plan, SEQ, 2 * control.FURTHER)[0].select("doc_key").persist(StorageLevel.MEMORY_AND_DISK)
    inputs = _held(every, chosen)
    whole, run = runs.Run(spark, f"{root}/whole"), runs.Run(spark, f"{root}/broken")
    last = whole.advance(inputs, q.STEPS, 40)
    if last == 0:
        return spark.createDataFrame([], "requirement string, check string, passed boolean, violations long")

    def fault(point: str, step: int) -> None:
        if point == "written_ahead" and run.snapshot() is not None:
            raise _Died

    try:
        run.advance(inputs, q.STEPS, max(1, last // 2), fault)
    except _Died:
        run.advance(inputs, q.STEPS, max(1, last // 2))
    first = max(1, last // 2)
    checks = requirements.run_checks(run, inputs, inputs.flags) | requirements.recovery_checks(run, whole) | requirements.replay_checks(run, inputs, first, last)
    if first + 2 <= last:
        other = mixture.compile_rows(mixture.fork_stages(mixture.STAGES, first + 2, {"web": 0.2, "code": 0.4, "instruct": 0.4}))
        own = replace(inputs, plan=other)
        side = run.fork("side", first, own, inputs.plan)
        side.advance(own, last, last)
        checks |= requirements.fork_checks(run, side, own)
    found = [(*name.split(".", 1), passed, n) for name, passed, n in audit.run_audit(checks)]
    return spark.createDataFrame(found, "requirement string, check string, passed boolean, violations long")
