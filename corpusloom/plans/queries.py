"""The engine's queries over the driver's tables, and the SQL that should give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit, contamination, gate, ledger, mixture, packing, tokenizer
from corpusloom.plans.oracle import FACTS_SQL, LANES_SQL, PLAN_SQL, PRETOKEN
from corpusloom.sources import lanes
from corpusloom.streaming import control

ACCEPT, REJECT = 0.56, 0.45  # of the middle stage
GRAM, OVERLAP = 8, 0.2
SEQ, BATCH = 128, 8
STEPS = mixture.STEPS

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return lanes.table(spark, sf_dir, name)


def _train(spark, sf_dir):
    return lanes.facts(spark, sf_dir).where("split = 'train'")


# --- documents, quality, gate


@query(f"WITH {FACTS_SQL} SELECT doc_key, lane, split, content_sha256, n_tokens FROM facts")
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.facts(spark, sf_dir).select("doc_key", "lane", "split", "content_sha256", F.col("n_tokens").cast("long").alias("n_tokens"))


@query(f"WITH {LANES_SQL} SELECT conv_id, turn, prompt, response FROM pairs")
def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.pair_turns(_table(spark, sf_dir, "conversations"))


@query(f"WITH {LANES_SQL} SELECT lane, split, count(*) AS n, sum(length(content))::BIGINT AS n_chars FROM docs GROUP BY ALL")
def catalog_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.documents_by_lane(spark, sf_dir).groupBy("lane", "split").agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("n_chars"))


_FEATURES = "doc_key, n_words::BIGINT AS n_words, n_distinct::BIGINT AS n_distinct, n_letters::BIGINT AS n_letters, n_chars::BIGINT AS n_chars, n_lines::BIGINT AS n_lines, n_distinct_lines::BIGINT AS n_distinct_lines"


@query(f"WITH {FACTS_SQL} SELECT {_FEATURES} FROM facts")
def quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "n_distinct", "n_letters", "n_chars", "n_lines", "n_distinct_lines")
    return lanes.facts(spark, sf_dir).select("doc_key", *(F.col(n).cast("long").alias(n) for n in names))


@query(f"WITH {FACTS_SQL} SELECT doc_key, quality FROM facts")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.facts(spark, sf_dir).select("doc_key", "quality")


@query(f"WITH {FACTS_SQL} SELECT content_sha256, count(*) AS copies, min(doc_key) AS first_key FROM facts GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = lanes.documents_by_lane(spark, sf_dir).groupBy(T.sha256(F.col("content")).alias("content_sha256"))
    return grouped.agg(F.count("*").alias("copies"), F.min("doc_key").alias("first_key")).where("copies > 1")


@query(f"WITH {FACTS_SQL} SELECT doc_key, min(doc_key) OVER (PARTITION BY content_sha256) AS first_key, doc_key = min(doc_key) OVER (PARTITION BY content_sha256) AS is_first FROM facts WHERE split = 'train'")
def first_copy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lanes.documents_by_lane(spark, sf_dir).where("split = 'train'").select("doc_key", T.sha256(F.col("content")).alias("content_sha256"))
    return gate.first_copies(docs).select("doc_key", "first_key", "is_first")


_WORDS = r"string_split_regex(trim(regexp_replace(lower(content), '[^a-z0-9\x{80}-\x{10FFFF}]+', ' ', 'g')), ' ')"
CONTAMINATION_SQL = (
    FACTS_SQL
    + rf""", toks AS (SELECT doc_key, lane, split, content_sha256, list_filter({_WORDS}, lambda x: x <> '') AS ws FROM features),
bench AS (SELECT 'benchmark/' || item_id AS doc_key, sha256(text) AS content_sha256, list_filter({_WORDS.replace("content", "text")}, lambda x: x <> '') AS ws FROM benchmark),
held AS (SELECT doc_key, content_sha256, ws FROM toks WHERE split = 'eval' UNION ALL SELECT * FROM bench),
tr AS (SELECT * FROM toks WHERE split = 'train'),
grams AS (SELECT DISTINCT doc_key, array_to_string(ws[i:i + {GRAM - 1}], ' ') AS g FROM (SELECT doc_key, ws, unnest(range(1, len(ws) - {GRAM} + 2)) AS i FROM tr)),
known AS (SELECT DISTINCT array_to_string(ws[i:i + {GRAM - 1}], ' ') AS g FROM (SELECT ws, unnest(range(1, len(ws) - {GRAM} + 2)) AS i FROM held)),
shared AS (SELECT doc_key, count(*) AS n_grams, count(known.g) AS n_shared FROM grams LEFT JOIN known USING (g) GROUP BY 1),
shares AS (SELECT doc_key, lane, content_sha256, coalesce(n_grams, 0) AS n_grams, coalesce(n_shared, 0) AS n_shared, coalesce(n_shared::DOUBLE / n_grams, 0.0::DOUBLE) AS overlap FROM tr LEFT JOIN shared USING (doc_key)),
matches AS (SELECT doc_key, (SELECT max(h.doc_key) FROM held h WHERE h.content_sha256 = tr.content_sha256) AS eval_key FROM tr),
flags AS (SELECT doc_key, CASE WHEN eval_key IS NOT NULL THEN 'eval_exact_match' WHEN overlap >= {OVERLAP} AND lane = 'web' THEN 'eval_ngram_overlap' END AS flag, eval_key, floor(overlap * 10000 + 0.5::DOUBLE) / 10000 AS overlap FROM shares JOIN matches USING (doc_key))"""
)


def _scanned(spark, sf_dir):
    """(train, held out) with words, as the contamination scan takes them; benchmark items are held out too."""

    def words(text):
        return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), "")

    docs = lanes.documents_by_lane(spark, sf_dir).select("doc_key", "lane", "split", T.sha256(F.col("content")).alias("content_sha256"), words(F.col("content")).alias("tokens"))
    bench = _table(spark, sf_dir, "benchmark").select(T.document_key(F.lit("benchmark"), F.col("item_id")).alias("doc_key"), T.sha256(F.col("text")).alias("content_sha256"), words(F.col("text")).alias("tokens"))
    held = docs.where("split = 'eval'").select("doc_key", "content_sha256", "tokens").unionByName(bench)
    return docs.where("split = 'train'"), held


def _flags(spark, sf_dir, only=None):
    train, held = _scanned(spark, sf_dir)
    if only is not None:
        train = train.join(only.select("doc_key"), "doc_key", "left_semi")
    return contamination.report(train, held, GRAM, OVERLAP, ("web",))


@query(f"WITH {CONTAMINATION_SQL} SELECT doc_key, eval_key FROM matches WHERE eval_key IS NOT NULL")
def contamination_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.exact_matches(*_scanned(spark, sf_dir))


@query(f"WITH {CONTAMINATION_SQL} SELECT doc_key, n_grams, n_shared FROM shares")
def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.overlaps(*_scanned(spark, sf_dir), GRAM)


@query(f"WITH {CONTAMINATION_SQL} SELECT doc_key, flag, eval_key, overlap FROM flags WHERE flag IS NOT NULL")
def contamination_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


@query(f"WITH {CONTAMINATION_SQL} SELECT overlap AS picked FROM (SELECT overlap, row_number() OVER (ORDER BY overlap) - 1 AS i, count(*) OVER () AS n FROM shares) WHERE i = floor(0.99 * (n - 1))")
def overlap_p99_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.overlaps(*_scanned(spark, sf_dir), GRAM)
    return contamination.picked_percentile(found.select(F.when(F.col("n_grams") > 0, F.col("n_shared") / F.col("n_grams")).otherwise(0.0).alias("overlap")), "overlap", 0.99)


_GATE = """
gated AS (
  SELECT f.doc_key, f.lane, f.content_sha256, quality, floor(quality * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score, flag, f.doc_key <> min(f.doc_key) OVER (PARTITION BY f.content_sha256) AS dup
  FROM facts f LEFT JOIN flags USING (doc_key) WHERE split = 'train'
), decided AS (
  SELECT doc_key, lane, content_sha256, quality, score,
         CASE WHEN flag IS NOT NULL OR dup OR score < {r} THEN 'REJECT' WHEN score < {a} THEN 'DEFER' ELSE 'ACCEPT' END AS decision,
         CASE WHEN flag IS NOT NULL THEN 'eval_contamination:' || flag WHEN dup THEN 'duplicate_content' WHEN score < {r} THEN 'low_quality' WHEN score < {a} THEN 'below_accept' ELSE 'score_ok' END AS reason
  FROM gated
)""".format(a=ACCEPT, r=REJECT)


@query(f"WITH {CONTAMINATION_SQL}, {_GATE} SELECT doc_key, lane, content_sha256, quality, score, decision, reason FROM decided")
def gate_first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.first_pass(lanes.facts(spark, sf_dir), _flags(spark, sf_dir), ACCEPT, REJECT)


@query(f"WITH {CONTAMINATION_SQL}, {_GATE} SELECT lane, decision, split_part(reason, ':', 1) AS reason, count(*) AS n FROM decided GROUP BY ALL")
def gate_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gate_first_pass(spark, sf_dir)
    return found.groupBy("lane", "decision", T.reason_kind(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {FACTS_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE split <> 'train') AS refused FROM facts")
def firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lanes.documents_by_lane(spark, sf_dir).select("doc_key", "split")
    refused = contamination.firewall_violations(docs.select("doc_key"), docs).select("doc_key", F.lit(1).alias("bad"))
    return docs.join(refused, "doc_key", "left").agg(F.count("*").alias("n"), F.count("bad").alias("refused"))


@query(r"""SELECT (quality = 1) AS good, count(*) AS n, sum(floor(q * 10000 + 0.5))::BIGINT AS score FROM (
  SELECT l.quality, q.quality AS q FROM labels l JOIN (WITH """ + FACTS_SQL + r""" SELECT * FROM facts) q ON q.doc_key = 'web/' || l.doc_id) GROUP BY 1""")
def quality_against_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _table(spark, sf_dir, "labels").select(T.document_key(F.lit("web"), F.col("doc_id")).alias("doc_key"), (F.col("quality") == 1).alias("good"))
    joined = known.join(lanes.facts(spark, sf_dir).select("doc_key", "quality"), "doc_key")
    return joined.groupBy("good").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("quality") * 10000 + 0.5)).cast("long").alias("score"))


# --- mixture plans


@query(f"WITH RECURSIVE {PLAN_SQL} SELECT step::INTEGER AS step, stage, lane, planned::INTEGER AS planned, floor, accept::DOUBLE AS accept, reject::DOUBLE AS reject FROM plan")
def mixture_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.compile_plan(spark).drop("adjusted")


@query(f"WITH RECURSIVE {PLAN_SQL} SELECT stage, lane, sum(planned)::BIGINT AS planned, round(sum(planned)::DOUBLE / sum(sum(planned)) OVER (PARTITION BY stage), 4) AS share FROM plan GROUP BY stage, lane")
def plan_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shares(mixture.compile_plan(spark))


@query(f"WITH RECURSIVE {PLAN_SQL} SELECT count(*) AS violations FROM (SELECT step FROM plan WHERE planned < floor UNION ALL SELECT step FROM plan GROUP BY step HAVING sum(planned) <> {BATCH})")
def plan_floor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.violations(mixture.compile_plan(spark)).agg(F.count("*").alias("violations"))


@query(f"WITH RECURSIVE {PLAN_SQL} SELECT i AS step, stage, accept::DOUBLE AS accept FROM range(1, 91) t(i) LEFT JOIN stages ON i BETWEEN s AND e")
def stage_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.range(1, 91).select(F.col("id").alias("step"))
    return mixture.steps_to_stages(steps, mixture.stage_table(spark)).select("step", "stage", "accept")


@query("""SELECT i AS step, round(CASE WHEN i <= 8 THEN 0.003::DOUBLE * i / 8.0::DOUBLE ELSE 0.003::DOUBLE * (0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1.0::DOUBLE + cos(pi() * ((i - 8) / 72.0::DOUBLE)))) END, 9) AS lr FROM range(1, 81) t(i)""")
def learning_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 81).select(F.col("id").alias("step"), F.round(T.learning_rate(F.col("id"), 3e-3, 8, 80), 9).alias("lr"))


# --- packing


SPANS_SQL = (
    FACTS_SQL
    + f""", placed AS (
  SELECT doc_key, lane, n_tokens, coalesce(sum(n_tokens) OVER (PARTITION BY lane ORDER BY sha256('0:' || doc_key) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM facts WHERE split = 'train' AND lane = 'web'
), spans AS (
  SELECT lane, seq, doc_key, greatest(0, seq * {SEQ} - off)::BIGINT AS start, least(n_tokens, (seq + 1) * {SEQ} - off)::BIGINT AS "end", off + greatest(0, seq * {SEQ} - off) - seq * {SEQ} AS place
  FROM (SELECT *, unnest(range(off // {SEQ}, (off + n_tokens - 1) // {SEQ} + 1)) AS seq FROM placed)
)"""
)


def _web(spark, sf_dir):
    return packing.with_order(lanes.facts(spark, sf_dir).where("split = 'train' and lane = 'web'").select("doc_key", "lane", "n_tokens"))


def _web_spans(spark, sf_dir):
    return packing.concat_spans(_web(spark, sf_dir), SEQ)


@query(f'WITH {SPANS_SQL} SELECT lane, seq, doc_key, start, "end", place FROM spans')
def pack_concat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web_spans(spark, sf_dir)


_LOSS_SQL = 'SELECT lane, sum("end" - start - 1)::BIGINT AS loss_tokens FROM spans GROUP BY lane'


@query(f"""WITH {SPANS_SQL}, d AS (SELECT lane, doc_key, sum("end" - start) AS n FROM spans GROUP BY ALL), naive AS (SELECT lane, sum(ceil(n::DOUBLE / {SEQ}))::BIGINT AS naive_sequences FROM d GROUP BY 1), l AS ({_LOSS_SQL}),
per AS (SELECT lane, count(DISTINCT seq) AS sequences, count(*) AS segments, sum("end" - start)::BIGINT AS real_tokens, (count(*) FILTER (WHERE start > 0))::BIGINT AS continued FROM spans GROUP BY 1),
rolled AS (SELECT lane, sum(sequences)::BIGINT AS sequences, sum(segments)::BIGINT AS segments, sum(real_tokens)::BIGINT AS real_tokens, sum(continued)::BIGINT AS continued, sum(loss_tokens)::BIGINT AS loss_tokens, sum(naive_sequences)::BIGINT AS naive_sequences FROM per JOIN naive USING (lane) JOIN l USING (lane) GROUP BY ROLLUP (lane))
SELECT *, real_tokens::DOUBLE / (sequences * {SEQ}) AS utilization, loss_tokens::DOUBLE / (sequences * {SEQ}) AS loss_fraction, segments::DOUBLE / sequences AS segments_per_sequence, 1 - sequences::DOUBLE / naive_sequences AS savings FROM rolled""")
def pack_concat_util(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _web_spans(spark, sf_dir)
    loss = spans.groupBy("lane").agg(F.sum(F.col("end") - F.col("start") - 1).alias("loss_tokens"))
    return packing.metrics(spans, loss, SEQ)


@query(f"WITH {FACTS_SQL} SELECT lane, sum(ceil(n_tokens::DOUBLE / {SEQ}))::BIGINT AS sequences, sum(n_tokens)::BIGINT AS real_tokens, sum(n_tokens)::DOUBLE / (sum(ceil(n_tokens::DOUBLE / {SEQ})) * {SEQ}) AS utilization FROM facts WHERE split = 'train' GROUP BY 1")
def naive_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _train(spark, sf_dir).groupBy("lane").agg(F.sum(F.ceil(F.col("n_tokens") / SEQ)).cast("long").alias("sequences"), F.sum("n_tokens").cast("long").alias("real_tokens"))
    return per.withColumn("utilization", F.col("real_tokens") / (F.col("sequences") * SEQ))


@query(f'WITH {SPANS_SQL} SELECT count(*) AS documents, count(*) FILTER (WHERE bad) AS broken FROM (SELECT doc_key, bool_or(start <> prev) AS bad FROM (SELECT doc_key, start, coalesce(lag("end") OVER (PARTITION BY doc_key ORDER BY start), 0) AS prev FROM spans) GROUP BY 1)')
def span_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _web_spans(spark, sf_dir)
    broken = packing.span_discontinuities(spans).withColumn("bad", F.lit(1))
    return spans.select("doc_key").distinct().join(broken, "doc_key", "left").agg(F.count("*").alias("documents"), F.count("bad").alias("broken"))


@query(f'WITH {SPANS_SQL} SELECT seq, doc_key, row_number() OVER (PARTITION BY lane, seq ORDER BY place) AS segment, coalesce(sum("end" - start) OVER (PARTITION BY lane, seq ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_in_row FROM spans')
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.segments(_web_spans(spark, sf_dir), ["lane", "seq"]).select("seq", "doc_key", F.col("segment").cast("long").alias("segment"), F.col("place").alias("offset_in_row"))


_TOKENS_SQL = (
    SPANS_SQL
    + f""", toks AS (SELECT doc_key, list_append(regexp_extract_all(content, '{PRETOKEN}'), '<eos>') AS tokens FROM docs WHERE lane = 'web'),
tokens AS (
  SELECT lane, seq, place + i AS pos, i AS position_id, t.tokens[start + i + 1] AS token, CASE WHEN start + i + 1 < "end" THEN t.tokens[start + i + 2] END AS label,
         CASE WHEN start + i + 1 < "end" THEN 1 ELSE 0 END AS loss, segment
  FROM (SELECT *, unnest(range(0, "end" - start)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY lane, seq ORDER BY place) AS segment FROM spans)) JOIN toks t USING (doc_key)
)"""
)


def _web_tokens(spark, sf_dir):
    docs = lanes.documents_by_lane(spark, sf_dir).where("lane = 'web' and split = 'train'")
    tokens = docs.select("doc_key", F.concat(T.pretokens(F.col("content")), F.array(F.lit("<eos>"))).alias("tokens"))
    return packing.materialize_tokens(_web_spans(spark, sf_dir), tokens, ["lane", "seq"])


@query(f"WITH {_TOKENS_SQL} SELECT seq, count(*) AS n, sum(loss)::BIGINT AS loss, sum(position_id * (pos + 1))::BIGINT AS positions, max(segment)::BIGINT AS segments, sha256(string_agg(token, chr(31) ORDER BY pos)) AS tokens_sha256, sha256(string_agg(coalesce(label, ''), chr(31) ORDER BY pos)) AS labels_sha256 FROM tokens GROUP BY lane, seq")
def next_token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _web_tokens(spark, sf_dir)
    row = F.array_sort(F.collect_list(F.struct("pos", "token", F.coalesce("label", F.lit("")).alias("label"))))
    held = t.groupBy("lane", "seq").agg(F.count("*").alias("n"), F.sum("loss").cast("long").alias("loss"), F.sum(F.col("position_id") * (F.col("pos") + 1)).cast("long").alias("positions"), F.max("segment").cast("long").alias("segments"), row.alias("r"))
    digest = lambda name: F.sha2(F.array_join(F.col(f"r.{name}"), "\x1f"), 256)
    return held.select("seq", "n", "loss", "positions", "segments", digest("token").alias("tokens_sha256"), digest("label").alias("labels_sha256"))


@query(f"WITH {_TOKENS_SQL}, per AS (SELECT lane, seq, count(*) AS n, sum(loss) AS loss FROM tokens GROUP BY ALL) SELECT lane, seq // {BATCH} AS batch, (count(*) * {SEQ})::BIGINT AS slots, sum(n)::BIGINT AS real_tokens, (count(*) * {SEQ} - sum(n))::BIGINT AS pad_tokens, sum(loss)::BIGINT AS loss_tokens FROM per GROUP BY ALL")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.batch_stats(_web_tokens(spark, sf_dir), ["lane", "seq"], SEQ, BATCH)


@query(f"""WITH {LANES_SQL}, p AS (SELECT 'instruct/' || (conv_id * 1000 + turn) AS doc_key, len(regexp_extract_all(prompt, '{PRETOKEN}')) + 2 AS loss_start, len(regexp_extract_all(' ' || response, '{PRETOKEN}')) + 1 AS n_response FROM pairs)
SELECT doc_key, loss_start::BIGINT AS loss_start, (loss_start + n_response)::BIGINT AS n, n_response::BIGINT AS loss_tokens FROM p""")
def response_loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lanes.pair_turns(_table(spark, sf_dir, "conversations"))
    prompt = F.concat(F.array(F.lit("<user>")), T.pretokens(F.col("prompt")), F.array(F.lit("<assistant>")))
    tokens = pairs.select(T.document_key(F.lit("instruct"), F.col("conv_id") * 1000 + F.col("turn")).alias("doc_key"), F.concat(prompt, T.pretokens(F.concat(F.lit(" "), F.col("response"))), F.array(F.lit("<eos>"))).alias("tokens"), F.size(prompt).alias("loss_start"))
    spans = tokens.select("doc_key", F.lit(0).cast("long").alias("start"), F.size("tokens").cast("long").alias("end"), F.lit(0).cast("long").alias("place"), F.col("doc_key").alias("seq"))
    rows = packing.materialize_tokens(spans, tokens, ["seq"], response_only=True)
    per = rows.groupBy(F.col("seq").alias("doc_key")).agg(F.count("*").alias("n"), F.sum("loss").cast("long").alias("loss_tokens"))
    return per.join(tokens.select("doc_key", F.col("loss_start").cast("long").alias("loss_start")), "doc_key").select("doc_key", "loss_start", "n", "loss_tokens")


#: The packer's rules as a recursion: bins are the open ones as {room, number}; a step places one document and closes at most two.
_BEST_FIT_SQL = f"""
lists AS (SELECT lane, list({{'k': doc_key, 'n': least(n_tokens, {SEQ})::BIGINT}} ORDER BY sha256('0:' || doc_key)) AS l FROM facts WHERE split = 'train' AND lane <> 'web' GROUP BY lane),
steps AS (
  SELECT lane, l, 0 AS i, []::STRUCT(room BIGINT, num BIGINT)[] AS bins, 0::BIGINT AS opened, NULL::BIGINT AS num, NULL::BIGINT AS place, NULL::BIGINT AS forced, NULL::BIGINT AS filled FROM lists
  UNION ALL
  SELECT lane, l, i + 1,
         list_filter(list_append(rest, {{'room': room - n, 'num': own}}), lambda b: b.room >= 4), opened + (fit IS NULL)::BIGINT, own, {SEQ} - room, out, CASE WHEN room - n < 4 THEN own END
  FROM (
    SELECT lane, l, i, opened, n, fit, coalesce(fit.num, opened) AS own, coalesce(fit.room, {SEQ}) AS room, CASE WHEN fit IS NULL AND len(bins) = 4 THEN list_sort(bins)[1].num END AS out,
           list_filter(bins, lambda b: b.num IS DISTINCT FROM fit.num AND b.num IS DISTINCT FROM CASE WHEN fit IS NULL AND len(bins) = 4 THEN list_sort(bins)[1].num END) AS rest
    FROM (SELECT *, l[i + 1].n AS n, list_sort(list_filter(bins, lambda b: b.room >= l[i + 1].n))[1] AS fit FROM steps WHERE i < len(l))
  )
), closed AS (
  SELECT lane, num, row_number() OVER (PARTITION BY lane ORDER BY turn, nth, num) - 1 AS seq FROM (
    SELECT lane, forced AS num, i AS turn, 0 AS nth FROM steps WHERE forced IS NOT NULL
    UNION ALL SELECT lane, filled, i, 1 FROM steps WHERE filled IS NOT NULL
    UNION ALL SELECT lane, unnest(list_transform(bins, lambda b: b.num)), 1000000000, 0 FROM steps WHERE i = len(l)
  )
)"""


@query(f"""WITH RECURSIVE {FACTS_SQL}, {_BEST_FIT_SQL} SELECT lane, 0::INTEGER AS stream, seq, l[i].k AS doc_key, 0::BIGINT AS start, l[i].n AS "end", place FROM steps JOIN closed USING (lane, num) WHERE i > 0""")
def pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = packing.with_order(_train(spark, sf_dir).where("lane <> 'web'").select("doc_key", "lane", "n_tokens"))
    return packing.best_fit_spans(docs, SEQ)


def _forged(spans: DataFrame) -> DataFrame:
    """Spans with faults of known kinds: shifted in the sequence, beyond their document, of held-out or unknown documents."""
    kind = F.pmod(F.col("seq") * 31 + F.col("start"), F.lit(13))
    return spans.select(
        "lane",
        "seq",
        F.when(kind == 1, "web/unknown").when(kind == 2, "web/20").otherwise(F.col("doc_key")).alias("doc_key"),
        "start",
        (F.col("end") + F.when(kind == 3, 100_000).otherwise(0)).alias("end"),
        (F.col("place") + F.when(kind == 4, 1).otherwise(0)).alias("place"),
    )


_FORGED_SQL = f"""
forged AS (
  SELECT lane, seq, CASE kind WHEN 1 THEN 'web/unknown' WHEN 2 THEN 'web/20' ELSE doc_key END AS doc_key, start, "end" + CASE WHEN kind = 3 THEN 100000 ELSE 0 END AS "end", place + (kind = 4)::INT AS place
  FROM (SELECT *, (seq * 31 + start) % 13 AS kind FROM spans)
), held AS (
  SELECT f.*, d.split, d.n_tokens AS n, coalesce(lag(place + "end" - start) OVER (PARTITION BY f.lane, seq ORDER BY place), 0) AS due FROM forged f LEFT JOIN facts d USING (doc_key)
), ruled AS (
  SELECT 'unknown_document' AS rule FROM held WHERE n IS NULL
  UNION ALL SELECT 'not_train' FROM held WHERE split <> 'train'
  UNION ALL SELECT 'out_of_bounds' FROM held WHERE start < 0 OR "end" > n OR start >= "end"
  UNION ALL SELECT 'gap_or_overlap' FROM held WHERE place <> due
  UNION ALL SELECT 'too_long' FROM held WHERE place + "end" - start > {SEQ}
)"""


@query(f"WITH {SPANS_SQL}, {_FORGED_SQL} SELECT rule, count(*) AS violations FROM ruled GROUP BY 1")
def packing_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations that the rules find in forged spans, by rule; sound spans have none (the run's audit holds that)."""
    facts = lanes.facts(spark, sf_dir).select("doc_key", "lane", "split", "n_tokens")
    found = packing.invariant_violations(_forged(_web_spans(spark, sf_dir)), facts, SEQ, ["lane", "seq"], False)
    return found.groupBy("rule").agg(F.count("*").alias("violations"))


_HELD_SQL = SPANS_SQL.replace("WHERE split = 'train' AND lane = 'web'", "WHERE split <> 'train' AND lane = 'web'").replace("SELECT doc_key, lane, n_tokens, coalesce", "SELECT doc_key, split AS lane, n_tokens, coalesce").replace("PARTITION BY lane ORDER BY sha256", "PARTITION BY split ORDER BY sha256")


_HELD_BINS_SQL = _BEST_FIT_SQL.replace("SELECT lane, list(", "SELECT lane || ':' || split AS lane, list(", 1).replace("split = 'train' AND lane <> 'web' GROUP BY lane", "split <> 'train' AND lane <> 'web' GROUP BY lane, split")


@query(f"""WITH RECURSIVE {_HELD_SQL}, {_HELD_BINS_SQL}
SELECT 'web' AS lane, lane AS split, count(DISTINCT seq) AS sequences, count(*) AS segments, sum("end" - start)::BIGINT AS real_tokens, sum("end" - start - 1)::BIGINT AS loss_tokens FROM spans GROUP BY lane
UNION ALL SELECT split_part(lane, ':', 1), split_part(lane, ':', 2), count(DISTINCT num), count(*), sum(l[i].n)::BIGINT, sum(l[i].n - 1)::BIGINT FROM steps WHERE i > 0 GROUP BY lane""")
def held_out_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and evaluation documents of every lane, packed by its policy without the gate, the last, partial sequences kept. loss_tokens: places that have a label."""
    docs = lanes.facts(spark, sf_dir).where("split <> 'train'").select("doc_key", F.col("lane").alias("_lane"), F.concat_ws(":", "lane", "split").alias("lane"), "n_tokens")
    docs = packing.with_order(docs)
    columns = ["lane", "seq", "doc_key", "start", "end"]
    web = packing.concat_spans(docs.where("_lane = 'web'"), SEQ).select(columns)
    spans = web.unionByName(packing.best_fit_spans(docs.where("_lane <> 'web'"), SEQ).select(columns))
    per = spans.groupBy("lane").agg(F.countDistinct("seq").alias("sequences"), F.count("*").alias("segments"), F.sum(F.col("end") - F.col("start")).cast("long").alias("real_tokens"), F.sum(F.col("end") - F.col("start") - 1).cast("long").alias("loss_tokens"))
    return per.select(F.split_part("lane", F.lit(":"), F.lit(1)).alias("lane"), F.split_part("lane", F.lit(":"), F.lit(2)).alias("split"), "sequences", "segments", "real_tokens", "loss_tokens")


# --- tokenizer


@query(f"WITH {LANES_SQL} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '{PRETOKEN}')) AS word FROM docs WHERE split = 'train') GROUP BY 1")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.word_counts(lanes.documents_by_lane(spark, sf_dir).where("split = 'train'"))


@query(f"WITH {LANES_SQL}, w AS (SELECT hex(encode(word)) AS h, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '{PRETOKEN}')) AS word FROM docs WHERE split = 'train') GROUP BY 1) SELECT h[2 * i + 1:2 * i + 4] AS pair, sum(n)::BIGINT AS n FROM (SELECT h, n, unnest(range(0, length(h) // 2 - 1)) AS i FROM w) GROUP BY 1")
def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.pair_counts(word_counts(spark, sf_dir))


_TRAINING_SQL = "SELECT 'train' AS s, number, content FROM lane_rows WHERE lane <> 'instruct' UNION ALL SELECT 'train', conv_id * 1000 + turn, prompt || ' ' || response FROM pairs"


@query(f"WITH {LANES_SQL} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '{PRETOKEN}')) AS word FROM ({_TRAINING_SQL}) WHERE number % 20 > 1) GROUP BY 1")
def training_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tokenizer is trained on: a pair counts as its prompt, a space and its response."""
    docs = lanes.documents_by_lane(spark, sf_dir).where("split = 'train'")
    return tokenizer.word_counts(docs.select(T.training_text(F.col("lane"), F.col("content"), F.col("prompt"), F.col("response")).alias("content")))


def trained(spark: SparkSession, sf_dir: str) -> tokenizer.Tokenizer:
    return tokenizer.train(training_word_counts(spark, sf_dir), 320)


@query()
def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(trained(spark, sf_dir).merges)], "rank int, left int, right int")


@query()
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.token_digests(lanes.documents_by_lane(spark, sf_dir), trained(spark, sf_dir)).select("doc_key", "n_tokens", "loss_start", "token_sha256")


# --- ledgers and audits on the tables that have their shape


_EVENT = """'{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}'"""


@query(f"""SELECT user_id, n AS records, split_part(list_reduce(list_prepend('-1|{"0" * 64}', l), lambda acc, x: (split_part(acc, '|', 1)::BIGINT + 1) || '|' || sha256('{{"data":' || x || ',"prev":"' || split_part(acc, '|', 2) || '","seq":' || (split_part(acc, '|', 1)::BIGINT + 1) || '}}')), '|', 2) AS head
FROM (SELECT user_id, count(*) AS n, list({_EVENT} ORDER BY event_id) AS l FROM events GROUP BY 1)""")
def ledger_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return ledger.chain_heads(events, "user_id", "event_id", F.to_json(F.struct("event_id", "event_type", "user_id")))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), kept AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY user_id ORDER BY i), -1) AS p FROM n WHERE event_id % 101 <> 0)
SELECT 'hash' AS violation, count(*) AS n FROM kept WHERE event_id % 97 = 0 UNION ALL SELECT 'link', count(*) FROM kept WHERE i <> p + 1 UNION ALL SELECT 'sequence', count(*) FROM kept WHERE i <> p + 1""")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification finds in chains of which records were edited (every 97th event) and taken out (every 101st)."""
    events = _table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq_key"), F.to_json(F.struct("event_id", "event_type", "user_id")).alias("data"))
    chained = ledger.chain(rows).withColumn("event_id", F.get_json_object("data", "$.event_id").cast("long"))
    edited = chained.where("event_id % 101 <> 0").withColumn("data", F.when(F.col("event_id") % 97 == 0, F.concat("data", F.lit(" "))).otherwise(F.col("data")))
    return ledger.violations(edited.drop("event_id")).groupBy("violation").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN (SELECT o_orderkey, min(o_orderdate) AS d FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON l_orderkey = o_orderkey WHERE d IS NULL OR d > l_shipdate")
def admitted_before_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    admissions = _table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"))
    consumed = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("at"), "l_linenumber")
    return audit.not_admitted_before(consumed, admissions, "k", "at").select(F.col("k").alias("l_orderkey"), "l_linenumber")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def rejected_not_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return audit.rejected_and_consumed(events.where("event_type = 'error'"), events.where("event_type = 'purchase'"), "user_id")


@query("SELECT event_id, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier FROM events")
def defer_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.earlier_count(_table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "earlier")


@query("SELECT event_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS attempt FROM events")
def attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.attempts(_table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup").select("event_id", "attempt")


@query("SELECT event_type, value AS median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = n // 2")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.upper_median(_table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "median")


@query("(SELECT l_returnflag AS flag, l_linenumber AS n, 'left' AS side FROM lineitem WHERE l_quantity > 25 EXCEPT ALL SELECT l_returnflag, l_linenumber, 'left' FROM lineitem WHERE l_quantity <= 25) UNION ALL (SELECT l_returnflag, l_linenumber, 'right' FROM lineitem WHERE l_quantity <= 25 EXCEPT ALL SELECT l_returnflag, l_linenumber, 'right' FROM lineitem WHERE l_quantity > 25)")
def stream_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("n"), "l_quantity")
    return audit.differences(rows.where("l_quantity > 25").select("flag", "n"), rows.where("l_quantity <= 25").select("flag", "n"))


@query("SELECT l_shipmode_key AS source, count(*) AS n FROM (SELECT regexp_extract(k, '^(.*)/([0-9]+)$', 1) AS l_shipmode_key FROM (SELECT 'a/' || l_returnflag || '/' || l_orderkey AS k FROM lineitem)) GROUP BY 1")
def keys_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "lineitem").select(T.document_key(F.concat(F.lit("a/"), F.col("l_returnflag")), F.col("l_orderkey")).alias("k"))
    return keys.select(T.split_key(F.col("k"))[0].alias("source")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS doc, count(*) AS spans, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS trace FROM lineitem GROUP BY 1")
def document_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.count("*").alias("spans"), F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    return per.select("doc", "spans", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("trace"))


# --- the control plane and what audits derive from it


def control_events(spark: SparkSession, sf_dir: str, last_step: int = STEPS, state: str | None = None, snapshots=()) -> DataFrame:
    """The run of the default plan. Only documents of the run's candidates are scanned for contamination."""
    facts = packing.with_order(lanes.facts(spark, sf_dir))
    return control.run_batch(facts, lambda chosen: _flags(spark, sf_dir, chosen), mixture.compile_rows(), last_step, state, snapshots=snapshots)


def ended(events: DataFrame) -> tuple[int, str | None]:
    """The last step that a run has finished, and why it went no further than that (None: the plan ends there)."""
    last = events.where("kind = 'state'").agg(F.max("step")).first()[0] or 0
    found = control.unfold(events, "exhausted").first()
    return last, found["reason"] if found else None


@query()
def control_plane_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.unfold(control_events(spark, sf_dir), "decision")


@query()
def control_plane_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.unfold(control_events(spark, sf_dir), "span")


@query()
def control_plane_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check, passed, violations over a run's decisions, spans and lane reports."""
    events = control_events(spark, sf_dir)
    facts, flags = lanes.facts(spark, sf_dir), _flags(spark, sf_dir)
    last, reason = ended(events)
    checks = run_checks(spark, events, facts, flags, [r for r in mixture.compile_rows() if r[0] <= last], last)
    unexplained = spark.range(last + 1, STEPS + 1) if reason is None else spark.range(0)
    found = audit.run_audit(checks | {"ends_with_the_plan_or_exhausted": unexplained})
    events.unpersist()
    return spark.createDataFrame(found, "check string, passed boolean, violations long")


def run_checks(spark: SparkSession, events: DataFrame, facts: DataFrame, flags: DataFrame, plan_rows: list[tuple], steps: int) -> dict[str, DataFrame]:
    plan = spark.createDataFrame(plan_rows, mixture.PLAN_SCHEMA)
    decisions, spans, report = (control.unfold(events, k) for k in ("decision", "span", "lane"))
    admitted = decisions.where(F.col("decision").isin(*audit.ADMITTED))
    protected = [x.name for x in mixture.LANES if x.protected]
    return {
        "every_step_once": audit.missing_steps(report.select("step").distinct(), 1, steps),
        "decisions_follow_from_documents_and_plan": audit.decision_mismatches(decisions, facts, plan, flags, protected),
        "defer_counts": audit.defer_discontinuities(decisions),
        "admitted_before_consumed": audit.not_admitted_before(spans.select("doc_key", "step"), admitted, "doc_key", "step"),
        "no_flagged_document_consumed": audit.rejected_and_consumed(flags, spans, "doc_key"),
        "no_rejected_document_consumed": audit.rejected_and_consumed(decisions.where("decision = 'REJECT'"), spans, "doc_key"),
        "only_train_documents": contamination.firewall_violations(spans, facts),
        "spans_follow_one_another": packing.span_discontinuities(spans),
        "sequences_sound": packing.invariant_violations(spans, facts, SEQ, ["step", "lane", "row"], False),
        "plan_reconciles": audit.plan_differences(report, plan),
        "plan_sound": mixture.violations(plan),
        "overrides_only_in_protected_lanes": decisions.where((F.col("decision") == "ACCEPT_FLOOR_OVERRIDE") & ~F.col("lane").isin(*protected)),
    }


@query()
def control_plane_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """planned_steps, last_step, exhausted: why a run on few documents ends before its plan, or null."""
    events = control_events(spark, sf_dir)
    last, reason = ended(events)
    events.unpersist()
    return spark.createDataFrame([(STEPS, last, reason)], "planned_steps int, last_step int, exhausted string")


@query()
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.decision_counts(control_plane_decisions(spark, sf_dir))


@query()
def decision_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.first_examples(control_plane_decisions(spark, sf_dir))


@query()
def planned_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = control.unfold(control_events(spark, sf_dir), "lane")
    return audit.stage_shares(report, spark.createDataFrame(mixture.compile_rows(), mixture.PLAN_SCHEMA))


@query()
def replay_from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows, different: what a run wrote after its middle step, and what a run from the snapshot of that step writes otherwise."""
    whole = control_events(spark, sf_dir)
    middle = ended(whole)[0] // 2
    taken = control.unfold(control_events(spark, sf_dir, middle, snapshots=[middle]), "snapshot").first()
    later = whole.where(F.col("step") > middle).select("kind", "step", "seq", "body")
    off = audit.differences(later, control_events(spark, sf_dir, state=taken["state"] if taken else None).select("kind", "step", "seq", "body"))
    return spark.createDataFrame([(later.count(), off.count())], "rows long, different long")
