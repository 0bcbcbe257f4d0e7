"""Audit queries: each returns the rows that break its rule, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.shared import fresh
from corpusloom.operators import gate as gate_rule

ADMITTED = ("ACCEPT", "ACCEPT_FLOOR_OVERRIDE")


def not_admitted_before(consumed: DataFrame, admissions: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of consumed (key, at) without an admission of the key at the same time or before."""
    first = admissions.groupBy(key).agg(F.min(at).alias("_first"))
    return consumed.join(first, key, "left").where(F.col("_first").isNull() | (F.col("_first") > F.col(at))).drop("_first")


def rejected_and_consumed(rejected: DataFrame, consumed: DataFrame, key: str) -> DataFrame:
    return consumed.join(rejected.select(key), key, "left_semi").select(key).distinct()


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with their numbers, that one of two tables has more often: the columns, and side. One aggregation of both tables."""
    count = fresh(left.columns, "_n")
    both = left.withColumn(count, F.lit(1)).unionByName(right.withColumn(count, F.lit(-1)))
    summed = both.groupBy(*left.columns).agg(F.sum(count).alias(count)).where(F.col(count) != 0)
    side = F.explode(F.array_repeat(F.when(F.col(count) > 0, "left").otherwise("right"), F.abs(F.col(count)).cast("int")))
    return summed.select(*left.columns, side.alias("side"))


def missing_steps(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Steps of first..last that are not there exactly once."""
    want = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("step"))
    return differences(rows.select(F.col("step").cast("int").alias("step")), want)


def earlier_count(events: DataFrame, key: str, order: str, matches: Column) -> DataFrame:
    """events with earlier: how many rows of the key before this one match."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("earlier", F.coalesce(F.sum(matches.cast("long")).over(before), F.lit(0)))


def defer_discontinuities(decisions: DataFrame) -> DataFrame:
    """Decisions, overrides apart, whose defer count is not the number of the document's earlier deferrals."""
    counted = earlier_count(decisions, "doc_key", "seq", F.col("decision") == "DEFER")
    return counted.where((F.col("decision") != "ACCEPT_FLOOR_OVERRIDE") & (F.col("defers") != F.col("earlier"))).drop("earlier")


def decision_mismatches(decisions: DataFrame, facts: DataFrame, plan: DataFrame, flags: DataFrame, protected: list[str]) -> DataFrame:
    """Decisions that the documents, the plan and the gate's rule do not give again. A content is a duplicate after its first admission."""
    stages = plan.select("step", F.col("accept").alias("_accept"), F.col("reject").alias("_reject")).distinct()
    first = decisions.where(F.col("decision").isin(*ADMITTED)).groupBy("content_sha256").agg(F.min("seq").alias("_admitted"))
    known = (
        decisions.join(facts.select("doc_key", F.col("quality").alias("_quality"), F.col("content_sha256").alias("_content"), F.col("lane").alias("_lane")), "doc_key", "left")
        .join(F.broadcast(stages), "step", "left")
        .join(flags.select("doc_key", F.col("flag").alias("_flag")), "doc_key", "left")
        .join(first, "content_sha256", "left")
    )
    value = gate_rule.score(F.col("_quality"), F.col("defers"))
    again, reason = gate_rule.decide(F.col("_flag"), F.coalesce(F.col("_admitted") < F.col("seq"), F.lit(False)), value, F.col("defers"), F.col("_accept"), F.col("_reject"))
    override = F.col("decision") == "ACCEPT_FLOOR_OVERRIDE"
    plain = (again != F.col("decision")) | (reason != F.col("reason"))
    wrong = F.when(override, (again != "DEFER") | ~F.col("lane").isin(*protected)).otherwise(plain)
    inputs = ~F.col("_quality").eqNullSafe(F.col("quality")) | ~F.col("_content").eqNullSafe(F.col("content_sha256")) | (F.col("score") != value) | ~F.col("_lane").eqNullSafe(F.col("lane"))
    return known.where(F.coalesce(wrong | inputs, F.lit(True))).select("step", "seq", "doc_key", "decision", "reason")


def plan_differences(lanes: DataFrame, plan: DataFrame) -> DataFrame:
    """(step, lane) where emitted is not planned - shortfall + backfill, the plan is another, or a floor was not held; step rows where backfill is not the shortfall."""
    both = plan.select("step", "lane", F.col("planned").alias("_planned"), F.col("floor").alias("_floor")).join(lanes, ["step", "lane"], "left")
    off = F.coalesce((F.col("emitted") != F.col("_planned") - F.col("shortfall") + F.col("backfill")) | (F.col("planned") != F.col("_planned")) | (F.col("emitted") < F.col("_floor")), F.lit(True))
    per_step = lanes.groupBy("step").agg(F.sum("shortfall").alias("s"), F.sum("backfill").alias("b")).where("s <> b").select("step", F.lit(None).cast("string").alias("lane"))
    return both.where(off).select("step", "lane").unionByName(per_step)


def stage_shares(lanes: DataFrame, plan: DataFrame) -> DataFrame:
    """stage, lane, planned_share, actual_share, overrides, shortfall."""
    joined = lanes.join(plan.select("step", "lane", "stage"), ["step", "lane"])
    per = joined.groupBy("stage", "lane").agg(*(F.sum(c).cast("long").alias(c) for c in ("planned", "emitted", "overrides", "shortfall")))
    whole = Window.partitionBy("stage")
    return per.select("stage", "lane", (F.col("planned") / F.sum("planned").over(whole)).alias("planned_share"), (F.col("emitted") / F.sum("emitted").over(whole)).alias("actual_share"), "overrides", "shortfall")


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("stage", "lane", "decision", F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


def first_examples(decisions: DataFrame) -> DataFrame:
    kind = F.split_part("reason", F.lit(":"), F.lit(1))
    return decisions.groupBy("decision", kind.alias("kind")).agg(F.min_by(F.struct("step", "lane", "doc_key", "score"), "seq").alias("example")).select("decision", "kind", "example.*")


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at index n // 2 of the sorted values of each group, not interpolated."""
    order = Window.partitionBy(*by).orderBy(value)
    ranked = rows.select(*by, value, (F.row_number().over(order) - 1).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    return ranked.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(*by, F.col(value).alias("median"))


def attempts(events: DataFrame, ledger: str, order: str, started: Column) -> DataFrame:
    """events with attempt: how often the ledger had been started, this row included."""
    return events.withColumn("attempt", F.sum(started.cast("long")).over(Window.partitionBy(ledger).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def segment_losses(spans: DataFrame, losses: DataFrame) -> DataFrame:
    """spans (step, row, place, start, end) with loss_sum over their places. losses: step, row, values array."""
    part = F.slice("values", F.col("place").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return spans.join(losses, ["step", "row"]).withColumn("loss_sum", F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double"))).drop("values")


def unequal_segments(want: DataFrame, got: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys of segments that are not the same, or in one table only: an order-sensitive comparison, since the keys hold the place."""
    a = want.select(*keys, F.struct(*columns).alias("_want"))
    both = a.join(got.select(*keys, F.struct(*columns).alias("_got")), keys, "full")
    return both.where(~F.col("_want").eqNullSafe(F.col("_got"))).select(*keys)


def every_and_some(rows: DataFrame, by: list[str], matches: Column) -> DataFrame:
    """by, every, some: whether all, or any, rows of a group match; a null counts as no."""
    hit = F.coalesce(matches, F.lit(False))
    return rows.groupBy(*by).agg(F.bool_and(hit).alias("every"), F.bool_or(hit).alias("some"))


def largest_difference(rows: DataFrame, left: str, right: str) -> DataFrame:
    return rows.agg(F.max(F.abs(F.col(left) - F.col(right))).alias("max_abs_diff"))


def set_union(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, members: the sorted distinct values of a group."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(column)).alias("members"))


def all_streams(**streams: DataFrame) -> DataFrame:
    """The rows of several streams (live, orphans, branches) with the stream's name; repeated rows stay."""
    out = None
    for name, rows in streams.items():
        named = rows.withColumn("stream", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def packed_samples(spans: DataFrame, sequence: list[str], n: int = 3) -> DataFrame:
    """The first n sequences, in order, that hold two segments or more."""
    several = spans.groupBy(*sequence).agg(F.count("*").alias("segments")).where("segments >= 2")
    return several.orderBy(*sequence).limit(n)


def not_held_out(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of a held-out scoring whose document is unknown or of another split than val and eval."""
    return rows.join(docs.select("doc_key", "split"), "doc_key", "left").where(~F.coalesce(F.col("split").isin("val", "eval"), F.lit(False)))


def share_deviation(shares: DataFrame) -> DataFrame:
    """stage, max_deviation of the actual shares from the planned ones."""
    return shares.groupBy("stage").agg(F.max(F.abs(F.col("actual_share") - F.col("planned_share"))).alias("max_deviation"))


def run_audit(checks: dict[str, DataFrame]) -> list[tuple[str, bool, int]]:
    """(check, passed, violations). A check whose query fails does not pass; no checks are no pass."""
    if not checks:
        raise ValueError("an audit without checks is no audit")
    out = []
    for name, df in checks.items():
        try:
            n = df.count()
        except Exception:  # noqa: BLE001  the audit itself goes on
            n = -1
        out.append((name, n == 0, n))
    return out
