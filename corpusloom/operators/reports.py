"""Reports of a run: losses by lane, throughput, and an audit's evidence."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import audit


def lane_losses(segments: DataFrame, by: list[str]) -> DataFrame:
    """segments: loss_sum, loss_tokens. by, loss (mean of the tokens that bear one), tokens."""
    per = segments.groupBy(*by).agg(F.sum("loss_sum").alias("_s"), F.sum("loss_tokens").cast("long").alias("tokens"))
    return per.select(*by, (F.col("_s") / F.greatest(F.lit(1), F.col("tokens"))).alias("loss"), "tokens")


def throughput(steps: DataFrame, slots_per_step: int) -> DataFrame:
    """steps: data_ms, ledger_ms, compute_ms, loss_tokens. One row: seconds, rates, the data's share and the upper median of a step."""
    whole = F.col("data_ms") + F.col("ledger_ms") + F.col("compute_ms")
    median = audit.upper_median(steps.select(F.lit(0).alias("_g"), whole.alias("_ms")), ["_g"], "_ms")
    total = steps.agg(F.count("*").alias("steps"), F.sum(whole).alias("_ms"), F.sum("data_ms").alias("_data"), F.sum("loss_tokens").cast("long").alias("loss_tokens"))
    seconds = F.col("_ms") / 1000
    return total.crossJoin(median.select("median")).select(
        "steps",
        seconds.alias("seconds"),
        (F.col("steps") * slots_per_step / seconds).alias("slot_tokens_per_second"),
        (F.col("loss_tokens") / seconds).alias("loss_tokens_per_second"),
        (F.col("_data") / F.col("_ms")).alias("data_share"),
        F.col("median").alias("median_step_ms"),
    )


def first_and_last_mean(losses: DataFrame, order: str, value: str, n: int = 10) -> DataFrame:
    """Mean of the first and of the last n values."""
    ranked = losses.select(value, F.row_number().over(Window.orderBy(order)).alias("_i"), F.count("*").over(Window.partitionBy()).alias("_n"))
    return ranked.agg(F.avg(F.when(F.col("_i") <= n, F.col(value))).alias("first_mean"), F.avg(F.when(F.col("_i") > F.col("_n") - n, F.col(value))).alias("last_mean"))


def compare_runs(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, identical: rows of the left run next to those of the right; a row that only one has is not identical."""
    a = left.select(*keys, F.struct(*columns).alias("_a"))
    b = right.select(*keys, F.struct(*columns).alias("_b"))
    return a.join(b, keys, "full").select(*keys, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("identical"))


def evidence(results: list[tuple[str, bool, int]]) -> tuple[str, str]:
    """An audit's results as JSON and as Markdown."""
    passed = sum(ok for _, ok, _ in results)
    table = "\n".join(f"| {name} | {'PASS' if ok else 'FAIL'} | {n} |" for name, ok, n in results)
    data = {"checks": [{"check": name, "passed": ok, "violations": n} for name, ok, n in results], "passed": passed, "total": len(results)}
    return json.dumps(data, indent=1, sort_keys=True), f"# Audit: {passed} of {len(results)} checks passed\n\n| check | result | violations |\n|-|-|-|\n{table}\n"
