"""Admission gate: the stateless rule, and a first pass that keeps the first copy of each content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGING, MAX_DEFERS = 0.04, 3


def score(quality: Column, defers: Column, aging: float = AGING) -> Column:
    return F.floor((quality + F.lit(aging) * defers) * 10000.0 + 0.5) / 10000.0


def decide(flag: Column, duplicate: Column, value: Column, defers: Column, accept: Column, reject: Column, max_defers: int = MAX_DEFERS) -> tuple[Column, Column]:
    """Decision and reason, the first rule that holds."""
    decision = F.when(flag.isNotNull() | duplicate | (value < reject), "REJECT").when(value < accept, F.when(defers >= max_defers, "REJECT").otherwise("DEFER")).otherwise("ACCEPT")
    reason = (
        F.when(flag.isNotNull(), F.concat(F.lit("eval_contamination:"), flag))
        .when(duplicate, "duplicate_content")
        .when(value < reject, "low_quality")
        .when(value < accept, F.when(defers >= max_defers, "defer_expired").otherwise("below_accept"))
        .otherwise("score_ok")
    )
    return decision, reason


def first_copies(docs: DataFrame) -> DataFrame:
    """docs with is_first: the least key of each content digest. Pre-aggregated; the join's large side is ids and digests."""
    first = docs.groupBy("content_sha256").agg(F.min("doc_key").alias("first_key"), F.count("*").alias("copies"))
    return docs.join(first, "content_sha256").withColumn("is_first", F.col("doc_key") == F.col("first_key"))


def first_pass(facts: DataFrame, flags: DataFrame, accept: float, reject: float) -> DataFrame:
    """facts of train documents, flags (doc_key, flag). Each document as if it came once, undeferred, after the first of its copies."""
    marked = first_copies(facts.where("split = 'train'")).join(flags.select("doc_key", "flag"), "doc_key", "left")
    value = score(F.col("quality"), F.lit(0))
    decision, reason = decide(F.col("flag"), ~F.col("is_first"), F.col("value"), F.lit(0), F.lit(accept), F.lit(reject))
    return marked.withColumn("value", value).select("doc_key", "lane", "content_sha256", "quality", F.col("value").alias("score"), decision.alias("decision"), reason.alias("reason"))
