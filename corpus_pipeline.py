"""From raw documents to token statistics in five stages; each is written as Parquet and read again as the next one's input.

language    op9: documents without a letter, or in no language with a score of LEAST_SCORE, go
exact       op5: of equal texts the row with the largest doc_id stays, one row where that id repeats
near        op6: of documents whose fingerprints link the one with the smallest doc_id stays
benchmark   op4: documents with a passage of a benchmark item go
tokens      op10: every document is encoded and decoded; this is the pipeline's result

All but the last stage return the columns of documents, further columns too, whatever their names; columns that the stages add
for a while get names that are free. A row without an id is judged like any other; of a group it stays only if no row of the
group has an id. Rows that repeat an id are told apart by their texts. Where no row has a language, none is learned and the
language stage drops documents without a letter only. Empty tables pass through.

A stage's decisions are rows of 16 bytes (a digest of id and whole text) that meet the documents in a join by shuffle, the same
plan at every size; nothing that grows with the documents is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, exact_dedup, langid, simhash
from corpusloom.llm.common import fresh, materialize, quoted, row_key, table, text_sha256

#: Calibrated score under which a document is in none of the learned languages.
LEAST_SCORE = 0.5

ORACLE_SQL = None  # language identification and fingerprints have no SQL form; tests hold run() against brute force


def _all(docs: DataFrame) -> list:
    return [F.col(quoted(c)) for c in docs.columns]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but those whose row_key is in gone (one column, row)."""
    key = fresh(docs.columns, "_key")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), text_sha256("text")))
    return keyed.join(gone.select(F.col("row").alias(key)).hint("shuffle_hash"), key, "left_anti").select(_all(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(langid.training_rows(docs))
    pred, score = fresh(docs.columns, "_lang_pred"), fresh(docs.columns, "_score")
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.annotate(docs, model, "text", (pred, score))
    return found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(_all(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(docs).where(~F.col("kept"))
    dropped = materialize(found.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("row")).distinct(), "pipeline-exact")
    key, number = fresh(docs.columns, "_key"), fresh(docs.columns, "_number")
    # rows of one id and text: the first by the other columns stays; equal keys meet once, for this and for the join
    order = [F.col(quoted(c)).asc_nulls_last() for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "variant"))]
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), text_sha256("text")))
    one = keyed.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(*order or [F.lit(0)]))).where(F.col(number) == 1)
    return one.join(dropped.select(F.col("row").alias(key)).hint("merge"), key, "left_anti").select(_all(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialize(simhash.near_duplicates(docs).select("doc_id", "row", "component"), "pipeline-near")
    me = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))
    stays = materialize(found.groupBy("component").agg(F.min(me).alias("stays"), F.count("*").alias("n")).where("n > 1").select("component", "stays.c"), "pipeline-stays")
    dropped = found.join(stays, "component").where("row <> c").select("row").distinct()
    return _without(docs, materialize(dropped, "pipeline-dropped"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, materialize(found.where("contaminated").select("row").distinct(), "pipeline-benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, stable=True)  # docs is the last stage's table


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
