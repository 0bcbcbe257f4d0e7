"""Documents by lane and split, read from raw JSON lines or from the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.shared import spread
from corpusloom.sources.shards import file_hashes

RAW_SCHEMA = "doc_id string, lane string, split string, origin string, content_sha256 string, text string, prompt string, response string"
SPLITS = ("train", "val", "eval")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table of texts, in as many tasks as there are cores at least."""
    return spread(table(spark, sf_dir, name).select(*columns))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents from JSON lines; blank lines are skipped, a line that is no record is an error, a path that is not there is no documents."""
    try:
        return spark.read.schema(RAW_SCHEMA).option("mode", "FAILFAST").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RAW_SCHEMA)


def write_raw(docs: DataFrame, path: str) -> DataFrame:
    """One folder for each lane and split, in order of ids; refuses to overwrite. Returns the files' hashes."""
    docs.repartition("lane", "split").sortWithinPartitions("lane", "split", "doc_id").write.partitionBy("lane", "split").json(path)
    return file_hashes(docs.sparkSession, path, "*.json")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def pair_turns(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    following = conversations.select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("response"))
    return following.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "prompt", "response")


def _split(number):
    return F.when(number % 20 == 0, "eval").when(number % 20 == 1, "val").otherwise("train")


def documents_by_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_key, lane, split, content, prompt, response: prose, conversation pairs and pages (taken whole, as code is) in one form."""
    web = texts(spark, sf_dir, "documents", "doc_id", "text").select(F.lit("web").alias("lane"), F.col("doc_id").alias("number"), F.col("text").alias("content"), F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("string").alias("response"))
    pairs = pair_turns(table(spark, sf_dir, "conversations"))
    instruct = pairs.select(F.lit("instruct").alias("lane"), (F.col("conv_id") * 1000 + F.col("turn")).alias("number"), T.canonical_json(prompt=F.col("prompt"), response=F.col("response")).alias("content"), "prompt", "response")
    code = texts(spark, sf_dir, "pages", "page_id", "html").select(F.lit("code").alias("lane"), F.col("page_id").alias("number"), F.col("html").alias("content"), F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("string").alias("response"))
    every = web.unionByName(instruct).unionByName(code)
    return every.select(T.document_key(F.col("lane"), F.col("number")).alias("doc_key"), "lane", _split(F.col("number")).alias("split"), F.coalesce("content", F.lit("")).alias("content"), "prompt", "response")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What planning and gating need of each document: key, lane, split, digest, token count, quality. No text."""
    docs = documents_by_lane(spark, sf_dir)
    features = T.quality_features(F.col("content"))
    counted = docs.select("doc_key", "lane", "split", T.sha256(F.col("content")).alias("content_sha256"), (F.size(T.pretokens(F.col("content"))) + 1).alias("n_tokens"), *(c.alias(k) for k, c in features.items()))
    return counted.withColumn("quality", T.quality_score(*(F.col(k) for k in features)))
