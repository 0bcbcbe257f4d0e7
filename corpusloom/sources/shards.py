"""Write-once token shards with manifests and a catalog that pins them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARD_DOCS = 128


class ShardIntegrityError(RuntimeError):
    """Stored tokens are not what the manifest or catalog says."""


def assign_shards(docs: DataFrame, per_shard: int = SHARD_DOCS) -> DataFrame:
    """docs (lane, split, doc_key) with shard_id and doc_idx: consecutive documents by a digest of their key, per_shard to a shard.

    Numbers are counted inside 4,096 parts of the digest's order and then over the parts, so no window holds a whole lane. Numbers of
    more than three digits are written out in full.
    """
    digest = F.sha2("doc_key", 256)
    parted = docs.withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, 3))
    inside = Window.partitionBy("lane", "split", "_part").orderBy("_digest", "doc_key")
    before = Window.partitionBy("lane", "split").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = docs.groupBy("lane", "split", F.substring(digest, 1, 3).alias("_part")).agg(F.count("*").alias("_size"))
    totals = totals.select("lane", "split", "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = parted.withColumn("_local", F.row_number().over(inside) - 1)
    # 16**3 rows a lane and split at most
    numbered = local.join(F.broadcast(totals), ["lane", "split", "_part"]).withColumn("_n", F.col("_local") + F.col("_before"))
    shard = F.concat_ws("-", "lane", "split", F.format_string("%03d", F.floor(F.col("_n") / per_shard)))
    return numbered.withColumn("shard_id", shard).withColumn("doc_idx", F.pmod("_n", F.lit(per_shard))).select(*docs.columns, "shard_id", "doc_idx")


def token_digest(tokens):
    return F.sha2(F.array_join(F.transform(tokens, lambda x: x.cast("string")), ","), 256)


def write_shards(docs: DataFrame, path: str) -> None:
    """docs: lane, split, shard_id, doc_idx, doc_key, content_sha256, tokens, loss_start, quality. Refuses to overwrite."""
    stored = docs.withColumn("token_sha256", token_digest(F.col("tokens"))).withColumn("length", F.size("tokens"))
    stored.write.mode("errorifexists").partitionBy("lane", "split").parquet(path)


def manifest(spark: SparkSession, path: str, tokenizer_sha256: str) -> DataFrame:
    """One row per shard: its documents in order with their offsets, and the digest of them all."""
    stored = spark.read.parquet(path)
    before = Window.partitionBy("shard_id").orderBy("doc_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    doc = F.struct("doc_idx", "doc_key", "content_sha256", "token_sha256", "offset", "length", "loss_start", "quality")
    shards = placed.groupBy("shard_id", "lane", "split").agg(F.array_sort(F.collect_list(doc)).alias("docs"), F.count("*").alias("num_docs"), F.sum("length").alias("num_tokens"))
    lines = F.array_join(F.transform("docs", lambda d: F.concat_ws(":", d["doc_idx"].cast("string"), d["doc_key"], d["content_sha256"], d["token_sha256"], d["length"].cast("string"))), "\n")
    return shards.withColumn("tokenizer_sha256", F.lit(tokenizer_sha256)).withColumn("manifest_sha256", F.sha2(F.concat_ws("\n", "shard_id", "tokenizer_sha256", lines), 256))


def catalog_digest(manifests: DataFrame) -> DataFrame:
    """catalog_sha256, num_shards: digests of 256 parts of the pins, then the digest of those, so no row holds them all."""
    pin = F.struct("shard_id", "manifest_sha256")
    part = F.substring(F.sha2("shard_id", 256), 1, 2).alias("part")
    parts = manifests.groupBy(part).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(pin))), 256).alias("sha"), F.count("*").alias("n"))
    every = F.array_sort(F.collect_list(F.struct("part", "sha")))
    return parts.agg(F.sha2(F.to_json(every), 256).alias("catalog_sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("num_shards"))


PINNED = ["shard_id", "lane", "split", "num_docs", "num_tokens", "tokenizer_sha256", "manifest_sha256"]


def write_catalog(manifests: DataFrame, path: str) -> str:
    """Store what pins each shard and the digest of it all, once; returns the digest."""
    pins = manifests.select(*PINNED)
    found = catalog_digest(pins)
    pins.write.mode("errorifexists").parquet(f"{path}/shards")
    found.coalesce(1).write.mode("errorifexists").json(f"{path}/digest")
    return found.first()["catalog_sha256"]


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The stored pins, if they are those of the stored digest."""
    pins = spark.read.parquet(f"{path}/shards")
    said, found = spark.read.json(f"{path}/digest").first(), catalog_digest(pins).first()
    if said is None or said["catalog_sha256"] != found["catalog_sha256"]:
        raise ShardIntegrityError("the catalog is not what its digest says")
    return pins


def pin_mismatches(catalog: DataFrame, manifests: DataFrame) -> DataFrame:
    """shard_id, what of shards that the catalog and the manifests do not describe alike."""
    pinned = catalog.select("shard_id", F.struct(*PINNED[1:]).alias("_pinned"))
    both = pinned.join(manifests.select("shard_id", F.struct(*PINNED[1:]).alias("_found")), "shard_id", "full")
    what = F.when(F.col("_pinned").isNull(), "not_in_catalog").when(F.col("_found").isNull(), "missing").when(F.col("_pinned") != F.col("_found"), "differs")
    return both.select("shard_id", what.alias("what")).where("what is not null")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 of the data files under path; each is read whole by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def retokenized_differently(stored: DataFrame, encoded: DataFrame) -> DataFrame:
    """doc_key of stored documents whose tokens are not those that the raw text gives now. encoded: doc_key, tokens."""
    again = encoded.select("doc_key", token_digest(F.col("tokens")).alias("_again"))
    return stored.select("doc_key", "token_sha256").join(again, "doc_key", "left").where("_again is null or _again <> token_sha256").select("doc_key")


def shards_where(manifests: DataFrame, **equal: str) -> DataFrame:
    for name, value in equal.items():
        manifests = manifests.where(F.col(name) == value)
    return manifests


def damaged(spark: SparkSession, path: str, manifests: DataFrame) -> DataFrame:
    """shard_id, doc_idx, what of documents whose stored tokens, digests or presence differ from the manifest."""
    stored = spark.read.parquet(path).select("shard_id", "doc_idx", F.col("token_sha256").alias("_said"), token_digest(F.col("tokens")).alias("_is"), F.size("tokens").alias("_length"))
    pinned = manifests.select("shard_id", F.explode("docs").alias("d")).select("shard_id", "d.doc_idx", "d.token_sha256", "d.length")
    both = pinned.join(stored, ["shard_id", "doc_idx"], "full")
    what = F.when(F.col("token_sha256").isNull(), "not_in_manifest").when(F.col("_is").isNull(), "missing").when(F.col("_is") != F.col("token_sha256"), "tokens").when(F.col("_length") != F.col("length"), "length")
    return both.select("shard_id", "doc_idx", what.alias("what")).where("what is not null")


def verify(spark: SparkSession, path: str, manifests: DataFrame) -> None:
    if found := damaged(spark, path, manifests).take(5):
        raise ShardIntegrityError(f"damaged documents: {found}")
