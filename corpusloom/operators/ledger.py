"""Hash-chained ledgers: append, commit, verify, recover, fork.

A ledger is a table (ledger, seq, prev, data, hash) or the same as JSON lines; hash = sha256 of the canonical JSON of seq, prev and
data. Appending folds over each ledger's rows in order, in one streaming pass that holds one digest a ledger; verifying is
parallel: each hash from its own row, each link by the row before. The first row's prev must be GENESIS and the last row must be
the committed head, so cut ends are noticed too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.functions.shipping import ship

GENESIS = "0" * 64
RECORD = "seq long, prev string, data string, hash string"
LINE = r'^\{"data":(.*),"hash":"([0-9a-f]{64})","prev":"([0-9a-f]{64})","seq":(\d+)\}$'
HEADS = "ledger string, records long, head string"


class LedgerError(RuntimeError):
    """A chain is broken or does not end at its committed head."""


def record_hash(seq: Column, prev: Column, data: Column) -> Column:
    return F.sha2(F.concat(F.lit('{"data":'), data, F.lit(',"prev":"'), prev, F.lit('","seq":'), seq.cast("string"), F.lit("}")), 256)


def _fold(rows: DataFrame) -> DataFrame:
    """rows: ledger, seq_key, data, records, head (of what is before them). ledger, seq, prev, data, hash."""
    ship(rows.sparkSession)
    ordered = rows.select("ledger", "seq_key", "data", "records", "head").repartition("ledger").sortWithinPartitions("ledger", "seq_key", "data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seq, head = None, 0, ""
        for f in frames:
            out = []
            for name, data, records, first in zip(f["ledger"], f["data"], f["records"], f["head"]):
                if name != now:
                    now, seq, head = name, int(records), first
                prev = head
                head = hashlib.sha256(f'{{"data":{data},"prev":"{prev}","seq":{seq}}}'.encode()).hexdigest()
                out.append((name, seq, prev, data, head))
                seq += 1
            yield pd.DataFrame(out, columns=["ledger", "seq", "prev", "data", "hash"])

    text = [StructField(n, StringType()) for n in ("prev", "data", "hash")]
    schema = StructType([StructField("ledger", rows.schema["ledger"].dataType), StructField("seq", LongType()), *text])
    return ordered.mapInPandas(run, schema)


def chain(rows: DataFrame, ledger: str = "ledger", order: str = "seq_key", data: str = "data", start: int = 0, head: str = GENESIS) -> DataFrame:
    """ledger, seq, prev, data, hash: each ledger's rows in order, chained on from head."""
    return _fold(rows.select(F.col(ledger).alias("ledger"), F.col(order).alias("seq_key"), F.col(data).alias("data"), F.lit(start).cast("long").alias("records"), F.lit(head).alias("head")))


def heads_of(chained: DataFrame) -> DataFrame:
    """ledger, records, head of chained rows."""
    return chained.groupBy("ledger").agg((F.max("seq") + 1).alias("records"), F.max_by("hash", "seq").alias("head"))


def chain_heads(rows: DataFrame, ledger: str, order: str, data: Column) -> DataFrame:
    """ledger, records, head: what commit() would store after appending all rows."""
    found = heads_of(chain(rows.select(F.col(ledger).alias("ledger"), F.col(order).alias("seq_key"), data.alias("data"))))
    return found.select(F.col("ledger").alias(ledger), "records", "head")


def violations(ledger_rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """ledger, seq, violation: rows whose hash or link is wrong, ledgers that begin or end elsewhere than they should."""
    order = Window.partitionBy("ledger").orderBy("seq")
    linked = ledger_rows.withColumn("_prev", F.lag("hash", 1, GENESIS).over(order)).withColumn("_seq", F.lag(F.col("seq") + 1, 1, 0).over(order))
    rules = {"hash": record_hash(F.col("seq"), F.col("prev"), F.col("data")) != F.col("hash"), "link": F.col("prev") != F.col("_prev"), "sequence": F.col("seq") != F.col("_seq")}
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    bad = linked.select("ledger", "seq", F.explode(found).alias("violation"))
    if heads is None:
        return bad
    last = ledger_rows.groupBy("ledger").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
    ends = heads.select("ledger", "records", "head").join(last, "ledger", "left")
    off = ends.where("coalesce(seq, -1) <> records - 1 or coalesce(hash, repeat('0', 64)) <> head").select("ledger", F.col("seq"), F.lit("head").alias("violation"))
    return bad.unionByName(off)


def append(rows: DataFrame, path: str, heads: DataFrame | None = None, attempt: int = 1) -> DataFrame:
    """Chain rows (ledger, seq_key, data) after each ledger's committed head, store them under the attempt, and return the new heads.

    heads: ledger, records, head of what is committed; None for new ledgers. Rows beyond a commit stay readable as orphans. An attempt
    may append several times, each time from the heads that the time before gave.
    """
    spark = rows.sparkSession
    known = heads if heads is not None else spark.createDataFrame([], HEADS)
    based = rows.join(known, "ledger", "left").select("ledger", "seq_key", "data", F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("head", F.lit(GENESIS)).alias("head"))
    _fold(based).withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(path)
    new = heads_of(spark.read.parquet(path).where(F.col("attempt") == attempt))
    return new.unionByName(known.join(new, "ledger", "left_anti"))


def commit(heads: DataFrame, path: str, number: int) -> None:
    """Store heads as commit `number`; a number is used once."""
    heads.select("ledger", "records", "head").coalesce(1).write.mode("errorifexists").parquet(f"{path}/commit={number:09d}")


def committed(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The last commit's number (0: none) and its heads."""
    try:
        found = spark.read.schema(HEADS + ", commit long").parquet(path)
    except Exception as e:  # the folder is made by the first commit
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0, spark.createDataFrame([], HEADS)
    last = found.agg(F.max("commit")).first()[0] or 0
    return last, found.where(F.col("commit") == last).drop("commit")


def _held_to(ledger_rows: DataFrame, heads: DataFrame, what: str) -> None:
    """Each ledger's prefix must end in its head."""
    ends = heads.where("records > 0").select("ledger", (F.col("records") - 1).alias("seq"), "head")
    off = ends.join(ledger_rows.select("ledger", "seq", "hash"), ["ledger", "seq"], "left").where("hash is null or hash <> head").select("ledger").take(3)
    if off:
        raise LedgerError(f"{what}: not the committed head in {sorted(r['ledger'] for r in off)}")


def recover(ledger_rows: DataFrame, heads: DataFrame, attempt: int) -> tuple[DataFrame, DataFrame]:
    """(live, orphans): rows up to the committed records, and the rows that the dead attempt wrote beyond them. The live rows must end in the heads."""
    marked = ledger_rows.join(heads.select("ledger", "records"), "ledger", "left")
    beyond = (F.col("attempt") == attempt) & (F.col("seq") >= F.coalesce("records", F.lit(0)))
    columns = ledger_rows.columns
    live = marked.where(~beyond).select(columns)
    _held_to(live, heads, "recovery")
    return live, marked.where(beyond).select(columns)


def fork(ledger_rows: DataFrame, heads: DataFrame, branch: str) -> DataFrame:
    """The prefix that a branch shares with its parent: rows before the checkpoint's offsets, which must end in its heads, under the branch's name."""
    kept = ledger_rows.join(heads.select("ledger", "records"), "ledger").where("seq < records")
    _held_to(kept, heads, "fork")
    return kept.select(*ledger_rows.columns).withColumn("branch", F.lit(branch))


def lineage(heads: DataFrame, branch: str, parent: str, fork_step: int, diverge_at: int, plan_sha256: str, parent_plan_sha256: str) -> DataFrame:
    """One row: where a branch comes from, and the prefixes of the parent's ledgers that it shares."""
    prefixes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("ledger", F.struct("records", "head")))))
    row = heads.agg(prefixes.alias("prefixes"))
    names = {"branch": branch, "parent_branch": parent, "fork_step": fork_step, "diverge_at_step": diverge_at, "fork_plan_sha256": plan_sha256, "parent_plan_sha256": parent_plan_sha256}
    return row.select(*(F.lit(v).alias(k) for k, v in names.items()), "prefixes")


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last one by order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


def orphans_against_live(orphans: DataFrame, live: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, identical: rows of a dead attempt that a later one wrote again, and whether as they were."""
    theirs = live.select(key, F.struct(*columns).alias("_live"))
    return orphans.select(key, F.struct(*columns).alias("_dead")).join(theirs, key).select(key, F.col("_dead").eqNullSafe(F.col("_live")).alias("identical"))


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, torn): complete JSON lines of ledger files, and lines that are no record, such as a torn last one."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.input_file_name().alias("ledger"))
    fields = [F.regexp_extract("value", LINE, i).alias(n) for i, n in enumerate(("data", "hash", "prev", "seq"), 1)]
    parsed = lines.select("ledger", "value", *fields)
    whole = F.col("hash") != ""
    return parsed.where(whole).select("ledger", F.col("seq").cast("long").alias("seq"), "prev", "data", "hash"), parsed.where(~whole).select("ledger", "value")


def write_lines(ledger_rows: DataFrame, path: str) -> None:
    line = F.concat(F.lit('{"data":'), F.col("data"), F.lit(',"hash":"'), F.col("hash"), F.lit('","prev":"'), F.col("prev"), F.lit('","seq":'), F.col("seq").cast("string"), F.lit("}"))
    ledger_rows.repartition("ledger").sortWithinPartitions("ledger", "seq").select(line.alias("value")).write.text(path)


def read_orphans(spark: SparkSession, path: str) -> DataFrame:
    """seq, data of the complete records of a dead attempt's files; its chain is not checked, what is no record is left out."""
    return read_lines(spark, path)[0].select("ledger", "seq", "data")


def write_torn(spark: SparkSession, path: str, line: str) -> None:
    """Half a record without its end, as a process leaves it that dies while it writes; to try recovery with."""
    spark.createDataFrame([(line[: len(line) // 2],)], "value string").coalesce(1).write.mode("append").text(path)
