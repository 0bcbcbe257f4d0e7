"""Snapshots of a run: the control plane's state with the pins and ledger offsets that it belongs to."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PINS = ("plan_sha256", "catalog_sha256", "tokenizer_sha256", "order_sha256")
SCHEMA = "branch string, step int, attempt int, state string, state_sha256 string, pins map<string,string>, heads map<string,struct<records:long,head:string>>, next_step int, next_sha256 string, snapshot_sha256 string"


class CheckpointError(RuntimeError):
    """A snapshot is damaged, exists already, or belongs to other inputs."""


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _seal(branch: str, step: int, attempt: int, state: str, pins: dict, heads: dict, next_step: int | None, next_sha256: str | None) -> tuple:
    body = (branch, step, attempt, state, _digest(state), dict(pins), {k: tuple(v) for k, v in heads.items()}, next_step, next_sha256)
    return (*body, _digest(json.dumps(body, sort_keys=True)))


def save(spark: SparkSession, path: str, branch: str, step: int, attempt: int, state: str, pins: dict[str, str], heads: dict[str, tuple[int, str]], next_step: int | None = None, next_sha256: str | None = None) -> None:
    """Refuses a snapshot of a branch and step that is there already. next_*: what the run expects to consume next."""
    if missing := set(PINS) - set(pins):
        raise CheckpointError(f"pins missing: {sorted(missing)}")
    row = _seal(branch, step, attempt, state, pins, heads, next_step, next_sha256)
    held = spark.createDataFrame([row], SCHEMA).drop("branch", "step").coalesce(1)
    try:  # the folder is the snapshot's name, so of two writers one fails
        held.write.mode("errorifexists").parquet(f"{path}/branch={branch}/step={step}")
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        raise CheckpointError(f"{branch} has a snapshot of step {step}") from e


def listed(spark: SparkSession, path: str, branch: str) -> list:
    """Snapshots of a branch by step, without their states; none where nothing was saved."""
    try:
        found = spark.read.schema(SCHEMA).parquet(path)
    except Exception as e:  # the folder is made by the first save
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return found.where(F.col("branch") == branch).select("step", "attempt", "state_sha256").orderBy("step").collect()


def load(spark: SparkSession, path: str, branch: str, step: int | None = None):
    """The snapshot of a step, or the latest, with its digests verified."""
    rows = spark.read.schema(SCHEMA).parquet(path).where(F.col("branch") == branch)
    rows = rows.where(F.col("step") == step) if step is not None else rows.orderBy(F.col("step").desc())
    found = rows.first()
    if found is None:
        raise CheckpointError(f"{branch} has no snapshot" + (f" of step {step}" if step is not None else ""))
    again = _seal(found.branch, found.step, found.attempt, found.state, found.pins, {k: (v["records"], v["head"]) for k, v in found.heads.items()}, found.next_step, found.next_sha256)
    if again[4] != found.state_sha256 or again[-1] != found.snapshot_sha256:
        raise CheckpointError(f"the snapshot of step {found.step} is not what was saved")
    return found


def verify_pins(snapshot, pins: dict[str, str]) -> None:
    """The inputs of a resumed or forked run are those of the snapshot."""
    if off := [p for p in PINS if snapshot.pins.get(p) != pins.get(p)]:
        raise CheckpointError(f"other inputs than the snapshot's: {off}")


def head_mismatches(snapshots: DataFrame, ledger_rows: DataFrame) -> DataFrame:
    """branch, step, ledger of snapshots whose stored head is not the hash of the ledger's last committed record."""
    heads = snapshots.select("branch", "step", F.explode("heads").alias("ledger", "h")).select("branch", "step", "ledger", (F.col("h.records") - 1).alias("seq"), F.col("h.head").alias("head"))
    joined = heads.where("seq >= 0").join(ledger_rows.select("ledger", "seq", "hash"), ["ledger", "seq"], "left")
    return joined.where("hash is null or hash <> head").select("branch", "step", "ledger")
