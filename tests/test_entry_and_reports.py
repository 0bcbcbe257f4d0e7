"""The entry point with and without the optional subpackage; snapshots and reports."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import shared
from corpusloom.operators import checkpoint, reports, runlog

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_optional_folders(tmp_path):
    target = tmp_path / "copy"
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=target, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def test_oracles_have_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


PIN = {p: p for p in checkpoint.PINS}


def test_snapshots(spark, tmp_path):
    path = f"{tmp_path}/snapshots"
    assert checkpoint.listed(spark, path, "main") == []
    checkpoint.save(spark, path, "main", 20, 1, '{"a":1}', PIN, {"decisions": (3, "h3")}, 21, "x")
    checkpoint.save(spark, path, "main", 40, 1, '{"a":2}', PIN, {"decisions": (5, "h5")})
    assert checkpoint.load(spark, path, "main").state == '{"a":2}' and checkpoint.load(spark, path, "main", 20).next_step == 21
    with pytest.raises(checkpoint.CheckpointError):
        checkpoint.save(spark, path, "main", 40, 2, "{}", PIN, {})
    with pytest.raises(checkpoint.CheckpointError):
        checkpoint.save(spark, path, "main", 60, 2, "{}", {}, {})
    with pytest.raises(checkpoint.CheckpointError):
        checkpoint.load(spark, path, "side")
    snapshot = checkpoint.load(spark, path, "main", 20)
    checkpoint.verify_pins(snapshot, PIN)
    with pytest.raises(checkpoint.CheckpointError, match="plan_sha256"):
        checkpoint.verify_pins(snapshot, PIN | {"plan_sha256": "other"})
    ledger = spark.createDataFrame([("decisions", i, f"h{i + 1}") for i in range(4)], "ledger string, seq long, hash string")
    assert [(r.step, r.ledger) for r in checkpoint.head_mismatches(spark.read.parquet(path), ledger).collect()] == [(40, "decisions")]
    forged = spark.read.parquet(path).withColumn("state", F.lit("{}"))
    forged.write.parquet(f"{tmp_path}/forged")
    with pytest.raises(checkpoint.CheckpointError, match="not what was saved"):
        checkpoint.load(spark, f"{tmp_path}/forged", "main")


def test_reports(spark):
    steps = spark.createDataFrame([(1.0, 2.0, 7.0, 100), (1.0, 1.0, 2.0, 50)], "data_ms double, ledger_ms double, compute_ms double, loss_tokens int")
    r = reports.throughput(steps, 128).first()
    assert (r.steps, r.median_step_ms, r.data_share) == (2, 10.0, 2 / 14) and r.loss_tokens_per_second == 150 / 0.014
    segments = spark.createDataFrame([("web", 3.0, 2), ("web", 1.0, 2), ("code", 0.0, 0)], "lane string, loss_sum double, loss_tokens int")
    assert {x.lane: x.loss for x in reports.lane_losses(segments, ["lane"]).collect()} == {"web": 1.0, "code": 0.0}
    losses = spark.createDataFrame([(i, float(i)) for i in range(30)], "step int, loss double")
    assert tuple(reports.first_and_last_mean(losses, "step", "loss").first()) == (4.5, 24.5)
    a = spark.createDataFrame([(1, "x"), (2, "y")], "step int, h string")
    b = spark.createDataFrame([(1, "x"), (3, "y")], "step int, h string")
    assert {x.step: x.identical for x in reports.compare_runs(a, b, ["step"], ["h"]).collect()} == {1: True, 2: False, 3: False}
    data, text = reports.evidence([("one", True, 0), ("two", False, 3)])
    assert '"passed": 1' in data and "| two | FAIL | 3 |" in text


def test_run_log(spark, tmp_path):
    log = runlog.RunLog("main")
    log.add("checkpoint_saved", "step 20", step=20)
    log.save(spark, f"{tmp_path}/log")
    log.add("replayed", "equal", "PASS")
    log.save(spark, f"{tmp_path}/log")
    log.save(spark, f"{tmp_path}/log")
    assert "PASS [main] replayed: equal" in log.text() and runlog.read(spark, f"{tmp_path}/log").count() == 2
    assert [r.event for r in runlog.missing_phases(runlog.read(spark, f"{tmp_path}/log"), ["replayed", "forked"]).collect()] == ["forked"]
    with pytest.raises(ValueError):
        log.add("x", level="LOUD")


def test_the_shared_folder_is_cleaned(spark, monkeypatch):
    monkeypatch.setattr(shared, "_MADE", {})
    path = shared.new_dir(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and shared.clean(spark) == 1 and shared.clean(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
