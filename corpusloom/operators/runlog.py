"""A run's log: one row per event, as JSON lines for machines and as text for people."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession

EVENT = "ts double, level string, component string, event string, msg string, fields string"
LEVELS = ("INFO", "PASS", "WARN", "FAIL")


class RunLog:
    """Events of the driver, in order; save() appends those that are new to a folder that any process may read."""

    def __init__(self, component: str):
        self.component, self.rows, self._saved = component, [], 0

    def add(self, event: str, msg: str = "", level: str = "INFO", **fields) -> None:
        if level not in LEVELS:
            raise ValueError(f"no level {level}")
        self.rows.append((time.time(), level, self.component, event, msg, json.dumps(fields, sort_keys=True)))

    def text(self) -> str:
        clock = lambda t: time.strftime("%H:%M:%S", time.gmtime(t))
        return "".join(f"{clock(ts)} {level:4} [{component}] {event}: {msg}\n" for ts, level, component, event, msg, _ in self.rows)

    def save(self, spark: SparkSession, path: str) -> None:
        new, self._saved = self.rows[self._saved :], len(self.rows)
        if new:
            spark.createDataFrame(new, EVENT).coalesce(1).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def missing_phases(log: DataFrame, phases: list[str]) -> DataFrame:
    """event of phases that the log does not have, and of events that failed."""
    want = log.sparkSession.createDataFrame([(p,) for p in phases], "event string")
    return want.join(log.select("event"), "event", "left_anti").unionAll(log.where("level = 'FAIL'").select("event"))
