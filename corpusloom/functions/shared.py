"""The folder that driver and executors share; names and partitions of frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # by application, where spark.checkpoint.dir is unset


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests, local mode) a temporary one for the application."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="corpusloom-")
    return "file://" + _OWN[context.applicationId]


_MADE: dict[str, list[str]] = {}  # by application, the folders handed out


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Delete what this application has written to the shared folder so far, once its results are stored elsewhere; returns how many folders."""
    conf, made = spark.sparkContext._jsc.hadoopConfiguration(), _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(made)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if its scan has fewer tasks than there are cores: work on texts is heavier than moving what little that is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def quoted(name: str) -> str:
    """A column's name as it stands, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores where a column has it already; Spark's names differ by more than case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
