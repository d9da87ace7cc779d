"""Session settings, the shared working folder and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
_staged: list[str] = []


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and measurements."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("contactloom")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach: the session's checkpoint folder.

    Only a local session may fall back to a temporary folder; on a cluster an
    unset folder is an error, as a machine-local one would lose data with its machine.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/") + "/contactloom"
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="contactloom-")
    return _local_folder


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the working folder."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", by: str | None = None, at: str | None = None) -> DataFrame:
    """Write once, read many: cuts the lineage and survives the loss of executors.

    A Parquet table rather than ``checkpoint()``: it is computed once, and its
    readers get column pruning and row-group statistics. ``by`` names a column of few
    values, whose rows are stored apart, so that a filter on it reads only its own. With ``at`` it is written
    to that path, in place of what lies there, and stays.
    """
    spark = df.sparkSession
    if at is not None:
        df.write.mode("overwrite").parquet(at)
        return spark.read.schema(df.schema).parquet(at)
    path = new_path(spark, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    _staged.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that ``stage`` returned, when the next one of its kind is written."""
    path = table._staged_at
    if path in _staged:
        _staged.remove(path)
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a scan that one task is given to work on.
TASK_ROWS = 200_000


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as cores, and no more than about ``TASK_ROWS`` rows in each, so that tasks
    do not grow with the table. Few, unsplittable or strongly compressed files would otherwise leave the cleaning of their
    rows to a few tasks; scans of enough partitions pass as they are. Only for plain scans, whose partitions are known
    without running anything and whose rows are counted from their footers."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-scan.count() // TASK_ROWS))
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)


def dealt(table: DataFrame, *by: str) -> DataFrame:
    """A stored table dealt anew for costly work on each of its rows: to as many tasks as there are cores, of about ``TASK_ROWS``
    rows at most. Spark cuts stored tables by their compressed bytes, by which a batch of some 100,000 rows is one
    task and millions are few. ``by`` names columns that tell its rows apart, so the parts are even."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(cores, -(-table.count() // TASK_ROWS)), *by)


def drop_staged(spark: SparkSession, first: int = 0) -> None:
    """Deletes the tables this process has staged, from number ``first`` on. Call it when the results
    that were computed from them are written; DataFrames that still read them stop working."""
    for path in _staged[first:]:
        _delete(spark, path)
    del _staged[first:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end; their results must be written by then."""
    first = len(_staged)
    try:
        yield
    finally:
        drop_staged(spark, first)
