"""Upload files of all formats as they arrive in a folder, each registered once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.config import DEFAULT, Config
from contactloom.integrate import RANGES, Integration, extract, prepare
from contactloom.operators.isolate import Transform
from contactloom.session import scratch, stage
from contactloom.streaming.buckets import numbers
from contactloom.streaming.ingest import run_available

LISTED = "path string, modificationTime timestamp, length bigint, content binary"
TABLES = ("raw", "files", "checked", "within", "errors")
MARK = f"_file string, file_id int, ranges {RANGES}"


def literal(path: str) -> str:
    """A path as Spark's readers take it, whose brackets, stars and so on mean themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def stream_uploads(
    spark: SparkSession, folder: str, path: str, checkpoint: str, batch_id: int = 1, config: Config = DEFAULT,
    max_files: int = 1000, transform: Transform | None = None,
) -> None:
    """Processes the files that have come into ``folder`` since the last run, in every format that ``integrate`` reads.

    Spark's file source lists them (names and sizes, no contents) and remembers them in ``checkpoint``; a micro-batch
    takes at most ``max_files``, so its list of names is bounded. It is written under its number: repeated, it
    replaces itself, with the same ids, as they go on from the mark of the batch before. The new mark is written last and
    makes the batch visible. A file is taken once; put a changed one under a new name. Hidden files are not listed.
    """
    files = (
        spark.readStream.format("binaryFile").schema(LISTED)
        .options(recursiveFileLookup=True, maxFilesPerTrigger=max_files).load(folder).select("path")
    )

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        names = [literal(row.path) for row in batch.collect()]
        if not names:
            return
        with scratch(session):
            known = _last_mark(session, path, number)
            extracted, errors = extract(session, names)
            at = lambda name: f"{path}/{name}/batch={number}"
            run = prepare(session, extracted, errors, batch_id, None, config, known, transform, at)
            last = stage(run.files.orderBy(F.desc("file_id")).limit(1), "mark")
            mine = run.files.join(known, "_file", "left_anti")
            mine.write.mode("overwrite").parquet(at("files"))
            run.errors.write.mode("overwrite").parquet(at("errors"))
            last.write.mode("overwrite").parquet(at("marks"))

    run_available(files.writeStream.foreachBatch(each), checkpoint)


def _last_mark(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The file with the highest numbers of all batches before: one row, or none."""
    found = [n for n in numbers(spark, f"{path}/marks") if n < before]
    return spark.read.schema(MARK).parquet(f"{path}/marks/batch={found[-1]}") if found else spark.createDataFrame([], MARK)


def uploaded(spark: SparkSession, path: str, batch_id: int = 1, config: Config = DEFAULT) -> Integration:
    """All complete micro-batches as one run: golden records, lineage, issues, quality and report follow from it."""
    found = numbers(spark, f"{path}/marks")
    if not found:
        raise ValueError(f"no upload has been processed into {path} yet")
    done = F.col("batch") <= found[-1]
    tables = {name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").where(done).drop("batch") for name in TABLES}
    return Integration(**tables, batch_id=batch_id, config=config)
