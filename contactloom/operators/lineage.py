"""Lineage, job and log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.config import DEFAULT, Config
from contactloom.operators.lookup import lookup_join
from contactloom.operators.transform import transform_rows, with_issues
from contactloom.session import stage

MAX_ERROR_TEXT = 2000


def json_of(columns: list[str]) -> Column:
    """Columns as JSON text; empty ones stay in it as null."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})


def lineage_id(file_id: str = "upload_file_id", row: str = "source_row") -> Column:
    """The same id in every run: file in the upper bits, row number in the lower 40."""
    return F.shiftleft(F.col(file_id).cast("bigint"), 40) + F.col(row)


def lineage_rows(
    raw: DataFrame, columns: list[str], keys: tuple[str, ...] = ("upload_file_id", "source_row"), config: Config = DEFAULT
) -> DataFrame:
    """Every source row with its raw and mapped values and whether it was valid: the raw values are
    carried through the cleaning, so it is one pass without a join."""
    carried = raw.withColumn("_raw", json_of(columns))
    checked = with_issues(transform_rows(carried, (*keys, "_raw"), config), (*keys, "_raw"), config)
    return checked.select(
        *keys, lineage_id(*keys).alias("id"), F.col("_raw").alias("raw_data"), json_of(columns).alias("mapped_data"),
        (F.col("error_count") == 0).alias("is_valid"),
    )


def link_sources(sources: DataFrame, assignments: DataFrame, base: DataFrame) -> DataFrame:
    """Source rows with the customer they contributed to, also those merged away;
    ``is_primary_source`` marks the row that the golden record kept.

    ``assignments`` is (rid, primary_id), ``base`` (primary_id, base_id).
    """
    sizes = assignments.groupBy("primary_id").agg(F.count("*").alias("n"))
    bases = stage(base.select("primary_id", "base_id").join(sizes, "primary_id"), "bases")
    owned = lookup_join(stage(assignments.select("rid", "primary_id"), "assigned"), bases, ["primary_id"], "n")
    links = owned.select(
        F.col("rid").alias("source_row"), F.col("primary_id").alias("customer_id"),
        (F.col("rid") == F.col("base_id")).alias("is_primary_source"),
    )
    return sources.join(links, "source_row", "left")


def link_issues(issues: DataFrame, lineage: DataFrame, keys=("upload_file_id", "source_row")) -> DataFrame:
    """Issues with the id of their source row; the last one, should a number repeat."""
    last = lineage.groupBy(*keys).agg(F.max("id").alias("source_row_id"))
    return issues.join(last, list(keys), "left")


def latest_jobs(events: DataFrame) -> DataFrame:
    """Job table from its events (job_id, ts, event_id, status, message): the last event
    counts, the duration runs from the first one."""
    latest = F.max_by(F.struct("status", "message"), F.struct("ts", "event_id"))
    jobs = events.groupBy("job_id").agg(latest.alias("last"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return jobs.select(
        "job_id", "last.status", F.substring("last.message", 1, MAX_ERROR_TEXT).alias("error_message"),
        F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("last_ts")).alias("duration_micros"),
    )


COUNTERS = ["rows_extracted", "rows_valid", "rows_invalid", "rows_merged"]


def update_jobs(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """The job table after its updates, which are ordered by ``seq``.

    Both have job_id, status, the ``COUNTERS``, error_message, started_at and completed_at; jobs
    also duration_seconds. An update sets status, message and all counters, those it does not name to 0; it
    sets the times only if it has them, and with a completion the duration since the start known by then.
    Updates of unknown jobs are ignored.
    """
    known = updates.join(jobs.select("job_id"), "job_id", "left_semi")
    moment = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    last = F.max_by(F.struct("status", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS], "error_message"), "seq")
    done = F.max(F.when(F.col("completed_at").isNotNull(), F.col("seq")))
    news = known.groupBy("job_id").agg(
        last.alias("last"), moment("started_at").alias("began"), moment("completed_at").alias("ended"), done.alias("done")
    )
    # The start that was known when the last completion came.
    before = known.join(news.select("job_id", "done"), "job_id").where("started_at IS NOT NULL AND seq <= done")
    starts = before.groupBy("job_id").agg(F.max_by("started_at", "seq").alias("start"))
    found = jobs.join(news, "job_id", "left").join(starts, "job_id", "left")
    start = F.coalesce("start", "started_at")
    seconds = F.timestamp_diff("MICROSECOND", start, F.col("ended")) / 1_000_000
    named = F.col("last").isNotNull()
    return found.select(
        "job_id",
        *[F.when(named, F.col("last")[c]).otherwise(F.col(c)).alias(c) for c in ("status", *COUNTERS, "error_message")],
        F.coalesce("began", "started_at").alias("started_at"),
        F.coalesce("ended", "completed_at").alias("completed_at"),
        F.coalesce(seconds, "duration_seconds").alias("duration_seconds"),
    )


def append_logs(entries: DataFrame, path: str) -> None:
    """Appends log lines (job_id, level, stage, message, detail, logged_at); detail is JSON text or null."""
    entries.select("job_id", "level", "stage", "message", "detail", "logged_at").write.mode("append").parquet(path)


def log_rollup(logs: DataFrame) -> DataFrame:
    return logs.groupBy("job_id", "stage", "level").agg(F.count("*").alias("entries"), F.max("logged_at").alias("last_at"))


def assign_batch(customers: DataFrame, produced: DataFrame, batch_id: int) -> DataFrame:
    """Puts the customers that a job produced into a batch; others keep theirs."""
    mine = produced.select("id").distinct().withColumn("_mine", F.lit(True))
    return customers.join(mine, "id", "left").withColumn(
        "batch_id", F.when(F.col("_mine"), F.lit(batch_id)).otherwise(F.col("batch_id"))
    ).drop("_mine")


def delete_rows(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Files that stay: a request (file_id, user_id, is_staff) deletes a file if it comes
    from staff or from its owner."""
    # One row per file that staff may delete, one per (file, user) otherwise: copies of a
    # request meet in a partial aggregate before the join.
    by_staff = requests.where("is_staff").select("file_id").distinct()
    by_owner = requests.where("NOT is_staff").select("file_id", F.col("user_id").alias("uploaded_by")).distinct()
    return files.join(by_staff, "file_id", "left_anti").join(by_owner, ["file_id", "uploaded_by"], "left_anti")
