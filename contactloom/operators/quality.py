"""Quality reports and dashboard metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.config import GOLDEN_FIELDS
from contactloom.functions import rules


def quality_report(checked: DataFrame, duplicates: DataFrame, by: str = "upload_file_id") -> DataFrame:
    """One row per job: row counts, empty golden fields of valid rows, scores in percent.

    ``duplicates`` is (by, duplicate_rows). One partial aggregate over the rows; the join
    is between two tables of one row per job.
    """
    ok = F.col("error_count") == 0
    missing = rules.missing_golden_fields(checked.columns)
    counts = checked.groupBy(by).agg(
        F.count("*").alias("total_rows"),
        F.count_if(ok).alias("valid_rows"),
        F.count_if(~ok).alias("invalid_rows"),
        F.coalesce(F.sum(F.when(ok, missing)), F.lit(0)).alias("missing_fields_count"),
        F.sum("error_count").alias("validation_error_count"),
    )
    slots = F.greatest(F.col("valid_rows") * len(GOLDEN_FIELDS), F.lit(1))
    pct = F.col("missing_fields_count") / slots * 100
    return (
        counts.join(duplicates, by, "left")
        .select(
            by, "total_rows", "valid_rows", "invalid_rows",
            F.coalesce("duplicate_rows", F.lit(0)).alias("duplicate_rows"),
            "missing_fields_count", F.round(pct, 2).alias("missing_pct"), "validation_error_count",
            F.round(F.greatest(F.lit(0.0), 100 - pct), 2).alias("completeness_score"),
        )
        .withColumn(
            "uniqueness_score",
            F.round((F.col("total_rows") - F.col("duplicate_rows")) / F.col("total_rows") * 100, 2),
        )
    )


def duplicates_by_key(valid: DataFrame, key: str = "email", by: str = "upload_file_id") -> DataFrame:
    """(by, duplicate_rows): rows beyond the first of each key.

    Counting per (group, key) first and summing after keeps the distinct count in partial
    aggregates, for any number of rows per group or key.
    """
    per_key = valid.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.count("*").alias("n"))
    return per_key.groupBy(by).agg(F.sum(F.col("n") - 1).alias("duplicate_rows"))


def status_counts(jobs: DataFrame, status: str, names: list[str], by: list[str] | None = None) -> DataFrame:
    """A column per status, zero where there is none, and the total."""
    grouped = jobs.groupBy(*(by or []))
    return grouped.agg(
        *[F.count_if(F.col(status) == n).alias(n) for n in names],
        F.count_if(F.col(status).isin(names)).alias("total"),
    )


def average_where(value: Column, condition: Column, digits: int) -> Column:
    return F.round(F.avg(F.when(condition, value)), digits)
