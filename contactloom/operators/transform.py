"""Row cleaning: blank to null, per-field normalisers, limits, synthesised full name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.config import DEFAULT, Config
from contactloom.functions import rules, text

NAME_FIELDS = ("first_name", "last_name", "full_name")


def data_columns(df: DataFrame, keep: tuple[str, ...]) -> list[str]:
    """Columns that carry contact data: neither named bookkeeping nor ``_`` columns."""
    return [c for c in df.columns if c not in keep and not c.startswith("_")]


def _base(field: str, config: Config):
    value = F.col(field).cast("string")
    if field == "email":
        return text.email(value)
    if field == "phone":
        return text.phone(value)
    if field in NAME_FIELDS:
        return text.name_base(value)
    if field == "country":
        return text.country(value, config)
    return text.clean(value)


def computed_once(df: DataFrame, label: str) -> DataFrame:
    """Counts the rows that pass (an observed metric of the query).

    It also keeps later filters from being rewritten in terms of the raw columns, which
    would evaluate every cleaning expression again for each condition on its result.
    """
    return df.observe(f"{label}-{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"))


def transform_rows(
    df: DataFrame,
    keep: tuple[str, ...] = ("source_row", "upload_file_id"),
    config: Config = DEFAULT,
    warnings: bool = False,
) -> DataFrame:
    """Clean every data column: narrow projections, no shuffle. Filter before it."""
    fields = data_columns(df, keep)
    others = [c for c in df.columns if c not in fields]
    based = df.select(*others, *[_base(f, config).alias(f) for f in fields])
    cleaned = based.select(
        *others, *[text.name_case(F.col(f)).alias(f) if f in NAME_FIELDS else F.col(f) for f in fields]
    )
    limited = [
        F.substring(F.col(f), 1, config.max_lengths[f]).alias(f) if f in config.max_lengths else F.col(f)
        for f in fields
    ]
    extra = []
    if warnings:
        extra = [
            F.array_compact(F.array(*[
                F.when(
                    F.length(f) > n,
                    F.struct(F.lit(f).alias("field_name"), F.lit(f"Truncated to {n} chars").alias("message")),
                )
                for f, n in config.max_lengths.items() if f in fields
            ])).alias("_warnings")
        ]
    out = cleaned.select(*others, *limited, *extra)
    if {"first_name", "last_name"} <= set(fields):
        parts = F.concat_ws(" ", "first_name", "last_name")
        both = F.col("first_name").isNotNull() & F.col("last_name").isNotNull()
        full = F.when(both, parts)
        out = out.withColumn("full_name", F.coalesce("full_name", full) if "full_name" in fields else full)
    return computed_once(out, "cleaned")


def with_issues(
    df: DataFrame,
    keep: tuple[str, ...] = ("source_row", "upload_file_id"),
    config: Config = DEFAULT,
) -> DataFrame:
    """Adds ``issues``, ``error_count`` and ``warning_count``; a query that needs the counts
    only never builds the array. A ``_transform_failed`` column, if any, is honoured."""
    failed = F.coalesce("_transform_failed", F.lit(False)) if "_transform_failed" in df.columns else None
    found = rules.rule_set(data_columns(df, keep), config)
    return computed_once(df.withColumns({
        "issues": rules.issues(found, failed),
        "error_count": rules.count_of(found, "error", failed),
        "warning_count": rules.count_of(found, "warning", failed),
    }), "checked")


CHECK_COLUMNS = ("issues", "error_count", "warning_count")


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where("error_count = 0").drop(*CHECK_COLUMNS)


def invalid_rows(df: DataFrame) -> DataFrame:
    codes = rules.error_codes(F.col("issues"))
    return df.where("error_count > 0").withColumn("_validation_errors", codes).drop(*CHECK_COLUMNS)


def issue_rows(df: DataFrame, keys: tuple[str, ...] = ("source_row", "upload_file_id")) -> DataFrame:
    """One row per issue."""
    return df.select(*keys, F.explode("issues").alias("i")).select(*keys, "i.*")


def issue_counts(df: DataFrame, by: str = "upload_file_id") -> DataFrame:
    """Errors and warnings per group; partial aggregation, groups of any size."""
    return df.groupBy(by).agg(F.sum("error_count").alias("errors"), F.sum("warning_count").alias("warnings"))
