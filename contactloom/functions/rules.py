"""Validation rules: a condition, and the issue that is reported where it holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.config import DEFAULT, GOLDEN_FIELDS, Config
from contactloom.functions import text

@dataclass(frozen=True)
class Rule:
    """``condition`` is true where the rule is broken; null counts as kept."""

    condition: Column
    field: str | None
    code: str
    message: Column
    severity: str
    raw: Column | None = None

    def broken(self) -> Column:
        return F.coalesce(self.condition, F.lit(False))

    def issue(self) -> Column:
        none = F.lit(None).cast("string")
        return F.when(
            self.condition,
            F.struct(
                F.lit(self.field).cast("string").alias("field_name"),
                F.lit(self.code).alias("error_code"),
                self.message.alias("error_message"),
                F.lit(self.severity).alias("severity"),
                (none if self.raw is None else self.raw).alias("raw_value"),
            ),
        )


def transform_failed(flag: Column) -> Rule:
    return Rule(flag, None, "TRANSFORM_FAILED", F.lit("Row could not be transformed"), "error")


def empty_row(columns: list[str]) -> Rule:
    """No value in any column that is not bookkeeping."""
    empty = F.col(columns[0]).isNull()
    for c in columns[1:]:
        empty = empty & F.col(c).isNull()
    return Rule(empty, None, "EMPTY_ROW", F.lit("Row has no usable data in any field"), "error")


def required(field: str) -> Rule:
    message = F.lit(f"Required field '{field}' is missing or empty")
    return Rule(text.blank(F.col(field)), field, "REQUIRED_FIELD_MISSING", message, "error")


def important(field: str) -> Rule:
    message = F.lit(f"Important field '{field}' is missing — row has reduced quality")
    return Rule(text.blank(F.col(field)), field, "IMPORTANT_FIELD_MISSING", message, "warning")


def invalid_email(config: Config = DEFAULT) -> Rule:
    c = F.col("email")
    message = F.concat(F.lit("'"), c, F.lit("' is not a valid email address"))
    return Rule(~c.rlike(config.email_pattern), "email", "INVALID_EMAIL", message, "error", c)


def invalid_phone(config: Config = DEFAULT) -> Rule:
    c = F.col("phone")
    message = F.concat(F.lit("'"), c, F.lit("' does not look like a valid phone number"))
    return Rule(~c.rlike("(?U)" + config.phone_pattern), "phone", "INVALID_PHONE", message, "warning", c)


def too_long(field: str, limit: int) -> Rule:
    c = F.col(field)
    message = F.lit(f"Value exceeds max length {limit} for '{field}'")
    return Rule(F.length(c) > limit, field, "VALUE_TOO_LONG", message, "warning", F.substring(c, 1, 100))


def rule_set(columns: list[str], config: Config = DEFAULT) -> list[Rule]:
    """The rules that apply to these columns, in the order their issues are reported."""
    found = [empty_row(columns)]
    found += [required(f) for f in config.required]
    found += [important(f) for f in config.important if f in columns]
    found += [invalid_email(config)] if "email" in columns else []
    found += [invalid_phone(config)] if "phone" in columns else []
    return found + [too_long(f, n) for f, n in config.max_lengths.items() if f in columns]


def issues(found: list[Rule], failed: Column | None = None) -> Column:
    """All issues of a row as one array. A row whose cleaning failed has just that one."""
    every = F.array_compact(F.array(*[r.issue() for r in found]))
    return every if failed is None else F.when(failed, F.array(transform_failed(F.lit(True)).issue())).otherwise(every)


def count_of(found: list[Rule], severity: str, failed: Column | None = None) -> Column:
    """Broken rules of a severity, straight from the conditions: no array is built."""
    n = sum((r.broken().cast("int") for r in found if r.severity == severity), F.lit(0))
    return n if failed is None else F.when(failed, F.lit(1 if severity == "error" else 0)).otherwise(n)


def error_codes(issue_column: Column) -> Column:
    return F.transform(
        F.filter(issue_column, lambda i: i["severity"] == "error"), lambda i: i["error_code"]
    )


def null_count(fields: list[str]) -> Column:
    return sum((F.col(f).isNull().cast("int") for f in fields), F.lit(0))


def filled_count(fields: list[str]) -> Column:
    return sum(((~text.blank(F.col(f))).cast("int") for f in fields), F.lit(0))


def missing_golden_fields(columns: list[str]) -> Column:
    """Empty ones among the tracked golden fields; a field the data lacks counts as empty."""
    present = [f for f in GOLDEN_FIELDS if f in columns]
    return null_count(present) + F.lit(len(GOLDEN_FIELDS) - len(present))
