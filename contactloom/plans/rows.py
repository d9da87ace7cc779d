"""Row cleaning, rules and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.config import DEFAULT, STATUS_LABELS, Config
from contactloom.functions import rules, text
from contactloom.operators import quality
from contactloom.operators.matching import duplicate_pairs, first_seen
from contactloom.operators.transform import (
    invalid_rows, issue_counts, issue_rows, transform_rows, valid_rows, with_issues,
)
from contactloom.plans import inputs as i
from contactloom.plans.registry import query, table
from contactloom.session import stage

# White space of the given texts, for SQL trim().
WS_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160))"


@query("null_blanks", f"""{i.WITH_CONTACTS}
SELECT source_row, CASE WHEN trim(email) <> '' THEN email END AS email,
       CASE WHEN trim(phone) <> '' THEN phone END AS phone, CASE WHEN trim(city) <> '' THEN city END AS city
FROM contacts""")
def null_blanks(spark, sf):
    return i.contacts(spark, sf).select(
        "source_row", *[text.null_blank(F.col(c)).alias(c) for c in ("email", "phone", "city")]
    )


@query("norm_email", f"{i.WITH_CONTACTS} SELECT source_row, {i.EMAIL_SQL} AS email FROM contacts")
def norm_email(spark, sf):
    return i.contacts(spark, sf).select("source_row", text.email(F.col("email")).alias("email"))


@query("norm_phone", f"{i.WITH_CONTACTS} SELECT source_row, {i.PHONE_SQL} AS phone FROM contacts")
def norm_phone(spark, sf):
    return i.contacts(spark, sf).select("source_row", text.phone(F.col("phone")).alias("phone"))


@query("norm_name", f"""{i.WITH_CONTACTS}
SELECT source_row AS id, 'contact' AS kind, {i.FIRST_SQL} AS name FROM contacts
UNION ALL SELECT p_partkey, 'part', {i._name_sql('p_name')} FROM part""")
def norm_name(spark, sf):
    people = i.contacts(spark, sf).select(
        F.col("source_row").alias("id"), F.lit("contact").alias("kind"), text.name(F.col("first_name")).alias("name")
    )
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), text.name(F.col("p_name")).alias("name")
    )
    return people.unionByName(parts)


@query("norm_country", f"{i.WITH_CONTACTS} SELECT source_row, {i.COUNTRY_SQL} AS country FROM contacts")
def norm_country(spark, sf):
    return i.contacts(spark, sf).select("source_row", text.country(F.col("country")).alias("country"))


@query("clean_text", f"""
SELECT doc_id, nullif(regexp_replace(trim(text, {WS_SQL}), '[\\x00-\\x1f\\x7f]', '', 'g'), '') AS text FROM documents""")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


@query("synth_full_name", f"{i.WITH_CLEAN} SELECT source_row, first_name, last_name, full_name FROM clean")
def synth_full_name(spark, sf):
    return i.clean(spark, sf).select("source_row", "first_name", "last_name", "full_name")


@query("truncate_warn", f"""
WITH c AS (SELECT doc_id, nullif(regexp_replace(trim(text, {WS_SQL}), '[\\x00-\\x1f\\x7f]', '', 'g'), '') AS t FROM documents)
SELECT doc_id, substr(t, 1, 255) AS address_line1,
       CASE WHEN length(t) > 255 THEN 'Truncated to 255 chars' END AS message FROM c""")
def truncate_warn(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("address_line1"))
    out = transform_rows(rows, keep=("doc_id",), warnings=True)
    return out.select("doc_id", "address_line1", F.try_element_at("_warnings", F.lit(1))["message"].alias("message"))


@query("transform_contacts", f"{i.WITH_CLEAN} SELECT * FROM clean")
def transform_contacts(spark, sf):
    return i.clean(spark, sf)


@query("status_display", """
SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'Queued' WHEN 'P' THEN 'Running' WHEN 'F' THEN
       CASE WHEN o_orderkey % 10 = 0 THEN 'Failed' ELSE 'Completed' END END AS status FROM orders
UNION ALL SELECT event_id, event_type FROM events""")
def status_display(spark, sf):
    from contactloom.plans.explorer import jobs

    mine = jobs(spark, sf).select("job_id", "status")
    events = table(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"))
    return mine.unionByName(events).select("job_id", text.status_label(F.col("status"), STATUS_LABELS).alias("status"))


@query("rows_to_json", """
SELECT event_id, '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","user_id":' || user_id ||
       ',"event_type":"' || event_type || '"}' AS doc FROM events""")
def rows_to_json(spark, sf):
    doc = F.struct("ts", "user_id", "event_type")
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return table(spark, sf, "events").select(
        "event_id", F.to_json(doc, {"timestampFormat": fmt, "timestampNTZFormat": fmt}).alias("doc")
    )


# --- rules --------------------------------------------------------------------------------------

def _code(df, code):
    return issue_rows(df).where(F.col("error_code") == code).drop("upload_file_id")


def _issue_sql(field, code, message, severity, raw, where, source="clean"):
    return (
        f"SELECT source_row, upload_file_id, {field} AS field_name, '{code}' AS error_code, {message} AS error_message, "
        f"'{severity}' AS severity, {raw} AS raw_value FROM {source} WHERE {where}"
    )


IMPORTANT_SQL = " UNION ALL ".join(
    _issue_sql(f"'{f}'", "IMPORTANT_FIELD_MISSING",
               f"'Important field ''{f}'' is missing — row has reduced quality'", "warning", "NULL", f"{f} IS NULL")
    for f in ("email", "phone", "full_name")
)
EMAIL_ISSUE_SQL = _issue_sql(
    "'email'", "INVALID_EMAIL", "'''' || email || ''' is not a valid email address'", "error", "email", i.BAD_EMAIL_SQL)
PHONE_ISSUE_SQL = _issue_sql(
    "'phone'", "INVALID_PHONE", "'''' || phone || ''' does not look like a valid phone number'", "warning", "phone",
    i.BAD_PHONE_SQL)
ISSUES_SQL = f"{IMPORTANT_SQL} UNION ALL {EMAIL_ISSUE_SQL} UNION ALL {PHONE_ISSUE_SQL}"
NO_FILE = "SELECT * EXCLUDE (upload_file_id) FROM"


@query("rule_important", f"{i.WITH_CLEAN} {NO_FILE} ({IMPORTANT_SQL})")
def rule_important(spark, sf):
    return _code(i.checked(spark, sf), "IMPORTANT_FIELD_MISSING")


@query("rule_email", f"{i.WITH_CLEAN} {NO_FILE} ({EMAIL_ISSUE_SQL})")
def rule_email(spark, sf):
    return _code(i.checked(spark, sf), "INVALID_EMAIL")


@query("rule_phone", f"{i.WITH_CLEAN} {NO_FILE} ({PHONE_ISSUE_SQL})")
def rule_phone(spark, sf):
    return _code(i.checked(spark, sf), "INVALID_PHONE")


@query("rule_required", f"""{i.WITH_CLEAN} {NO_FILE} ({_issue_sql(
    "'city'", "REQUIRED_FIELD_MISSING", "'Required field ''city'' is missing or empty'", "error", "NULL", "city IS NULL")})""")
def rule_required(spark, sf):
    rows = with_issues(i.clean(spark, sf), config=Config(required=("city",)))
    return _code(rows, "REQUIRED_FIELD_MISSING")


@query("rule_empty", f"""{i.WITH_CLEAN}
SELECT source_row, 'EMPTY_ROW' AS error_code, 'Row has no usable data in any field' AS error_message, 'error' AS severity
FROM clean WHERE first_name IS NULL AND phone IS NULL""")
def rule_empty(spark, sf):
    rows = with_issues(i.clean(spark, sf).select("source_row", "first_name", "phone"), keep=("source_row",))
    return issue_rows(rows, ("source_row",)).where("error_code = 'EMPTY_ROW'").select(
        "source_row", "error_code", "error_message", "severity"
    )


@query("rule_length", """
SELECT doc_id, 'address_line1' AS field_name, 'VALUE_TOO_LONG' AS error_code,
       'Value exceeds max length 255 for ''address_line1''' AS error_message, 'warning' AS severity,
       substr(text, 1, 100) AS raw_value FROM documents WHERE length(text) > 255""")
def rule_length(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("address_line1"))
    return issue_rows(with_issues(rows, keep=("doc_id",)), ("doc_id",)).where("error_code = 'VALUE_TOO_LONG'")


@query("issues", f"{i.WITH_CLEAN} {ISSUES_SQL}")
def issues(spark, sf):
    return issue_rows(i.checked(spark, sf))


@query("valid_rows", f"{i.WITH_VALID} SELECT * FROM valid")
def valid(spark, sf):
    return i.valid(spark, sf)


@query("invalid_rows", f"""{i.WITH_CLEAN}
SELECT source_row, upload_file_id, email, phone, full_name, 'INVALID_EMAIL' AS codes FROM clean WHERE {i.BAD_EMAIL_SQL}""")
def invalid(spark, sf):
    return invalid_rows(i.checked(spark, sf)).select(
        "source_row", "upload_file_id", "email", "phone", "full_name",
        F.array_join("_validation_errors", ",").alias("codes"),
    )


@query("issue_counts", f"""{i.WITH_CLEAN}
SELECT f.upload_file_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings
FROM (SELECT DISTINCT upload_file_id FROM clean) f LEFT JOIN ({ISSUES_SQL}) s USING (upload_file_id)
GROUP BY f.upload_file_id""")
def counts(spark, sf):
    return issue_counts(i.checked(spark, sf))


# --- quality ------------------------------------------------------------------------------------

MISSING_SQL = " + ".join(
    f"({f} IS NULL)::INT" for f in ("email", "phone", "full_name", "first_name", "last_name", "city", "postal_code", "country")
) + " + 3"


@query("quality_report", f"""{i.WITH_VALID},
t AS (SELECT upload_file_id, count(*) AS total_rows FROM clean GROUP BY 1),
v AS (SELECT upload_file_id, count(*) AS valid_rows, sum({MISSING_SQL}) AS missing_fields_count,
             count(email) - count(DISTINCT email) AS duplicate_rows FROM valid GROUP BY 1)
SELECT upload_file_id, total_rows, valid_rows, total_rows - valid_rows AS invalid_rows, duplicate_rows,
       CAST(missing_fields_count AS BIGINT) AS missing_fields_count,
       round(missing_fields_count / (valid_rows * 11) * 100, 2) AS missing_pct,
       total_rows - valid_rows AS validation_error_count,
       round(100 - missing_fields_count / (valid_rows * 11) * 100, 2) AS completeness_score,
       round((total_rows - duplicate_rows) / total_rows * 100, 2) AS uniqueness_score
FROM t JOIN v USING (upload_file_id)""")
def quality_report(spark, sf):
    rows = i.checked(spark, sf)
    return quality.quality_report(rows, quality.duplicates_by_key(valid_rows(rows)))


@query("quality_report_full", f"""{i.first_seen_sql(scope='upload_file_id')},
t AS (SELECT upload_file_id, count(*) AS total_rows FROM clean GROUP BY 1),
u AS (SELECT upload_file_id, count(*) AS duplicate_rows FROM seen JOIN valid ON rid = source_row
      WHERE rid <> primary_id GROUP BY 1),
v AS (SELECT upload_file_id, count(*) AS valid_rows, sum({MISSING_SQL}) AS missing_fields_count FROM valid GROUP BY 1)
SELECT upload_file_id, total_rows, valid_rows, total_rows - valid_rows AS invalid_rows, duplicate_rows,
       CAST(missing_fields_count AS BIGINT) AS missing_fields_count,
       round(missing_fields_count / (valid_rows * 11) * 100, 2) AS missing_pct,
       total_rows - valid_rows AS validation_error_count,
       round(100 - missing_fields_count / (valid_rows * 11) * 100, 2) AS completeness_score,
       round((total_rows - duplicate_rows) / total_rows * 100, 2) AS uniqueness_score
FROM t JOIN v USING (upload_file_id) JOIN u USING (upload_file_id)""")
def quality_report_full(spark, sf):
    """Duplicates by the first-seen rule within each file, over all match keys."""
    rows = stage(i.checked(spark, sf), "checked")
    ok = valid_rows(rows)
    pairs = duplicate_pairs(first_seen(ok, DEFAULT.file_match_keys, ["upload_file_id"], "source_row"))
    of_file = ok.select(F.col("source_row").alias("duplicate_id"), "upload_file_id")
    duplicates = pairs.join(of_file, "duplicate_id").groupBy("upload_file_id").agg(F.count("*").alias("duplicate_rows"))
    return quality.quality_report(rows, duplicates)
