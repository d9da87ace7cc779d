"""Deliveries that come one after the other, and rows that a caller's own step fails on."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from contactloom.config import DEFAULT
from contactloom.operators.isolate import apply_isolated
from contactloom.operators.transform import issue_rows, transform_rows, with_issues
from contactloom.plans import inputs as i
from contactloom.plans.entities import FOLD_FIELDS, fold_sql
from contactloom.plans.folders import _ROWS, FIELDS, NAMES, _as, _contacts, _write_json
from contactloom.plans.registry import query
from contactloom.plans.tables import _ARRIVAL, arrivals
from contactloom.session import new_path, stage
from contactloom.streaming import ingest as st
from contactloom.streaming.uploads import stream_uploads, uploaded


@query("incremental_golden", f"""{i.first_seen_sql(_ARRIVAL)},
members AS (SELECT v.*, s.rid, s.primary_id FROM valid v JOIN seen s ON s.rid = {_ARRIVAL})
{fold_sql('members', 'primary_id', FOLD_FIELDS, FOLD_FIELDS)}""")
def incremental_golden(spark, sf):
    """Golden records that three deliveries refresh; equals one fold over all of them."""
    arrived, state, mark = (new_path(spark, n) for n in ("arrived", "state", "mark"))
    rows = stage(arrivals(spark, sf), "valid")
    for delivery in range(3):
        rows.where(F.col("delivery") == delivery).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(rows.schema).parquet(arrived)
        st.merge_incrementally(stream, state, mark, DEFAULT.file_match_keys, fields=FOLD_FIELDS)
    return st.golden_records(spark, state)


@query("stream_uploads", _ROWS)
def uploads(spark, sf):
    """CSV, JSON and line-delimited files arrive one after the other, some in folders with odd names."""
    folder, out, mark = (new_path(spark, n) for n in ("uploads", "uploaded", "mark"))
    rows = _contacts(spark, sf).withColumnsRenamed(NAMES)
    share = F.pmod(F.col("ref").cast("long"), F.lit(3))
    rows.where(share == 0).write.options(header=True, escape='"').csv(f"{folder}/a [1] list")
    stream_uploads(spark, folder, out, mark)
    _write_json(rows.where(share == 1), f"{folder}/b")
    rows.where(share == 2).write.json(f"{folder}/c")
    _as(spark, f"{folder}/c", ".ndjson")
    stream_uploads(spark, folder, out, mark, max_files=5)
    found = uploaded(spark, out).checked
    return found.withColumn("source_row", F.col("extra_fields")["ref"].cast("long")).select(*FIELDS)


def _domains(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A step as a caller may write it, which takes for granted that an e-mail holds an @."""
    at = pc.find_substring(batch["email"], "@")
    if pc.any(pc.less(at, 0)).as_py():
        raise ValueError("no @")
    return batch.append_column("domain", pc.list_element(pc.split_pattern(batch["email"], "@"), 1))


NO_AT = "(email IS NOT NULL AND NOT contains(email, '@'))"


def _isolated(spark, sf):
    rows = i.contacts(spark, sf).select("source_row", "upload_file_id", "email", "city")
    kind = "source_row bigint, upload_file_id int, email string, city string, domain string"
    return with_issues(transform_rows(apply_isolated(rows, _domains, schema=kind)))


@query("transform_isolated", f"""{i.WITH_CONTACTS}
SELECT source_row, upload_file_id, {NO_AT} AS failed, CASE WHEN NOT {NO_AT} THEN lower(trim(email)) END AS email,
       CASE WHEN NOT {NO_AT} THEN nullif(trim(split_part(email, '@', 2)), '') END AS domain, CASE WHEN NOT {NO_AT} THEN city END AS city,
       CASE WHEN {NO_AT} THEN 'ValueError: no @' END AS error FROM (SELECT * REPLACE (nullif(email, '') AS email) FROM contacts)""")
def transform_isolated(spark, sf):
    """A caller's step that raises for some rows: these are flagged, all others go on."""
    return _isolated(spark, sf).select(
        "source_row", "upload_file_id", F.col("_transform_failed").alias("failed"), "email", "domain", "city",
        F.col("_transform_error").alias("error"),
    )


@query("rule_transform_failed", f"""{i.WITH_CONTACTS}
SELECT source_row, upload_file_id, 'TRANSFORM_FAILED' AS error_code, 'error' AS severity FROM contacts WHERE {NO_AT}""")
def rule_transform_failed(spark, sf):
    found = issue_rows(_isolated(spark, sf)).where("error_code = 'TRANSFORM_FAILED'")
    return found.select("source_row", "upload_file_id", "error_code", "severity")
