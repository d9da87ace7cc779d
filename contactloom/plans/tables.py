"""Lineage, jobs, logs, exports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.config import DEFAULT, EXPORT_FIELDS
from contactloom.integrate import integrate
from contactloom.operators import lineage
from contactloom.operators.survivorship import golden_fold
from contactloom.operators.transform import issue_rows
from contactloom.plans import entities as e
from contactloom.plans import inputs as i
from contactloom.plans.explorer import FILES_SQL, files, jobs
from contactloom.plans.registry import query, table
from contactloom.plans.rows import ISSUES_SQL, MISSING_SQL
from contactloom.session import new_path, stage
from contactloom.sinks import export
from contactloom.sources import records, xlsx
from contactloom.streaming import ingest as st

LINEAGE_FIELDS = ["email", "phone", "first_name", "city", "country"]
_JSON = "json_object(" + ", ".join(f"'{f}', {f}" for f in LINEAGE_FIELDS) + ")"


@query("lineage_rows", f"""{i.WITH_CLEAN}
SELECT r.upload_file_id, r.source_row, CAST(r.upload_file_id AS BIGINT) * 1099511627776 + r.source_row AS id, r.raw_data, c.mapped_data, c.is_valid
FROM (SELECT upload_file_id, source_row, CAST({_JSON} AS VARCHAR) AS raw_data FROM contacts) r
JOIN (SELECT source_row, CAST({_JSON} AS VARCHAR) AS mapped_data, NOT ({i.BAD_EMAIL_SQL}) AS is_valid FROM clean) c USING (source_row)""")
def lineage_rows(spark, sf):
    return lineage.lineage_rows(i.contacts(spark, sf), LINEAGE_FIELDS)


@query("lineage_link", f"""{i.WITH_VALID}, {e.EMAIL_MEMBERS_SQL},
gold AS ({e.fold_sql('members', 'primary_id', e.FOLD_FIELDS, ['email'])}),
links AS (SELECT m.rid, primary_id, m.rid = base_id AS is_primary FROM members m JOIN gold USING (primary_id))
SELECT c.upload_file_id, c.source_row, primary_id AS customer_id, is_primary AS is_primary_source
FROM clean c LEFT JOIN links ON rid = c.source_row""")
def lineage_link(spark, sf):
    members = stage(e._email_members(spark, sf), "members")
    golden = golden_fold(members, e.FOLD_FIELDS)
    sources = i.contacts(spark, sf).select("upload_file_id", "source_row")
    return lineage.link_sources(sources, members.select("rid", "primary_id"), golden)


@query("issues_linked", f"""{i.WITH_CLEAN}
SELECT source_row, upload_file_id, field_name, error_code, severity,
       CAST(upload_file_id AS BIGINT) * 1099511627776 + source_row AS source_row_id FROM ({ISSUES_SQL})""")
def issues_linked(spark, sf):
    issues = issue_rows(i.checked(spark, sf)).select("source_row", "upload_file_id", "field_name", "error_code", "severity")
    sources = i.contacts(spark, sf).select("upload_file_id", "source_row", lineage.lineage_id().alias("id"))
    return lineage.link_issues(issues, sources)


@query("job_latest", """
SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, arg_max(substr(props, 1, 2000), event_id) AS error_message,
       epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_micros
FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) GROUP BY user_id""")
def job_latest(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("status"), F.col("props").alias("message")
    )
    return lineage.latest_jobs(events)


_UPDATES = """updates AS (SELECT user_id AS job_id, event_id AS seq, event_type AS status, CAST(floor(value) AS BIGINT) AS rows_extracted,
  CASE WHEN event_id % 2 = 0 THEN event_id END AS rows_valid, CAST(NULL AS BIGINT) AS rows_invalid, CAST(user_id AS BIGINT) AS rows_merged,
  CASE WHEN event_type = 'error' THEN props END AS error_message, CASE WHEN event_id % 5 = 0 THEN ts END AS started_at,
  CASE WHEN event_id % 7 = 0 THEN ts END AS completed_at FROM events)"""


@query("job_updates", f"""WITH {_UPDATES},
j AS (SELECT DISTINCT job_id FROM updates WHERE job_id % 3 <> 0 UNION SELECT -1),
u AS (SELECT *, max_by(started_at, CASE WHEN started_at IS NOT NULL THEN seq END) OVER (PARTITION BY job_id ORDER BY seq) AS known
      FROM updates WHERE job_id % 3 <> 0),
a AS (SELECT job_id, arg_max(status, seq) AS status, arg_max(rows_extracted, seq) AS rows_extracted,
             coalesce(arg_max_null(rows_valid, seq), 0) AS rows_valid, arg_max(rows_merged, seq) AS rows_merged,
             arg_max_null(error_message, seq) AS error_message, arg_max(started_at, seq) AS began, arg_max(completed_at, seq) AS ended,
             arg_max_null(known, CASE WHEN completed_at IS NOT NULL THEN seq END) AS start
      FROM u GROUP BY job_id)
SELECT job_id, coalesce(status, 'pending') AS status, coalesce(rows_extracted, 0) AS rows_extracted, coalesce(rows_valid, 0) AS rows_valid,
       CAST(0 AS BIGINT) AS rows_invalid, coalesce(rows_merged, 0) AS rows_merged, error_message,
       epoch_us(began) AS started_us, epoch_us(ended) AS completed_us,
       (epoch_us(ended) - epoch_us(start)) / 1000000 AS duration_seconds FROM j LEFT JOIN a USING (job_id)""")
def job_updates(spark, sf):
    """Two in three users are jobs, their events are updates; one job has none."""
    table(spark, sf, "events").createOrReplaceTempView("job_events")
    updates = spark.sql("WITH " + _UPDATES.replace("FROM events", "FROM job_events") + " SELECT * FROM updates")
    ids = updates.where("job_id % 3 != 0").select("job_id").distinct().unionByName(spark.sql("SELECT -1L AS job_id"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in lineage.COUNTERS]
    none = F.lit(None).cast("timestamp")
    jobs_now = ids.select(
        "job_id", F.lit("pending").alias("status"), *zero, F.lit(None).cast("string").alias("error_message"),
        none.alias("started_at"), none.alias("completed_at"), F.lit(None).cast("double").alias("duration_seconds"),
    )
    after = lineage.update_jobs(stage(jobs_now, "jobs"), stage(updates, "updates"))
    micros = {c: F.unix_micros(F.col(f"{c}_at").cast("timestamp")).alias(f"{c}_us") for c in ("started", "completed")}
    return after.select("job_id", "status", *lineage.COUNTERS, "error_message", *micros.values(), "duration_seconds")


@query("log_append", """
SELECT user_id AS job_id, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS stage, props AS detail
FROM events""")
def log_append(spark, sf):
    """Log lines of two stages, appended one after the other."""
    path = new_path(spark, "log")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    lines = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), level.alias("level"), F.col("event_type").alias("stage"),
        F.concat(F.lit("event "), F.col("event_id")).alias("message"), F.col("props").alias("detail"), F.col("ts").alias("logged_at"),
    )
    lineage.append_logs(lines.where("level = 'ERROR'"), path)
    lineage.append_logs(lines.where("level != 'ERROR'"), path)
    return spark.read.schema(lines.schema).parquet(path).select("job_id", "level", "stage", "detail")


@query("log_rollup", """
SELECT user_id AS job_id, event_type AS stage, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       count(*) AS entries, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY ALL""")
def log_rollup(spark, sf):
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    logs = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), level.alias("level"), F.col("ts").alias("logged_at")
    )
    return lineage.log_rollup(logs).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query("assign_batch", f"""{i.WITH_GOLDEN}
SELECT id, CASE WHEN id IN (SELECT coalesce(merged_into_id, id) FROM golden WHERE batch_id IN (2, 4)) THEN 9 ELSE batch_id END AS batch_id
FROM golden WHERE NOT is_duplicate""")
def assign_batch(spark, sf):
    golden = i.golden(spark, sf)
    produced = golden.where("batch_id IN (2, 4)").select(F.coalesce("merged_into_id", "id").alias("id"))
    return lineage.assign_batch(golden.where("NOT is_duplicate").select("id", "batch_id"), produced, 9)


@query("delete_rows", f"""WITH {FILES_SQL},
requests AS (SELECT o_custkey AS file_id, CAST(o_orderkey % 25 AS INT) AS user_id, o_orderkey % 10 = 0 AS is_staff FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT file_id, uploaded_by, file_format FROM files f
WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.file_id = f.file_id AND (is_staff OR user_id = uploaded_by))""")
def delete_rows(spark, sf):
    requests = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("file_id"), (F.col("o_orderkey") % 25).cast("int").alias("user_id"),
        (F.col("o_orderkey") % 10 == 0).alias("is_staff"),
    )
    return lineage.delete_rows(files(spark, sf).select("file_id", "uploaded_by", "file_format"), requests)


@query("integrate_files", f"""{i.WITH_VALID}
SELECT upload_file_id, count(*) AS total_rows, count(v.source_row) AS valid_rows, count(*) - count(v.source_row) AS invalid_rows,
       CAST(sum(CASE WHEN v.source_row IS NOT NULL THEN {MISSING_SQL} ELSE 0 END) AS BIGINT) AS missing_fields_count,
       count(*) - count(v.source_row) AS validation_error_count
FROM clean LEFT JOIN (SELECT source_row FROM valid) v USING (source_row) GROUP BY 1""")
def integrate_files(spark, sf):
    """Five CSV files with headers of their own, from bytes to the quality report."""
    path = new_path(spark, "uploads")
    names = {"email": "Email Address", "phone": "mobile", "first_name": "fname", "city": "Town", "postal_code": "ZIP Code"}
    rows = i.contacts(spark, sf).drop("source_row").withColumnsRenamed(names).repartition("upload_file_id")
    rows.write.partitionBy("upload_file_id").options(header=True, escape='"', emptyValue="").csv(path)
    report = integrate(spark, path).quality
    # Files are numbered by name, which is the order of the upload ids.
    return report.select(
        F.col("file_id").alias("upload_file_id"), "total_rows", "valid_rows", "invalid_rows", "missing_fields_count",
        "validation_error_count",
    )


# --- exports --------------------------------------------------------------------------------------

_EXPORT = ", ".join(f"CAST({f} AS VARCHAR) AS {f}" for f in EXPORT_FIELDS)


@query("export_csv", f"{i.WITH_GOLDEN} SELECT {_EXPORT} FROM golden")
def export_csv(spark, sf):
    path = new_path(spark, "export")
    export.write_csv(export.export_rows(i.golden(spark, sf)), path)
    return spark.read.options(header=True, escape='"').csv(path)


@query("export_selected", f"{i.WITH_GOLDEN} SELECT {_EXPORT} FROM golden WHERE id IN (SELECT l_orderkey + 2 FROM lineitem WHERE l_returnflag = 'R')")
def export_selected(spark, sf):
    path = new_path(spark, "export")
    ids = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") + 2).alias("id"))
    export.write_csv(export.export_rows(i.golden(spark, sf), ids), path)
    return spark.read.options(header=True, escape='"').csv(path)


@query("export_json", f"{i.WITH_GOLDEN} SELECT count(*) OVER () AS count, id, email, source_count, is_duplicate, city FROM golden")
def export_json(spark, sf):
    path = new_path(spark, "export")
    written = export.write_json(export.export_rows(i.golden(spark, sf)), path)
    kind = "id bigint, email string, source_count bigint, is_duplicate boolean, city string"
    return spark.read.schema(kind).json(path).withColumn("count", F.lit(written).cast("bigint"))


@query("export_json_document", f"""{i.WITH_GOLDEN}
SELECT CAST(count(*) OVER () AS INT) AS count, CAST(id AS VARCHAR) AS id, email, city, CAST(source_count AS VARCHAR) AS source_count
FROM golden WHERE id IN (SELECT l_orderkey + 2 FROM lineitem WHERE l_returnflag = 'R')""")
def export_json_document(spark, sf):
    """The records of selected ids in one document, read back by the reader of such files."""
    path = new_path(spark, "export")
    ids = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") + 2).alias("id"))
    written = export.write_json_document(export.export_rows(i.golden(spark, sf), ids), path)
    names = ["id", "email", "city", "source_count"]
    return records.read_records(spark, path, "json", "*").select(F.lit(written).alias("count"), *[F.col("raw")[n].alias(n) for n in names])


@query("export_xlsx", f"""{i.WITH_GOLDEN}
SELECT CAST(id AS VARCHAR) AS id, email, full_name, city, CAST(source_count AS VARCHAR) AS source_count,
       CASE WHEN is_duplicate THEN 'True' ELSE 'False' END AS is_duplicate FROM golden""")
def export_xlsx(spark, sf):
    path = new_path(spark, "workbooks")
    export.write_xlsx(export.export_rows(i.golden(spark, sf)), path)
    names = ["id", "email", "full_name", "city", "source_count", "is_duplicate"]
    return xlsx.read_xlsx(spark, path).where("error IS NULL").select(*[F.col("raw")[n].alias(n) for n in names])


@query("xlsx_scan", f"{i.WITH_CONTACTS} SELECT 'Customers' AS sheet, CAST(source_row AS VARCHAR) AS source_row, email, city, loyalty_tier FROM contacts")
def xlsx_scan(spark, sf):
    """Contacts as workbooks, several of them, read in parallel."""
    path = new_path(spark, "workbooks")
    rows = i.contacts(spark, sf).select("source_row", "email", "city", "loyalty_tier").repartition(4)
    export.write_xlsx(rows, path)
    names = ["source_row", "email", "city", "loyalty_tier"]
    return xlsx.read_xlsx(spark, path).select(F.col("_source_sheet").alias("sheet"), *[F.col("raw")[n].alias(n) for n in names])


# --- streams --------------------------------------------------------------------------------------

@query("stream_ingest", f"""{i.WITH_CLEAN}
SELECT source_row, upload_file_id, email, phone, full_name, country,
       CASE WHEN {i.BAD_EMAIL_SQL} THEN 1 ELSE 0 END AS error_count FROM clean""")
def stream_ingest(spark, sf):
    """Contact files as they arrive: the same rows as in one batch."""
    arrived, out, mark = (new_path(spark, n) for n in ("arrived", "ingested", "mark"))
    rows = i.contacts(spark, sf)
    for part in (rows.where("upload_file_id <= 2"), rows.where("upload_file_id > 2")):
        part.write.mode("append").parquet(arrived)
        st.ingest(spark.readStream.schema(rows.schema).parquet(arrived), out, mark)
    return spark.read.parquet(out).select(
        "source_row", "upload_file_id", "email", "phone", "full_name", "country", "error_count"
    )


@query("stream_counts", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n,
       count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL""")
def stream_counts(spark, sf):
    out, mark = new_path(spark, "counts"), new_path(spark, "mark")
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    st.running_counts(events, out, mark)
    return st.latest_counts(spark, out).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "errors")


_ARRIVAL = "CAST(CASE WHEN upload_file_id <= 2 THEN 0 WHEN upload_file_id <= 4 THEN 1 ELSE 2 END AS BIGINT) * 281474976710656 + source_row"


@query("incremental_merge", f"{i.first_seen_sql(_ARRIVAL)} SELECT rid, primary_id, key_set FROM seen")
def incremental_merge(spark, sf):
    """Valid rows arrive in three deliveries; equals one first-seen run over all of them."""
    arrived, state, mark = (new_path(spark, n) for n in ("arrived", "state", "mark"))
    rows = stage(arrivals(spark, sf), "valid")
    for delivery in range(3):
        rows.where(F.col("delivery") == delivery).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(rows.schema).parquet(arrived)
        st.merge_incrementally(stream, state, mark, DEFAULT.file_match_keys)
    return st.assignments(spark, state)


def arrivals(spark, sf):
    """Valid rows with ids that rise with their delivery."""
    delivery = F.when(F.col("upload_file_id") <= 2, 0).when(F.col("upload_file_id") <= 4, 1).otherwise(2)
    numbered = i.valid(spark, sf).withColumn("delivery", delivery)
    return numbered.withColumn("rid", F.shiftleft(F.col("delivery").cast("bigint"), 48) + F.col("source_row"))
