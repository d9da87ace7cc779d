"""Jobs, joins, aggregates, paging and explorer queries.

Files are the customers, jobs their orders, batches groups of files: tables that grow with
the data like those of the service.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.config import STATUS_LABELS
from contactloom.operators import explore, quality
from contactloom.operators.answers import answer, with_intent
from contactloom.operators.lookup import lookup_join
from contactloom.operators.transform import issue_rows, valid_rows
from contactloom.plans import inputs as i
from contactloom.plans.registry import query, table
from contactloom.plans.rows import ISSUES_SQL, MISSING_SQL
from contactloom.session import stage

STATUSES = list(STATUS_LABELS)

JOBS_SQL = """jobs AS (
SELECT o_orderkey AS job_id, o_custkey AS file_id, CAST(o_custkey % 50 + 1 AS INT) AS batch_id, o_orderdate AS started_at,
       CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running'
            ELSE CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'completed' END END AS status
FROM orders)"""
FILES_SQL = """files AS (
SELECT c_custkey AS file_id, c_name AS original_name, c_nationkey AS uploaded_by, CAST(c_custkey % 50 + 1 AS INT) AS batch_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'csv' WHEN 'MACHINERY' THEN 'xml' WHEN 'HOUSEHOLD' THEN 'xlsx' ELSE 'json' END AS file_format
FROM customer)"""
WITH_JOBS = f"WITH {JOBS_SQL}, {FILES_SQL}"


def jobs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("file_id"),
        (F.col("o_custkey") % 50 + 1).cast("int").alias("batch_id"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").when(
            F.col("o_orderkey") % 10 == 0, "failed").otherwise("completed").alias("status"),
    )


def files(spark, sf):
    segment = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("file_id"), F.col("c_name").alias("original_name"),
        F.col("c_nationkey").alias("uploaded_by"), (F.col("c_custkey") % 50 + 1).cast("int").alias("batch_id"),
        F.when(segment == "BUILDING", "csv").when(segment == "MACHINERY", "xml").when(segment == "HOUSEHOLD", "xlsx")
        .otherwise("json").alias("file_format"),
    )


# --- joins ----------------------------------------------------------------------------------------

@query("jobs_of_owner", f"""{WITH_JOBS}
SELECT job_id, file_id, status, original_name, uploaded_by FROM jobs JOIN files USING (file_id) WHERE uploaded_by = 7""")
def jobs_of_owner(spark, sf):
    """A file may have any share of the jobs, so its row is looked up."""
    mine = files(spark, sf).where("uploaded_by = 7").select("file_id", "original_name", "uploaded_by")
    all_jobs = jobs(spark, sf).select("job_id", "file_id", "status")
    sizes = stage(all_jobs.groupBy("file_id").agg(F.count("*").alias("n")), "sizes")
    return lookup_join(all_jobs, stage(mine.join(sizes, "file_id"), "mine"), ["file_id"], "n", counts=sizes)


@query("batches_of_owner", """
SELECT c_custkey AS batch_id, c_nationkey AS owner FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
def batches_of_owner(spark, sf):
    """Existence as a semi join; copies of a key collapse before the shuffle."""
    large = table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    owners = table(spark, sf, "customer").join(large, "c_custkey", "left_semi")
    return owners.select(F.col("c_custkey").alias("batch_id"), F.col("c_nationkey").alias("owner"))


@query("ids_lookup", """
SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def ids_lookup(spark, sf):
    wanted = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf, "orders").join(wanted, "o_orderkey", "left_semi").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority")
    )


@query("missing_ids", """
SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def missing_ids(spark, sf):
    known = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(known, "id", "left_anti")


@query("lineage_of", f"""{i.WITH_GOLDEN}
SELECT coalesce(s.merged_into_id, s.id) AS customer_id, s.id AS source_id, g.email, s.phone AS source_phone
FROM golden s JOIN golden g ON g.id = coalesce(s.merged_into_id, s.id)""")
def lineage_of(spark, sf):
    golden = i.golden(spark, sf)
    sources = golden.select(
        F.coalesce("merged_into_id", "id").alias("customer_id"), F.col("id").alias("source_id"),
        F.col("phone").alias("source_phone"),
    )
    owners = golden.where("NOT is_duplicate").select(F.col("id").alias("customer_id"), "email", "source_count")
    return lookup_join(sources, owners, ["customer_id"], "source_count")


@query("duplicates_with_primary", f"""{i.WITH_GOLDEN}
SELECT d.id, d.merged_into_id, d.full_name AS duplicate_name, p.full_name AS primary_name
FROM golden d JOIN golden p ON p.id = d.merged_into_id""")
def duplicates_with_primary(spark, sf):
    golden = i.golden(spark, sf)
    duplicates = golden.where("merged_into_id IS NOT NULL").select(
        "id", "merged_into_id", F.col("full_name").alias("duplicate_name")
    )
    primaries = golden.where("NOT is_duplicate").select(
        F.col("id").alias("merged_into_id"), F.col("full_name").alias("primary_name"), "source_count"
    )
    return lookup_join(duplicates, primaries, ["merged_into_id"], "source_count")


# --- aggregates -----------------------------------------------------------------------------------

@query("count_golden", f"{i.WITH_GOLDEN} SELECT count(*) AS n FROM golden")
def count_golden(spark, sf):
    return i.golden(spark, sf).agg(F.count("*").alias("n"))


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES)


@query("status_counts", f"{WITH_JOBS} SELECT {_COUNTS}, count(*) AS total FROM jobs")
def status_counts(spark, sf):
    return quality.status_counts(jobs(spark, sf), "status", STATUSES)


DURATION_SQL = """durations AS (SELECT l_orderkey AS job_id, max(l_shipdate) AS completed_at FROM lineitem GROUP BY 1)"""


def durations(spark, sf):
    done = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.max("l_shipdate").alias("completed_at")
    )
    return jobs(spark, sf).join(done, "job_id").withColumn(
        "duration_seconds", F.datediff("completed_at", "started_at") * 86400
    )


@query("avg_duration", f"""{WITH_JOBS}, {DURATION_SQL}
SELECT round(avg(date_diff('day', started_at, completed_at) * 86400) FILTER (status = 'completed'), 3) AS avg_seconds,
       round(avg(date_diff('day', started_at, completed_at)) FILTER (status = 'unknown'), 3) AS none_seconds
FROM jobs JOIN durations USING (job_id)""")
def avg_duration(spark, sf):
    seconds = F.col("duration_seconds")
    return durations(spark, sf).agg(
        quality.average_where(seconds, F.col("status") == "completed", 3).alias("avg_seconds"),
        quality.average_where(seconds, F.col("status") == "unknown", 3).alias("none_seconds"),
    )


@query("severity_counts", f"""{i.WITH_CLEAN}
SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
       count(*) AS total, coalesce(sum(CASE WHEN severity = 'fatal' THEN 1 END), 0)::BIGINT AS fatal FROM ({ISSUES_SQL})""")
def severity_counts(spark, sf):
    severity = F.col("severity")
    return issue_rows(i.checked(spark, sf)).agg(
        F.count_if(severity == "error").alias("errors"), F.count_if(severity == "warning").alias("warnings"),
        F.count("*").alias("total"), F.coalesce(F.sum(F.when(severity == "fatal", 1)), F.lit(0)).alias("fatal"),
    )


@query("dashboard", f"""{i.WITH_GOLDEN}, {JOBS_SQL}, {FILES_SQL}, {DURATION_SQL},
per_file AS (SELECT upload_file_id, round(sum({MISSING_SQL}) / (count(*) * 11) * 100, 2) AS missing_pct,
                    count(email) - count(DISTINCT email) AS dup FROM valid GROUP BY 1)
SELECT (SELECT count(*) FROM files) AS total_files,
       (SELECT count(*) FROM jobs) AS jobs_total,
       {', '.join(f"(SELECT count(*) FROM jobs WHERE status = '{s}') AS jobs_{s}" for s in STATUSES)},
       (SELECT round(avg(date_diff('day', started_at, completed_at) * 86400), 3) FROM jobs JOIN durations USING (job_id)
         WHERE status = 'completed') AS average_processing_time_seconds,
       (SELECT round(avg(missing_pct), 2) FROM per_file) AS missing_data_percentage,
       (SELECT count(*) FROM ({ISSUES_SQL}) WHERE severity = 'error') AS errors,
       (SELECT count(*) FROM ({ISSUES_SQL}) WHERE severity = 'warning') AS warnings,
       (SELECT CAST(sum(dup) AS BIGINT) FROM per_file) AS duplicate_rows_total,
       (SELECT count(*) FROM golden WHERE is_duplicate) AS duplicate_customers,
       (SELECT count(*) FROM golden) AS total_customers""")
def dashboard(spark, sf):
    """Every table is aggregated once; the one-row results are stacked and folded into one
    row, as no two of them fill the same column."""
    checked = stage(i.checked(spark, sf), "checked")
    report = quality.quality_report(checked, quality.duplicates_by_key(valid_rows(checked)))
    golden = i.golden(spark, sf)
    parts = [
        files(spark, sf).agg(F.count("*").alias("total_files")),
        quality.status_counts(jobs(spark, sf), "status", STATUSES).select(
            F.col("total").alias("jobs_total"), *[F.col(s).alias(f"jobs_{s}") for s in STATUSES]),
        durations(spark, sf).agg(quality.average_where(
            F.col("duration_seconds"), F.col("status") == "completed", 3).alias("average_processing_time_seconds")),
        report.agg(
            F.round(F.avg("missing_pct"), 2).alias("missing_data_percentage"),
            F.sum("duplicate_rows").alias("duplicate_rows_total"), F.sum("validation_error_count").alias("errors")),
        checked.agg(F.sum("warning_count").alias("warnings")),
        golden.agg(
            F.count_if("is_duplicate").alias("duplicate_customers"), F.count("*").alias("total_customers")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


REQUESTED_SQL = """requested AS (SELECT CAST(user_id % 60 + 1 AS INT) AS batch_id, min(event_id) AS pos FROM events GROUP BY 1)"""


def requested_batches(spark, sf):
    asked = table(spark, sf, "events").select(
        (F.col("user_id") % 60 + 1).cast("int").alias("batch_id"), F.col("event_id").alias("pos")
    )
    return asked.groupBy("batch_id").agg(F.min("pos").alias("pos"))


@query("batch_status", f"""{WITH_JOBS}, {REQUESTED_SQL}
SELECT pos, batch_id, {_COUNTS}, count(*) AS total FROM jobs JOIN requested USING (batch_id) GROUP BY pos, batch_id""")
def batch_status(spark, sf):
    """Counts first, then the requested order: the join is between small tables."""
    per_batch = quality.status_counts(jobs(spark, sf), "status", STATUSES, by=["batch_id"])
    return per_batch.join(requested_batches(spark, sf), "batch_id").orderBy("pos")


@query("batch_counts", """
SELECT c_custkey AS batch_id, coalesce(f.n, 0) AS file_count, coalesce(j.n, 0) AS job_count FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) f ON f.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) j ON j.o_custkey = c_custkey""")
def batch_counts(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), "o_orderkey")
    per_order = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    per_batch = orders.join(per_order, "o_orderkey", "left").groupBy("batch_id").agg(
        F.count("*").alias("files"), F.sum("n").alias("jobs")
    )
    batches = table(spark, sf, "customer").select(F.col("c_custkey").alias("batch_id"))
    return batches.join(per_batch, "batch_id", "left").select(
        "batch_id", F.coalesce("files", F.lit(0)).alias("file_count"), F.coalesce("jobs", F.lit(0)).alias("job_count")
    )


@query("batch_outcome", f"""{WITH_JOBS}
SELECT batch_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'completed' END AS status FROM jobs GROUP BY 1""")
def batch_outcome(spark, sf):
    return jobs(spark, sf).groupBy("batch_id").agg(
        F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("completed").alias("status")
    )


@query("ordered_distinct", "SELECT user_id, min(event_id) AS pos FROM events GROUP BY 1")
def ordered_distinct(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("pos")).orderBy("pos")


@query("union_files", f"""{i.WITH_CONTACTS}
SELECT source_row, email, phone, city FROM (
  SELECT source_row, email, phone, NULL AS city FROM contacts WHERE upload_file_id <= 2
  UNION ALL SELECT source_row, email, NULL, city FROM contacts WHERE upload_file_id > 2)""")
def union_files(spark, sf):
    rows = i.contacts(spark, sf)
    first = rows.where("upload_file_id <= 2").select("source_row", "email", "phone")
    rest = rows.where("upload_file_id > 2").select("source_row", "email", "city")
    return first.unionByName(rest, allowMissingColumns=True)


# --- sorting and paging ---------------------------------------------------------------------------

SHOWN = ["id", "email", "full_name", "city", "created_at", "source_count"]
_SHOWN = ", ".join(SHOWN)


@query("sorted_page", f"""{i.WITH_GOLDEN}
SELECT {_SHOWN} FROM golden WHERE NOT is_duplicate ORDER BY city DESC NULLS FIRST, id LIMIT 50 OFFSET 100""")
def sorted_page(spark, sf):
    rows = explore.select_golden(i.golden(spark, sf))
    return explore.page(rows, "-city", page=3, page_size=50).select(*SHOWN)


@query("keyset_page", f"""{i.WITH_GOLDEN}
SELECT {_SHOWN} FROM golden WHERE NOT is_duplicate AND (city > 'NATION_17' OR city IS NULL OR (city = 'NATION_17' AND id > 900))
ORDER BY city ASC NULLS LAST, id LIMIT 50""")
def keyset_page(spark, sf):
    rows = explore.select_golden(i.golden(spark, sf))
    return explore.page(rows, "city", page_size=50, after=("NATION_17", 900)).select(*SHOWN)


@query("page_meta", f"""{i.WITH_GOLDEN}
SELECT count(*) AS count, 1 AS page, 20 AS page_size, greatest(1, CAST(ceil(count(*) / 20) AS BIGINT)) AS total_pages
FROM golden WHERE NOT is_duplicate""")
def page_meta(spark, sf):
    return explore.page_meta(explore.select_golden(i.golden(spark, sf)))


@query("newest_files", f"""{WITH_JOBS}
SELECT job_id, file_id, CAST(started_at AS DATE) AS started, original_name FROM jobs JOIN files USING (file_id)
ORDER BY started_at DESC NULLS FIRST, job_id LIMIT 20""")
def newest_files(spark, sf):
    newest = explore.page(jobs(spark, sf), "-started_at", allowed=["started_at"], id_column="job_id")
    return newest.join(files(spark, sf).select("file_id", "original_name"), "file_id").select(
        "job_id", "file_id", F.to_date("started_at").alias("started"), "original_name"
    )


# --- explorer -------------------------------------------------------------------------------------

@query("explorer", f"""{i.WITH_GOLDEN}
SELECT {_SHOWN} FROM golden WHERE NOT is_duplicate ORDER BY created_at DESC NULLS FIRST, id LIMIT 20""")
def explorer(spark, sf):
    return explore.page(explore.select_golden(i.golden(spark, sf))).select(*SHOWN)


_SEARCH = " OR ".join(f"coalesce({f} ILIKE '%r9_@ex%', false)" for f in ["email", "full_name", "first_name", "last_name", "phone", "city"])


@query("explorer_search", f"{i.WITH_GOLDEN} SELECT {_SHOWN} FROM golden WHERE NOT is_duplicate AND ({_SEARCH})")
def explorer_search(spark, sf):
    return explore.select_golden(i.golden(spark, sf), search=" R9_@ex ").select(*SHOWN)


@query("explorer_filter", f"""{i.WITH_GOLDEN}
SELECT {_SHOWN} FROM golden WHERE is_duplicate AND country = 'CA' AND city = 'NATION_7'""")
def explorer_filter(spark, sf):
    return explore.select_golden(i.golden(spark, sf), is_duplicate=True, country="CA", city="NATION_7").select(*SHOWN)


@query("explorer_batch", f"""{i.WITH_GOLDEN}, {FILES_SQL}
SELECT {_SHOWN} FROM golden WHERE NOT is_duplicate AND batch_id = 3
  AND EXISTS (SELECT 1 FROM files f WHERE f.batch_id = 3 AND f.uploaded_by = 7)
ORDER BY full_name ASC NULLS LAST, id LIMIT 100""")
def explorer_batch(spark, sf):
    owned = files(spark, sf).where("uploaded_by = 7")
    rows = explore.select_golden(i.golden(spark, sf), batch_id=3, owned_batches=owned)
    return explore.page(rows, "full_name", page_size=100).select(*SHOWN)


@query("record_by_id", f"{i.WITH_GOLDEN} SELECT {_SHOWN} FROM golden WHERE id = 78")
def record_by_id(spark, sf):
    return i.golden(spark, sf).where("id = 78").select(*SHOWN)


@query("job_list", f"""{WITH_JOBS}
SELECT job_id, file_id, batch_id, status FROM jobs WHERE status = 'completed'
ORDER BY started_at DESC NULLS FIRST, job_id LIMIT 20""")
def job_list(spark, sf):
    rows = jobs(spark, sf).where("status = 'completed'")
    return explore.page(rows, "-started_at", allowed=["started_at"], id_column="job_id").drop("started_at")


@query("job_errors", f"""{i.WITH_CLEAN}
SELECT source_row, field_name, error_code, severity, raw_value FROM ({ISSUES_SQL}) WHERE upload_file_id = 2
ORDER BY source_row, field_name, error_code LIMIT 50 OFFSET 100""")
def job_errors(spark, sf):
    rows = issue_rows(i.checked(spark, sf, "upload_file_id = 2"))
    ordered = rows.orderBy("source_row", F.col("field_name").asc_nulls_last(), "error_code")
    return ordered.offset(100).limit(50).select("source_row", "field_name", "error_code", "severity", "raw_value")


@query("batch_history", f"""{WITH_JOBS}
SELECT b.batch_id, f.file_count, j.job_count, j.failed_jobs FROM (SELECT DISTINCT batch_id FROM files WHERE uploaded_by = 7) b
JOIN (SELECT batch_id, count(*) AS file_count FROM files GROUP BY 1) f USING (batch_id)
JOIN (SELECT batch_id, count(*) AS job_count, count(*) FILTER (status = 'failed') AS failed_jobs FROM jobs GROUP BY 1) j USING (batch_id)""")
def batch_history(spark, sf):
    """Batches of an owner with file and job counts: grouped once, not counted per batch."""
    all_files = files(spark, sf)
    mine = all_files.where("uploaded_by = 7").select("batch_id").distinct()
    file_counts = all_files.groupBy("batch_id").agg(F.count("*").alias("file_count"))
    job_counts = jobs(spark, sf).groupBy("batch_id").agg(
        F.count("*").alias("job_count"), F.count_if(F.col("status") == "failed").alias("failed_jobs")
    )
    return file_counts.join(mine, "batch_id", "left_semi").join(job_counts, "batch_id")


@query("batch_detail", f"""{WITH_JOBS}
SELECT files.batch_id, file_id, original_name, file_format, job_id, status FROM files LEFT JOIN jobs USING (file_id)
WHERE files.batch_id = 8""")
def batch_detail(spark, sf):
    """Files of a batch with their jobs, as flat rows: nesting a batch into one value would
    gather it in one task."""
    inside = files(spark, sf).where("batch_id = 8").drop("uploaded_by")
    all_jobs = jobs(spark, sf).select("file_id", "job_id", "status")
    sizes = stage(all_jobs.groupBy("file_id").agg(F.count("*").alias("n")), "sizes")
    with_jobs = lookup_join(all_jobs, stage(inside.join(sizes, "file_id"), "inside"), ["file_id"], "n", counts=sizes)
    without = inside.join(sizes, "file_id", "left_anti")
    return with_jobs.unionByName(without, allowMissingColumns=True)


@query("file_list", f"""{WITH_JOBS}
SELECT file_id, original_name, file_format FROM files WHERE file_format = 'csv' AND uploaded_by = 7
ORDER BY file_id DESC LIMIT 20""")
def file_list(spark, sf):
    rows = files(spark, sf).where("file_format = 'csv' AND uploaded_by = 7")
    return rows.orderBy(F.col("file_id").desc()).limit(20).select("file_id", "original_name", "file_format")


# --- text queries ---------------------------------------------------------------------------------

ASKED_SQL = """asked AS (SELECT event_id, CASE event_type
   WHEN 'click' THEN '  Show ' || CAST(user_id % 70 AS VARCHAR) || ' customers'
   WHEN 'view' THEN 'Customers in nation_' || CAST(user_id % 30 AS VARCHAR)
   WHEN 'signup' THEN 'How many customers like ' || CAST(user_id AS VARCHAR) || '?'
   WHEN 'purchase' THEN 'search for USER' || CAST(user_id AS VARCHAR) || CASE WHEN user_id % 3 = 0 THEN '_@' ELSE '@' END
   ELSE CASE WHEN user_id % 2 = 0 THEN 'list customers' ELSE 'duplicate rows, top ' || CAST(user_id AS VARCHAR) END END AS query
 FROM events)"""
_S = "trim(replace(CASE WHEN regexp_matches(n, '^(search for |search |find |show |list )') THEN trim(regexp_replace(n, '^(search for |search |find |show |list )', '')) ELSE n END, 'customers', ''))"
INTENTS_SQL = f"""intents AS (SELECT event_id, query,
  CASE WHEN query = '' THEN 'invalid' WHEN contains(n, 'how many') OR contains(n, 'count') OR contains(n, 'number of customers') THEN 'count'
       WHEN contains(n, 'duplicate') THEN 'duplicates'
       WHEN regexp_matches(n, '^(customers in |customer in |people in |users in )') THEN 'city_filter'
       WHEN {_S} <> '' THEN 'search' ELSE 'list' END AS intent,
  CASE WHEN regexp_matches(n, '^(customers in |customer in |people in |users in )') THEN trim(regexp_replace(n, '^(customers in |customer in |people in |users in )', ''))
       ELSE {_S} END AS arg,
  CASE WHEN regexp_matches(n, '(^|\\s)(show|top|first|limit)\\s+[0-9]+(\\s|$)')
       THEN least(greatest(CAST(regexp_extract(n, '(?:^|\\s)(?:show|top|first|limit)\\s+([0-9]+)(?:\\s|$)', 1) AS BIGINT), 1), 50) ELSE 10 END AS row_limit
  FROM (SELECT event_id, trim(query) AS query, lower(trim(query)) AS n FROM asked))"""


def asked(spark, sf):
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("  Show "), (F.col("user_id") % 70).cast("string"), F.lit(" customers")))
        .when(kind == "view", F.concat(F.lit("Customers in nation_"), (F.col("user_id") % 30).cast("string")))
        .when(kind == "signup", F.concat(F.lit("How many customers like "), user, F.lit("?")))
        .when(kind == "purchase", F.concat(F.lit("search for USER"), user, F.when(F.col("user_id") % 3 == 0, "_@").otherwise("@")))
        .otherwise(F.when(F.col("user_id") % 2 == 0, "list customers").otherwise(F.concat(F.lit("duplicate rows, top "), user)))
    )
    return table(spark, sf, "events").select("event_id", text.alias("query"))


@query("query_intents", f"""WITH {ASKED_SQL}, {INTENTS_SQL}
SELECT event_id, query, intent, CASE WHEN intent IN ('search', 'city_filter') THEN arg END AS argument FROM intents""")
def query_intents(spark, sf):
    return with_intent(asked(spark, sf)).select("event_id", "query", "intent", F.lower("argument").alias("argument"))


@query("query_limit", f"WITH {ASKED_SQL}, {INTENTS_SQL} SELECT event_id, CAST(row_limit AS INT) AS row_limit FROM intents")
def query_limit(spark, sf):
    return with_intent(asked(spark, sf)).select("event_id", "row_limit")


_ANSWER_FIELDS = ["email", "phone", "full_name", "first_name", "last_name", "city", "state", "country"]


@query("query_answers", f"""{i.WITH_GOLDEN}, {ASKED_SQL}, {INTENTS_SQL},
q AS (SELECT DISTINCT query, intent, arg, row_limit FROM intents),
args AS (SELECT DISTINCT intent, arg FROM q WHERE intent IN ('search', 'city_filter')),
found AS (SELECT intent, arg, id FROM args JOIN golden ON
   CASE WHEN intent = 'city_filter' THEN city ILIKE arg
        ELSE {' OR '.join(f"coalesce({f} ILIKE '%' || arg || '%', false)" for f in _ANSWER_FIELDS)} END),
hits AS (SELECT q.query, f.id FROM q JOIN found f ON f.intent = q.intent AND f.arg = q.arg
   UNION ALL SELECT query, id FROM q JOIN golden ON q.intent = 'list'
   UNION ALL SELECT query, id FROM q JOIN golden ON q.intent = 'duplicates' AND is_duplicate),
ranked AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) AS r FROM hits),
kept AS (SELECT ranked.query, id FROM ranked JOIN q USING (query) WHERE r <= row_limit),
sizes AS (SELECT query, count(*) AS n FROM kept GROUP BY 1)
SELECT q.query, q.intent, CASE WHEN q.intent = 'count' THEN (SELECT count(*) FROM golden) ELSE coalesce(n, 0) END AS count, id
FROM q LEFT JOIN sizes USING (query) LEFT JOIN kept USING (query)""")
def query_answers(spark, sf):
    return answer(asked(spark, sf), i.golden(spark, sf))
