"""Inputs of the registered queries, derived from the given tables.

``contacts`` is one submitted contact record per order, with noise that depends on keys
only, so that both engines derive the same rows at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators.lookup import lookup_join
from contactloom.operators.transform import transform_rows, valid_rows, with_issues
from contactloom.plans.registry import table
from contactloom.session import spread, stage

CONTACTS_SQL = """
SELECT o_orderkey + 2 AS source_row,
       CAST(o_orderkey % 5 + 1 AS INT) AS upload_file_id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            WHEN o_orderkey % 13 = 0 THEN 'not-an-email'
            WHEN o_orderkey % 3 = 0 THEN upper(concat('user', CAST(c_custkey AS STRING), '@example.com'))
            ELSE concat('  user', CAST(c_custkey AS STRING), '@example.com ') END AS email,
       CASE WHEN o_orderkey % 7 = 0 THEN '   '
            WHEN o_orderkey % 17 = 0 THEN 'n/a'
            WHEN o_orderkey % 19 = 0 THEN concat('5-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))
            WHEN o_orderkey % 2 = 0 THEN concat('+1 (555) ', substr(lpad(CAST(c_custkey AS STRING), 7, '0'), 1, 3), '-', substr(lpad(CAST(c_custkey AS STRING), 7, '0'), 4, 4))
            ELSE concat('1.555.', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS phone,
       CASE WHEN o_orderkey % 10 = 1 THEN NULL
            WHEN c_custkey % 4 = 0 THEN 'alice' WHEN c_custkey % 4 = 1 THEN 'BOB'
            WHEN c_custkey % 4 = 2 THEN 'mary-jane' ELSE concat('O', chr(39), 'NEIL') END AS first_name,
       lower(c_mktsegment) AS last_name,
       CASE WHEN o_orderkey % 4 = 0 THEN c_name ELSE NULL END AS full_name,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE n_name END AS city,
       lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') AS postal_code,
       CASE WHEN n_regionkey = 0 THEN 'united states' WHEN n_regionkey = 1 THEN ' UK '
            WHEN n_regionkey = 2 THEN 'Canada' WHEN n_regionkey = 3 THEN 'in' ELSE lower(n_name) END AS country,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS created_date,
       o_orderpriority AS loyalty_tier
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

DATA_COLUMNS = [
    "email", "phone", "first_name", "last_name", "full_name", "city", "postal_code", "country",
    "created_date", "loyalty_tier",
]

# The same cleaning in SQL. The fixture is ASCII, so title case is a capital at the start
# of every run of letters.
_TITLE = """array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z]+|[^A-Za-z]+'),
    lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"""


def _name_sql(c: str) -> str:
    t = f"trim({c})"
    return (
        f"nullif(CASE WHEN {t} SIMILAR TO '.*[A-Za-z].*' AND ({t} = upper({t}) OR {t} = lower({t})) "
        f"THEN {_TITLE.format(c=t)} ELSE {t} END, '')"
    )


COUNTRY_SQL = """CASE lower(trim(country))
    WHEN 'united states' THEN 'US' WHEN 'usa' THEN 'US' WHEN 'u.s.a.' THEN 'US' WHEN 'us' THEN 'US'
    WHEN 'united kingdom' THEN 'GB' WHEN 'uk' THEN 'GB' WHEN 'great britain' THEN 'GB'
    WHEN 'canada' THEN 'CA' WHEN 'ca' THEN 'CA' WHEN 'australia' THEN 'AU' WHEN 'au' THEN 'AU'
    WHEN 'india' THEN 'IN' WHEN 'in' THEN 'IN' WHEN 'germany' THEN 'DE' WHEN 'de' THEN 'DE'
    WHEN 'france' THEN 'FR' WHEN 'fr' THEN 'FR' ELSE nullif(upper(trim(country)), '') END"""

EMAIL_SQL = "nullif(lower(trim(email)), '')"
PHONE_SQL = "nullif(regexp_replace(phone, '[^0-9+]', '', 'g'), '')"
FIRST_SQL, LAST_SQL, FULL_SQL = _name_sql("first_name"), _name_sql("last_name"), _name_sql("full_name")

CLEAN_SQL = f"""
SELECT source_row, upload_file_id, email, phone, first_name, last_name,
       coalesce(full_name, CASE WHEN first_name IS NOT NULL AND last_name IS NOT NULL
                                THEN first_name || ' ' || last_name END) AS full_name,
       city, postal_code, country, created_date, loyalty_tier
FROM (SELECT source_row, upload_file_id, {EMAIL_SQL} AS email, {PHONE_SQL} AS phone,
             {FIRST_SQL} AS first_name, {LAST_SQL} AS last_name, {FULL_SQL} AS full_name,
             nullif(trim(city), '') AS city, nullif(trim(postal_code), '') AS postal_code,
             {COUNTRY_SQL} AS country, nullif(trim(created_date), '') AS created_date,
             nullif(trim(loyalty_tier), '') AS loyalty_tier
      FROM contacts)
"""

BAD_EMAIL_SQL = "email IS NOT NULL AND NOT regexp_matches(email, '^[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}$')"
BAD_PHONE_SQL = "phone IS NOT NULL AND NOT regexp_matches(phone, '^\\+?[0-9\\s\\-().]{7,20}$')"

WITH_CONTACTS = f"WITH contacts AS ({CONTACTS_SQL})"
WITH_CLEAN = f"{WITH_CONTACTS}, clean AS ({CLEAN_SQL})"
WITH_VALID = f"{WITH_CLEAN}, valid AS (SELECT * FROM clean WHERE NOT ({BAD_EMAIL_SQL}))"
_KEYS = [("email",), ("phone", "full_name"), ("first_name", "last_name", "postal_code")]


def first_seen_ctes(source: str, rid: str, key_sets=_KEYS, scope: str = "", seen: str = "seen") -> str:
    """Steps of a WITH RECURSIVE up to ``seen`` (rid, primary_id, key_set), the ordered rule in rounds: open
    records that come first at all their keys are unique, those that share a key with one are duplicates, both leave."""
    lead = f"CAST({scope} AS VARCHAR) || chr(31) || " if scope else ""
    keys = ", ".join(f"{lead}{' || chr(31) || '.join(f'lower({p})' for p in parts)} AS k{n}" for n, parts in enumerate(key_sets))
    names = [f"k{n}" for n in range(len(key_sets))]
    columns = ", ".join(names)
    first = " AND ".join(f"({k} IS NULL OR rid = min(rid) OVER (PARTITION BY {k}))" for k in names)
    shares = " OR ".join(f"({k} IS NOT NULL AND bool_or(u) OVER (PARTITION BY {k}))" for k in names)

    def held(table: str, where: str) -> str:
        return " UNION ALL ".join(f"SELECT rid, {n} AS key_set, {k} AS key FROM {table} WHERE {where} AND {k} IS NOT NULL" for n, k in enumerate(names))

    return f"""{seen}_wide AS (SELECT {rid} AS rid, {keys} FROM {source}),
{seen}_rounds(rid, {columns}, s) AS (
  SELECT rid, {columns}, 'open' FROM {seen}_wide
  UNION ALL
  SELECT rid, {columns}, CASE WHEN u THEN 'unique' WHEN {shares} THEN 'duplicate' ELSE 'open' END
  FROM (SELECT *, {first} AS u FROM {seen}_rounds WHERE s = 'open')),
{seen}_owned AS ({held(f"{seen}_rounds", "s = 'unique'")}),
{seen}_held AS ({held(f"{seen}_wide", "true")}),
{seen}_hits AS (SELECT h.rid, min(h.key_set) AS key_set, min_by(o.rid, h.key_set) AS owner
  FROM {seen}_held h JOIN {seen}_owned o ON h.key_set = o.key_set AND h.key = o.key WHERE o.rid < h.rid GROUP BY h.rid),
{seen} AS (SELECT rid, coalesce(owner, rid) AS primary_id, key_set FROM {seen}_wide LEFT JOIN {seen}_hits USING (rid))"""


def first_seen_sql(rid: str = "source_row", scope: str = "") -> str:
    """A WITH head over ``valid``."""
    return f"{WITH_VALID.replace('WITH', 'WITH RECURSIVE', 1)},\n{first_seen_ctes('valid', rid, scope=scope)}"


# Golden table of the explorer queries: one record per valid row; the first row of an
# e-mail within a file survives, the others are marked as merged into it.
GOLDEN_SQL = """
SELECT source_row AS id, upload_file_id AS batch_id, email, phone, full_name, first_name, last_name,
       CAST(NULL AS STRING) AS address_line1, CAST(NULL AS STRING) AS address_line2, city,
       CAST(NULL AS STRING) AS state, postal_code, country,
       CASE WHEN email IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY upload_file_id, email) END AS source_count,
       email IS NOT NULL AND source_row > min(source_row) OVER (PARTITION BY upload_file_id, email) AS is_duplicate,
       CASE WHEN email IS NOT NULL AND source_row > min(source_row) OVER (PARTITION BY upload_file_id, email)
            THEN min(source_row) OVER (PARTITION BY upload_file_id, email) END AS merged_into_id,
       created_date AS created_at, created_date AS updated_at, loyalty_tier
FROM valid
"""
WITH_GOLDEN = f"{WITH_VALID}, golden AS ({GOLDEN_SQL})"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(table(spark, sf_dir, "orders")).createOrReplaceTempView("orders")
    for name in ("customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(CONTACTS_SQL)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_rows(contacts(spark, sf_dir))


def checked(spark: SparkSession, sf_dir: str, only: str = "true") -> DataFrame:
    """``only`` limits the raw rows: a condition on raw columns belongs before the cleaning."""
    return with_issues(transform_rows(contacts(spark, sf_dir).where(only)))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(checked(spark, sf_dir))


_golden_tables: dict[tuple[str, str], DataFrame] = {}


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden table that explorer, dashboard and export queries read: written once
    per session, as those queries run against a stored table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _golden_tables:
        _golden_tables[key] = stage(golden_rows(spark, sf_dir), "golden")
    return _golden_tables[key]


def golden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See GOLDEN_SQL. Counts and survivors per e-mail are an aggregate joined back, not a
    window, so that no e-mail gathers its rows in one task."""
    rows = stage(valid(spark, sf_dir), "valid")
    with_email = rows.where("email IS NOT NULL")
    groups = stage(
        with_email.groupBy("upload_file_id", "email").agg(
            F.min("source_row").alias("first_id"), F.count("*").alias("source_count"), F.count("*").alias("_n")
        ), "groups",
    )
    grouped = lookup_join(with_email, groups, ["upload_file_id", "email"], "_n")
    alone = rows.where("email IS NULL").withColumns(
        {"first_id": F.col("source_row"), "source_count": F.lit(1).cast("bigint")}
    )
    none = F.lit(None).cast("string")
    duplicate = F.col("source_row") > F.col("first_id")
    return grouped.unionByName(alone).select(
        F.col("source_row").alias("id"), F.col("upload_file_id").alias("batch_id"), "email", "phone",
        "full_name", "first_name", "last_name", none.alias("address_line1"), none.alias("address_line2"),
        "city", none.alias("state"), "postal_code", "country", "source_count",
        duplicate.alias("is_duplicate"), F.when(duplicate, F.col("first_id")).alias("merged_into_id"),
        F.col("created_date").alias("created_at"), F.col("created_date").alias("updated_at"), "loyalty_tier",
    )
