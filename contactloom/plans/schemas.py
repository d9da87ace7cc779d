"""Schema detection and mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.config import ALIASES
from contactloom.operators import schema
from contactloom.operators.transform import computed_once
from contactloom.plans import inputs as i
from contactloom.plans.registry import query, table

# What each of the five files calls the fields.
HEADERS = {
    "email": ["Email", "email_address", "E_Mail", "customer_email", "EMAIL"],
    "phone": ["Phone Number", "mobile", "tel", "cell", "PHONE"],
    "first_name": ["First Name", "fname", "given", "first", "FIRST_NAME"],
    "last_name": ["Last Name", "surname", "family_name", "last", "lname"],
    "full_name": ["name", "Full Name", "customer_name", "fullname", "NAME"],
    "city": ["City", "town", "CITY", "Town", "city"],
    "postal_code": ["ZIP Code", "zip", "postcode", "Postal Code", "ZIP"],
    "country": ["nation", "COUNTRY", "Country", "country", "Nation"],
    "created_date": ["signup_date", "created_at", "join_date", "registration_date", "date_created"],
    "loyalty_tier": ["loyalty_tier", "Tier", "tier", "loyalty", "Loyalty Tier"],
}


def raw_rows(spark, sf):
    """Contacts as sparse rows with the names of their file; empty cells are left out."""
    rows = i.contacts(spark, sf)
    def entry(field, names):
        name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("upload_file_id"))
        return F.struct(name.alias("key"), F.col(field).alias("value"))
    entries = F.filter(F.array(*[entry(f, n) for f, n in HEADERS.items()]), lambda e: e["value"].isNotNull())
    return computed_once(rows.select(
        F.col("upload_file_id").alias("file_id"), "source_row", F.map_from_entries(entries).alias("raw")
    ), "raw")


RAW_SQL = "raw AS (" + " UNION ALL ".join(
    f"SELECT upload_file_id AS file_id, source_row, list_element({names}, upload_file_id) AS \"column\", {field} AS value, "
    f"'{field}' AS field FROM contacts WHERE {field} IS NOT NULL" for field, names in HEADERS.items()
) + ")"
WITH_RAW = f"{i.WITH_CONTACTS}, {RAW_SQL}"
_ALIAS_ROWS = ", ".join(f"('{a}', '{c}')" for c, names in ALIASES.items() for a in names)
WITH_NAMED = f"""{WITH_RAW}, aliases(alias, canonical) AS (VALUES {_ALIAS_ROWS}),
named AS (SELECT raw.*, coalesce(canonical, "column") AS canonical, canonical IS NULL AS is_unknown
          FROM raw LEFT JOIN aliases ON lower("column") = alias)"""


@query("alias_map", f"""{WITH_NAMED}
SELECT file_id, "column", canonical, count(*) AS rows FROM named GROUP BY ALL""")
def alias_map(spark, sf):
    cells = raw_rows(spark, sf).select("file_id", F.explode(F.map_keys("raw")).alias("column"))
    counted = cells.groupBy("file_id", "column").agg(F.count("*").alias("rows"))
    return schema.alias_table(counted).drop("is_unknown")


@query("apply_mapping", f"""{i.WITH_CONTACTS}
SELECT source_row, full_name AS email, city FROM contacts""")
def apply_mapping(spark, sf):
    rows = i.contacts(spark, sf).select(
        "source_row", F.col("email").alias("Email"), F.col("city").alias("Town"), F.col("full_name").alias("email_address")
    )
    return schema.map_columns(rows)


@query("apply_mapping_open", f"""{WITH_NAMED}
SELECT file_id, source_row, canonical, value FROM named""")
def apply_mapping_open(spark, sf):
    mapped = schema.map_open_rows(raw_rows(spark, sf))
    return mapped.select("file_id", "source_row", F.explode("mapped").alias("canonical", "value"))


def _type_sql(v: str) -> str:
    return f"""CASE WHEN lower({v}) IN ('true', 'false', 'yes', 'no', '1', '0') THEN 'boolean'
      WHEN regexp_matches({v}, '^([0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}|[0-9]{{2}}[-/][0-9]{{2}}[-/][0-9]{{4}})$') THEN 'date'
      WHEN regexp_matches({v}, '^[+-]?[0-9]+$') THEN 'integer'
      WHEN regexp_matches({v}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' ELSE 'string' END"""


TYPED_TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"],
    "events": ["event_id", "event_type", "value", "props"],
}
_CELLS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM {t}" for t, cs in TYPED_TABLES.items() for c in cs
)
_PLURALITY = """SELECT {by}, arg_max(t, n * 10 - CASE t WHEN 'integer' THEN 0 WHEN 'float' THEN 1 WHEN 'boolean' THEN 2 WHEN 'date' THEN 3 ELSE 4 END) AS inferred_type,
  CAST(sum(n) AS BIGINT) AS value_count FROM (SELECT {by}, t, count(*) AS n FROM ({cells}) GROUP BY ALL) GROUP BY ALL"""


@query("infer_types", _PLURALITY.format(
    by='table_name, "column"', cells=f'SELECT table_name, "column", {_type_sql("v")} AS t FROM ({_CELLS})'))
def infer_types(spark, sf):
    found = None
    for name, columns in TYPED_TABLES.items():
        part = schema.infer_column_types(table(spark, sf, name), columns).withColumn("table_name", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


@query("unknown_columns", f"""{WITH_NAMED} SELECT DISTINCT file_id, "column" FROM named WHERE is_unknown""")
def unknown_columns(spark, sf):
    return schema.alias_table(schema.column_union(raw_rows(spark, sf))).where("is_unknown").select("file_id", "column")


@query("column_union", f"""{WITH_RAW} SELECT DISTINCT file_id, "column" FROM raw""")
def column_union(spark, sf):
    return schema.column_union(raw_rows(spark, sf))


@query("column_sample", f"""{WITH_RAW}, ranked AS (SELECT file_id, source_row, dense_rank() OVER (PARTITION BY file_id ORDER BY source_row) AS n FROM raw)
SELECT DISTINCT file_id, "column" FROM raw JOIN (SELECT DISTINCT file_id, source_row FROM ranked WHERE n <= 20) USING (file_id, source_row)""")
def column_sample(spark, sf):
    """The columns that the first twenty rows of each file have."""
    return schema.column_union(schema.sample_rows(raw_rows(spark, sf), 20))


_LABEL = i._TITLE.format(c="replace(canonical, '_', ' ')")


@query("discover_attributes", f"""{WITH_NAMED}
SELECT canonical AS name, {_LABEL} AS label, string_agg(DISTINCT "column", ',' ORDER BY "column") AS source_names,
       count(DISTINCT file_id) AS file_count FROM named GROUP BY canonical""")
def discover_attributes(spark, sf):
    found = schema.attributes(schema.column_union(raw_rows(spark, sf)))
    return found.select("name", "label", F.array_join("source_names", ",").alias("source_names"), "file_count")


@query("attribute_files", f"""{WITH_NAMED} SELECT DISTINCT canonical AS name, "column" AS source_name, file_id FROM named""")
def attribute_files(spark, sf):
    return schema.attribute_files(schema.column_union(raw_rows(spark, sf)))


@query("project_attributes", f"{i.WITH_CONTACTS} SELECT source_row AS _source_row, email, city, country FROM contacts")
def project_attributes(spark, sf):
    rows = i.contacts(spark, sf).withColumnRenamed("source_row", "_source_row")
    return schema.project_attributes(rows, [" email ", "city", "", "country", "email"])


@query("split_extra", f"""{i.WITH_CLEAN}
SELECT source_row, email, city, '{{"created_date":"' || created_date || '","loyalty_tier":"' || loyalty_tier || '"}}' AS extra FROM clean""")
def split_extra(spark, sf):
    rows = schema.split_extra(i.clean(spark, sf).drop("upload_file_id"), keep=["source_row"])
    return rows.select("source_row", "email", "city", F.to_json("extra_fields").alias("extra"))


@query("schema_summary", f"""{WITH_NAMED},
types AS ({_PLURALITY.format(by='file_id, "column", canonical, is_unknown', cells=f'SELECT file_id, "column", canonical, is_unknown, {_type_sql("trim(value)")} AS t FROM named WHERE trim(value) <> {chr(39)*2}')})
SELECT file_id, count(*) AS mapped_columns, string_agg("column", ',' ORDER BY "column") FILTER (is_unknown) AS unknown_columns,
       string_agg(canonical || ':' || inferred_type, ',' ORDER BY canonical || ':' || inferred_type) AS type_map FROM types GROUP BY file_id""")
def schema_summary(spark, sf):
    found = schema.schema_summary(raw_rows(spark, sf))
    return found.select(
        "file_id", "mapped_columns", F.array_join("unknown_columns", ",").alias("unknown_columns"),
        F.array_join("type_map", ",").alias("type_map"),
    )
