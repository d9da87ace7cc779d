"""Free text: fields, labels, tables, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.config import LABEL_VALUE_PATTERN, TEXT_PATTERNS
from contactloom.operators import text_fields as t
from contactloom.plans.registry import query, table
from contactloom.plans.rows import WS_SQL

TEXTS_SQL = """texts AS (SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"""


def texts(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")
    return docs.unionByName(turns)


_FIELD = {n: f"nullif(trim(regexp_extract(text, '{p.replace('(?:', '(?:')}', 0), {WS_SQL}), '')" for n, p in TEXT_PATTERNS.items()}
FIELDS_SQL = "SELECT id, " + ", ".join(f"{sql} AS {n}" for n, sql in _FIELD.items()) + " FROM texts"
_PAIRS = f"""pairs AS (SELECT id, generate_subscripts(l, 1) AS pos, unnest(l) AS label, unnest(v) AS value
  FROM (SELECT id, regexp_extract_all(text, '{LABEL_VALUE_PATTERN}', 1) AS l, regexp_extract_all(text, '{LABEL_VALUE_PATTERN}', 2) AS v FROM texts)),
named AS (SELECT id, pos, replace(lower(trim(label, {WS_SQL})), ' ', '_') AS label, trim(value, {WS_SQL}) AS value FROM pairs),
labels AS (SELECT id, label, arg_max(value, pos) AS value FROM named WHERE label <> '' AND value <> '' AND length(label) < 40 GROUP BY 1, 2)"""


@query("text_fields", f"WITH {TEXTS_SQL} {FIELDS_SQL}")
def text_fields(spark, sf):
    return t.text_fields(texts(spark, sf), ["id"])


@query("label_values", f"WITH {TEXTS_SQL}, {_PAIRS} SELECT * FROM labels")
def label_values(spark, sf):
    return t.label_values(texts(spark, sf), ["id"])


@query("text_records", f"""WITH {TEXTS_SQL}, {_PAIRS}, f AS ({FIELDS_SQL}),
g AS (SELECT id, 'email' AS label, email AS value FROM f UNION ALL SELECT id, 'phone', phone FROM f UNION ALL SELECT id, 'postal_code', postal_code FROM f),
h AS (SELECT * FROM g WHERE value IS NOT NULL)
SELECT * FROM h UNION ALL SELECT l.* FROM labels l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id = l.id AND h.label = l.label)""")
def text_records(spark, sf):
    return t.text_records(texts(spark, sf), ["id"])


@query("raw_text", f"WITH {TEXTS_SQL} SELECT id, text AS raw_text FROM texts")
def raw_text(spark, sf):
    return texts(spark, sf).select("id", t.raw_text(F.col("text")).alias("raw_text"))


@query("grid_rows", """
SELECT p_partkey AS id, 1 AS row_no, p_name AS "Name", p_type AS col_1, CAST(NULL AS VARCHAR) AS "Size" FROM part
UNION ALL SELECT p_partkey, 2, p_brand, 'z', CAST(p_size AS VARCHAR) FROM part""")
def grid_rows(spark, sf):
    """A table per part: an unnamed and a repeated column, a short and a blank row."""
    none = F.lit(None).cast("string")
    size = F.col("p_size").cast("string")
    grid = F.array(
        F.array(F.lit(" Name "), F.lit(""), F.lit("Size"), F.lit("Size")),
        F.array(F.col("p_name"), F.col("p_type")),
        F.array(none, F.lit(" "), F.lit("")),
        F.array(F.col("p_brand"), F.lit("z"), F.lit("first"), size),
    )
    rows = t.grid_rows(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), grid.alias("grid")), ["id"])
    return rows.select("id", "row_no", *[F.col("row")[c].alias(c) for c in ("Name", "col_1", "Size")])


_KIND = "role = 'assistant' AND turn % 2 = 1 AND conv_id % 3 = 0"


@query("page_kinds", f"""
WITH p AS (SELECT conv_id, turn + 1 AS page_no, {_KIND} AS has_table, CASE WHEN conv_id % 5 = 0 THEN '  ' ELSE text END AS text FROM conversations)
SELECT conv_id, count(*) AS pages_total, count(*) FILTER (has_table) AS table_pages,
       count(*) FILTER (NOT has_table AND trim(text, {WS_SQL}) <> '') AS text_pages,
       count(*) FILTER (NOT has_table AND trim(text, {WS_SQL}) = '') AS empty_pages,
       bool_and(NOT has_table AND trim(text, {WS_SQL}) = '') AS is_scanned, CAST(NULL AS VARCHAR) AS warning
FROM p GROUP BY conv_id""")
def page_kinds(spark, sf):
    """A conversation as a document, a turn as a page."""
    pages = table(spark, sf, "conversations").select(
        "conv_id", (F.col("turn") + 1).alias("page_no"), F.expr(_KIND).alias("has_table"),
        F.when(F.col("conv_id") % 5 == 0, "  ").otherwise(F.col("text")).alias("text"),
    )
    return t.page_kinds(pages, "conv_id")
