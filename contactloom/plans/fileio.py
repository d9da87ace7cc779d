"""Files: written from the contacts, read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.plans import inputs as i
from contactloom.plans.registry import query, table
from contactloom.session import new_path, stage
from contactloom.sources import files, formats

FIELDS = ["source_row", "email", "phone", "full_name", "city", "country"]
_READ_SQL = "CAST(source_row AS VARCHAR) AS source_row, nullif(trim(email), '') AS email, nullif(trim(phone), '') AS phone, full_name, city, trim(country) AS country"
_RAW_CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "emptyValue": ""}


def _texts(df, columns):
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


@query("csv_scan", f"{i.WITH_CONTACTS} SELECT {_READ_SQL} FROM contacts")
def csv_scan(spark, sf):
    path = new_path(spark, "csv")
    _texts(i.contacts(spark, sf), FIELDS).write.options(**_RAW_CSV).csv(path)
    return files.read_csv(spark, path).select(*FIELDS)


@query("csv_delimiter", f"""{i.WITH_CONTACTS}
SELECT {_READ_SQL}, list_element([',', ';', chr(9), '|', ','], upload_file_id) AS delimiter FROM contacts""")
def csv_delimiter(spark, sf):
    """Four delimiters in one folder: found per file, each layout read once."""
    path = new_path(spark, "delimiters")
    rows = stage(i.contacts(spark, sf).select("upload_file_id", *FIELDS), "rows")
    for n, sep in enumerate([",", ";", "\t", "|", ","]):
        part = _texts(rows.where(F.col("upload_file_id") == n + 1), FIELDS)
        part.write.options(sep=sep, **_RAW_CSV).csv(f"{path}/{n}")
    return files.read_csv_folder(spark, path, ordinals=False).select(*FIELDS, F.col("_delimiter").alias("delimiter"))


@query("decode_text", "SELECT doc_id, text FROM documents")
def decode_text(spark, sf):
    """Every second text that Latin-1 can hold is stored in it, the others as UTF-8, every
    third of those with a leading mark."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    latin = (F.col("doc_id") % 2 == 1) & ~F.col("text").rlike(r"[^\x00-\xff]")
    utf8 = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(formats.BOM), F.col("text"))).otherwise(F.col("text"))
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode(utf8, "UTF-8"))
    return docs.select("doc_id", content.alias("content")).select(
        "doc_id", formats.decode_text(F.col("content")).alias("text")
    )


def _hygiene_lines(spark, sf):
    """CSV lines without header; every tenth is followed by a row of empty cells, every
    seventh has a cell too many, every ninth one too few."""
    n = F.col("source_row")
    row = F.concat_ws(",", n.cast("string"), F.concat(F.lit("  "), F.coalesce("city", F.lit("")), F.lit(" ")))
    line = F.when(n % 7 == 0, F.concat(row, F.lit(",x,extra"))).when(n % 9 == 0, row).otherwise(F.concat(row, F.lit(",x")))
    lines = F.when(n % 10 == 0, F.array(line, F.lit(" , ,"))).otherwise(F.array(line))
    path = new_path(spark, "hygiene")
    i.contacts(spark, sf).select(F.explode(lines).alias("value")).write.text(path)
    return files.read_csv(spark, path, columns=["source_row", "city", "mark"], ordinals=False, multi_line=False)


# A reader of header-less lines names the columns itself.
@query("row_hygiene", f"""{i.WITH_CONTACTS}
SELECT CAST(source_row AS VARCHAR) AS source_row, trim(city) AS city, source_row % 7 = 0 AS overflow,
       CASE WHEN source_row % 9 = 0 AND source_row % 7 <> 0 THEN NULL ELSE 'x' END AS mark FROM contacts""")
def row_hygiene(spark, sf):
    return _hygiene_lines(spark, sf).select("source_row", "city", F.col("_overflow").alias("overflow"), "mark")


@query("extract_report", f"""{i.WITH_CONTACTS}
SELECT count(*) AS total_rows, count(*) FILTER (source_row % 7 = 0) AS overflow_rows FROM contacts""")
def extract_report(spark, sf):
    report = files.csv_report(_hygiene_lines(spark, sf))
    return report.agg(F.sum("total_rows").alias("total_rows"), F.sum("overflow_rows").alias("overflow_rows"))


@query("source_row", f"""{i.WITH_CONTACTS}
SELECT upload_file_id, source_row AS id, row_number() OVER (PARTITION BY upload_file_id ORDER BY source_row) + 1 AS source_row FROM contacts""")
def source_row(spark, sf):
    """One folder per uploaded file, its rows in order; records count from 2."""
    path = new_path(spark, "ordinals")
    rows = i.contacts(spark, sf).select("upload_file_id", F.col("source_row").alias("id"), "city")
    spread = rows.repartition("upload_file_id").sortWithinPartitions("upload_file_id", "id")
    spread.write.partitionBy("upload_file_id").options(**_RAW_CSV).csv(path)
    read = files.read_csv(spark, path, columns=["id", "city"], header=True, multi_line=False)
    in_path = F.regexp_extract("_file", r"upload_file_id=(\d+)", 1).cast("int")
    return read.select(in_path.alias("upload_file_id"), F.col("id").cast("bigint").alias("id"), F.col("_source_row").alias("source_row"))


# --- JSON -----------------------------------------------------------------------------------------

_ITEM = ["source_row", "email", "city"]


def _documents(spark, sf, per_doc=100):
    """JSON documents of up to a hundred records: id, and the records' JSON in order."""
    rows = i.contacts(spark, sf).select(
        F.floor(F.col("source_row") / per_doc).alias("doc_id"), "source_row",
        F.to_json(F.struct(*_ITEM), {"ignoreNullFields": "false"}).alias("item"),
    )
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source_row", "item"))).alias("items"))
    return listed.select("doc_id", F.array_join(F.transform("items", lambda r: r["item"]), ",").alias("body"))


def _fields(records, keys):
    field = lambda name, kind: F.try_variant_get("item", f"$.{name}", kind).alias(name)
    return records.select(*keys, field("source_row", "bigint"), field("email", "string"), field("city", "string"))


_DOC_ROW = "CAST(floor(source_row / 100) AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY floor(source_row / 100) ORDER BY source_row) AS ordinal"


@query("json_scan", f"{i.WITH_CONTACTS} SELECT {_DOC_ROW}, source_row, email, city FROM contacts")
def json_scan(spark, sf):
    docs = _documents(spark, sf).select("doc_id", F.concat(F.lit("["), "body", F.lit("]")).alias("value"))
    path = new_path(spark, "json")
    docs.select(F.to_json(F.struct("doc_id", "value")).alias("value")).write.text(path)
    back = spark.read.text(path).select(F.from_json("value", "doc_id bigint, value string").alias("d")).select("d.*")
    return _fields(files.json_items(back, "doc_id").withColumnRenamed("_source_row", "ordinal"), ["doc_id", "ordinal"])


@query("json_unwrap", f"""{i.WITH_CONTACTS}
SELECT {_DOC_ROW}, source_row, email, city FROM contacts""")
def json_unwrap(spark, sf):
    """Three shapes: an array, an object with the array under a key, two arrays of which
    only one holds objects."""
    kind = F.col("doc_id") % 3
    value = (
        F.when(kind == 0, F.concat(F.lit("["), "body", F.lit("]")))
        .when(kind == 1, F.concat(F.lit('{"total": 3, "customers": ['), "body", F.lit("]}")))
        .otherwise(F.concat(F.lit('{"codes": [1, 2], "rows": ['), "body", F.lit("]}")))
    )
    docs = _documents(spark, sf).select("doc_id", value.alias("value"))
    return _fields(files.json_items(docs, "doc_id").withColumnRenamed("_source_row", "ordinal"), ["doc_id", "ordinal"])


@query("json_non_objects", f"""{i.WITH_CONTACTS}
SELECT CAST(source_row AS BIGINT) AS id, 'Row ' || n || ': expected object, got ' || t || ' — skipped' AS error
FROM contacts, (VALUES (2, 'int'), (3, 'str'), (4, 'list'), (5, 'NoneType'), (6, 'bool'), (7, 'float')) v(n, t)""")
def json_non_objects(spark, sf):
    body = F.concat(F.lit('[{"a": 1}, '), F.col("source_row").cast("string"), F.lit(', "text", [1], null, true, 2.5]'))
    docs = i.contacts(spark, sf).select(F.col("source_row").alias("id"), body.alias("value"))
    _, errors = files.split_objects(files.json_items(docs, "id"))
    return errors.select("id", "error")


@query("bad_documents", f"""{i.WITH_CONTACTS}
SELECT CAST(source_row AS BIGINT) AS id, CASE source_row % 4 WHEN 0 THEN 'JSON parse error' WHEN 1 THEN 'Unexpected top-level JSON type: int'
       ELSE 'Unexpected top-level JSON type: str' END AS error FROM contacts WHERE source_row % 4 <> 3""")
def bad_documents(spark, sf):
    """Broken documents give an error each and no exception."""
    n = F.col("source_row")
    value = F.when(n % 4 == 0, '{"a": ').when(n % 4 == 1, "17").when(n % 4 == 2, '"x"').otherwise('[{"a": 1}]')
    return files.json_errors(i.contacts(spark, sf).select(n.alias("id"), value.alias("value")), "id")


def _ndjson(spark, sf):
    """A line per contact; every ninth is cut off, every fifth followed by a blank line."""
    item = F.to_json(F.struct(*_ITEM))
    n = F.col("source_row")
    line = F.when(n % 9 == 0, F.substring(item, 1, 20)).otherwise(item)
    lines = F.when(n % 5 == 0, F.array(line, F.lit("  "))).otherwise(F.array(line))
    path = new_path(spark, "ndjson")
    i.contacts(spark, sf).select(F.explode(lines).alias("value")).write.text(path)
    return files.read_ndjson(spark, path, "source_row bigint, email string, city string")


@query("ndjson_scan", f"{i.WITH_CONTACTS} SELECT source_row, email, city FROM contacts WHERE source_row % 9 <> 0")
def ndjson_scan(spark, sf):
    return _ndjson(spark, sf)[0].select(*_ITEM)


@query("ndjson_errors", f"""{i.WITH_CONTACTS}
SELECT substr('{{"source_row":' || source_row || ',"email":"' || coalesce(email, '"') || '"', 1, 13) AS start, 'JSON parse error' AS error
FROM contacts WHERE source_row % 9 = 0""")
def ndjson_errors(spark, sf):
    errors = _ndjson(spark, sf)[1]
    message = F.regexp_replace("error", "^Line [0-9]+: ", "")
    return errors.select(F.substring("value", 1, 13).alias("start"), message.alias("error"))


_NESTED_SQL = """SELECT o_orderkey AS id, c_name AS customer__name, n_name AS customer__nation__name,
   n_regionkey AS customer__nation__region, '["' || o_orderstatus || '","x"]' AS tags"""


def _nested(spark, sf):
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"))
    inner = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return joined.select(
        F.col("o_orderkey").alias("id"), F.struct(F.col("c_name").alias("name"), inner.alias("nation")).alias("customer"),
        F.array("o_orderstatus", F.lit("x")).alias("tags"),
    )


@query("json_flatten", f"""SELECT id, customer__name, customer__nation__name, CAST(customer__nation__region AS VARCHAR) AS customer__nation__region, 'x' AS tags FROM (
{_NESTED_SQL} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""")
def json_flatten(spark, sf):
    """Known schema: one projection."""
    path = new_path(spark, "nested")
    _nested(spark, sf).write.json(path)
    kind = "id bigint, customer struct<name:string, nation:struct<name:string, region:string>>, tags array<string>"
    return files.flatten(spark.read.schema(kind).json(path))


@query("json_flatten_open", f"""WITH n AS ({_NESTED_SQL} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT id, 'id' AS path, CAST(id AS VARCHAR) AS value FROM n UNION ALL SELECT id, 'customer__name', customer__name FROM n
UNION ALL SELECT id, 'customer__nation__name', customer__nation__name FROM n
UNION ALL SELECT id, 'customer__nation__region', CAST(customer__nation__region AS VARCHAR) FROM n
UNION ALL SELECT id, 'tags', tags FROM n
UNION ALL SELECT -event_id - 1, 'k', regexp_extract(props, '[0-9]+') FROM events""")
def json_flatten_open(spark, sf):
    """Unknown schema: leaves as rows; lists stay JSON text."""
    rows = _nested(spark, sf)
    items = rows.select("id", F.try_parse_json(F.to_json(F.struct(*rows.columns))).alias("item"))
    events = table(spark, sf, "events").select((-F.col("event_id") - 1).alias("id"), F.try_parse_json("props").alias("item"))
    return files.flatten_items(items.unionByName(events), ["id"])


# --- XML ------------------------------------------------------------------------------------------

@query("xml_scan", f"{i.WITH_CONTACTS} SELECT CAST(source_row AS VARCHAR) AS source_row, full_name, city, postal_code FROM contacts")
def xml_scan(spark, sf):
    path = new_path(spark, "xml")
    fields = ["source_row", "full_name", "city", "postal_code"]
    _texts(i.contacts(spark, sf), fields).write.format("xml").options(rowTag="customer", rootTag="customers").save(path)
    records, _ = files.read_xml_folder(spark, path, ", ".join(f"{f} string" for f in fields))
    return records["customer"].select(*fields)


@query("xml_flatten", """
SELECT CAST(o_orderkey AS VARCHAR) AS "@id", c_name AS customer__name, CAST(c_nationkey AS VARCHAR) AS "customer@nation", '2' AS tag
FROM orders JOIN customer ON o_custkey = c_custkey""")
def xml_flatten(spark, sf):
    """Attributes, nested elements and a repeated element, of which the last counts."""
    path = new_path(spark, "xmlnested")
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nested = F.struct(F.col("c_nationkey").alias("@nation"), F.col("c_name").alias("name"))
    orders.select(
        F.col("o_orderkey").alias("@id"), nested.alias("customer"), F.array(F.lit("1"), F.lit("2")).alias("tag")
    ).write.format("xml").options(rowTag="order", rootTag="orders", attributePrefix="@").save(path)
    kind = "`@id` string, customer struct<`@nation`:string, name:string>, tag array<string>"
    return files.flatten(files.read_xml(spark, path, "order", kind))


def _xml_documents(spark, sf):
    """One document per contact; a namespace, and a broken end in every sixth."""
    n = F.col("source_row")
    body = F.when(n % 3 == 0, "<note/><c:row/><c:row/>").when(n % 3 == 1, "<a/><b/>").otherwise("")
    end = F.when(n % 6 == 5, "<broken>").otherwise("</c:root>")
    doc = F.concat(F.lit('<c:root xmlns:c="urn:x">'), body, end)
    return i.contacts(spark, sf).select(n.cast("string").alias("_file"), F.encode(doc, "UTF-8").alias("content"))


@query("xml_record_tag", f"""{i.WITH_CONTACTS}
SELECT CAST(source_row AS VARCHAR) AS id, CASE source_row % 3 WHEN 0 THEN 'row' ELSE 'a' END AS record_tag
FROM contacts WHERE source_row % 3 < 2 AND source_row % 6 <> 5""")
def xml_record_tag(spark, sf):
    return files.xml_record_tags(files.xml_children(_xml_documents(spark, sf))).withColumnRenamed("_file", "id")


@query("bad_files", f"""{i.WITH_CONTACTS}
SELECT CAST(source_row AS VARCHAR) AS id, CASE source_row % 6 WHEN 5 THEN 'XML parse error'
       ELSE 'Could not detect record element in XML' END AS error FROM contacts WHERE source_row % 3 = 2""")
def bad_files(spark, sf):
    errors = files.xml_children(_xml_documents(spark, sf)).where("error IS NOT NULL")
    return errors.select(F.col("_file").alias("id"), F.split("error", ":")[0].alias("error"))


# --- names, sizes, checksums ----------------------------------------------------------------------

_EXT = ["csv", "JSON", "ndjson", "xls", "Xlsx", "xml", "pdf", "txt"]
_UPLOADS_SQL = f"""uploads AS (
SELECT 'https://h/' || doc_id || '/file' || doc_id || '.' || list_element({_EXT}, CAST(doc_id % 8 + 1 AS INT)) AS path, n_chars AS length FROM documents
UNION ALL SELECT url, length(html) FROM pages)"""


def _uploads(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("doc_id") % 8 + 1).cast("int"))
    number = F.col("doc_id").cast("string")
    name = F.concat(F.lit("https://h/"), number, F.lit("/file"), number, F.lit("."), ext)
    docs = table(spark, sf, "documents").select(name.alias("path"), F.col("n_chars").alias("length"))
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.length("html").cast("bigint").alias("length"))
    return docs.unionByName(pages)


_EXT_SQL = "regexp_extract(lower(path), '[^/]\\.([^./]+)$', 1)"
_FORMAT_SQL = f"CASE {_EXT_SQL} WHEN 'csv' THEN 'csv' WHEN 'json' THEN 'json' WHEN 'ndjson' THEN 'json' WHEN 'xlsx' THEN 'xlsx' WHEN 'xml' THEN 'xml' WHEN 'pdf' THEN 'pdf' END"
_MESSAGE_SQL = f"""'Unsupported file format: ''.' || ext || '''' || CASE WHEN ext = 'xls' THEN ' (legacy .xls is not supported; convert to .xlsx first)' ELSE '' END
  || '. Supported: [''csv'', ''json'', ''ndjson'', ''pdf'', ''xlsx'', ''xml'']'"""


@query("file_format", f"""WITH {_UPLOADS_SQL}, f AS (SELECT path, {_EXT_SQL} AS ext, {_FORMAT_SQL} AS file_format FROM uploads)
SELECT path, file_format, CASE WHEN file_format IS NULL THEN {_MESSAGE_SQL} END AS error FROM f""")
def file_format(spark, sf):
    path = F.col("path")
    return _uploads(spark, sf).select(
        "path", formats.stored_format(path).alias("file_format"), formats.format_error(path).alias("error")
    )


@query("admission", f"""WITH {_UPLOADS_SQL}, f AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS path, length FROM uploads),
g AS (SELECT path AS name, length, {_EXT_SQL} AS ext, {_FORMAT_SQL} AS file_format FROM f)
SELECT name, length, file_format, CASE WHEN name = '' THEN 'Invalid or missing filename.'
  WHEN file_format IS NULL THEN {_MESSAGE_SQL} WHEN length <= 0 THEN 'Uploaded file is empty.'
  WHEN length > 500 THEN 'File too large (' || length || ' bytes). Maximum allowed is 500 bytes.' END AS reason FROM g""")
def admission(spark, sf):
    from contactloom.config import Config

    checked = formats.admission(_uploads(spark, sf), Config(max_upload_bytes=500))
    return checked.select("name", "length", "file_format", "reason")


@query("content_md5", """
SELECT md5(text) AS checksum, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def content_md5(spark, sf):
    return formats.exact_copies(table(spark, sf, "documents"), "text", "doc_id")
