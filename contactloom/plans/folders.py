"""Folders of files, from bytes to checked rows, in every format and with damaged files among them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.integrate import integrate
from contactloom.plans import inputs as i
from contactloom.plans.registry import query
from contactloom.session import new_path
from contactloom.sinks import export

#: Headers of the files, and what they mean.
NAMES = {"email": "E_Mail", "phone": "Mobile", "first_name": "fname", "last_name": "surname", "city": "Town", "full_name": "name"}
FIELDS = ["source_row", "email", "phone", "full_name", "city", "country", "error_count"]
_ROWS = f"""{i.WITH_CLEAN}
SELECT source_row, email, phone, full_name, city, country, CASE WHEN {i.BAD_EMAIL_SQL} THEN 1 ELSE 0 END AS error_count FROM clean"""


def _contacts(spark: SparkSession, sf: str) -> DataFrame:
    rows = i.contacts(spark, sf).withColumn("ref", F.col("source_row").cast("string"))
    return rows.select("ref", "email", "phone", "first_name", "last_name", "full_name", "city", "country")


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    rows = integrate(spark, folder).checked
    return rows.withColumn("source_row", F.col("extra_fields")["ref"].cast("long")).select(*FIELDS)


def _as(spark: SparkSession, path: str, extension: str) -> None:
    """Gives the written parts of a folder an extension."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            system.rename(status.getPath(), hadoop.Path(path, name.rsplit(".", 1)[0] + extension))


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of a task as the lines of one document: an object with other members around the list."""
    yield pd.DataFrame({"value": ['{"made": {"by": ["nobody"], "n": 1},', '"rows": [']})
    before = " "
    for batch in batches:
        yield pd.DataFrame({"value": [before] + [x for r in batch["value"] for x in (r, ",")][:-1]})
        before = ","
    yield pd.DataFrame({"value": ["],", '"after": []}']})


def _write_json(rows: DataFrame, path: str) -> None:
    record = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
    rows.select(record.alias("value")).mapInPandas(_documents, "value string").write.text(path)
    _as(rows.sparkSession, path, ".json")


@query("integrate_json", _ROWS)
def integrate_json(spark, sf):
    """Documents of many lines, each record printed over several, in a wrapper."""
    folder = new_path(spark, "folder")
    _write_json(_contacts(spark, sf).withColumnsRenamed(NAMES), f"{folder}/a")
    return _checked(spark, folder)


@query("integrate_ndjson", _ROWS)
def integrate_ndjson(spark, sf):
    """A record per line, once under the name of the format and once as ``.json``."""
    folder = new_path(spark, "folder")
    rows = _contacts(spark, sf).withColumnsRenamed(NAMES)
    odd = F.col("ref").cast("long") % 2 == 1
    rows.where(odd).write.json(f"{folder}/a")
    rows.where(~odd).write.json(f"{folder}/b")
    _as(spark, f"{folder}/b", ".ndjson")
    return _checked(spark, folder)


@query("integrate_xml", _ROWS)
def integrate_xml(spark, sf):
    """Records with a nested element that has the records' own name."""
    folder = new_path(spark, "folder")
    rows = _contacts(spark, sf).withColumnsRenamed(NAMES | {"ref": "customer"})
    rows.write.format("xml").options(rowTag="customer", rootTag="customers").save(f"{folder}/a")
    checked = integrate(spark, folder).checked
    return checked.withColumn("source_row", F.col("extra_fields")["customer"].cast("long")).select(*FIELDS)


@query("integrate_xlsx", _ROWS)
def integrate_xlsx(spark, sf):
    folder = new_path(spark, "folder")
    export.write_xlsx(_contacts(spark, sf).withColumnsRenamed(NAMES), f"{folder}/a")
    return _checked(spark, folder)


@query("integrate_bad_files", _ROWS)
def integrate_bad_files(spark, sf):
    """Headers that differ in case only, names that clash once flattened, a repeated name, and
    broken files of every format: all sound rows arrive."""
    folder = new_path(spark, "folder")
    rows = _contacts(spark, sf)
    part = F.col("ref").cast("long") % 3
    upper = rows.where(part == 0).withColumnsRenamed({"email": "mail"})
    lines = upper.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in upper.columns[:2]], *[F.coalesce(c, F.lit("")) for c in upper.columns[1:]]))
    head = "\t".join(["ref", "EMAIL", "Email", "Mobile", "fname", "surname", "name", "Town", "country"])
    lines.mapInPandas(_with_head(head), "value string").write.text(f"{folder}/a")
    _as(spark, f"{folder}/a", ".csv")
    _write_json(rows.where(part == 1).withColumnsRenamed(NAMES), f"{folder}/b")
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    twice = F.concat(F.lit('{"extra": {"x": 1}, "extra__x": 2, "ref": "-1", '), F.substring(record, 2, 1_000_000))
    rows.where(part == 2).withColumnsRenamed(NAMES).select(twice.alias("value")).write.text(f"{folder}/c")
    _as(spark, f"{folder}/c", ".ndjson")
    for name, extension in (("d", ".json"), ("e", ".xml"), ("f", ".xlsx"), ("g", ".xls")):
        rows.limit(1).select(F.concat(F.lit('[{"a": <b> '), "ref").alias("value")).write.text(f"{folder}/{name}")
        _as(spark, f"{folder}/{name}", extension)
    return _checked(spark, folder)


def _with_head(head: str):
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        for batch in batches:
            yield pd.DataFrame({"value": batch.iloc[:, 0]})

    return add


@query("integrate_report", f"""{i.WITH_CONTACTS}
SELECT 'json' AS file_format, count(*) FILTER (source_row % 3 = 1) AS total_rows, 0 AS errors FROM contacts
UNION ALL SELECT 'csv', count(*) FILTER (source_row % 3 = 0), 0 FROM contacts
UNION ALL SELECT 'ndjson', count(*) FILTER (source_row % 3 = 2), count(*) FILTER (source_row % 3 = 2 AND source_row % 5 = 0) FROM contacts
UNION ALL SELECT 'xml', 0, 1""")
def integrate_report(spark, sf):
    """Rows and errors per format; every fifth line of the line-delimited files is broken as well."""
    folder = new_path(spark, "folder")
    rows = _contacts(spark, sf)
    number = F.col("ref").cast("long")
    rows.where(number % 3 == 0).write.options(header=True, escape='"').csv(f"{folder}/a")
    _write_json(rows.where(number % 3 == 1), f"{folder}/b")
    lines = rows.where(number % 3 == 2).select("ref", F.to_json(F.struct("*")).alias("value"))
    broken = lines.where(F.col("ref").cast("long") % 5 == 0).select(F.concat(F.lit("{"), "ref").alias("value"))
    lines.select("value").unionByName(broken).write.text(f"{folder}/c")
    _as(spark, f"{folder}/c", ".ndjson")
    rows.limit(1).select(F.lit("<r><c>").alias("value")).write.text(f"{folder}/d")
    _as(spark, f"{folder}/d", ".xml")
    report = integrate(spark, folder).report
    return report.groupBy("file_format").agg(F.sum("total_rows").alias("total_rows"), F.sum("errors").alias("errors"))


@query("integrate_two_batches", f"""{i.WITH_CONTACTS}
SELECT count(*) AS records, count(*) AS ids, count(*) FILTER (source_row % 2 = 0) AS unchanged FROM contacts""")
def integrate_two_batches(spark, sf):
    """Two batches, of which the first is run again when a file has come that sorts first: no id is
    given twice, and all rows of the earlier files keep theirs."""
    first, second = new_path(spark, "folder"), new_path(spark, "folder")
    rows = _contacts(spark, sf)
    number = F.col("ref").cast("long")
    rows.where(number % 2 == 0).write.json(f"{first}/b")
    rows.where(number % 4 == 1).write.json(f"{second}/b")
    once = integrate(spark, first, batch_id=1)
    rows.where(number % 4 == 3).write.json(f"{first}/a")
    again = integrate(spark, first, batch_id=1, known_files=once.files)
    other = integrate(spark, second, batch_id=2)
    ids = again.raw.select("rid").unionByName(other.raw.select("rid"))
    ref = F.try_element_at("raw", F.lit("ref")).alias("ref")
    kept = once.raw.select("rid", ref).join(again.raw.select("rid", ref), ["rid", "ref"], "left_semi")
    return ids.agg(F.count("*").alias("records"), F.count_distinct("rid").alias("ids")).withColumn(
        "unchanged", F.lit(kept.count())
    )
