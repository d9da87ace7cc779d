"""Delimited files as users upload them: quoted line breaks, odd encodings, names of any characters, and many of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.integrate import integrate, number_files
from contactloom.plans import inputs as i
from contactloom.plans.folders import _ROWS, FIELDS, NAMES, _contacts
from contactloom.plans.registry import query
from contactloom.session import new_path
from contactloom.sources.delimited import read_delimited

_WRITTEN = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@query("csv_scan_quoted", f"""{i.WITH_CONTACTS}
SELECT CAST(source_row AS VARCHAR) AS source_row, nullif(trim(email), '') AS email,
       'from' || chr(10) || '"' || coalesce(trim(city), '') || '", ' || chr(10) || chr(10) || source_row AS note FROM contacts""")
def csv_scan_quoted(spark, sf):
    """Cells and a header of several lines, with quotes and delimiters in them."""
    path = new_path(spark, "quoted")
    city = F.coalesce(F.trim("city"), F.lit(""))
    note = F.concat(F.lit('from\n"'), city, F.lit('", \n\n'), F.col("source_row").cast("string"))
    rows = i.contacts(spark, sf).select(F.col("source_row").cast("string").alias("source_row"), note.alias("the\nnote, \"long\""), "email")
    rows.write.options(**_WRITTEN).csv(path)
    raw = read_delimited(spark, path)[0].select("raw")
    return raw.select(
        F.col("raw")["source_row"].alias("source_row"), F.col("raw")["email"].alias("email"), F.col("raw")['the\nnote, "long"'].alias("note")
    )


ENCODINGS = ["UTF-8", "ISO-8859-1", "UTF-16LE", "UTF-16", "UTF-16BE"]


@query("csv_encodings", f"""{i.WITH_CONTACTS}
SELECT CAST(source_row AS VARCHAR) AS source_row, nullif(trim(email), '') AS email, nullif(trim(phone), '') AS phone, 'Ä,é' AS mark,
       list_element([',', ';', chr(9), '|', ','], upload_file_id) AS delimiter FROM contacts""")
def csv_encodings(spark, sf):
    """Each upload in another encoding and with another delimiter."""
    path = new_path(spark, "encodings")
    rows = i.contacts(spark, sf).select(
        "upload_file_id", F.col("source_row").cast("string").alias("source_row"), "email", "phone", F.lit("Ä,é").alias("mark")
    )
    for n, (sep, encoding) in enumerate(zip([",", ";", "\t", "|", ","], ENCODINGS, strict=True), 1):
        part = rows.where(F.col("upload_file_id") == n).drop("upload_file_id")
        part.write.options(sep=sep, encoding=encoding, **_WRITTEN).csv(f"{path}/{n}")
    read, _ = read_delimited(spark, path)
    return read.select(*[F.col("raw")[c].alias(c) for c in ("source_row", "email", "phone", "mark")], F.col("_delimiter").alias("delimiter"))


@query("record_ranges", f"""{i.WITH_CONTACTS},
f AS (SELECT source_row // 3 AS file, count(*) + 2 AS size FROM contacts GROUP BY 1)
SELECT file, CAST(row_number() OVER (ORDER BY file) AS INT) AS file_id, size,
       CAST(coalesce(sum(size) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low FROM f""")
def record_ranges(spark, sf):
    """Record numbers of as many files as there are groups of three contacts; half of them are known from an earlier run."""
    file = F.floor(F.col("source_row") / 3)
    sizes = i.contacts(spark, sf).groupBy(F.format_string("%012d", file).alias("_file")).agg((F.count("*") + 1).alias("top"))
    half = sizes.agg(F.percentile_approx(F.col("_file").cast("long"), 0.5)).first()[0]
    known = number_files(sizes.where(F.col("_file").cast("long") <= half))
    found = number_files(sizes, known).select("_file", "file_id", F.inline("ranges"))
    return found.select(F.col("_file").cast("long").alias("file"), "file_id", "size", "low")


def _rename(spark, path: str, extension: str) -> None:
    """Gives the written parts of a folder names with blanks, brackets and signs."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for n, status in enumerate(system.listStatus(hadoop.Path(path))):
        if status.getPath().getName().startswith("part-"):
            system.rename(status.getPath(), hadoop.Path(path, f"my list [{n}] {{a}} 100%2F+é{extension}"))


@query("integrate_odd_names", _ROWS)
def integrate_odd_names(spark, sf):
    """Files of three formats whose names hold blanks, brackets, braces and per cent signs."""
    folder = new_path(spark, "folder")
    rows = _contacts(spark, sf).withColumnsRenamed(NAMES)
    third = F.col("ref").cast("long") % 3
    rows.where(third == 0).write.options(**_WRITTEN).csv(f"{folder}/a")
    rows.where(third == 1).write.json(f"{folder}/b")
    rows.where(third == 2).write.json(f"{folder}/c")
    for part, extension in (("a", ".csv"), ("b", ".ndjson"), ("c", ".json")):
        _rename(spark, f"{folder}/{part}", extension)
    checked = integrate(spark, folder).checked
    return checked.withColumn("source_row", F.col("extra_fields")["ref"].cast("long")).select(*FIELDS)
