"""Formats by file name, admission checks, checksums and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.config import DEFAULT, FORMATS, Config
from contactloom.functions import text

BOM = "\ufeff"


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"[^/]\.([^./]+)$", 1)


def glob_of(extension: str) -> str:
    """Pattern of the names with an extension, in either case."""
    return "*." + "".join(f"[{c}{c.upper()}]" for c in extension)


#: How deep below a folder hidden files are looked for.
HIDDEN_DEPTH = 6


def hidden_files(spark: SparkSession, folder: str) -> DataFrame:
    """(_file, error): files of a supported format that Spark does not read, as their names begin with ``_`` or ``.``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    safe = "".join("\\" + c if c in "\\{}[]*?^" else c for c in folder.rstrip("/"))
    system = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for depth in range(HIDDEN_DEPTH):
        for status in system.globStatus(hadoop.Path(safe + "/*" * depth + "/{_,.}*")) or []:
            name = status.getPath().toString()
            if status.isFile() and name.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() in FORMATS:
                found.append((name, "Not read: the name begins with '_' or '.'"))
    return spark.createDataFrame(found, "_file string, error string")


def stored_format(path: Column) -> Column:
    """Format under which a file is stored; null if it is not supported."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.try_element_at(table, extension(path))


def format_error(path: Column) -> Column:
    ext = extension(path)
    hint = F.when(ext == "xls", " (legacy .xls is not supported; convert to .xlsx first)").otherwise("")
    names = ", ".join(f"'{f}'" for f in sorted(FORMATS))
    message = F.concat(F.lit("Unsupported file format: '."), ext, F.lit("'"), hint, F.lit(f". Supported: [{names}]"))
    return F.when(stored_format(path).isNull(), message)


def base_name(name: Column) -> Column:
    """Last part of the path, without NUL characters."""
    last = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1)
    return text.strip(F.replace(last, F.lit("\x00"), F.lit("")))


def admission(files: DataFrame, config: Config = DEFAULT, per_batch: int | None = None) -> DataFrame:
    """Adds ``name``, ``file_format`` and ``reason``; a null reason means accepted.

    ``files`` has path and length. ``per_batch``, if given, refuses batches (column
    ``batch_id``) of more files than that as a whole.
    """
    named = files.withColumn("name", base_name(F.col("path")))
    name, size = F.col("name"), F.col("length")
    too_large = F.concat(
        F.lit("File too large ("), size.cast("string"),
        F.lit(f" bytes). Maximum allowed is {config.max_upload_bytes} bytes."),
    )
    reason = (
        F.when((name == "") | name.isin(".", ".."), "Invalid or missing filename.")
        .when(stored_format(name).isNull(), format_error(name))
        .when(size <= 0, "Uploaded file is empty.")
        .when(size > config.max_upload_bytes, too_large)
    )
    out = named.select("*", stored_format(name).alias("file_format"), reason.alias("reason"))
    if per_batch is None:
        return out
    crowded = files.groupBy("batch_id").agg(F.count("*").alias("n")).where(F.col("n") > per_batch)
    return out.join(crowded, "batch_id", "left").withColumn(
        "reason", F.when(F.col("n").isNotNull(), f"A batch may hold at most {per_batch} files.").otherwise(F.col("reason"))
    ).drop("n")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length): the content column is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def decode_text(content: Column) -> Column:
    """UTF-8 if the bytes are valid UTF-8, else Latin-1; a leading mark is dropped."""
    decoded = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.ltrim(decoded, F.lit(BOM))


def checksum(content: Column) -> Column:
    return F.md5(content)


def exact_copies(df: DataFrame, content: str, record_id: str) -> DataFrame:
    """(checksum, copies, first_id) of contents that occur more than once."""
    return (
        df.groupBy(checksum(F.col(content)).alias("checksum"))
        .agg(F.count("*").alias("copies"), F.min(record_id).alias("first_id"))
        .where("copies > 1")
    )
