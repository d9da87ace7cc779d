"""The whole way from a folder of files to golden records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.config import DEFAULT, FORMATS, GOLDEN_FIELDS, Config
from contactloom.functions import text
from contactloom.operators import batch, matching, quality, schema
from contactloom.operators.isolate import Transform, apply_isolated
from contactloom.operators.lookup import lookup_join
from contactloom.operators.survivorship import golden_fold
from contactloom.operators.transform import issue_rows, transform_rows, valid_rows, with_issues
from contactloom.session import dealt, stage
from contactloom.sources import delimited, formats, records, streams, xlsx

ROW = ["_file", "_source_row", "raw"]
KEYS = ("file_id", "source_row", "rid")
# Names of a record that are not its data.
OWN_KEYS = [
    "_source_row", "_source_sheet", "_source_page", "_raw_text", "_transform_failed", "_validation_errors", "source_count",
]


def _union(parts: list[DataFrame], names: list[str], spark: SparkSession, kinds: str) -> DataFrame:
    out = spark.createDataFrame([], kinds)
    for part in parts:
        out = out.unionByName(part.select(*names))
    return out


#: Formats whose files one task reads, for which a limit on the content of a file holds. Workbooks are held whole, so Spark's
#: own limit is theirs; the others are read as streams, and only a limit that was set is theirs.
STREAMED = ["json", "xml"]


def extract(spark: SparkSession, folder: str | list[str], multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of all supported files below a folder (or of a bounded list of files, as Spark's readers take it), each format read by its
    reader: rows are (_file, _source_row, raw MAP), errors (_file, error). Readers take the folder and tell
    files by their names' endings, so names may hold any character. Files too large to be read
    whole are told from the listing. CSV files are always split; ``multi_line`` is no longer needed."""
    listing = stage(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        F.col("_metadata.file_path").alias("_file"), formats.extension(F.col("path")).alias("extension"), "length"), "listing")
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    of_stream = streams.most_bytes(spark, folder)
    large = (F.col("extension") == "xlsx") & (F.col("length") > most)
    if of_stream is not None:
        large = large | F.col("extension").isin(STREAMED) & (F.col("length") > of_stream)
    present = {r.extension for r in listing.select("extension").distinct().collect() if r.extension in FORMATS}
    rows, errors = [], [listing.select("_file", formats.format_error(F.col("_file")).alias("error")).where("error IS NOT NULL")]
    if isinstance(folder, str):
        errors.append(formats.hidden_files(spark, folder))
    message = F.format_string("File too large to be read whole (%d bytes, limit %d)", "length", F.lit(most))
    errors.append(listing.where(large).select("_file", message.alias("error")))
    if "csv" in present:
        read, bad = delimited.read_delimited(spark, folder)
        rows.append(read)
        errors.append(bad)
    for kind in STREAMED:
        if kind in present:
            read = stage(records.read_records(spark, folder, kind), kind)
            rows.append(read.where("error IS NULL"))
            errors.append(read.where("error IS NOT NULL"))
    if "ndjson" in present:
        read, bad = records.read_lines(spark, folder)
        rows.append(read)
        errors.append(bad)
    if "xlsx" in present:
        read = stage(xlsx.read_xlsx(spark, folder), "sheets")
        rows.append(read.where("error IS NULL"))
        errors.append(read.where("error IS NOT NULL"))
    if "pdf" in present:
        errors.append(listing.where("extension = 'pdf'").withColumn("error", F.lit("PDF text must be extracted beforehand")))
    return (
        _union(rows, ROW, spark, "_file string, _source_row long, raw map<string,string>"),
        _union(errors, ["_file", "error"], spark, "_file string, error string"),
    )


#: Record numbers of a batch: the rest of 63 bits is the batch.
RECORD_BITS = 48
RANGES = "array<struct<row: bigint, low: bigint, size: bigint>>"


def number_files(sizes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(_file, file_id, ranges) for files (_file, top), whose rows are numbered up to ``top``, and for all others that are
    ``known`` from earlier runs.

    A file gets a range of record numbers (row, low, size), as many as it has rows, after those of all files before it.
    Known files keep their number and ranges; if one has grown, its further rows get another range, and new files
    follow, so any number of files of any sizes fits. One row per file meets in a task.
    """
    none = F.lit(None).cast(RANGES)
    if known is None:
        known = sizes.select("_file", F.lit(0).alias("file_id"), none.alias("ranges")).limit(0)
    last = known.agg(
        F.max("file_id").alias("id"),
        F.max(F.array_max(F.transform("ranges", lambda r: r.low + r["size"]))).alias("mark"),
    ).first()
    both = sizes.join(known, "_file", "full")
    upto = F.coalesce(F.array_max(F.transform("ranges", lambda r: r.row + r["size"])), F.lit(0).cast("bigint"))
    both = both.withColumn("row", upto).withColumn("size", F.greatest(F.coalesce("top", F.lit(-1)) + 1 - F.col("row"), F.lit(0)))
    order = W.orderBy("_file")
    earlier = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = F.sum(F.col("file_id").isNull().cast("int")).over(order)
    made = F.array(F.struct("row", (F.lit(last.mark or 0) + earlier).alias("low"), "size"))
    ranges = F.concat(F.coalesce("ranges", F.array().cast(RANGES)), F.when(F.col("size") > 0, made).otherwise(F.array().cast(RANGES)))
    return both.select("_file", F.coalesce("file_id", F.lit(last.id or 0) + fresh).cast("int").alias("file_id"), ranges.alias("ranges"))


def with_record_ids(rows: DataFrame, numbered: DataFrame, sizes: DataFrame, batch_id: int) -> DataFrame:
    """``rows`` (_file, _source_row) with ``file_id`` and ``rid``, which no other batch and no other row has. ``sizes`` holds
    the rows (``rows``) of each file; rows find their file's ranges whatever its size."""
    if not 0 <= batch_id < 1 << 63 - RECORD_BITS:
        raise ValueError(f"batch ids run from 0 to {(1 << 63 - RECORD_BITS) - 1}")
    found = lookup_join(rows, numbered.join(sizes.select("_file", "rows"), "_file"), ["_file"], "rows")
    mine = F.element_at(F.filter("ranges", lambda r: r.row <= F.col("_source_row")), -1)
    number = mine.low + F.col("_source_row") - mine.row
    fits = F.when(number < 1 << RECORD_BITS, number).otherwise(F.raise_error(F.lit(f"a batch holds 2^{RECORD_BITS} rows at most")))
    return found.withColumn("rid", F.lit(batch_id << RECORD_BITS) + fits).drop("ranges")


def golden_columns(mapped: DataFrame) -> DataFrame:
    """Rows of a map of canonical names as golden fields and the map of all others."""
    entry = F.col("mapped")
    extra = F.map_filter(entry, lambda k, v: ~k.isin([*GOLDEN_FIELDS, *OWN_KEYS]))
    return mapped.select(*KEYS, *[F.try_element_at(entry, F.lit(f)).alias(f) for f in GOLDEN_FIELDS], extra.alias("_extra"))


def clean_and_check(mapped: DataFrame, config: Config = DEFAULT, transform: Transform | None = None) -> DataFrame:
    """Golden fields and the other entries cleaned, with the issues of each row. ``transform`` changes batches of the golden
    fields and of the map ``_extra`` before that; rows for which it fails are flagged."""
    columns = golden_columns(mapped)
    if transform is not None:
        columns = apply_isolated(columns, transform, KEYS)
    clean = transform_rows(columns, KEYS, config, warnings=True)
    extra = F.map_filter(F.transform_values("_extra", lambda k, v: text.clean(v)), lambda k, v: v.isNotNull())
    clean = clean.withColumn("_cleaned", extra).withColumn("extra_fields", F.when(F.size("_cleaned") > 0, F.col("_cleaned")))
    checked = with_issues(clean.drop("_extra", "_cleaned"), (*KEYS, "_warnings"), config)
    cut = F.transform(
        "_warnings",
        lambda w: F.struct(
            w.field_name.alias("field_name"), F.lit("VALUE_TRUNCATED").alias("error_code"), w.message.alias("error_message"),
            F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("raw_value"),
        ),
    )
    return checked.withColumn("issues", F.concat("issues", cut)).withColumn(
        "warning_count", F.col("warning_count") + F.size("_warnings")
    ).drop("_warnings")


@dataclass
class Integration:
    """A run: its stored inputs, and the tables that follow from them when asked for. ``files`` (_file, file_id,
    ranges of record numbers) are to be given to later runs of the batch."""

    raw: DataFrame
    files: DataFrame
    checked: DataFrame
    within: DataFrame
    errors: DataFrame
    batch_id: int
    config: Config

    @property
    def report(self) -> DataFrame:
        """(_file, file_format, file_id, total_rows, errors) of every file that gave rows or errors."""
        rows = self.raw.groupBy("_file").agg(F.first("file_id").alias("file_id"), F.count("*").alias("total_rows"))
        bad = self.errors.groupBy("_file").agg(F.count("*").alias("errors"))
        both = rows.join(bad, "_file", "full").fillna(0, ["total_rows", "errors"])
        return both.select("_file", formats.extension(F.col("_file")).alias("file_format"), "file_id", "total_rows", "errors")

    @property
    def issues(self) -> DataFrame:
        return issue_rows(self.checked, KEYS)

    @property
    def lineage(self) -> DataFrame:
        """Every source row, raw and mapped, and the first row of its golden record."""
        mapped = self.checked.select(
            "rid", (F.col("error_count") == 0).alias("is_valid"),
            F.to_json(F.struct(*GOLDEN_FIELDS, "extra_fields")).alias("mapped_data"),
        )
        raw = self.raw.select(*KEYS, "_file", F.to_json("raw", {"ignoreNullFields": "false"}).alias("raw_data"))
        return raw.join(mapped, "rid").join(self.within.select("rid", "primary_id"), "rid", "left")

    @cached_property
    def golden(self) -> DataFrame:
        """Golden records within each file."""
        members = valid_rows(self.checked).join(self.within.select("rid", "primary_id"), "rid")
        return stage(golden_fold(members, GOLDEN_FIELDS, extra="extra_fields"), "golden")

    @cached_property
    def customers(self) -> DataFrame:
        """Golden records of the batch, with those merged away."""
        mine = self.golden.withColumnRenamed("primary_id", "id").withColumn("batch_id", F.lit(self.batch_id))
        return batch.merge_batch(mine, self.config)

    @property
    def quality(self) -> DataFrame:
        duplicates = self.within.where("rid != primary_id").select("rid")
        per_file = self.checked.select("rid", "file_id").join(duplicates, "rid", "left_semi").groupBy("file_id").agg(
            F.count("*").alias("duplicate_rows")
        )
        return quality.quality_report(self.checked, per_file, "file_id")


def prepare(
    spark: SparkSession, extracted: DataFrame, errors: DataFrame, batch_id: int, attributes: list[str] | None = None,
    config: Config = DEFAULT, known_files: DataFrame | None = None, transform: Transform | None = None,
    kept: Callable[[str], str | None] = lambda name: None,
) -> Integration:
    """Rows with their ids, mapped, cleaned, checked and matched within their files. ``kept`` may give the paths at which the
    tables ``raw``, ``checked`` and ``within`` are to stay."""
    extracted = stage(extracted, "extracted")
    sizes = stage(extracted.groupBy("_file").agg(F.max("_source_row").alias("top"), F.count("*").alias("rows")), "sizes")
    numbered = stage(number_files(sizes.select("_file", "top"), known_files), "files")
    raw = with_record_ids(extracted, numbered, sizes, batch_id).withColumnRenamed("_source_row", "source_row")
    raw = stage(raw, "raw", at=kept("raw"))
    mapped = schema.map_open_rows(dealt(raw, "rid"), config=config, layouts=schema.shapes(raw))
    if attributes:
        wanted = schema.requested_attributes(attributes, config)
        mapped = mapped.withColumn("mapped", F.map_filter("mapped", lambda k, v: k.isin(wanted)))
    checked = stage(clean_and_check(mapped, config, transform), "checked", at=kept("checked"))
    within = stage(matching.first_seen(valid_rows(checked), config.file_match_keys, ["file_id"]), "within", at=kept("within"))
    return Integration(raw, numbered, checked, within, errors, batch_id, config)


def integrate(
    spark: SparkSession,
    folder: str,
    batch_id: int = 1,
    attributes: list[str] | None = None,
    config: Config = DEFAULT,
    known_files: DataFrame | None = None,
    multi_line: bool = True,
    transform: Transform | None = None,
) -> Integration:
    """Extract, map, clean, check and match within files; merging follows on demand.

    ``attributes`` limits the data to these canonical fields. Files are told apart by
    ``file_id``; all of them are processed in one job. With ``known_files``, the ``files`` of
    an earlier run of the batch, files and rows keep their ids when others come. ``transform`` is
    the caller's own step on Arrow batches of mapped rows (see ``operators.isolate``).
    """
    extracted, errors = extract(spark, folder, multi_line)
    return prepare(spark, extracted, errors, batch_id, attributes, config, known_files, transform)
