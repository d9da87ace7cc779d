"""Delimited files of any layout, encoding and name, read by splits.

Spark splits the files at line breaks, also inside quotes. Whether a split begins inside a quoted cell
follows from what the lines before it do: each line is a function between "outside" and "inside" (it
keeps, swaps or sets the state). Functions are composed over the lines of a split, and then over the
splits of a file, of which there are few. So every line knows the state it begins in, and records that
cross line breaks or splits are the only ones whose lines are brought together. Files without blank lines in
which no line that begins outside a cell ends inside one skip all this: each of their lines is a record.

Everything that differs from file to file is data: encoding, delimiter and header are one row per file,
looked up by the lines. No list of files goes through the driver, and names may hold any character.

* Encoding: UTF-16 if the file begins with its mark, or most lines hold zero bytes; else UTF-8 if all
  bytes are valid, else Latin-1. Files in UTF-16 are read whole.
* Delimiter: the one by which the first lines have the steadiest number of cells.
* A record longer than ``MAX_RECORD`` characters, as after a quote that is never closed, is an error row.
"""

from __future__ import annotations

import csv
import io
import sys
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.functions import text
from contactloom.operators.lookup import MANY_KEYS, lookup_join, shuffled
from contactloom.operators.transform import computed_once
from contactloom.session import stage
from contactloom.sources.files import DELIMITERS, position, with_ordinals
from contactloom.sources.formats import BOM

CSV_FILES = "*.[cC][sS][vV]"
#: Lines of a file that its delimiter is told by, and characters of each.
SAMPLE_LINES, SAMPLE_WIDTH = 50, 4096
MAX_RECORD = 16 << 20
LINE = ["_file", "_block", "_seq", "value"]


# --- lines and what is known of their files -------------------------------------------------------

def _utf16_lines(spark: SparkSession, folder: str, glob: str, which: DataFrame) -> DataFrame:
    """Lines of the files (_file, big) in UTF-16. Their breaks are no single bytes, so each is decoded whole."""
    contents = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(folder)
    contents = contents.select(F.col("_metadata.file_path").alias("_file"), "content").join(which, "_file")
    whole = F.when(F.col("big"), F.decode("content", "UTF-16BE")).otherwise(F.decode("content", "UTF-16LE"))
    lines = F.split(F.ltrim(whole, F.lit(BOM)), "\n", -1)
    return contents.select("_file", F.lit(0).cast("long").alias("_block"), F.posexplode(lines).alias("_seq", "value")).select(
        "_file", "_block", F.col("_seq").cast("long").alias("_seq"), "value"
    )


def read_lines(spark: SparkSession, folder: str, glob: str = CSV_FILES) -> DataFrame:
    """(_file, _block, _seq, value): the decoded lines of all files, without their breaks."""
    raw = spark.read.options(recursiveFileLookup=True, pathGlobFilter=glob, lineSep="\n").text(folder)
    lines = stage(raw.select(*position(), "value"), "lines")
    zeros = F.contains("value", F.lit("\x00"))
    hexed = F.hex(F.substring(F.col("value").cast("binary"), 1, 2))
    head = F.min_by(hexed, F.when(F.col("_block") == 0, F.col("_seq")))
    facts = lines.groupBy("_file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), head.alias("head"), F.count_if(zeros).alias("zeros"), F.count("*").alias("n")
    )
    marked = F.col("head").isin("FEFF", "FFFE")
    wide = marked | (F.col("zeros") * 2 > F.col("n"))
    big = F.when(marked, F.col("head") == "FEFF").otherwise(F.col("head").startswith("00"))
    facts = stage(facts.select("_file", "utf8", wide.alias("wide"), big.alias("big"), "n"), "encodings")
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    odd = facts.where(~F.col("utf8") | F.col("wide"))
    if odd.isEmpty():
        return lines
    known = lookup_join(lines, facts.select("_file", "utf8", "wide", "n"), ["_file"], "n").where(~F.col("wide"))
    decoded = known.withColumn("value", F.when(F.col("utf8"), F.col("value")).otherwise(latin)).select(*LINE)
    return stage(decoded.unionByName(_utf16_lines(spark, folder, glob, facts.where("wide").select("_file", "big"))), "decoded")


def steadiest(sample: str) -> str:
    """Of the delimiters that split the header, the one by which the records of a sample have the steadiest number of
    cells: the largest share of the commonest number, then the largest number."""
    best, found = None, DELIMITERS[0]
    for sep in DELIMITERS:
        sizes = [len(r) for r in csv.reader(io.StringIO(sample, newline=""), delimiter=sep) if r]
        if len(sizes) > 2 and sample.count("\n") >= SAMPLE_LINES - 1:
            sizes.pop()  # it may be cut
        if not sizes or sizes[0] < 2:
            continue
        times = Counter(sizes)
        cells = max(times, key=lambda s: (times[s], s))
        score = (times[cells] / len(sizes), cells)
        if best is None or score > best:
            best, found = score, sep
    return found


def _dialects(lines: DataFrame) -> DataFrame:
    """(_file, delimiter, quoted, blank, n) of each file."""
    @F.pandas_udf("string")
    def detect(samples: pd.Series) -> pd.Series:
        csv.field_size_limit(sys.maxsize)
        return samples.map(steadiest)

    blank = F.col("value").isin("", "\r")
    sizes = lines.groupBy("_file").agg(
        F.count("*").alias("n"), F.max(F.contains("value", F.lit('"'))).alias("quoted"), F.max(blank).alias("blank")
    )
    nth = F.row_number().over(W.partitionBy("_file").orderBy("_block", "_seq"))
    first = lines.where((F.col("_block") == 0) & ~blank).withColumn("nth", nth).where(F.col("nth") <= SAMPLE_LINES)
    held = F.sort_array(F.collect_list(F.struct("nth", F.substring("value", 1, SAMPLE_WIDTH).alias("value"))))
    samples = first.groupBy("_file").agg(F.array_join(F.transform(held, lambda s: s.value), "\n").alias("sample"))
    told = samples.select("_file", detect(F.ltrim("sample", F.lit(BOM))).alias("delimiter"))
    return stage(sizes.join(told, "_file"), "dialects")


# --- records over line breaks ---------------------------------------------------------------------

def ends_inside(line: str, sep: str, inside: bool) -> bool:
    """Whether a line ends in a quoted cell. Quotes open a cell only at its beginning; two are one inside."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = line.find('"', at)
        while at >= 0 and line.startswith('"', at + 1):
            at = line.find('"', at + 2)
        if at < 0:
            return True
        at = line.find(sep, at + 1) + 1
        if not at:
            return False
        inside = False


@F.pandas_udf(T.IntegerType())
def _line_function(lines: pd.Series, seps: pd.Series) -> pd.Series:
    """State after a line that begins outside, plus twice that of one that begins inside."""
    return pd.Series([
        None if line is None else ends_inside(line, sep, False) + 2 * ends_inside(line, sep, True)
        for line, sep in zip(lines, seps, strict=True)
    ], dtype="Int32")


@F.pandas_udf(T.BooleanType())
def _opens(lines: pd.Series, seps: pd.Series) -> pd.Series:
    return pd.Series([ends_inside(line, sep, False) for line, sep in zip(lines, seps, strict=True)], dtype=bool)


def _crossing(lines: DataFrame) -> DataFrame:
    """(_file) of the files in which a line that begins outside a cell ends inside one. In all others no line ever begins inside."""
    quoted = lines.where(F.col("quoted") & F.contains("value", F.lit('"')))
    return quoted.select("_file", _opens("value", "delimiter").alias("opens")).where("opens").select("_file").distinct()


KEEP, SWAP = 2, 1  # 0 and 3 set the state


def _running(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``before``: the function (as ``fn``) composed of those of all rows before, within ``by``."""
    earlier = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sets = F.col("fn").isin(0, 3)
    swaps = F.coalesce(F.sum((F.col("fn") == SWAP).cast("int")).over(earlier), F.lit(0))
    rows = rows.withColumn("__swaps", swaps)
    last = F.max(F.when(sets, F.struct(*order, (F.col("fn") == 3).cast("int").alias("state"), "__swaps"))).over(earlier)
    rows = rows.withColumn("__last", last)
    swapped = F.pmod(F.col("__swaps") - F.coalesce(F.col("__last")["__swaps"], F.lit(0)), F.lit(2))
    state = F.col("__last")["state"].bitwiseXOR(swapped)
    free = F.when(swapped == 1, SWAP).otherwise(KEEP)
    return rows.withColumn("before", F.coalesce(F.when(state == 1, 3).when(state == 0, 0), free)).drop("__swaps", "__last")


def _after(before: Column, fn: Column) -> Column:
    """``before`` and then ``fn``, as one function."""
    low = F.when(before.bitwiseAND(F.lit(1)) == 1, F.shiftright(fn, 1)).otherwise(fn.bitwiseAND(F.lit(1)))
    high = F.when(F.shiftright(before, 1) == 1, F.shiftright(fn, 1)).otherwise(fn.bitwiseAND(F.lit(1)))
    return low + F.lit(2) * high


def _records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((_file, _block, _seq, value, delimiter) of the records of lines (with delimiter), whose place is that of their
    first line; (_file, error) of records that are too long)."""
    function = F.when(F.contains("value", F.lit('"')), _line_function("value", "delimiter")).otherwise(F.lit(KEEP))
    split = ["_file", "_block"]
    upto = W.partitionBy(*split).orderBy("_seq").rowsBetween(W.unboundedPreceding, 0)
    inside = [F.col("before").bitwiseAND(F.lit(1)), F.shiftright("before", 1)]
    # Line that begins the last record up to here, if the split begins outside and if it begins inside a cell: both are
    # found in the shuffle that composes the functions, so that lines need not be dealt by split once more.
    heads = [F.max(F.when(state == 0, F.col("_seq"))).over(upto) for state in inside]
    marked = _running(lines.withColumn("fn", function), split, ["_seq"])
    marked = stage(marked.withColumns({"head0": heads[0], "head1": heads[1]}), "quotes")
    whole = marked.groupBy(*split).agg(F.max_by(_after(F.col("before"), F.col("fn")), "_seq").alias("fn"))
    # A file begins outside: what is composed of all splits before, from there.
    begins = stage(_running(whole, ["_file"], ["_block"]).select(*split, F.col("before").bitwiseAND(F.lit(1)).alias("begin")), "begins")
    per_split = F.broadcast if begins.count() <= MANY_KEYS else shuffled
    began = F.col("begin") == 1
    known = marked.join(per_split(begins), split).withColumn("before", F.when(began, inside[1]).otherwise(inside[0]))
    after = F.when(F.col("before") == 1, F.shiftright("fn", 1)).otherwise(F.col("fn").bitwiseAND(F.lit(1)))
    head = F.when(began, F.col("head1")).otherwise(F.col("head0"))
    known = known.select(
        *LINE, "delimiter", (F.col("before") == 0).alias("starts"), (after == 1).alias("open"),
        F.when(head.isNotNull(), F.struct(F.col("_block").alias("b"), head.alias("s"))).alias("record"),
    )
    single = known.where(F.col("starts") & ~F.col("open")).select(*LINE, "delimiter")
    # Lines before the first record of a split belong to the last one that began before.
    last = known.groupBy(*split).agg(F.max("record").alias("record"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*split, F.max("record").over(earlier).alias("carried"))
    parts = known.where(~F.col("starts") | F.col("open")).join(per_split(carried), split).withColumn("record", F.coalesce("record", "carried"))
    key = ["_file", F.col("record.b").alias("_block"), F.col("record.s").alias("_seq")]
    pieces = stage(parts.select(*key, F.struct(F.col("_block").alias("b"), F.col("_seq").alias("s"), "value").alias("line"), "delimiter"), "pieces")
    place = ["_file", "_block", "_seq"]
    sizes = pieces.groupBy(*place).agg(F.sum(F.length("line.value") + 1).alias("size"))
    fit = pieces.join(sizes.where(F.col("size") <= MAX_RECORD).select(*place), place)
    ordered = F.transform(F.sort_array(F.collect_list("line")), lambda line: line.value)
    joined = fit.groupBy(*place).agg(F.array_join(ordered, "\n").alias("value"), F.first("delimiter").alias("delimiter"))
    message = F.format_string("Record of %d characters: a quote may not be closed", "size")
    long = sizes.where(F.col("size") > MAX_RECORD).select("_file", message.alias("error"))
    return single.unionByName(joined), long


@F.pandas_udf(T.ArrayType(T.StringType()))
def _quoted_cells(records: pd.Series, seps: pd.Series) -> pd.Series:
    csv.field_size_limit(sys.maxsize)
    return pd.Series([
        None if record is None else [cell for row in csv.reader(io.StringIO(record, newline=""), delimiter=sep) for cell in row]
        for record, sep in zip(records, seps, strict=True)
    ], dtype=object)


def _plain_cells(line: Column, sep: Column) -> Column:
    found = None
    for d in DELIMITERS:
        cut = F.split(F.rtrim(line, F.lit("\r")), f"[{d}]", -1)
        found = F.when(sep == d, cut) if found is None else found.when(sep == d, cut)
    return found


@F.pandas_udf(T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("places", T.ArrayType(T.IntegerType()))]))
def _header(headers: pd.Series) -> pd.DataFrame:
    """Names of a header and their places; of equal names the last one."""
    found = [{name.strip(): n for n, name in enumerate(cells, 1)} for cells in headers]
    return pd.DataFrame({"names": [list(f) for f in found], "places": [list(f.values()) for f in found]})


def read_delimited(spark: SparkSession, folder: str, glob: str = CSV_FILES) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of the files below a folder: rows are (_file, _source_row, raw, _overflow, _delimiter), with the
    cells of a record by header name, stripped, blank to null; records without any value are left out after numbering.
    Errors are (_file, error), also for records with more cells than the header."""
    lines = read_lines(spark, folder, glob)
    dialects = _dialects(lines)
    if not dialects.where("quoted").isEmpty():
        crossing = _crossing(lookup_join(lines, dialects, ["_file"], "n")).withColumn("crosses", F.lit(True))
        dialects = stage(dialects.join(crossing, "_file", "left").fillna(False, ["crosses"]), "crossing")
    else:
        dialects = dialects.withColumn("crosses", F.lit(False))
    kinds = lookup_join(lines, dialects, ["_file"], "n")
    quoted = F.contains("value", F.lit('"'))
    quoted_cells = F.when(quoted, _quoted_cells(F.when(quoted, F.col("value")), "delimiter"))
    plain_cells = _plain_cells(F.col("value"), F.col("delimiter"))
    straight, long = ~F.col("crosses") & ~F.col("blank"), None

    def of_lines(which: Column, cells: Column) -> DataFrame:
        each = with_ordinals(stage(kinds.where(straight & which).select(*LINE, "delimiter"), "plain"), 1)
        return each.select("_file", "_source_row", "delimiter", cells.alias("cells"))

    parts = [of_lines(~F.col("quoted"), plain_cells)]
    if not dialects.where(straight & F.col("quoted")).isEmpty():
        parts.append(of_lines(F.col("quoted"), F.coalesce(quoted_cells, plain_cells)))
    if not dialects.where(~straight).isEmpty():
        found, long = _records(kinds.where(~straight).select(*LINE, "delimiter"))
        found = stage(found.where(~F.col("value").isin("", "\r")), "found")
        found = with_ordinals(found, 1, dense=True)
        parts.append(found.select("_file", "_source_row", "delimiter", F.coalesce(quoted_cells, plain_cells).alias("cells")))
    every = stage(reduce(DataFrame.unionByName, parts), "cells")
    heads = every.where("_source_row = 1").select("_file", F.col("cells").alias("head"))
    first = F.array(F.ltrim(F.element_at("head", 1), F.lit(BOM)))
    whole = F.concat(first, F.slice("head", 2, F.size("head")))
    per_file = heads.select("_file", _header(whole).alias("header"), F.size("head").alias("width"))
    per_file = stage(per_file.join(every.groupBy("_file").agg(F.count("*").alias("n")), "_file"), "headers")
    rows = lookup_join(every.where("_source_row > 1"), per_file, ["_file"], "n")
    overflow = F.size("cells") > F.col("width")

    def filled(found: DataFrame) -> DataFrame:
        """Those with any value. Stripped first, then compared, each cell once."""
        stripped = F.transform("header.places", lambda p: text.strip(F.get("cells", p - 1)))
        cells = F.transform(stripped, lambda v: F.nullif(v, F.lit("")))
        made = found.select(
            "_file", "_source_row", F.map_from_arrays("header.names", cells).alias("raw"), overflow.alias("_overflow"),
            F.col("delimiter").alias("_delimiter"),
        )
        return computed_once(made, "cells").where(F.exists(F.map_values("raw"), lambda v: v.isNotNull()))

    many = F.format_string("%d row(s) had more cells than the header; the extra ones are left out", F.count("*"))
    errors = filled(rows.where(overflow)).groupBy("_file").agg(many.alias("error")).select("_file", "error")
    rows = filled(rows)
    return rows, errors if long is None else errors.unionByName(long)
