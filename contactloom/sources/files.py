"""CSV, JSON, NDJSON and XML files of contact records as DataFrames.

Every reader gives one row per record with ``_file`` and ``_source_row``, the number of
the record in its file. Bad records and files become rows of an error table, never
exceptions.
"""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.functions import text
from contactloom.sources import streams
from contactloom.sources.formats import BOM
from contactloom.session import stage

# Delimiters in order of preference.
DELIMITERS = [",", ";", "\t", "|"]
_ABSENT = "\x00"


# --- record numbers -------------------------------------------------------------------------------

def with_ordinals(rows: DataFrame, first: int, dense: bool = False) -> DataFrame:
    """Numbers the records of each file in file order, starting with ``first``.

    Rows carry ``_file``, ``_block`` (offset of their split) and ``_seq`` (rising by one
    within a split; with gaps if rows were left out, then say ``dense``). Only counts per
    split are put in order over a file; the largest group in one task is a split, so a
    file may hold any share of the data.
    """
    if dense:
        rows = rows.withColumn("_seq", F.row_number().over(W.partitionBy("_file", "_block").orderBy("_seq")))
    splits = rows.groupBy("_file", "_block").agg(F.min("_seq").alias("_start"), F.count("*").alias("_n"))
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(offsets, ["_file", "_block"]).withColumn(
        "_source_row", F.col("_offset") + F.col("_seq") - F.col("_start") + first
    ).drop("_block", "_seq", "_start", "_offset")


def position() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    ]


# --- CSV ------------------------------------------------------------------------------------------

def delimiter(line: Column) -> Column:
    """The candidate that occurs most often in the line; ties go to the earlier one."""
    counts = [F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS]
    top = F.greatest(*counts)
    found = F.when(counts[0] == top, DELIMITERS[0])
    for d, n in zip(DELIMITERS[1:], counts[1:]):
        found = found.when(n == top, d)
    return found


def csv_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(delimiter, encoding, header, files): one row per distinct layout.

    One pass over the lines: the first line of a file and whether all its bytes are valid
    UTF-8 are partial aggregates. The driver sees file names only.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", *position())
    starts = (F.col("_block") == 0) & (F.col("value") != "")
    heads = lines.groupBy("_file").agg(
        F.min_by("value", F.when(starts, F.col("_seq"))).alias("header"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
    ).where("header IS NOT NULL")
    named = heads.select(
        "_file", F.ltrim("header", F.lit(BOM)).alias("header"),
        F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"),
    )
    return named.withColumn("delimiter", delimiter(F.col("header"))).groupBy("delimiter", "encoding", "header").agg(
        F.collect_list("_file").alias("files")
    )


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    multi_line: bool = True,
    ordinals: bool = True,
    header: bool | None = None,
    as_map: bool = False,
) -> DataFrame:
    """Files of one layout: all columns as text, stripped, blank to null; rows without any
    value dropped after numbering. ``_overflow`` marks rows with more cells than columns.

    Without ``columns`` the first line names them; with ``columns`` the files have no
    header line unless ``header`` says so. Quoted line breaks need ``multi_line``,
    which reads a file in one task; turn it off for large files without them. ``as_map``
    gives one map ``raw`` by exact header names instead of columns.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    header = columns is None if header is None else header
    if columns is None:
        first = spark.read.option("encoding", encoding).text(paths[0]).where("value != ''").first()
        line = (first.value if first else "").lstrip(BOM)
        columns = [c.strip() for c in next(csv.reader([line], delimiter=sep))]
    fields = [T.StructField(f"c{n}", T.StringType()) for n in range(len(columns) + 1)]
    raw = (
        spark.read.schema(T.StructType(fields))
        .options(header=header, sep=sep, quote='"', escape='"', encoding=encoding, mode="PERMISSIVE")
        .options(multiLine=multi_line, nullValue=_ABSENT, recursiveFileLookup=True)
        .csv(paths)
    )
    cells = [text.strip(F.col(f"c{n}")) for n in range(len(columns))]
    overflow = F.col(f"c{len(columns)}").isNotNull()
    if as_map:
        # Names that differ in case only cannot be columns side by side.
        last = {name: n for n, name in enumerate(columns)}
        filled = [F.nullif(cells[n], F.lit("")) for n in last.values()]
        rows = raw.select(
            *position(), F.map_from_arrays(F.lit(list(last)), F.array(*filled)).alias("raw"), overflow.alias("_overflow")
        )
        rows = with_ordinals(stage(rows, "csv"), 2)
        return rows.where(F.exists(F.map_values("raw"), lambda v: v.isNotNull()))
    # The last column of a repeated header name wins.
    last = {name: cell for name, cell in zip(columns, cells)}
    rows = raw.select(
        *position(), *[F.nullif(cell, F.lit("")).alias(name) for name, cell in last.items()], overflow.alias("_overflow")
    )
    if ordinals:
        rows = with_ordinals(stage(rows, "csv"), 2)
    else:
        rows = rows.drop("_block", "_seq")
    return rows.where(F.coalesce(*[F.col(f"`{c}`") for c in last]).isNotNull())


def read_csv_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files of any layouts below a folder: each layout is read once, then all are united
    by column name. The driver sees one row per layout with its file names."""
    out = None
    for layout in csv_layouts(spark, path).toLocalIterator():
        part = read_csv(spark, layout.files, sep=layout.delimiter, encoding=layout.encoding, **options)
        part = part.withColumn("_delimiter", F.lit(layout.delimiter))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def csv_report(rows: DataFrame) -> DataFrame:
    """Per file: records, records with too many cells, the message about them."""
    return rows.groupBy("_file").agg(
        F.count("*").alias("total_rows"), F.count_if("_overflow").alias("overflow_rows")
    ).withColumn("error", F.when(
        F.col("overflow_rows") > 0,
        F.concat(F.col("overflow_rows").cast("string"), F.lit(" row(s) had more columns than the header — extras dropped")),
    ))


# --- JSON -----------------------------------------------------------------------------------------

# How the types of JSON values are named in messages.
TYPE_NAMES = [("ARRAY", "list"), ("BOOLEAN", "bool"), ("STRING", "str"), ("BIGINT", "int"), ("VOID", "NoneType")]


def _type_name(kind: Column) -> Column:
    found = F.when(kind.startswith(TYPE_NAMES[0][0]), TYPE_NAMES[0][1])
    for prefix, name in TYPE_NAMES[1:]:
        found = found.when(kind.startswith(prefix), name)
    return found.otherwise("float")


def _parts(df: DataFrame, variant: str) -> DataFrame:
    """A row per element of an array or entry of an object: adds pos, key and value."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(variant).outer()))


def json_items(documents: DataFrame, key: str, value: str = "value", records_key: str | None = None) -> DataFrame:
    """(key, _source_row, item VARIANT): the records of JSON documents.

    A document is an array of records, or an object with the array under ``records_key``
    (by default the first of its keys, in alphabetical order, that holds an array of
    objects), or one record.
    """
    parsed = documents.select(key, F.try_parse_json(F.col(value)).alias("doc")).where("doc IS NOT NULL")
    kind = F.schema_of_variant("doc")
    arrays = parsed.where(kind.startswith("ARRAY")).select(key, F.col("doc").alias("records"))
    objects = parsed.where(kind.startswith("OBJECT"))
    entries = _parts(objects, "doc").select(key, F.col("key").alias("entry"), F.col("value").alias("part"))
    first_kind = F.schema_of_variant(F.try_variant_get("part", "$[0]", "variant"))
    holds_records = first_kind.startswith("OBJECT") | (F.to_json("part") == "[]")
    wrapped = entries.where(
        (F.col("entry") == records_key) if records_key else F.coalesce(holds_records, F.lit(False))
    ).groupBy(key).agg(F.min("entry").alias("entry"))
    under = entries.join(wrapped, [key, "entry"], "left_semi").select(key, F.col("part").alias("records"))
    single = objects.join(wrapped, key, "left_anti").select(key, F.lit(1).alias("_source_row"), F.col("doc").alias("item"))
    listed = _parts(arrays.unionByName(under), "records").select(
        key, (F.col("pos") + 1).alias("_source_row"), F.col("value").alias("item")
    )
    return listed.unionByName(single)


def json_errors(documents: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, error) of documents that are not JSON, or neither array nor object."""
    doc = documents.select(key, value, F.try_parse_json(F.col(value)).alias("doc"))
    kind = F.schema_of_variant("doc")
    bad = F.when(F.col("doc").isNull(), "JSON parse error").when(
        ~(kind.startswith("ARRAY") | kind.startswith("OBJECT")),
        F.concat(F.lit("Unexpected top-level JSON type: "), _type_name(kind)),
    )
    return doc.select(key, bad.alias("error")).where("error IS NOT NULL")


def split_objects(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors): items that are no objects are skipped and reported."""
    kind = F.schema_of_variant("item")
    is_object = kind.startswith("OBJECT")
    message = F.concat(
        F.lit("Row "), F.col("_source_row").cast("string"), F.lit(": expected object, got "), _type_name(kind), F.lit(" — skipped")
    )
    return items.where(is_object), items.where(~is_object).withColumn("error", message).drop("item")


def flatten_items(items: DataFrame, keys: Sequence[str], max_depth: int = 32) -> DataFrame:
    """(keys..., path, value): leaves of open records, nested names joined by ``__``.

    One level per step until no object is left; lists stay as JSON text."""
    keys = list(keys)
    open_part = _parts(items, "item").select(*keys, F.col("key").alias("path"), F.col("value").alias("item"))
    done = None
    for _ in range(max_depth):
        is_object = F.schema_of_variant("item").startswith("OBJECT")
        leaves = open_part.where(~is_object).select(*keys, "path", F.col("item").cast("string").alias("value"))
        done = leaves if done is None else done.unionByName(leaves)
        inner = open_part.where(is_object)
        if inner.isEmpty():
            return done
        open_part = _parts(inner, "item").select(
            *keys, F.concat_ws("__", "path", "key").alias("path"), F.col("value").alias("item")
        )
    raise ValueError(f"records nested deeper than {max_depth} levels")


def ndjson_items(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of line-delimited JSON: items (_file, _source_row, item VARIANT) are
    numbered among the lines that parse; blank lines are skipped. Errors (_file, error,
    value) name the line of what does not parse and the number of what is no object."""
    lines = spark.read.option("recursiveFileLookup", "true").text(paths).select("value", *position())
    lines = stage(lines, "lines")
    parsed = F.try_parse_json("value")
    good = with_ordinals(lines.where(~text.blank(F.col("value")) & parsed.isNotNull()), 1, dense=True)
    records, skipped = split_objects(good.withColumn("item", parsed))
    bad = with_ordinals(lines, 1).where(~text.blank(F.col("value")) & parsed.isNull()).select(
        "_file", F.concat(F.lit("Line "), F.col("_source_row").cast("string"), F.lit(": JSON parse error")).alias("error"), "value"
    )
    return records, skipped.select("_file", "error", "value").unionByName(bad)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) with the fields of a known schema."""
    items, errors = ndjson_items(spark, path)
    row = F.from_json("value", schema)
    return items.select("_file", "_source_row", row.alias("r")).select("_file", "_source_row", "r.*"), errors


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns joined by ``__``; attributes (``@x``) are attached without
    it and an element's own text takes the element's name. In arrays the last value wins."""
    columns: dict[str, Column] = {}

    def walk(data_type, column: Column, name: str, in_array: bool):
        if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StructType | T.StringType):
            walk(data_type.elementType, column, name, True)
        elif isinstance(data_type, T.StructType):
            for f in data_type.fields:
                inner = name if f.name == "_VALUE" else name + f.name if f.name.startswith("@") else f"{name}__{f.name}" if name else f.name
                walk(f.dataType, column[f.name] if column is not None else F.col(f"`{f.name}`"), inner, in_array)
        else:
            columns[name] = F.try_element_at(F.array_compact(column), F.lit(-1)) if in_array else column

    walk(df.schema, None, "", False)
    return df.select(*[c.alias(name) for name, c in columns.items()])


# --- XML ------------------------------------------------------------------------------------------

_CHILDREN = "_file string, position long, tag string, nth long, error string"
CHUNK = 50_000


def _tags(opened: streams.Opened) -> Iterator[tuple]:
    """(position, tag, nth of its tag, error) of the children of the root, in order. The document is first read through
    once, so that a parse error gives one row and no children; one of more than ``CHUNK`` children is then read again."""
    names, count = [], 0
    try:
        for found in streams.child_names(opened):
            count += len(found)
            names = names + found if count <= CHUNK else []
    except ElementTree.ParseError as e:
        yield None, None, None, f"XML parse error: {e}"
        return
    if not count:
        yield None, None, None, "Could not detect record element in XML"
    seen, position = Counter(), 0
    for found in [names] if count <= CHUNK else streams.child_names(opened):
        for name in found:
            tag = name.rsplit("}", 1)[-1]
            seen[tag] += 1
            position += 1
            yield position, tag, seen[tag], None


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many documents together, as most documents have a few children only."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def rows(batch):
        for key, path, content in zip(*batch.columns, strict=True):
            key = key.as_py()
            for row in _tags(streams.opener(path.as_py(), content.as_py())):
                yield key, *row

    for batch in batches:
        found = rows(batch)
        while chunk := list(islice(found, CHUNK)):
            columns = [pa.array(column, kind) for column, kind in zip(zip(*chunk, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["_file", "position", "tag", "nth", "error"])


def xml_children(contents: DataFrame) -> DataFrame:
    """(_file, position, tag, nth of its tag, error) from (_file, content), or (_file, path, content) where
    ``content`` is null for files that tasks open."""
    path = "path" if "path" in contents.columns else F.lit(None).cast("string").alias("path")
    return contents.select("_file", path, "content").mapInArrow(_children, _CHILDREN)


def xml_record_tags(children: DataFrame) -> DataFrame:
    """(_file, record_tag): the commonest child of the root, the earlier one on a tie."""
    counted = children.where("tag IS NOT NULL").groupBy("_file", "tag").agg(
        F.count("*").alias("n"), F.min("position").alias("first")
    )
    return counted.groupBy("_file").agg(F.max_by("tag", F.struct("n", -F.col("first"))).alias("record_tag"))


def read_xml(spark: SparkSession, path: str, record_tag: str, schema: str | T.StructType) -> DataFrame:
    """Records of one tag, names without their namespace, attributes as ``@name``; all
    values stay text. Files that are no XML give no rows."""
    return (
        spark.read.format("xml").schema(schema)
        .options(rowTag=record_tag, attributePrefix="@", ignoreNamespace=True, inferSchema=False, mode="DROPMALFORMED")
        .load(path)
    )


def read_xml_folder(
    spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType | None = None, record_tag: str | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """({record tag: records}, errors). The tag is found per file unless it is given, and
    each tag is read once; records are numbered among all children of the root. A file
    that is no XML as a whole gives its error and no records."""
    children = stage(xml_children(streams.file_rows(spark, paths)), "children")
    good = children.where("error IS NULL")
    chosen = good.select("_file").distinct().withColumn("record_tag", F.lit(record_tag)) if record_tag else xml_record_tags(good)
    chosen = stage(chosen, "tags")
    out = {}
    for row in chosen.select("record_tag").distinct().toLocalIterator():
        tag = row.record_tag
        reader = spark.read.format("xml").options(
            rowTag=tag, attributePrefix="@", ignoreNamespace=True, inferSchema=False, mode="PERMISSIVE")
        raw = (reader.schema(schema) if schema is not None else reader).load(paths)
        fields = [f"`{c}`" for c in raw.columns]
        numbered = with_ordinals(stage(raw.select(*fields, *position()), "xml"), 1).withColumnRenamed("_source_row", "nth")
        of_file = good.where(F.col("tag") == tag).join(chosen.where(F.col("record_tag") == tag), "_file", "left_semi")
        places = of_file.select("_file", "nth", F.col("position").alias("_source_row"))
        out[tag] = numbered.join(places, ["_file", "nth"]).drop("nth")
    return out, children.where("error IS NOT NULL").select("_file", "error")
