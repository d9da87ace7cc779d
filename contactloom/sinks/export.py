"""Exports of the golden table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from contactloom.config import EXPORT_FIELDS
from contactloom.session import _delete, new_path
from contactloom.sources.streams import Opened, file_rows, opener

#: Bytes of a document that are passed on at once.
BLOCK = 4 << 20


def export_rows(golden: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The export columns in id order, duplicates included; ``ids`` limits the records."""
    chosen = golden if ids is None else golden.join(ids.select("id").distinct(), "id", "left_semi")
    return chosen.select(*EXPORT_FIELDS).orderBy("id")


def write_csv(rows: DataFrame, path: str) -> None:
    """Parts in id order, each with the header; nulls are empty cells, quotes doubled."""
    options = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(header=True, quote='"', escape='"', **options).csv(path)


def write_json(rows: DataFrame, path: str) -> int:
    """One JSON record per line; returns their number, counted while writing."""
    counted = Observation("exported")
    rows.observe(counted, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", False).json(path)
    return counted.get["n"]


def write_json_document(rows: DataFrame, path: str) -> int:
    """One document ``{"count": n, "results": [...]}``; returns n. The records are ordered and written by all cores. A document
    is one file, so one task puts the parts together, in blocks of bytes that it does not look into."""
    spark = rows.sparkSession
    counted = Observation("exported")
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    at = new_path(spark, "records")
    rows.observe(counted, F.count(F.lit(1)).alias("n")).select(F.concat(record, F.lit(",")).alias("value")).write.text(at)
    count = counted.get["n"]

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(text: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["value"])

        yield made(f'{{"count": {count}, "results": ['.encode())
        last = b""
        for batch in batches:
            for part, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for block in _lines(opener(part.as_py(), content.as_py())):
                    if last:
                        yield made(last)
                    last = block
        if last:
            yield made(last.removesuffix(b","))
        yield made(b"]}")

    number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long")
    parts = file_rows(spark, at).select("path", "content", number.alias("number"))
    parts.coalesce(1).sortWithinPartitions("number").mapInArrow(document, "value string").write.text(path)
    _delete(spark, at)
    return count


def _lines(opened: Opened) -> Iterator[bytes]:
    """Whole lines of a file in blocks, without the break at their end."""
    rest = b""
    with opened() as stream:
        while block := stream.read(BLOCK):
            lines, found, left = block.rpartition(b"\n")
            if found:
                yield rest + lines
                rest = left
            else:
                rest += block
    if rest:
        yield rest


def write_xlsx(rows: DataFrame, path: str) -> None:
    """Workbooks with a sheet "Customers", one or more per task."""
    from contactloom.sinks.xlsx import register

    register(rows.sparkSession)
    rows.write.format("contact_xlsx").mode("append").save(path)
