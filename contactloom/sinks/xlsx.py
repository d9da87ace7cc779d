"""XLSX as a data source to write to: each task streams its rows into workbooks."""

from __future__ import annotations

import datetime
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from xml.sax.saxutils import escape

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS_PER_WORKBOOK = 1_000_000
#: Rows that are compressed at once, and how hard: the fastest level, as the rows are written once and soon read.
ROWS_AT_ONCE, LEVEL = 500, 1

# The parts every workbook has.
PARTS = {
    "[Content_Types].xml": (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        "</Types>"
    ),
    "_rels/.rels": (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
        "</Relationships>"
    ),
    "xl/_rels/workbook.xml.rels": (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
        "</Relationships>"
    ),
    "xl/workbook.xml": (
        '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
        'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
        '<sheets><sheet name="Customers" sheetId="1" r:id="rId1"/></sheets></workbook>'
    ),
}


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f"<c><v>{value}</v></c>"
    if isinstance(value, datetime.datetime | datetime.date):
        value = value.isoformat()
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _row(values) -> bytes:
    return ("<row>" + "".join(map(_cell, values)) + "</row>").encode("utf-8")


@dataclass
class Written(WriterCommitMessage):
    names: list


class XlsxWriter(DataSourceWriter):
    """Workbooks are written under a hidden name and renamed when the job commits, so a
    lost task leaves nothing behind that a reader would take for a result."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def _store(self):
        from pyarrow import fs

        uri = re.sub("^file:/(?!/)", "file:///", self.path)
        store, root = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        store.create_dir(root, recursive=True)
        return store, root

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self._store()
        names = []
        rows = iter(iterator)
        some = list(islice(rows, ROWS_AT_ONCE))
        while some:
            name = f"part-{uuid.uuid4().hex}.xlsx"
            names.append(name)
            with store.open_output_stream(f"{root}/_{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL) as book:
                for part, content in PARTS.items():
                    book.writestr(part, content)
                with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                    sheet.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                    sheet.write(_row(self.columns))
                    left = ROWS_PER_WORKBOOK
                    while some and left > 0:
                        sheet.write(b"".join(map(_row, some)))
                        left -= len(some)
                        some = list(islice(rows, min(ROWS_AT_ONCE, left) or ROWS_AT_ONCE))
                    sheet.write(b"</sheetData></worksheet>")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        for message in messages:
            for name in message.names if message else []:
                store.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        for message in messages:
            for name in message.names if message else []:
                store.delete_file(f"{root}/_{name}")


class XlsxSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contact_xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options["path"], schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSink)
