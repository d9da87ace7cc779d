"""Workbooks as rows of open columns, one task per group of files."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.sources.formats import glob_of
from contactloom.sources.records import maps

ROWS = "_file string, _source_sheet string, _source_row long, raw map<string,string>, error string"
CHUNK = 5_000

# Namespaces, and the number formats that show dates.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
DAY_ZERO = datetime.datetime(1899, 12, 30)


def _column_number(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


class _Workbook:
    def __init__(self, content: bytes):
        self.book = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.book.namelist())
        self.shared = self._shared()
        self.dates = self._date_styles()

    def _tree(self, part: str):
        return ElementTree.fromstring(self.book.read(part)) if part in self.names else None

    def _shared(self) -> list[str]:
        tree = self._tree("xl/sharedStrings.xml")
        if tree is None:
            return []
        return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in tree.iter(f"{MAIN}si")]

    def _date_styles(self) -> list[bool]:
        tree = self._tree("xl/styles.xml")
        if tree is None:
            return []
        formats = {int(f.get("numFmtId")): f.get("formatCode", "") for f in tree.iter(f"{MAIN}numFmt")}
        def shows_date(number):
            plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats.get(number, ""))
            return number in DATE_FORMATS or re.search("[dmyhsDMYHS]", plain) is not None
        styles = tree.find(f"{MAIN}cellXfs")
        return [shows_date(int(x.get("numFmtId", 0))) for x in styles] if styles is not None else []

    def sheets(self) -> list[tuple[str, str]]:
        targets = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels")}
        found = []
        for sheet in self._tree("xl/workbook.xml").iter(f"{MAIN}sheet"):
            target = targets[sheet.get(LINK)]
            found.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        return found

    def _value(self, cell) -> str | None:
        kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        if kind == "b":
            return str(v.text == "1")
        if kind != "n":
            return v.text
        style = int(cell.get("s", 0))
        number = float(v.text) if re.search("[.eE]", v.text) else int(v.text)
        if style < len(self.dates) and self.dates[style]:
            day = DAY_ZERO + datetime.timedelta(seconds=round(number * 86400))
            return day.strftime("%Y-%m-%d %H:%M:%S")
        return str(number)

    def rows(self, part: str) -> Iterator[list[str | None]]:
        """Rows by sheet position; the XML is read as a stream."""
        expected = 1
        with self.book.open(part) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if element.tag != f"{MAIN}row":
                    continue
                number = int(element.get("r", expected))
                for _ in range(number - expected):
                    yield []
                expected = number + 1
                values: list[str | None] = []
                for cell in element.iter(f"{MAIN}c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(values)
                    values += [None] * (at - len(values))
                    values.append(self._value(cell))
                yield values
                element.clear()


#: What a damaged workbook may raise: no archive, bad XML, missing parts, bad references and numbers.
BROKEN = (
    zipfile.BadZipFile, ElementTree.ParseError, KeyError, TypeError, ValueError, IndexError, AttributeError, zlib.error,
    EOFError, NotImplementedError, OSError,
)


def _records(path: str, content: bytes, all_sheets: bool) -> Iterator[tuple]:
    try:
        book = _Workbook(content)
        sheets = book.sheets()
    except BROKEN as e:
        yield path, None, None, None, f"Cannot open workbook: {e}"
        return
    for name, part in sheets if all_sheets else sheets[:1]:
        try:
            yield from _sheet(path, name, book.rows(part))
        except BROKEN as e:  # what was read before stays
            yield path, name, None, None, f"Sheet '{name}' cannot be read further: {e}"


def _sheet(path: str, name: str, rows: Iterator[list[str | None]]) -> Iterator[tuple]:
    head = next(rows, None)
    if head is None:
        yield path, name, None, None, f"Sheet '{name}' is empty"
        return
    headers = [str(h or f"col_{n}").strip() for n, h in enumerate(head)]
    for number, values in enumerate(rows, 2):
        if any(v is not None for v in values):
            padded = values + [None] * (len(headers) - len(values))
            yield path, name, number, dict(zip(headers, padded)), None


def _reader(all_sheets: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                records = _records(path.as_py(), content.as_py(), all_sheets)
                while chunk := list(islice(records, CHUNK)):
                    yield _arrow(chunk)
    return read


def _arrow(chunk: list[tuple]) -> pa.RecordBatch:
    paths, names, numbers, raws, errors = zip(*chunk, strict=True)
    text = [pa.array(column, pa.string()) for column in (paths, names, errors)]
    columns = [text[0], text[1], pa.array(numbers, pa.int64()), maps(raws), text[2]]
    return pa.RecordBatch.from_arrays(columns, names=["_file", "_source_sheet", "_source_row", "raw", "error"])


def read_xlsx(spark: SparkSession, path: str, all_sheets: bool = False) -> DataFrame:
    """(_file, _source_sheet, _source_row, raw, error): rows of the first or of all sheets;
    rows without values are left out. A workbook that cannot be read gives one error row.
    """
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob_of("xlsx")).load(path)
    return files.where(F.col("length") <= most).select("path", "content").mapInArrow(_reader(all_sheets), ROWS)
