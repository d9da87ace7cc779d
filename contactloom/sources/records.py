"""Records of JSON and XML files as open maps, read one by one.

Each file is one row of Spark's ``binaryFile`` source and is read by one task as a stream: records
are decoded, flattened and passed on in chunks, and of the file a task holds a window of about
a megabyte, or the longest record. A file is first read through once, so one that breaks off in
the middle gives its error and no records. Large JSON documents are read by splits (below).
Nothing in a file can stop the others: what cannot be read becomes an error row.

Rows are (_file, _source_row, raw, error): a record with its number and its values as text, or
an error. Names of nested values are joined by ``__``; of names that clash the later value wins.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators.lookup import MANY_KEYS, shuffled
from contactloom.session import stage
from contactloom.sources.files import position, with_ordinals
from contactloom.sources.formats import BOM, glob_of
from contactloom.sources.streams import Opened, children, file_rows, open_at, opener, streamed

ROWS = "_file string, _source_row bigint, raw map<string,string>, error string"
CHUNK = 5000
#: Bytes that are read at once.
BLOCK = 1 << 20
#: Bytes from which on a JSON document is read by splits, bytes of one, and tasks that they are dealt to at most.
LARGE, SPLIT, MOST_TASKS = 128 << 20, 16 << 20, 10_000
Found = tuple[int | None, dict[str, str | None] | None, str | None]

# Messages about records.
SKIPPED = "Row %d: expected object, got %s — skipped"
BAD_LINE = "Line %d: JSON parse error"
_SPACE = re.compile(r"[ \t\n\r]*")
# How the types of JSON values are named in messages.
_NAMES = {list: "list", bool: "bool", str: "str", int: "int", float: "float", type(None): "NoneType"}


def read_records(spark: SparkSession, folder: str, kind: str, glob: str | None = None) -> DataFrame:
    """Records and errors of the files of one ``kind``, "json" or "xml", below a folder, or of all whose
    names fit ``glob``. Files above a limit that was set on the content of a file are not opened."""
    files = file_rows(spark, folder, recursiveFileLookup=True, pathGlobFilter=glob or glob_of(kind))
    opened = ["_file", "path", "content"]
    reader = _reader(JSON if kind == "json" else XML)
    if kind != "json" or not streamed(spark, folder):
        return files.select(*opened).mapInArrow(reader, ROWS)
    splits = files.where(F.col("length") > LARGE).select("_file", "path", F.explode(F.sequence(F.lit(0), ((F.col("length") - 1) / SPLIT).cast("int"))).alias("split"))
    wanted = splits.count()
    if not wanted:
        return files.select(*opened).mapInArrow(reader, ROWS)
    by_splits, done = _by_splits(splits.repartition(min(wanted, MOST_TASKS)))
    others = files.join(done, "_file", "left_anti").select(*opened)
    return others.mapInArrow(reader, ROWS).unionByName(by_splits)


def _reader(parse: Callable[[Opened], Iterable[Found]]):
    schema = pa.schema(
        [("_file", pa.string()), ("_source_row", pa.int64()), ("raw", pa.map_(pa.string(), pa.string())), ("error", pa.string())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.set_int_max_str_digits(0)
        for batch in batches:
            for name, path, content in zip(*batch.columns, strict=True):
                chunk: list[Found] = []
                for found in _guarded(parse(opener(path.as_py(), content.as_py()))):
                    chunk.append(found)
                    if len(chunk) == CHUNK:
                        yield _batch(name.as_py(), chunk, schema)
                        chunk = []
                if chunk:
                    yield _batch(name.as_py(), chunk, schema)

    return read


def _guarded(found: Iterable[Found]) -> Iterator[Found]:
    """What is found, and an error where the file cannot be read on."""
    try:
        yield from found
    except (ValueError, LookupError, RecursionError) as e:
        yield None, None, f"File cannot be read: {e}"


def _clean(value):
    """Text without lone surrogates, which JSON can write and UTF-8 cannot."""
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(value, str) else value


def maps(raws: list[dict | None]) -> pa.Array:
    try:
        return _map_array(raws)
    except UnicodeEncodeError:
        return _map_array([None if raw is None else {_clean(k): _clean(v) for k, v in raw.items()} for raw in raws])


def _map_array(raws: list[dict | None]) -> pa.Array:
    """All names and all values as one array each, which is several times faster than entry by entry."""
    keys, values, ends = [], [], [0]
    for raw in raws:
        if raw is not None:
            keys += raw
            values += raw.values()
        ends.append(len(keys))
    # A null among the offsets stands for a null map.
    starts = [None if raw is None else at for raw, at in zip(raws, ends)]
    offsets = pa.array([*starts, ends[-1]], pa.int32())
    return pa.MapArray.from_arrays(offsets, pa.array(keys, pa.string()), pa.array(values, pa.string()))


def _batch(name: str, chunk: list[Found], schema: pa.Schema) -> pa.RecordBatch:
    numbers, raws, errors = zip(*chunk, strict=True)
    errors = [_clean(e) for e in errors]
    columns = [pa.array([name] * len(chunk)), pa.array(numbers, pa.int64()), maps(raws), pa.array(errors, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


# --- JSON -----------------------------------------------------------------------------------------

def _blocks(stream: BinaryIO, errors: str = "replace") -> Iterator[str]:
    """The text of a stream, without a mark at its start. ``send`` tells how much is wanted next."""
    decoder, size, begun = codecs.getincrementaldecoder("utf-8")(errors), BLOCK, False
    while block := stream.read(size):
        text = decoder.decode(block)
        text = text if begun else text.lstrip(BOM)
        begun = begun or text != ""
        size = max(BLOCK, (yield text) or 0)
    yield decoder.decode(b"", True)


class _Text:
    """A window on the text of a stream, at whose place ``at`` values are read."""

    def __init__(self, stream: BinaryIO, errors: str = "replace", place: int = 0, most: int = sys.maxsize):
        """``place`` is that of the stream's first byte in its file, ``most`` the longest window."""
        self.blocks = _blocks(stream, errors)
        self.text, self.at, self.ended = next(self.blocks), 0, False
        self.decode = json.JSONDecoder().raw_decode
        self.passed, self.counted, self.most = place, 0, most

    def place(self) -> int:
        """The byte of the file that begins here, if all of it is UTF-8."""
        self.passed += len(self.text[self.counted : self.at].encode())
        self.counted = self.at
        return self.passed

    def more(self) -> None:
        """Drops what was read and doubles what was not."""
        rest = self.text[self.at :]
        if len(rest) > self.most:
            raise self.wrong("a value is too long")
        self.place()
        try:
            self.text, self.at, self.counted = rest + self.blocks.send(len(rest)), 0, 0
        except StopIteration:
            self.ended = True

    def after(self, skipped: int = 0) -> str:
        """The first character that is no space, ``skipped`` characters on; none at the end."""
        while True:
            at = _SPACE.match(self.text, self.at + skipped).end()
            if at < len(self.text) or self.ended:
                return self.text[at : at + 1]
            self.more()

    def peek(self) -> str:
        """Goes on to the first character that is no space."""
        found = self.after()
        self.at = _SPACE.match(self.text, self.at).end()
        return found

    def value(self) -> object:
        """The value that begins here. One that the window cuts off is in error near the window's end, or as an open
        string; a number may go on."""
        self.peek()
        while True:
            try:
                value, end = self.decode(self.text, self.at)
                if self.ended or end + 4 <= len(self.text):
                    self.at = end
                    return value
            except json.JSONDecodeError as e:
                if self.ended or not (e.msg.startswith("Unterminated string") or e.pos + 16 >= len(self.text)):
                    raise
            self.more()

    def wrong(self, message: str) -> json.JSONDecodeError:
        return json.JSONDecodeError(message, self.text, self.at)


def _to_list(text: _Text) -> bool:
    """Goes to where the list of records begins: the document itself, or the first list of objects of a wrapper
    object (an empty list counts)."""
    if text.peek() != "{":
        return text.peek() == "["
    text.at += 1
    while text.peek() == '"':
        text.value()
        if text.peek() != ":":
            raise text.wrong("expected a colon")
        text.at += 1
        if text.peek() == "[" and text.after(1) in ("{", "]"):
            return True
        text.value()
        if text.peek() != ",":
            break
        text.at += 1
    return False


def _items(text: _Text) -> Iterator[object]:
    """Members of the array that begins here."""
    text.at += 1
    if text.peek() != "]":
        while True:
            yield text.value()
            if text.peek() == "]":
                break
            if text.peek() != ",":
                raise text.wrong("expected a comma")
            text.at += 1
    text.at += 1


def _rest_of_object(text: _Text) -> None:
    """Reads the members after a value of an object, and its end."""
    while text.peek() == ",":
        text.at += 1
        name = text.value()
        if not isinstance(name, str) or text.peek() != ":":
            raise text.wrong("expected a member")
        text.at += 1
        text.value()
    if text.peek() != "}":
        raise text.wrong("expected the end of the object")
    text.at += 1


def _document(opened: Opened) -> tuple[bool, object]:
    """Whether a document, read to its end, holds a list of records; if not, its value."""
    with opened() as stream:
        text = _Text(stream)
        wrapped = text.peek() == "{"
        listed, value = _to_list(text), None
        if listed:
            for _ in _items(text):
                pass
            if wrapped:
                _rest_of_object(text)
            if text.peek():
                raise text.wrong("more after the end")
    if not listed:
        with opened() as stream:
            text = _Text(stream)
            value = text.value()
            if text.peek():
                raise text.wrong("more after the end")
    return listed, value


def _record(number: int, value: object) -> Found:
    if isinstance(value, dict):
        return number, _flat(value), None
    return None, None, SKIPPED % (number, _NAMES[type(value)])


def _split(opened: Opened) -> Iterator[str]:
    """The lines of a text. The last one of a block waits for the next block."""
    with opened() as stream:
        blocks, rest = _blocks(stream), ""
        block = next(blocks)
        while block is not None:
            lines = (rest + block).splitlines(keepends=True)
            rest = lines.pop() if lines else ""
            for line in lines:
                yield line.splitlines()[0]
            try:
                block = blocks.send(len(rest))
            except StopIteration:
                block = None
        yield from rest.splitlines()


def _parsed(opened: Opened) -> Iterator[tuple[int, object]]:
    """Number and value of each line that is not blank; the value of one in error is the error."""
    for number, line in enumerate(_split(opened), 1):
        if line.strip():
            try:
                yield number, json.loads(line)
            except (ValueError, RecursionError) as e:
                yield number, e


def _lines(opened: Opened) -> Iterator[Found]:
    """A record per line; if no line is one, the document as a whole is in error."""
    if not any(isinstance(value, dict) for _, value in _parsed(opened)):
        yield None, None, "JSON parse error"
        return
    good = 0
    for number, value in _parsed(opened):
        if isinstance(value, Exception):
            yield None, None, BAD_LINE % number
        else:
            good += 1
            yield _record(good, value)


def _flat(record: dict) -> dict[str, str | None]:
    """Leaves in the order of the document; lists stay JSON text."""
    out: dict[str, str | None] = {}
    todo = [iter(record.items())]
    names = [""]
    while todo:
        entry = next(todo[-1], None)
        if entry is None:
            todo.pop()
            names.pop()
            continue
        name, value = names[-1] + entry[0], entry[1]
        if isinstance(value, dict):
            todo.append(iter(value.items()))
            names.append(name + "__")
        else:
            out.pop(name, None)  # the later value takes the later place
            out[name] = _text(value)
    return out


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list | bool):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return str(value)


def JSON(opened: Opened) -> Iterator[Found]:
    """An array of records, an object that holds one, a single record, or a record per line."""
    try:
        listed, value = _document(opened)
    except json.JSONDecodeError:
        yield from _lines(opened)
        return
    except RecursionError:
        yield None, None, "JSON parse error: nested too deeply"
        return
    if listed:
        with opened() as stream:
            text = _Text(stream)
            _to_list(text)
            for number, item in enumerate(_items(text), 1):
                yield _record(number, item)
    elif isinstance(value, dict):
        yield _record(1, value)
    else:
        yield None, None, f"Unexpected top-level JSON type: {_NAMES[type(value)]}"


# --- large JSON documents -------------------------------------------------------------------------
#
# A split is a range of bytes; its records are those that begin in it. The first split finds the list by reading on from
# the start of the document. Each other one takes a place between two objects for the begin of a record, and the next such
# place if the text cannot be read on from there. It says where its first record begins, and where the first one after
# the split does. If each split begins where the one before it says, all splits have read what one task would have
# read, as that depends on the place alone: records are numbered on, and the document is read once. If not
# (nested lists that are longer than a split, records that are no objects, bytes that are no UTF-8, a document
# in error), the file is left to one task.

PARTS = (
    "_file string, split int, attempt int, nth bigint, raw map<string,string>, other string, "
    "first bigint, next bigint, n bigint, wrapped boolean, ended string"
)
#: Bytes before a split in which the end of the record before is looked for, and places that are tried.
LOOK_BACK, TRIES = 4096, 100
_BETWEEN = re.compile(rb"\}[ \t\n\r]*,[ \t\n\r]*(?=\{)")
_MARK = BOM.encode()


def _ending(text: _Text) -> str:
    """How the document ends after a list that ends here: as a list, or as an object around it."""
    text.at += 1
    kind = "object" if text.peek() else "list"
    if kind == "object":
        _rest_of_object(text)
        if text.peek():
            raise text.wrong("more after the end")
    return kind


def _upto(text: _Text, upto: int) -> Iterator[object]:
    """Items from here on that begin before a byte. Returns how the document ends, if it does."""
    while True:
        text.peek()
        if text.place() >= upto:
            return None
        yield text.value()
        if text.peek() == "]":
            return _ending(text)
        if text.peek() != ",":
            raise text.wrong("expected a comma")
        text.at += 1


def _first_split(opened: Callable[[int], BinaryIO], upto: int) -> Iterator[tuple]:
    begin = 0
    with opened(0) as stream:
        while stream.read(len(_MARK)) == _MARK:
            begin += len(_MARK)
    with opened(begin) as stream:
        text = _Text(stream, "strict", begin, upto - begin)
        wrapped = text.peek() == "{"
        if not _to_list(text):
            raise text.wrong("expected a list")
        text.at += 1
        first, n = text.place(), 0
        ended = _ending(text) if text.peek() == "]" else None
        if ended is None:
            items = _upto(text, upto)
            while True:
                try:
                    item = next(items)
                except StopIteration as end:
                    ended = end.value
                    break
                n += 1
                yield 0, n, item
        yield 0, first, text.place(), n, wrapped, ended


def _later_split(opened: Callable[[int], BinaryIO], begin: int, upto: int) -> Iterator[tuple]:
    back = max(0, begin - LOOK_BACK)
    with opened(back) as stream:
        around = stream.read(upto + 1 - back)
    at = 0
    for attempt in range(TRIES):
        found = _BETWEEN.search(around, at)
        while found and back + found.end() < begin:
            found = _BETWEEN.search(around, found.end())
        if not found or back + found.end() >= upto:
            return
        first, n = back + found.end(), 0
        with opened(first) as stream:
            text = None
            try:
                text = _Text(stream, "strict", first, upto - begin)
                items = _upto(text, upto)
                while True:
                    try:
                        item = next(items)
                    except StopIteration as end:
                        yield attempt, first, text.place(), n, None, end.value
                        return
                    n += 1
                    yield attempt, n, item
            except (ValueError, RecursionError):
                # Places up to here lie in the same list or text; the object that ended here may be a record.
                at = max(found.end(), (text.place() if text else first) - 1 - back)


def _split_items(opened: Callable[[int], BinaryIO], split: int, size: int) -> Iterator[tuple]:
    """(attempt, nth, item) of the items of a split, and at last, if there is a place from which on it can be read, (attempt, byte of
    the first, byte of the first after the split, number, whether the document is an object, how it ends)."""
    try:
        yield from _later_split(opened, split * size, (split + 1) * size) if split else _first_split(opened, size)
    except (ValueError, RecursionError):
        return


def _split_reader(size: int):
    kinds = [
        pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(),
        pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(),
    ]
    names = [part.split(" ")[0] for part in PARTS.split(", ")]

    def made(key: str, split: int, rows: list[tuple]) -> pa.RecordBatch:
        attempt, nth, raw, other, *summary = zip(*rows, strict=True)
        columns = [[key] * len(rows), [split] * len(rows), attempt, nth, maps(list(raw)), other, *summary]
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.set_int_max_str_digits(0)
        for batch in batches:
            for key, path, split in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = []
                for attempt, *found in _split_items(lambda place: open_at(path, place), split, size):
                    if len(found) == 2:
                        nth, item = found
                        is_record = isinstance(item, dict)
                        raw, other = _flat(item) if is_record else None, None if is_record else _NAMES[type(item)]
                        rows.append((attempt, nth, raw, other, None, None, None, None, None))
                    else:
                        rows.append((attempt, None, None, None, *found))
                    if len(rows) >= CHUNK:
                        yield made(key, split, rows)
                        rows = []
                if rows:
                    yield made(key, split, rows)

    return read


def _chain(size: int):
    """Of the splits of a file those that make up its document, with the number of items before; none if they do not fit."""
    def fitting(found: pd.DataFrame) -> pd.DataFrame:
        good, place, before, wrapped, fits = [], None, 0, None, False
        columns = ["_file", "split", "attempt", "first", "next", "n", "wrapped", "ended"]
        for key, split, attempt, first, after, n, is_wrapped, ended in found.sort_values("split")[columns].itertuples(index=False, name=None):
            if place is None and split:
                break  # the first one has found no list
            if place is not None:
                expected = place // size
                if split < expected:
                    continue  # a record of an earlier split goes on up to its end
                if split > expected or first != place:
                    break
            wrapped = is_wrapped if place is None else wrapped
            good.append((key, split, attempt, before))
            place, before = after, before + n
            if isinstance(ended, str):
                fits = ended == ("object" if wrapped else "list")
                break
        return pd.DataFrame(good if fits else [], columns=["_file", "split", "attempt", "before"])

    return fitting


def _by_splits(splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows as of ``read_records``, files) of the documents whose splits (_file, path, split) fit."""
    parts = stage(splits.mapInArrow(_split_reader(SPLIT), PARTS), "parts")
    facts = parts.where("n IS NOT NULL").drop("nth", "raw", "other")
    chain = facts.groupBy("_file").applyInPandas(_chain(SPLIT), "_file string, split int, attempt int, before bigint")
    chain = stage(chain, "splits")
    per_split = F.broadcast if chain.count() <= MANY_KEYS else shuffled
    number = F.col("before") + F.col("nth")
    is_record = F.col("other").isNull()
    rows = parts.where("nth IS NOT NULL").join(per_split(chain), ["_file", "split", "attempt"]).select(
        "_file", F.when(is_record, number).alias("_source_row"), "raw",
        F.when(~is_record, F.format_string(SKIPPED, number, "other")).alias("error"),
    )
    return rows, per_split(chain.select("_file").distinct())


def read_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of the line-delimited JSON below a folder, which Spark splits: rows (_file, _source_row, raw) are
    numbered among the lines that parse, errors (_file, error) name the line."""
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter=glob_of("ndjson")).text(folder).select("value", *position())
    parsed = stage(
        lines.mapInArrow(_line_reader, "_file string, _block bigint, _seq bigint, raw map<string,string>, other string, bad boolean"),
        "lines",
    )
    numbered = with_ordinals(parsed.where("raw IS NOT NULL OR other IS NOT NULL"), 1, dense=True)
    skipped = numbered.where("raw IS NULL").select("_file", F.format_string(SKIPPED, "_source_row", "other").alias("error"))
    bad = with_ordinals(parsed, 1).where("bad").select("_file", F.format_string(BAD_LINE, "_source_row").alias("error"))
    return numbered.where("raw IS NOT NULL").select("_file", "_source_row", "raw"), skipped.unionByName(bad)


def _line_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.set_int_max_str_digits(0)
    names = ["_file", "_block", "_seq", "raw", "other", "bad"]
    for batch in batches:
        raws, others, bads = [], [], []
        for line in batch.column(0).to_pylist():
            raw, other, bad = None, None, False
            line = line.lstrip(BOM)
            if line.strip():
                try:
                    value = json.loads(line)
                    raw = _flat(value) if isinstance(value, dict) else None
                    other = None if isinstance(value, dict) else _NAMES[type(value)]
                except (ValueError, RecursionError):
                    bad = True
            raws.append(raw)
            others.append(other)
            bads.append(bad)
        made = [maps(raws), pa.array(others, pa.string()), pa.array(bads, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=names)


# --- XML ------------------------------------------------------------------------------------------

def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def XML(opened: Opened) -> Iterator[Found]:
    """The records are the children of the root with the commonest name (the earlier one on a
    tie), numbered among all children."""
    try:
        names = Counter(_local(child.tag) for child in children(opened))
    except (ElementTree.ParseError, ValueError, LookupError) as e:  # also encodings that are not known
        yield None, None, f"XML parse error: {e}"
        return
    if not names:
        yield None, None, "Could not detect record element in XML"
        return
    record = names.most_common(1)[0][0]
    for number, child in enumerate(children(opened), 1):
        if _local(child.tag) == record:
            yield number, dict(_leaves(child)), None


def _leaves(record: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """Attributes as ``path@name``; the text of an element under its path."""
    todo = [(record, "")]
    while todo:
        element, path = todo.pop()
        for name, value in element.attrib.items():
            yield f"{path}@{_local(name)}", value
        if path and element.text and (element.text.strip() or not len(element)):
            yield path, element.text.strip()
        prefix = f"{path}__" if path else ""
        todo += [(child, prefix + _local(child.tag)) for child in reversed(element)]
