"""Files that tasks open themselves and read on as streams, so that no task holds a whole file."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from functools import partial
from typing import BinaryIO
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Opened = Callable[[], BinaryIO]
#: Spark's own limit on the content of a file, as it stands unless somebody has set another one.
UNLIMITED = 2**31 - 1
#: Bytes of an XML document that are parsed at once.
BLOCK = 1 << 16
# Names that Hadoop and Arrow give to the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}
_PARTS = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(.*)", re.DOTALL)


def _store(path: str):
    """(file system or None for the local one, path in it) of a path as Hadoop writes it, with plain characters."""
    scheme, place, rest = _PARTS.fullmatch(path).groups()
    if (scheme or "file") == "file":
        return None, rest
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{place or ''}/")
    return store, root.rstrip("/") + rest


def open_file(path: str) -> BinaryIO:
    store, rest = _store(path)
    return open(rest, "rb") if store is None else store.open_input_stream(rest)


def open_at(path: str, place: int) -> BinaryIO:
    """A file from a byte on."""
    store, rest = _store(path)
    stream = open(rest, "rb") if store is None else store.open_input_file(rest)
    stream.seek(place)
    return stream


def opener(path: str, content: bytes | None) -> Opened:
    """What opens a file anew each time: its content, if Spark has brought it, else the file itself."""
    return partial(open_file, path) if content is None else partial(io.BytesIO, content)


def _opens(path: str) -> bool:
    try:
        _store(path)
    except (ValueError, OSError, ImportError):
        return False
    return True


def most_bytes(spark: SparkSession, folder: str | list[str]) -> int | None:
    """The longest file that is read, if there is a limit: one that was set, or Spark's own where tasks cannot open files."""
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    return None if most >= UNLIMITED and streamed(spark, folder) else most


def streamed(spark: SparkSession, folder: str | list[str]) -> bool:
    """Whether tasks can open the files below the folders; other stores are read by Spark, whole files at a time."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for one in [folder] if isinstance(folder, str) else folder:
        path = hadoop.Path(one)
        if not _opens(path.getFileSystem(conf).getUri().toString() + "/"):
            return False
    return True


def file_rows(spark: SparkSession, folder: str | list[str], **options) -> DataFrame:
    """(_file, path, content, length) of the files below a folder; ``content`` is null where tasks open the file at ``path``."""
    files = spark.read.format("binaryFile").options(**options).load(folder)
    most = most_bytes(spark, folder)
    if most is not None:
        files = files.where(F.col("length") <= most)
    content: Column = F.lit(None).cast("binary") if streamed(spark, folder) else F.col("content")
    return files.select(F.col("_metadata.file_path").alias("_file"), "path", content.alias("content"), "length")


def children(opened: Opened) -> Iterator[ElementTree.Element]:
    """The children of the root, each whole, and given up when the next one is asked for."""
    root, depth = None, 0
    with opened() as stream:
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                root = element if root is None else root
                depth += 1
                continue
            depth -= 1
            if depth == 1:
                yield element
                root.clear()


class _Names:
    """Target of a parser that keeps the names of the children of the root only."""

    def __init__(self):
        self.found, self.depth = [], 0

    def start(self, name: str, attributes: dict) -> None:
        self.depth += 1

    def end(self, name: str) -> None:
        self.depth -= 1
        if self.depth == 1:
            self.found.append(name)


def child_names(opened: Opened) -> Iterator[list[str]]:
    """The names of the children of the root, as they stand, by blocks of the document. No elements are made."""
    target = _Names()
    parser = ElementTree.XMLParser(target=target)
    with opened() as stream:
        while block := stream.read(BLOCK):
            parser.feed(block)
            yield target.found
            target.found = []
    parser.close()
    yield target.found
