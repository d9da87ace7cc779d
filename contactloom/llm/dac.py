"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every
id, level 1 the second chunk of the ids that have one, and so on. A continuation bitmap per
level tells which ids go on, and a rank directory (ones before every 512 bits and, within
those, before every 64) turns the place of an id on one level into its place on the next. So
any id, or any stretch of ids, is read without decoding what lies before it.

File image (all numbers little-endian): magic ``DAC1``, u32 documents, u32 levels; per document
u8 "has an identifier", i64 identifier; u64 ends of the documents in ids; per level u64 number of
chunks, the chunks, the bitmap in 64-bit words, u64 per 512 bits, u16 per 64 bits.

Images lie in a Parquet table in the shared folder, one row each, so that any store Spark
can write to will do. Documents are in ascending order of identifiers across images; a bucket
of identifiers makes one or more images. Documents without an identifier come first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import byte_ranges, ordered_buckets
from contactloom.llm.tokens import END, forget, tokenizer
from contactloom.session import stage

MAGIC = b"DAC1"
#: Ids after which an image is closed; a longer document has one of its own.
IMAGE_IDS = 1 << 19
#: Bytes of text that are encoded at once.
BUFFER = 5 << 20
#: Entries of a worker's word table; texts are being sorted in the same executor.
TABLE = 850_000
BITS = 8


def write_image(names: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The image of some documents."""
    ends = np.cumsum([len(x) for x in ids], dtype="<u8")
    rest = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    levels = []
    while True:
        goes_on = rest >= 1 << BITS
        levels.append(_level((rest & 255).astype(np.uint8), goes_on))
        if not goes_on.any():
            break
        rest = rest[goes_on] >> BITS
    known = np.array([n is not None for n in names], np.uint8)
    head = MAGIC + struct.pack("<II", len(names), len(levels))
    return b"".join([head, known.tobytes(), np.array([n or 0 for n in names], "<i8").tobytes(), ends.tobytes(), *levels])


def _level(chunks: np.ndarray, goes_on: np.ndarray) -> bytes:
    words = -(-len(chunks) // 512) * 8 + 8  # whole 512-bit blocks, and one more to ask about the end
    bits = np.zeros(words * 64, bool)
    bits[: len(chunks)] = goes_on
    bitmap = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.bitwise_count(bitmap).astype(np.uint64).reshape(-1, 8)
    inside = np.cumsum(ones, axis=1) - ones
    blocks = ones.sum(axis=1)
    before = np.cumsum(blocks) - blocks
    return b"".join(
        [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), before.astype("<u8").tobytes(), inside.astype("<u2").tobytes()]
    )


class Image:
    """Reads an image at any place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not an image of token ids")
        documents, levels = struct.unpack_from("<II", data, 4)
        self._data, self._at = data, 12
        known, names = self._take(np.uint8, documents), self._take("<i8", documents)
        self.names = [int(n) if k else None for k, n in zip(known, names, strict=True)]
        self.ends = self._take("<u8", documents).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(self._take("<u8", 1)[0])
            chunks, words = self._take(np.uint8, n), -(-n // 512) * 8 + 8
            self.levels.append((chunks, self._take("<u8", words), self._take("<u8", words // 8), self._take("<u2", words)))

    def _take(self, kind, count: int) -> np.ndarray:
        found = np.frombuffer(self._data, kind, count, self._at)
        self._at += found.nbytes
        return found

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        out = np.zeros(len(places), "<u4")
        which, at = np.arange(len(places)), np.asarray(places, np.int64)
        for level, (chunks, bitmap, before, inside) in enumerate(self.levels):
            out[which] |= chunks[at].astype("<u4") << np.uint32(BITS * level)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            goes_on = (bitmap[word] >> bit & np.uint64(1)).astype(bool)
            if not goes_on.any():
                break
            which, word, bit = which[goes_on], word[goes_on], bit[goes_on]
            low = bitmap[word] & ((np.uint64(1) << bit) - np.uint64(1))
            at = (before[word >> 3] + inside[word] + np.bitwise_count(low)).astype(np.int64)
        return out

    def document(self, number: int) -> np.ndarray:
        """All ids of a document. Its chunks lie side by side on every level, so each level takes one rank."""
        low, high = int(self.ends[number - 1]) if number else 0, int(self.ends[number])
        out, which = None, None
        for level, (chunks, bitmap, before, inside) in enumerate(self.levels):
            part = chunks[low:high].astype("<u4")
            if which is None:
                out = part
            else:
                out[which] |= part << np.uint32(BITS * level)
            bits = np.unpackbits(bitmap[low >> 6 : (high >> 6) + 1].view(np.uint8), bitorder="little")
            on = np.flatnonzero(bits[low & 63 : (low & 63) + high - low])
            if not len(on):
                break
            word = low >> 6
            head = int(bitmap[word]) & ((1 << (low & 63)) - 1)
            low = int(before[word >> 3]) + int(inside[word]) + head.bit_count()
            high = low + len(on)
            which = on if which is None else which[on]
        return out


def write_ids(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", image_ids: int = IMAGE_IDS
) -> DataFrame:
    """Writes the ids of whole texts, each ended by id ``END``; the table of images (start, n_ids, image).

    ``start`` is the number of ids before an image. Null texts count as empty. Rows of one identifier are in the
    order of their texts' hashes and then of their texts, so the images do not depend on how the rows were dealt.
    """
    spark = docs.sparkSession
    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        ordered_buckets(docs, doc_id, text, pieces).alias("bucket"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    sorted_rows = rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary, TABLE)
        names, ids, held, bucket, start, number = [], [], 0, None, 0, 0

        def image():
            columns = [[bucket], [number], [start], [held], [write_image(names, ids)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        fields = pa.schema(
            [("bucket", pa.int32()), ("number", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())]
        )
        for batch in batches:
            for low, length in byte_ranges(batch.column(2), BUFFER):
                part = batch.slice(low, length)
                found, ends = words.encode(part.column(2), END)
                for own, name, data in zip(
                    part.column(0).to_pylist(), part.column(1).to_pylist(), np.split(found, ends[:-1]), strict=True
                ):
                    if names and (own != bucket or held >= image_ids):
                        yield image()
                        start, number = (start + held, number + 1) if own == bucket else (0, 0)
                        names, ids, held = [], [], 0
                    bucket = own
                    names.append(name)
                    ids.append(data)
                    held += len(data)
        if names:
            yield image()

    images = stage(
        sorted_rows.mapInArrow(write, "bucket int, number int, start long, n_ids long, image binary"), "images"
    )
    sums = images.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # At most two rows for each bucket; there are four buckets for each shuffle partition.
    return images.join(F.broadcast(first), "bucket").select(
        (F.col("first") + F.col("start")).cast("long").alias("start"), "n_ids", "image"
    )


def read_documents(images: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): each document, read from the images by its place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = Image(data.as_py())
                starts = np.concatenate(([0], image.ends[:-1])).astype(np.int64)
                checks = [zlib.crc32(image.document(i).tobytes()) for i in range(len(image.names))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(image.names, pa.int64()), pa.array(start + starts), pa.array(image.ends - starts), pa.array(checks, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return images.select("start", "image").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
