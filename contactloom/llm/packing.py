"""Packing by shortest-pack-first over the histogram of lengths.

Documents are cut into pieces of at most ``WIDTH`` ids. The driver sees only how many pieces
there are of each length. From the longest length to the shortest, the pieces of a length
go into the patterns (kinds of sequences begun so far) that are filled least and still have
room, as many at once as there are sequences of that pattern; what finds no room begins new
sequences. A pattern is a list of lengths with a count, so the work does not depend on the
number of documents, and there are few patterns.

Pieces then find their place by rank: the pieces of a length are numbered without gaps, and
ranges of these numbers belong to the patterns. A number is counted in two steps (within a
slice of the length, and over the slices before), so a length shared by a third of all pieces is
numbered by many tasks.

A null text counts as empty: its one id is the end mark. Rows that repeat are packed again.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import byte_ranges
from contactloom.llm.tokens import END, TABLE, forget, tokenizer
from contactloom.session import stage

WIDTH = 2048
#: Bytes of text that are encoded at once.
BUFFER = 4 << 20
#: The same, and words in a worker's table, where memory is short.
LEAN_BUFFER = 1 << 20
LEAN_TABLE = 200_000
#: A length is numbered in so many slices.
SLICES = 64


def cut_pieces(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, ids: bool = False,
    lean: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for): the pieces of each document.

    Workers keep the words they have met for their next task, unless ``lean``: then they keep fewer, and none when
    a task ends. That costs time, and leaves memory to what else runs in the session.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = {"start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long"}
    if ids:
        parts["ids"] = "array<int>"
    schema = rows.select("doc_id", *[F.lit(None).cast(kind).alias(name) for name, kind in parts.items()]).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary, LEAN_TABLE if lean else TABLE)
        for batch in batches:
            for low, length in byte_ranges(batch.column(1), LEAN_BUFFER if lean else BUFFER):
                part = batch.slice(low, length)
                found, ends = words.encode(part.column(1), END)
                sizes = np.diff(ends, prepend=0)
                count = -(-sizes // width)
                owner = np.repeat(np.arange(len(sizes)), count)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                first = (ends - sizes)[owner] + nth * width
                last = np.minimum(first + width, ends[owner])
                pieces = [found[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                columns = [
                    part.column(0).take(pa.array(owner)),
                    pa.array(nth * width),
                    pa.array(last - first),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                    pa.array(sizes[owner]),
                ]
                if ids:
                    columns.append(pa.array([p.view("<i4") for p in pieces], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if lean:
            del words
            forget()

    return rows.mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, list[int]]]:
    """[(count, lengths)]: how often each pattern of lengths is used."""
    open_by_fill: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        fill = min((f for f in open_by_fill if f + length <= width), default=None)
        while left and fill is not None:
            count, lengths = open_by_fill[fill].pop()
            if not open_by_fill[fill]:
                del open_by_fill[fill]
            used = min(left, count)
            if count > used:
                open_by_fill[fill].append((count - used, lengths))
            open_by_fill[fill + length].append((used, [*lengths, length]))
            left -= used
            fill = min((f for f in open_by_fill if f + length <= width), default=None)
        if left:
            open_by_fill[length].append((left, [length]))
    return [pattern for fill in sorted(open_by_fill) for pattern in open_by_fill[fill]]


def _ranges(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first, offset in it) for each place in a pattern."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + count - 1, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return out


def pack(pieces: DataFrame, width: int = WIDTH, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``pieces`` (with ``length``) and their sequence_id and offset. Read three times: pass a table."""
    spark = pieces.sparkSession
    histogram = {int(r.length): r["count"] for r in pieces.groupBy("length").count().collect()}
    if any(length > width for length in histogram):
        raise ValueError(f"pieces longer than {width}")
    places = _ranges(shortest_pack_first(histogram, width))
    # Ranges of one length are cut in two by the patterns that use it; their number is bounded by
    # the lengths of the histogram and the places of a sequence, not by the documents.
    table = spark.createDataFrame(places, "length long, low long, high long, first long, offset long")

    named = pieces.select("*", F.pmod(F.xxhash64(*order), F.lit(SLICES)).alias("__slice"))
    own = Window.partitionBy("length", "__slice").orderBy(*order, F.xxhash64(*pieces.columns))
    counts = pieces.groupBy("length", F.pmod(F.xxhash64(*order), F.lit(SLICES)).alias("__slice")).agg(
        F.count("*").alias("n")
    )
    before = Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    # At most width * SLICES rows.
    ranked = (
        named.withColumn("__nth", F.row_number().over(own) - 1)
        .join(F.broadcast(firsts), ["length", "__slice"])
        .withColumn("__rank", F.col("__first") + F.col("__nth"))
    )
    here = F.broadcast(table.withColumnRenamed("length", "__length"))
    met = (F.col("length") == F.col("__length")) & F.col("__rank").between(F.col("low"), F.col("high"))
    return ranked.join(here, met).select(
        *pieces.columns, (F.col("first") + F.col("__rank") - F.col("low")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, ids: bool = False, lean: bool = False):
    """Every document in sequences of ``width`` ids: its pieces with sequence_id and offset."""
    return pack(stage(cut_pieces(docs, vocabulary, doc_id, text, width, ids, lean), "pieces"), width)


def sequences(packed: DataFrame, width: int = WIDTH, padding: int = 0) -> DataFrame:
    """(sequence_id, ids, lengths) from packed pieces with ids: each padded to ``width``."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    return parts.select(
        "sequence_id",
        F.concat(ids, F.array_repeat(F.lit(padding), width - F.size(ids))).alias("ids"),
        F.col("p.length").alias("lengths"),
    )
