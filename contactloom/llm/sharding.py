"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``VIRTUAL`` points of a ring. A document's key falls into an arc between
two points and belongs to the shard at its clockwise end, unless that shard is full: no
shard takes more than (1 + ``SLACK``) times the mean number of bytes, and what overflows
goes on clockwise to the next point of a shard with room. Balance is therefore guaranteed
(with 16 shards none is more than 0.1 % above the mean), and documents move only where the
ring or a full shard makes them.

The order in which documents are placed is a second hash of the key, cut into ``SLICES``.
All documents of one arc and one slice form a cell, the smallest thing that is placed; the
driver sees nothing but the ``shards * VIRTUAL * SLICES`` sizes and counts of the cells, however
large the corpus is. A cell larger than the room of every shard goes to the emptiest one.

A null or empty text has size 1. A null identifier is keyed by its text. Equal rows (same
identifier and text) are told apart by a running number, so that a million repeats spread
over the ring as a million keys. The result has one row per input row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import points_before
from contactloom.session import stage

VIRTUAL = 64
SLICES = 64
SLACK = 0.001


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(position, shard) clockwise; a shard's points do not depend on how many others there are."""
    points = []
    for shard in range(shards):
        for copy in range(virtual):
            digest = hashlib.md5(f"shard {shard} point {copy}".encode()).digest()
            points.append((int.from_bytes(digest[:7], "big"), shard))
    return sorted(points)


def place(cells, shards: int, virtual: int = VIRTUAL, slack: float = SLACK):
    """[(arc, slice, shard, home, hops, first slot)] for cells (arc, slice, bytes, rows), by slice and arc."""
    owners = [shard for _, shard in ring(shards, virtual)]
    total = sum(c[2] for c in cells)
    capacity = -int(-total * (1 + slack) // shards)
    room, count = [capacity] * shards, [0] * shards
    placed = []
    for arc, part, size, rows in sorted(cells, key=lambda c: (c[1], c[0])):
        tried: list[int] = []
        for step in range(len(owners)):
            shard = owners[(arc + step) % len(owners)]
            if shard not in tried:
                tried.append(shard)
                if room[shard] >= size or len(tried) == shards:
                    break
        if room[shard] < size:
            shard = max(range(shards), key=lambda s: room[s])
        placed.append((arc, part, shard, owners[arc], tried.index(shard), count[shard]))
        room[shard] -= size
        count[shard] += rows
    return placed


def shard_documents(
    docs: DataFrame,
    shards: int,
    doc_id: str = "doc_id",
    text: str = "text",
    virtual: int = VIRTUAL,
    slices: int = SLICES,
    slack: float = SLACK,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home_shard, hops), a row for each of ``docs``.

    ``home_shard`` is the owner on the ring, ``hops`` the number of full shards passed.
    ``slot`` counts the documents of a shard without gaps.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    single = counted.withColumn("copy", F.explode(F.expr("sequence(0L, n - 1)"))).drop("n")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws("-", F.lit("null"), "size", "text_crc32"))
    key = F.md5(F.concat_ws("#", name, F.when(F.col("copy") > 0, F.col("copy").cast("string"))))
    ends = [position for position, _ in ring(shards, virtual)]
    # A key on a point belongs to it; beyond the last point the ring starts again.
    position = F.conv(F.substring(key, 1, 14), 16, 10).cast("long")
    part = (F.conv(F.substring(key, 15, 8), 16, 10).cast("long") % slices).cast("int")
    located = single.withColumn("position", position).withColumn("part", part).withColumn(
        "arc", points_before(ends, F.col("position")) % len(ends)
    )
    located = stage(located.select("doc_id", "size", "text_crc32", "copy", "arc", "part"), "ring")
    sums = located.groupBy("arc", "part").agg(F.sum("size"), F.count("*"))
    cells = list(zip(*[c.to_pylist() for c in sums.toArrow().columns], strict=True))
    schema = pa.schema([(n, pa.int32()) for n in ("arc", "part", "shard", "home_shard", "hops")] + [("first_slot", pa.int64())])
    columns = list(zip(*place(cells, shards, virtual, slack), strict=True)) or [[]] * len(schema)
    placed = spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema))
    within = Window.partitionBy("arc", "part").orderBy("doc_id", "size", "text_crc32", "copy")
    numbered = located.withColumn("nth", F.row_number().over(within) - 1)
    # At most shards * virtual * slices rows of 28 bytes, whatever the input.
    joined = numbered.join(F.broadcast(placed), ["arc", "part"])
    return joined.select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("first_slot") + F.col("nth")).cast("long").alias("slot"),
        "home_shard",
        "hops",
    )
