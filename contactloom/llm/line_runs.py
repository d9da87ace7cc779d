"""Repeated line runs, by a suffix array over sequences of line ids.

Every document is a sequence of line ids. Suffixes (a document from some line on) are sorted by
distributed prefix doubling: a suffix is ranked by its first line, then by its first 2, 4, 8 ...
lines, each time from the ranks of its two halves. A rank counts the suffixes that sort before,
so the ranks of a round are the suffix array to that depth, and suffixes of equal rank form an
interval in which the longest common prefix is at least that long. Lines that occur once end every
repeat; they are left out at the start and cut the sequences. A suffix takes part in the next
round only while a stretch it may decide is longer than its rank is deep.

A run of lines is repeated if it occurs earlier: in a document with a smaller identifier, or further
up in the same one. What is deleted are the later copies of maximal repeated runs with
``MIN_WORDS`` words or more. Such a run is the union of the shortest stretches inside it that have
``MIN_WORDS`` words and begin, or end, at one of its lines. A stretch of n lines is told by the two
ranks of depth 2^k <= n that begin at its first line and end at its last; the earliest suffix in the
interval of that pair is the copy that stays. So rounds stop at the depth of the longest stretch, and
the result is the one that ranks of full depth would give.

Null texts count as empty. Rows with the same identifier and text are one document, and all get the
same result; rows with an equal identifier and different texts are ordered by a hash of the text;
rows without an identifier come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import few, let
from contactloom.session import stage

MIN_WORDS = 50
#: Ranges into which the followers of one line are cut when they are ranked.
SPREAD = 64


def stretches(words: np.ndarray, least: int) -> list[list[int]]:
    """For each line the ends (exclusive) of the stretches that begin there: the shortest with
    ``least`` words from that line on, and those that are the shortest up to their last line."""
    n = len(words)
    before = np.concatenate(([0], np.cumsum(words)))
    ends: list[set[int]] = [set() for _ in range(n)]
    for start, end in enumerate(np.searchsorted(before, before[:-1] + least, side="left").tolist()):
        if end <= n:
            ends[start].add(end)
    for last, start in enumerate((np.searchsorted(before, before[1:] - least, side="right") - 1).tolist()):
        if start >= 0:
            ends[start].add(last + 1)
    return [sorted(e) for e in ends]


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(id, hash, line, h, ends) for every line of docs (id, hash, text)."""
    schema = docs.select(
        "id", "hash", F.lit(0).alias("line"), F.lit(0).cast("long").alias("h"), F.array(F.lit(0)).alias("ends")
    ).schema

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                owner, line, h, ends = [], [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    own = text.encode().split(b"\n")
                    words = np.fromiter((len(x.split()) for x in own), np.int64, len(own))
                    owner.extend([i] * len(own))
                    line.extend(range(len(own)))
                    h.extend(map(xxhash.xxh64_intdigest, own))
                    ends.extend(stretches(words, least))
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at),
                        part.column(1).take(at),
                        pa.array(line, pa.int32()),
                        pa.array(np.array(h, np.uint64).view(np.int64)),
                        pa.array(ends, pa.list_(pa.int32())),
                    ],
                    names=schema.names,
                )

    return docs.select("id", "hash", "text").mapInArrow(split, schema)


def _sum_before(counts: DataFrame, group: list[str], order: str, cut: Column) -> DataFrame:
    """``counts`` with ``before``: the sum of n over smaller ``order`` in the group. ``cut`` grows with
    ``order`` and cuts a group into ranges; only their sums meet in one task."""
    parts = counts.withColumn("cut", cut)
    keys = [*group, "cut"]
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(*keys).agg(F.sum("n").alias("m"))
    starts = starts.select(*keys, F.coalesce(F.sum("m").over(across), F.lit(0)).alias("start"))
    own = parts.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return own.join(starts, keys).withColumn("before", F.col("start") + F.col("own")).drop("cut", "start", "own")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """The lines that occur more than once, ranked by their id; ``seg`` numbers unbroken stretches of them."""
    repeated = lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    ranked = _sum_before(stage(repeated, "repeated"), [], "h", F.shiftright("h", 48)).select("h", F.col("before").alias("r"))
    doc = Window.partitionBy("id", "hash").orderBy("line")
    seg = Window.partitionBy("id", "hash", "seg")
    # Rows with the same identifier and text are one document.
    rows = lines.join(ranked, "h").repartition("id", "hash").dropDuplicates(["id", "hash", "line"])
    rows = rows.withColumn("seg", F.col("line") - F.row_number().over(doc))
    rows = rows.withColumn("last", F.max("line").over(seg))
    return rows.select(
        "id", "hash", "line", "seg", "r", F.expr("filter(ends, e -> e <= last + 1)").alias("ends")
    )


def _deeper(ranks: DataFrame, depth: int, total: int) -> DataFrame:
    """Ranks of twice the depth, for the suffixes that are long enough and in segments that need them."""
    seg = Window.partitionBy("id", "hash", "seg")
    longest = F.expr("coalesce(array_max(ends) - line, 0)")
    needed = ranks.withColumn("low", F.lead("r", depth).over(seg.orderBy("line"))).withColumn(
        "longest", F.max(longest).over(seg)
    )
    pairs = stage(needed.where((F.col("longest") >= 2 * depth) & F.col("low").isNotNull()), "pairs").drop("longest")
    pairs = few(pairs, pairs.count())
    counts = pairs.groupBy("r", "low").agg(F.count("*").alias("n"))
    cut = F.floor(F.col("low") * SPREAD / max(1, total)).cast("int")
    ranked = _sum_before(counts, ["r"], "low", cut).select(
        F.col("r").alias("high"), F.col("low").alias("next"), (F.col("r") + F.col("before")).alias("deeper")
    )
    met = (pairs.r == ranked.high) & (pairs.low == ranked.next)
    return pairs.join(ranked, met).select("id", "hash", "line", "seg", F.col("deeper").alias("r"), "ends")


def _named(ranks: DataFrame, depth: int) -> DataFrame:
    """(id, hash, line, end, a, b): stretches of depth to 2 * depth - 1 lines, named by two ranks."""
    each = ranks.select("id", "hash", "line", "r", F.explode("ends").alias("end"))
    each = each.where(F.col("end") - F.col("line") >= depth).where(F.col("end") - F.col("line") < 2 * depth)
    same = each.where(F.col("end") - F.col("line") == depth).select("id", "hash", "line", "end", F.col("r").alias("a"), F.col("r").alias("b"))
    if depth == 1:
        return same
    longer = each.where(F.col("end") - F.col("line") > depth).withColumn("at", F.col("end") - depth)
    second = ranks.select(F.col("id").alias("id2"), F.col("hash").alias("hash2"), F.col("line").alias("at2"), F.col("r").alias("b"))
    met = F.col("id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2")) & (F.col("at") == F.col("at2"))
    return same.unionByName(longer.join(second, met).select("id", "hash", "line", "end", F.col("r").alias("a"), "b"))


def repeated_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(id, hash, lines): numbers of the lines of docs (id, hash, text) to delete, sorted."""
    lines = stage(_lines(docs, least), "lines")
    ranks = stage(_first_ranks(lines), "ranks")
    total = ranks.count()
    depth, found = 1, []
    while True:
        found.append(_named(ranks, depth))
        if ranks.where(F.expr("array_max(ends) - line") >= 2 * depth).isEmpty():
            break
        ranks = stage(_deeper(ranks, depth, total), "ranks")
        ranks = few(ranks, ranks.count())
        depth *= 2
    named = found[0]
    for more in found[1:]:
        named = named.unionByName(more)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "line")
    named = stage(named.withColumn("n", F.col("end") - F.col("line")).withColumn("place", place), "stretches")
    # Most copies meet on the way to the earliest one, before the shuffle.
    first = named.groupBy("n", "a", "b").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    first = first.where("copies > 1").drop("copies")
    later = named.join(first, ["n", "a", "b"]).where("place != first")
    gone = later.select("id", "hash", F.explode(F.expr("sequence(line, end - 1)")).alias("line"))
    return gone.groupBy("id", "hash").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(doc, text, n_lines, n_removed, removed): each row of ``docs`` as a struct, what is left of its
    text (null only where it was), its number of lines, and the numbers, from 0, of those removed."""
    content = F.coalesce(F.col(text), F.lit(""))
    gone = repeated_lines(docs.select(F.col(doc_id).alias("id"), F.xxhash64(content).alias("hash"), content.alias("text")), least)
    gone = stage(gone, "gone").select(F.col("id").alias("gone_id"), F.col("hash").alias("gone_hash"), F.col("lines").alias("removed"))
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(content).alias("hash"))
    own = F.col("doc").getField(text)
    met = F.col("doc").getField(doc_id).eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash"))
    # Line numbers are small beside the texts: they are hashed, so that no text is sorted.
    joined = rows.join(gone.hint("shuffle_hash"), met, "left")
    left = let(
        F.split(own, "\n", -1),
        lambda parts: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed")), lambda i: F.get(parts, i)
            ),
            "\n",
        ),
    )
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select(
        "doc",
        F.when(F.col("removed").isNull(), own).otherwise(left).alias("text"),
        F.size(F.split(F.coalesce(own, F.lit("")), "\n", -1)).alias("n_lines"),
        F.size(removed).alias("n_removed"),
        removed.alias("removed"),
    )
