"""Repeated passages, wherever in a line they begin or end.

A document is a sequence of words. A word goes if it lies in a window of ``least`` words that occurs
earlier: in a document with a smaller identifier, or further up in the same one. As every longer
passage is the union of its windows, these are the later copies of all passages with ``least`` words
or more. Where copies overlap in one document, the earliest window stays whole.

Windows are not sorted one by one. Each is told by its anchor, the least hash among its runs of half
as many words, which depends on its words only; about one position in thirteen is an anchor. Only
windows whose anchor occurs twice are written and compared, so no repeat is missed.

Null texts count as empty. Rows with the same identifier and text are one document, and all get the
same result; rows with an equal identifier and different texts are ordered by a hash of the text;
rows without an identifier come last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.line_runs import MIN_WORDS
from contactloom.session import stage

#: Windows that are looked at together.
PART = 1 << 15

# Odd multipliers of two independent hashes.
FIRST = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SECOND = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def runs(words: np.ndarray, n: int, by: tuple[int, int, int] = FIRST) -> np.ndarray:
    """Hash of each ``n`` consecutive word hashes."""
    one, two, three = (np.uint64(x) for x in by)

    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * one + (b ^ (b >> np.uint64(32))) * two
        x = (x ^ (x >> np.uint64(29))) * three
        return x ^ (x >> np.uint64(32))

    if len(words) < n:
        return np.zeros(0, np.uint64)
    out, done, own, size = None, 0, words, 1
    while True:
        if n & size:
            left = len(words) - done - size + 1
            out = own if out is None else both(out[:left], own[done : done + left])
            done += size
        if done == n:
            return out
        own = both(own[:-size], own[size:])
        size *= 2


def anchors(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of half a window, position of the anchor of each window)."""
    half = runs(words, least // 2)
    width = least - least // 2 + 1
    if len(words) < least:
        return half, np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(half, width)
    # Taking the least of each window copies them, so a long text is looked at in parts.
    least_of = [windows[i : i + PART].argmin(axis=1) for i in range(0, len(windows), PART)]
    return half, np.concatenate(least_of) + np.arange(len(windows))


def _hashes(text: str) -> np.ndarray:
    own = text.encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))


def _anchors(docs: DataFrame, least: int) -> DataFrame:
    """(id, hash, anchor): a row for each anchor of docs (id, hash, text)."""
    schema = docs.select("id", "hash", F.lit(0).cast("long").alias("anchor")).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                found = []
                for text in part.column(2):
                    half, at = anchors(_hashes(text.as_py()), least)
                    found.append(half[np.unique(at)].view(np.int64))
                owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                columns = [part.column(0).take(owner), part.column(1).take(owner), pa.array(np.concatenate(found))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("id", "hash", "text").mapInArrow(find, schema)


def _windows(docs: DataFrame, least: int) -> DataFrame:
    """(id, hash, at, a, b): the windows of docs (id, hash, text, anchors) that have one of the anchors."""
    zero = F.lit(0).cast("long")
    schema = docs.select("id", "hash", F.lit(0).alias("at"), zero.alias("a"), zero.alias("b")).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = _hashes(batch.column(2)[i].as_py())
                half, at = anchors(words, least)
                wanted = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(np.isin(half[at].view(np.int64), wanted))
                owner = pa.array(np.full(len(at), i))
                names = [pa.array(runs(words, least, by)[at].view(np.int64)) for by in (FIRST, SECOND)]
                columns = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(at.astype(np.int32)), *names]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("id", "hash", "text", "anchors").mapInArrow(find, schema)


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(id, hash, gone): ranges of words (low, high), from 0, to delete from docs (id, hash, text), sorted."""
    found = stage(_anchors(docs, least), "anchors")
    twice = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    wanted = found.join(twice, "anchor").groupBy("id", "hash").agg(F.collect_set("anchor").alias("anchors"))
    wanted = stage(wanted, "wanted").select(F.col("id").alias("id2"), F.col("hash").alias("hash2"), "anchors")
    met = F.col("id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "at")
    named = _windows(docs.join(wanted.hint("shuffle_hash"), met), least).withColumn("place", place)
    named = stage(named.drop("id", "hash", "at"), "windows")
    first = named.groupBy("a", "b").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    later = named.join(first.where("copies > 1"), ["a", "b"]).where("place != first")
    same = F.col("place.id").eqNullSafe(F.col("first.id")) & (F.col("place.hash") == F.col("first.hash"))
    low = F.when(same, F.greatest("place.at", F.col("first.at") + least)).otherwise(F.col("place.at"))
    gone = later.select("place.id", "place.hash", F.struct(low.alias("low"), (F.col("place.at") + least).alias("high")).alias("range"))
    return gone.where("range.low < range.high").groupBy("id", "hash").agg(F.sort_array(F.collect_set("range")).alias("gone"))


def cut(text: str, lows: list[int], highs: list[int]) -> str:
    """``text`` (as UTF-8) without the words of the ranges, and without the blanks after them in their line."""
    content = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^ \t-\r]+", content)]
    left, at, upto = [], 0, 0
    for low, high in zip(lows, highs, strict=True):
        low = max(low, upto)
        if low < high:
            left.append(content[at : spans[low][0]] if low > upto or not at else b"")
            at, upto = re.compile(rb"[ \t]*").match(content, spans[high - 1][1]).end(), high
    return b"".join([*left, content[at:]]).decode()


def drop_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(doc, text, cut): each row of ``docs`` as a struct, what is left of its text (null only where it
    was), and whether anything was removed."""
    content = F.coalesce(F.col(text), F.lit(""))
    gone = repeated_passages(docs.select(F.col(doc_id).alias("id"), F.xxhash64(content).alias("hash"), content.alias("text")), least)
    gone = stage(gone, "gone").select(
        F.col("id").alias("gone_id"), F.col("hash").alias("gone_hash"), F.col("gone.low").alias("lows"), F.col("gone.high").alias("highs")
    )
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(content).alias("hash"))
    own = F.col("doc").getField(text)
    met = F.col("doc").getField(doc_id).eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash"))
    joined = rows.join(gone.hint("shuffle_hash"), met, "left")

    @F.pandas_udf("string")
    def left(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        each = zip(texts, lows, highs, strict=True)
        return pd.Series([None if t is None else cut(t, a, b) for t, a, b in each], dtype=object)

    changed = F.col("lows").isNotNull()
    # The worker receives nulls for texts that stay.
    return joined.select(
        "doc", F.when(changed, left(F.when(changed, own), "lows", "highs")).otherwise(own).alias("text"), changed.alias("cut")
    )
