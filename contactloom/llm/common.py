"""Shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
BLANKS = r"[ \t-\r]+"


def worker_state() -> dict:
    """What a Python worker keeps from task to task. Functions travel with the query, by value,
    so their own module's variables are new in every task."""
    return vars(sys.modules.setdefault("_corpus_worker", types.ModuleType("_corpus_worker")))


#: Rows of a few numbers that one task takes in a round of an iterative step.
TASK_ROWS = 500_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows need; rounds over what little is left of
    a large table are then not spread over as many tasks as the table was."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-blanks; 0 for null."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, BLANKS))).otherwise(0).cast("long")


def text_key(text: Column) -> Column:
    """Tells rows apart that share an identifier. Null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def beside(docs: DataFrame, decided: DataFrame, doc_id: str, text: str, how: str) -> DataFrame:
    """``docs`` joined to decisions (__id, __key, ...) on identifier and text; null equals null.
    Decisions are small beside the texts: they are hashed, so that no text is sorted."""
    met = F.col(doc_id).eqNullSafe(F.col("__id")) & (text_key(F.col(text)) == F.col("__key"))
    joined = docs.join(decided.hint("shuffle_hash"), met, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("__id", "__key")


def one_of_each(rows: DataFrame, doc_id: str, text: str, count: str) -> DataFrame:
    """``rows`` without repeats in identifier and text. ``count`` tells how many there are of a
    row; only those with more than one are looked at."""
    single, several = rows.where(F.col(count) == 1), rows.where(F.col(count) > 1)
    nth = F.row_number().over(Window.partitionBy(doc_id, text_key(F.col(text))).orderBy(F.lit(1)))
    return single.unionByName(several.withColumn("__nth", nth).where("__nth = 1").drop("__nth"))


def hex60(value: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a long that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def points_before(points: list[int], value: Column, inclusive: bool = False) -> Column:
    """How many of the sorted ``points`` are below ``value`` (or equal, if inclusive), by bisection."""
    if not points:
        return F.lit(0)
    array, steps = F.lit(points), [1 << b for b in reversed(range(len(points).bit_length()))]

    def further(low: Column, step: Column) -> Column:
        point = F.element_at(array, F.least(low + step, F.lit(len(points))))
        return F.when((low + step <= len(points)) & ((point <= value) if inclusive else (point < value)), low + step).otherwise(low)

    return F.aggregate(F.lit(steps), F.lit(0), further)


def ordered_buckets(docs: DataFrame, doc_id: str, text: str, pieces: int) -> Column:
    """Number of a bucket, ascending with the identifier; about ``pieces`` equal ones.

    Only the identifiers are read for it. An identifier that fills several buckets by itself
    is spread over them by its texts, and so are rows without one, which come first.
    """
    shares = [i / pieces for i in range(1, pieces)] or [0.5]
    found = docs.agg(F.percentile_approx(F.col(doc_id), shares, 10_000)).first()[0] or []
    points = [int(p) for p in found]
    name = F.col(doc_id)
    below, upto = points_before(points, name), points_before(points, name, inclusive=True)
    spread = F.xxhash64(F.col(text))
    own = let(
        F.struct(below.alias("low"), upto.alias("high")),
        lambda b: F.when(b.high - b.low > 1, b.low + F.pmod(spread, b.high - b.low)).otherwise(b.low),
    )
    return F.when(name.isNull(), -1 - F.pmod(spread, F.lit(pieces))).otherwise(own).cast("int")


def byte_ranges(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first, length): runs of texts with about ``limit`` bytes; a longer text has its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    low, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield low, i - low
            low, held = i, 0
        held += size
    if len(sizes) > low:
        yield low, len(sizes) - low
