"""Joins of a large table to a one-row-per-key table whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.session import stage

MAX_HOT_KEYS = 10_000
MAX_HOT_BYTES = 64 << 20
MIN_HOT_ROWS = 200_000
#: Into so many keys are dealt by their hashes to find those that may be hot.
BUCKETS = 1 << 14
#: Rows above which a table is not broadcast, however small Spark takes its stored columns to be.
MANY_KEYS = 200_000


def shuffled(df: DataFrame) -> DataFrame:
    """For a table with a row per record: never broadcast. Spark judges by the compressed size of the stored file and the share
    of the columns read, by which millions of ids look like a few megabytes and would all go through the driver."""
    return df.hint("merge")


def lookup_join(
    big: DataFrame,
    per_key: DataFrame,
    on: list[str],
    rows_column: str,
    how: str = "inner",
    min_hot_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``big`` joined to ``per_key`` (unique in ``on``) without a hot task.

    ``rows_column`` tells how many rows of ``big`` hold a key. It is a column of ``per_key``
    if that has every key of ``big``; otherwise ``counts`` (``on``, ``rows_column``) must be given
    for all of them, as a key that finds nothing can be as hot as any. Keys with more than
    1/10,000 of all rows are hot; there can be at most 10,000 of them, so their side is
    broadcast, if it is no larger than ``MAX_HOT_BYTES``, and the hot rows stay where they are.
    All other keys are joined by shuffle, where none can fill more than its share of a
    task. All inputs are read more than once, so pass staged tables.
    """
    sizes = per_key if counts is None else counts
    floor = MIN_HOT_ROWS if min_hot_rows is None else min_hot_rows
    size = sizes.agg(F.sum(rows_column).alias("total"), F.max(rows_column).alias("top"), F.count("*").alias("keys")).first()
    limit = max(floor, (size.total or 0) // MAX_HOT_KEYS)
    found = per_key.drop(rows_column)
    side = shuffled if size["keys"] > MANY_KEYS else lambda df: df
    if (size.top or 0) <= limit:
        return big.join(side(found), on, how)
    hot_keys = sizes.where(F.col(rows_column) > limit).select(*on)
    hot = found.join(F.broadcast(hot_keys), on, "left_semi")
    width = hot_keys.join(hot, on, "left").agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if width > MAX_HOT_BYTES:  # a few very wide rows; adaptive execution splits their tasks
        return big.join(side(found), on, how)
    at_hot = big.join(F.broadcast(hot_keys), on, "left_semi").join(F.broadcast(hot), on, how)
    cold = found.join(F.broadcast(hot_keys), on, "left_anti")
    at_cold = big.join(F.broadcast(hot_keys), on, "left_anti").join(side(cold), on, how)
    return at_hot.unionByName(at_cold)


def with_facts(big: DataFrame, on: list[str], facts: dict[str, Column], min_hot_rows: int | None = None) -> DataFrame:
    """``big`` with aggregates over all rows of its key on each row; rows without a key are left out.

    Keys are hot as in ``lookup_join``. Those are aggregated in parts and joined back by broadcast; all others take one
    shuffle, in which a window computes the aggregates, so nothing per key is written, read and sorted a second time. The
    result is dealt by ``on`` unless a key is hot. ``big`` is read more than once, so pass a staged table.
    """
    floor = MIN_HOT_ROWS if min_hot_rows is None else min_hot_rows
    for c in on:
        big = big.where(F.col(c).isNotNull())
    at_key = W.partitionBy(*on)
    dealt = lambda rows: rows.withColumns({name: fact.over(at_key) for name, fact in facts.items()})
    # A key of many rows is in a bucket of many rows, and buckets are counted without dealing the rows out.
    bucket = F.pmod(F.xxhash64(*on), F.lit(BUCKETS))
    full = [r.bucket for r in big.groupBy(bucket.alias("bucket")).count().where(F.col("count") > floor).select("bucket").collect()]
    if not full:
        return dealt(big)
    sizes = big.where(bucket.isin(full)).groupBy(*on).agg(F.count("*").alias("_rows"))
    large = stage(sizes.where(F.col("_rows") > floor), "large")
    if large.isEmpty():
        return dealt(big)
    limit = max(floor, big.count() // MAX_HOT_KEYS)
    hot_keys = F.broadcast(large.where(F.col("_rows") > limit).select(*on))
    at_hot = big.join(hot_keys, on, "left_semi")
    per_key = at_hot.groupBy(*on).agg(*[fact.alias(name) for name, fact in facts.items()])
    return at_hot.join(F.broadcast(per_key), on).unionByName(dealt(big.join(hot_keys, on, "left_anti")))
