"""Merging customers of one batch across its files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.config import COMPLETENESS_FIELDS, DEFAULT, GOLDEN_FIELDS, Config
from contactloom.operators.components import chain_roots
from contactloom.operators.lookup import lookup_join, shuffled
from contactloom.operators.matching import first_seen
from contactloom.operators.survivorship import golden_fold
from contactloom.session import stage

_KEEP = ("id", "batch_id", "source_count", "extra_fields")


def with_golden_fields(df: DataFrame) -> DataFrame:
    """Adds the golden fields the data lacks as nulls."""
    missing = [f for f in GOLDEN_FIELDS if f not in df.columns]
    return df.withColumns({f: F.lit(None).cast("string") for f in missing}) if missing else df


def merge_batch(customers: DataFrame, config: Config = DEFAULT, closure: bool = False) -> DataFrame:
    """All customers with ``is_duplicate`` and ``merged_into_id``; survivors carry the
    merged fields, map entries and the sum of source counts.

    Matching is the first-seen rule in id order over the batch keys; the batch is part of
    every key. The most complete record survives, the earlier one on a tie, and blanks
    are filled from the others. ``merged_into_id`` always names the survivor itself. With
    ``closure`` the survivors are matched again by their merged fields until no two of
    them share a key.
    """
    current = stage(with_golden_fields(customers).select(*_KEEP, *GOLDEN_FIELDS), "customers")
    original = current
    merged_into = None
    while True:
        found = stage(first_seen(current, config.batch_match_keys, ["batch_id"], "id"), "found")
        if merged_into is not None and found.where("key_set IS NOT NULL").isEmpty():
            break
        members = current.join(shuffled(found.select(F.col("rid").alias("id"), "primary_id")), "id")
        golden = stage(
            golden_fold(
                members, GOLDEN_FIELDS, COMPLETENESS_FIELDS, record_id="id",
                count=F.coalesce("source_count", F.lit(1)), blank_is_empty=True, extra="extra_fields",
            ), "golden",
        )
        # primary_id is the head of a cluster; base_id is its survivor.
        survivors = golden.select("primary_id", "base_id")
        heads = found.select(F.col("rid").alias("id"), "primary_id")
        moves = _survivor_of(heads, survivors)
        merged_into = moves if merged_into is None else merged_into.where("merged_into_id IS NOT NULL").unionByName(
            moves
        )
        batch_of = current.select("id", "batch_id")
        current = golden.withColumnRenamed("base_id", "id").drop("primary_id").join(shuffled(batch_of), "id").select(
            *_KEEP, *GOLDEN_FIELDS
        )
        if not closure:
            break
        current = stage(current, "customers")
    if closure:
        merged_into = chain_roots(stage(merged_into, "moves")).select(
            "id", F.when(F.col("root") != F.col("id"), F.col("root")).alias("merged_into_id")
        )
    duplicates = (
        original.join(shuffled(merged_into.where("merged_into_id IS NOT NULL")), "id")
        .withColumn("is_duplicate", F.lit(True))
    )
    survivors = current.withColumn("is_duplicate", F.lit(False)).withColumn(
        "merged_into_id", F.lit(None).cast("bigint")
    )
    return survivors.unionByName(duplicates)


def _survivor_of(heads: DataFrame, survivors: DataFrame) -> DataFrame:
    """(id, merged_into_id) with null for survivors."""
    sizes = heads.groupBy("primary_id").agg(F.count("*").alias("n"))
    table = stage(survivors.join(shuffled(sizes), "primary_id"), "survivors")
    return lookup_join(heads, table, ["primary_id"], "n").select(
        "id", F.when(F.col("base_id") != F.col("id"), F.col("base_id")).alias("merged_into_id")
    )


def repoint_lineage(sources: DataFrame, merged: DataFrame) -> DataFrame:
    """Moves the source rows of duplicates to the record they were merged into."""
    sizes = sources.groupBy("customer_id").agg(F.count("*").alias("n"))
    owners = merged.select(F.col("id").alias("customer_id"), F.coalesce("merged_into_id", "id").alias("survivor"))
    moves = stage(sizes.join(shuffled(owners), "customer_id", "left").withColumn("survivor", F.coalesce("survivor", "customer_id")), "moves")
    moved = lookup_join(sources, moves, ["customer_id"], "n")
    return moved.withColumn("customer_id", F.col("survivor")).drop("survivor")


def merge_counts(merged: DataFrame, by: str = "batch_id") -> DataFrame:
    return merged.groupBy(by).agg(
        F.count_if(F.col("is_duplicate")).alias("merged"),
        F.count_if(~F.col("is_duplicate")).alias("unique_left"),
    )
