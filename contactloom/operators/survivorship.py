"""Golden records from clusters.

Ordered rule: the first record of a cluster is the base; each later record replaces the
base if it has strictly fewer empty ranking fields than the record merged so far, and
either way fills the fields that are still empty.

Whichever record is the base, the fields filled after a prefix of the cluster are those
that any record of the prefix fills. So with ``t(f)`` = first record that fills field
``f`` (minima per cluster, see ``with_facts``), a record can tell by itself whether
it replaces the base: it compares its own empty count with the number of ``t(f)`` not
before it. A golden value is the one of the *last* replacing record that has the field,
or else of the first record that has it. At most (ranking fields + 1) replacements and
one first fill per field matter in any cluster, so all other rows are dropped before the
values are shuffled: no group is collected, and a cluster may be of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import rules, text
from contactloom.operators.lookup import shuffled, with_facts
from contactloom.session import stage


def _filled(field: str, blank_is_empty: bool) -> Column:
    c = F.col(field)
    return ~text.blank(c) if blank_is_empty else c.isNotNull()


def golden_fold(
    members: DataFrame,
    fields: Sequence[str],
    ranking: Sequence[str] | None = None,
    cluster: str = "primary_id",
    record_id: str = "rid",
    count: Column | None = None,
    blank_is_empty: bool = False,
    min_hot_rows: int | None = None,
    extra: str | None = None,
) -> DataFrame:
    """One row per cluster: (cluster, base_id, source_count, fields...[, extra]).

    ``count`` is what a record adds to ``source_count`` (1 by default). ``extra`` names a
    map column that is merged key by key under the same rule.
    """
    ranking = list(ranking or fields)
    rows = stage(members, "members")
    facts = {f"_t{i}": F.min(F.when(_filled(f, blank_is_empty), F.col(record_id))) for i, f in enumerate(fields)}
    facts |= {"_head": F.min(record_id), "_sources": F.sum(count if count is not None else F.lit(1))}
    ids = F.col(record_id)
    empty_before = sum(
        (F.coalesce(F.col(f"_t{fields.index(f)}") >= ids, F.lit(True)).cast("int") for f in ranking), F.lit(0)
    )
    own_empty = sum(((~_filled(f, blank_is_empty)).cast("int") for f in ranking), F.lit(0))
    replaces = (ids == F.col("_head")) | (own_empty < empty_before)
    first_fill = F.lit(False)
    for i in range(len(fields)):
        first_fill = first_fill | F.coalesce(F.col(f"_t{i}") == ids, F.lit(False))
    joined = with_facts(rows, [cluster], facts, min_hot_rows).withColumn("_replaces", replaces)
    matter = joined.where(F.col("_replaces") | first_fill)

    def value(f: str) -> Column:
        has = _filled(f, blank_is_empty)
        last = F.max_by(F.col(f), F.when(F.col("_replaces") & has, ids))
        first = F.min_by(F.col(f), F.when(has, ids))
        return F.coalesce(last, first).alias(f)

    golden = matter.groupBy(cluster).agg(
        F.max(F.when(F.col("_replaces"), ids)).alias("base_id"), *[value(f) for f in fields],
        F.max("_sources").alias("source_count"),
    )
    if extra is None:
        return golden
    # Map entries follow the same rule per key; entries meet by (cluster, key).
    flagged = joined.select(cluster, ids, "_replaces", F.explode(extra).alias("_key", "_value"))
    entries = flagged.groupBy(cluster, "_key").agg(
        F.max(F.when(F.col("_replaces"), F.struct(ids, F.col("_value")))).alias("last"),
        F.min(F.struct(ids, F.col("_value"))).alias("first"),
    ).select(cluster, F.struct("_key", F.coalesce("last", "first")["_value"].alias("_value")).alias("_entry"))
    maps = entries.groupBy(cluster).agg(F.map_from_entries(F.collect_list("_entry")).alias(extra))
    return golden.join(shuffled(maps), cluster, "left")


def golden_most_complete(
    members: DataFrame, fields: Sequence[str], cluster: str = "primary_id", record_id: str = "rid"
) -> DataFrame:
    """Set-based rule: fields come from the record with fewest empty fields that has them
    (ties: the earlier record). One aggregate."""
    ranked = members.withColumn("_rank", F.struct(rules.null_count(list(fields)).alias("n"), F.col(record_id)))
    return ranked.groupBy(cluster).agg(
        F.min("_rank")[record_id].alias("base_id"),
        F.count("*").alias("source_count"),
        *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_rank"))).alias(f) for f in fields],
    )


def merge_maps(duplicate: Column, primary: Column) -> Column:
    """Both maps; the primary's value wins where both have the key."""
    rest = F.map_filter(duplicate, lambda k, _: ~F.coalesce(F.map_contains_key(primary, k), F.lit(False)))
    return F.coalesce(F.map_concat(rest, primary), primary, duplicate)
