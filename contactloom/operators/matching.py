"""Match keys and the first-seen merge.

First-seen rule: records are taken in id order; a record that holds a key of an earlier
*unique* record is its duplicate, by the first key set (in priority order) that hits; any
other record is unique and owns all its keys. Duplicates own nothing, so the rule is not
transitive.

A record is therefore unique exactly if no earlier unique record shares a key with it.
That is decided in rounds: in each one the records that come first at *all* their keys are
unique, and everything else that holds one of their keys is a duplicate. Both leave, the rest
goes on. Keys are shuffled as text only once: each is then known by the number of the first
row that holds it (``coded``), which no other key of its set can have, so all that follows
moves numbers only. Nothing collects a group. Record ids may repeat: rows decide one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import text
from contactloom.operators.lookup import lookup_join, with_facts
from contactloom.session import stage

SEPARATOR = "\x1f"
#: Open key rows up to which a caller lets one ordered task finish; by default none.
ORDERED_REST = 0


def key_columns(key_sets: Sequence[Sequence[str]], scope: Sequence[str] = ()) -> list[Column]:
    """One string per key set, null unless all parts are filled. Records of different
    scopes (file, batch) never share a key."""
    def one(parts):
        values = [text.match_form(F.col(p)) for p in parts]
        scoped = [F.col(s).cast("string") for s in scope] + values
        filled = values[0].isNotNull()
        for v in values[1:]:
            filled = filled & v.isNotNull()
        return F.when(filled, F.concat_ws(SEPARATOR, *scoped))
    return [one(parts).alias(f"k{i}") for i, parts in enumerate(key_sets)]


def keyed(df: DataFrame, key_sets, scope=(), record_id: str = "rid") -> DataFrame:
    """(rid, k0, k1, ...)"""
    return df.select(F.col(record_id).alias("rid"), *key_columns(key_sets, scope))


def edges(keyed_df: DataFrame) -> DataFrame:
    """(rid, key_set, key): one row per record and filled key set."""
    keys = [c for c in keyed_df.columns if c.startswith("k") and c[1:].isdigit()]
    others = [c for c in keyed_df.columns if c not in keys]
    # Nulls are left out after the explode, which then is compiled; a filter inside the array is interpreted row by row.
    pairs = F.array(*[F.struct(F.lit(int(k[1:])).alias("key_set"), F.col(k).alias("key")) for k in keys])
    found = keyed_df.select(*others, F.explode(pairs).alias("e")).select(*others, "e.key_set", "e.key")
    return found.where("key IS NOT NULL")


def match_keys(df: DataFrame, key_sets, scope=(), record_id: str = "rid") -> DataFrame:
    return edges(keyed(df, key_sets, scope, record_id))


def _combinations(keyed_df: DataFrame) -> DataFrame:
    """Distinct key combinations with their first record. Copies of a record collapse
    here in a partial aggregate, however many there are."""
    keys = [c for c in keyed_df.columns if c != "rid"]
    some_key = F.coalesce(*keys).isNotNull()
    return keyed_df.where(some_key).groupBy(*keys).agg(F.min("rid").alias("rid"))


def numbered(keyed_df: DataFrame) -> DataFrame:
    """A stored table (rid, k0, k1, ..., row) whose rows have numbers of their own."""
    return stage(keyed_df.withColumn("row", F.monotonically_increasing_id()), "keyed")


def coded(keyed_df: DataFrame, min_hot_rows: int | None = None, texts: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(rows, keys) of a table of ``numbered``.

    ``rows`` (row, rid, k0, k1, ..., leads) has numbers instead of keys, for rows with any key; ``leads`` tells that no row
    with any of its keys has a lower rid. ``keys`` (key_set, key, code) is given with ``texts``: what the numbers stand for.
    """
    facts = {"code": F.min("row"), "first": F.min("rid")}
    codes = with_facts(edges(keyed_df.where("rid IS NOT NULL")), ["key_set", "key"], facts, min_hot_rows)
    if texts:
        codes = stage(codes, "codes")
    names = [c for c in keyed_df.columns if c not in ("rid", "row")]
    rows = codes.groupBy("row", "rid").agg(
        *[F.max(F.when(F.col("key_set") == int(k[1:]), F.col("code"))).alias(k) for k in names],
        F.bool_and(F.col("first") == F.col("rid")).alias("leads"),
    )
    # A key has the number of one of its rows.
    return stage(rows, "coded"), codes.where("row = code").select("key_set", "key", "code") if texts else None


def _ordered_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rule itself, for a rest of proven size that arrives sorted by record."""
    owner: dict[tuple, int] = {}
    out = []
    current, rid, keys = None, None, []

    def decide():
        if current is not None and all(owner.get(k, rid) == rid for k in keys):
            for k in keys:
                if k not in owner:
                    owner[k] = rid
                    out.append((k[0], k[1], rid))

    for batch in batches:
        for row, record, key_set, key in zip(batch["row"], batch["rid"], batch["key_set"], batch["key"]):
            if row != current:
                decide()
                current, rid, keys = row, record, []
            keys.append((key_set, key))
    decide()
    yield pd.DataFrame(out, columns=["key_set", "key", "owner"])


def code_owners(
    rows: DataFrame, holders: DataFrame, min_hot_rows: int | None = None, ordered_rest: int = ORDERED_REST
) -> DataFrame:
    """(key_set, key, owner): the unique record that owns each key of the ``rows`` of ``coded``, if any does. ``holders``
    (key_set, key, holders) counts the rows of each key; rows without ``leads`` get it here.

    The number of rounds is the longest alternation of unique and duplicate records along
    rising ids, a handful in contact data. A caller who knows that long chains of few
    records are left may have at most ``ordered_rest`` open key rows finished in one ordered task.
    """
    on = ["key_set", "key"]
    open_rows, owned_parts = rows, []
    keys = [c for c in rows.columns if c not in ("row", "rid", "leads")]
    filled = sum((F.col(k).isNotNull().cast("int") for k in keys), F.lit(0))
    while True:
        left = open_rows.agg(F.sum(filled)).first()[0] or 0
        if left == 0:
            break
        if left <= ordered_rest:
            rest = edges(open_rows.select("row", "rid", *keys)).repartition(1).sortWithinPartitions("rid", "row", "key_set")
            owned_parts.append(rest.mapInPandas(_ordered_rest, "key_set int, key bigint, owner bigint"))
            break
        if "leads" not in open_rows.columns:
            at_key = with_facts(edges(open_rows), on, {"first": F.min("rid")}, min_hot_rows)
            leads = at_key.groupBy("row").agg(F.bool_and(F.col("first") == F.col("rid")).alias("leads"))
            open_rows = stage(open_rows.join(leads, "row"), "leading")
        unique, others = open_rows.where("leads"), open_rows.where("NOT leads").drop("leads")
        owned = stage(edges(unique.select("rid", *keys)).groupBy(*on).agg(F.min("rid").alias("owner")), "owned")
        owned_parts.append(owned)
        hit = lookup_join(edges(others.select("row", *keys)), owned, on, "holders", min_hot_rows=min_hot_rows, counts=holders)
        open_rows = stage(others.join(hit.select("row").distinct(), "row", "left_anti"), "open")
    if not owned_parts:
        return edges(rows.select("rid", *keys)).select(*on, F.col("rid").alias("owner"))
    owners = owned_parts[0]
    for part in owned_parts[1:]:
        owners = owners.unionByName(part)
    return owners


def holders_of(rows: DataFrame) -> DataFrame:
    """(key_set, key, holders) of the ``rows`` of ``coded``."""
    counted = edges(rows.drop("leads", "rid")).groupBy("key_set", "key").agg(F.count("*").alias("holders"))
    return stage(counted, "holders")


def first_seen(
    df: DataFrame,
    key_sets,
    scope=(),
    record_id: str = "rid",
    min_hot_rows: int | None = None,
    ordered_rest: int = ORDERED_REST,
) -> DataFrame:
    """(rid, primary_id, key_set): every record with the unique record it belongs to.

    Unique records point at themselves with a null ``key_set``.
    """
    keyed_df = numbered(keyed(df, key_sets, scope, record_id))
    rows, _ = coded(keyed_df, min_hot_rows)
    holders = holders_of(rows)
    owners = code_owners(rows, holders, min_hot_rows, ordered_rest)
    # Only owners that came earlier count: a key may find its owner after the record.
    hits = lookup_join(
        edges(rows.drop("row", "leads")), owners, ["key_set", "key"], "holders", min_hot_rows=min_hot_rows, counts=holders
    )
    matched = (
        hits.where(F.col("owner") < F.col("rid"))
        .groupBy("rid")
        .agg(F.min(F.struct("key_set", "owner")).alias("hit"))
    )
    return keyed_df.select("rid").join(matched, "rid", "left").select(
        "rid", F.coalesce("hit.owner", "rid").alias("primary_id"), F.col("hit.key_set").alias("key_set")
    )


def duplicate_pairs(assignments: DataFrame) -> DataFrame:
    return assignments.where(F.col("rid") != F.col("primary_id")).select(
        "primary_id", F.col("rid").alias("duplicate_id"), "key_set"
    )


def first_of_key(df: DataFrame, key: Column, record_id: str = "rid", min_hot_rows: int | None = None) -> DataFrame:
    """Single-key merge: (rid, primary_id). Records without the key stay alone."""
    with_key = stage(df.select(F.col(record_id).alias("rid"), key.alias("key")), "key")
    first = stage(
        with_key.where("key IS NOT NULL").groupBy("key").agg(
            F.min("rid").alias("primary_id"), F.count("*").alias("holders")
        ), "first",
    )
    grouped = lookup_join(with_key.where("key IS NOT NULL"), first, ["key"], "holders", min_hot_rows=min_hot_rows)
    alone = with_key.where("key IS NULL").select("rid", F.col("rid").alias("primary_id"))
    return grouped.select("rid", "primary_id").unionByName(alone)
