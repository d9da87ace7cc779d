"""Transitive clustering and chain roots.

Connected components by alternating "large star" and "small star" steps (Kiveris et al.,
"Connected Components in MapReduce and Beyond", SoCC 2014): the number of steps grows
with the logarithm of the longest path. Each step is a minimum per node (partial
aggregate) and a ``lookup_join``, so a hub with a third of all records is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.lookup import lookup_join
from contactloom.operators.matching import _combinations, edges, keyed
from contactloom.session import stage


def _centres(pairs: DataFrame) -> DataFrame:
    """(a, m, n): the smallest of a node and its neighbours, and how many pairs it has."""
    return stage(
        pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")), "centre"
    )


def _large_star(links: DataFrame, min_hot_rows) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    starred = lookup_join(both, _centres(both), ["a"], "n", min_hot_rows=min_hot_rows)
    return starred.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, min_hot_rows) -> DataFrame:
    """Links a node and all its smaller neighbours to the smallest of them."""
    centres = _centres(links)
    starred = lookup_join(links, centres, ["a"], "n", min_hot_rows=min_hot_rows)
    neighbours = starred.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return neighbours.unionByName(centres.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, min_hot_rows: int | None = None, max_steps: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node."""
    # Links always run from the larger to the smaller node.
    downward = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stage(downward.distinct(), "links")
    previous = None
    for _ in range(max_steps):
        mark = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(mark) == previous:
            break
        previous = tuple(mark)
        current = stage(_large_star(current, min_hot_rows), "links")
        current = stage(_small_star(current, min_hot_rows), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def cluster_transitively(
    df: DataFrame, key_sets, scope=(), record_id: str = "rid", min_hot_rows: int | None = None
) -> DataFrame:
    """(rid, primary_id): records linked by any chain of shared keys form one cluster.

    Components are found over distinct key combinations. As a key lies in exactly one
    component, each record then finds its own by its first filled key.
    """
    keyed_df = stage(keyed(df, key_sets, scope, record_id), "keyed")
    keys = [c for c in keyed_df.columns if c != "rid"]
    combos = stage(edges(_combinations(keyed_df)), "combos")
    first = stage(
        combos.groupBy("key_set", "key").agg(F.min("rid").alias("first_rid"), F.count("*").alias("n")), "first"
    )
    links = lookup_join(combos, first, ["key_set", "key"], "n", min_hot_rows=min_hot_rows).select(
        F.col("rid").alias("a"), F.col("first_rid").alias("b")
    )
    found = connected_components(links, min_hot_rows)
    key_root = first.join(
        found.withColumnRenamed("node", "first_rid"), "first_rid", "left"
    ).select("key_set", "key", F.coalesce("root", "first_rid").alias("primary_id"))
    one_key = F.coalesce(*[
        F.when(F.col(k).isNotNull(), F.struct(F.lit(int(k[1:])).alias("key_set"), F.col(k).alias("key")))
        for k in keys
    ])
    lead = stage(keyed_df.select("rid", one_key.alias("e")).select("rid", "e.key_set", "e.key"), "lead")
    with_key = lead.where("key IS NOT NULL")
    holders = with_key.groupBy("key_set", "key").agg(F.count("*").alias("n"))
    key_root = stage(key_root.join(holders, ["key_set", "key"]), "keyroot")
    out = lookup_join(with_key, key_root, ["key_set", "key"], "n", min_hot_rows=min_hot_rows)
    alone = lead.where("key IS NULL").select("rid", F.col("rid").alias("primary_id"))
    return out.select("rid", "primary_id").unionByName(alone)


def chain_roots(parents: DataFrame, min_hot_rows: int | None = None, max_steps: int = 60) -> DataFrame:
    """(id, root) from (id, merged_into_id): follows merges to a record that is not merged.

    Pointer jumping halves every chain per step. ``merged_into_id`` is null at roots.
    """
    current = stage(parents.select("id", F.coalesce("merged_into_id", "id").alias("root")), "chain")
    for _ in range(max_steps):
        # Every target is listed with its number of followers, also those that stay put:
        # a root that many records already reached is then known to be hot.
        targets = current.where("root != id").groupBy(F.col("root").alias("via")).agg(F.count("*").alias("n"))
        onward = current.select(F.col("id").alias("via"), F.col("root").alias("next"))
        step = stage(
            targets.join(onward, "via", "left").select("via", F.coalesce("next", "via").alias("next"), "n"), "step"
        )
        if step.where("next != via").isEmpty():
            return current
        moving = current.where("root != id").withColumnRenamed("root", "via")
        moved = lookup_join(moving, step, ["via"], "n", min_hot_rows=min_hot_rows)
        current = stage(
            moved.select("id", F.col("next").alias("root")).unionByName(current.where("root = id")), "chain"
        )
    raise RuntimeError(f"merge chains longer than 2^{max_steps}, or a cycle")
