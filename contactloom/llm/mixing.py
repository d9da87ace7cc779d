"""Mixing sources to target weights by hash-threshold histograms.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3 ... and share the words of
the whole corpus by weight. A source gives each document at most ``MOST`` times: what its
share would exceed that by is shared among the others, by weight, until none is above.

A source whose target is q times its size gives every document floor(q) times, and once
more those whose hash lies below the source's threshold. Thresholds nest: a larger budget
takes all that a smaller one takes. They are found without sorting: words are summed by
source and hash bucket, the bucket in which the budget runs out is cut into finer buckets,
and only the few documents of the last one are looked at one by one. Rows that agree in
identifier, source and size count as copies of one document, and any number of them
may be taken, so that a text repeated a million times cannot overshoot the budget.

A null text has size 0; documents of size 0 are never taken. Equal rows may differ in what
they give (2 of 3 copies); the result then has both values, on any of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import hex60, word_count
from contactloom.session import stage

MOST = 3
#: Each level cuts a bucket of the 60-bit hash into 2^12.
LEVEL_BITS = 12
LEVELS = 3
HASH_BITS = 60


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for (source, source_size).

    One row per source meets in one task, no documents. The level at which no source is
    above its limit is found by sorting the sources by limit per weight: those up to some
    place in that order are at their limit, the rest share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    limit = F.col("limit")
    ranked = weighed.withColumn("limit", (F.col("source_size") * most).cast("double")).withColumn(
        "ratio", limit / F.col("weight")
    )
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(onward)
    leveled = ranked.withColumn("level", level)
    open_level = F.min_by(F.when(F.col("ratio") > F.col("level"), F.col("level")), F.when(F.col("ratio") > F.col("level"), F.col("ratio")))
    found = leveled.withColumn("found", open_level.over(whole))
    share = F.col("weight") * F.col("found")
    target = F.when(F.col("found").isNull() | (share >= limit), limit).otherwise(share)
    return found.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row for each of ``docs``.

    ``copies`` says how often the mix takes the document, ``taken`` is that times its size.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
    )
    units = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    label = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string"))
    units = stage(units.withColumn("label", label).withColumn("h", hex60(F.col("label"))), "mix")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = source_targets(sizes, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = targets.withColumn("base", F.least(F.lit(most), whole).cast("long"))
    budgets = stage(budgets.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "budgets")

    at = budgets.where("rest > 0").select("source", F.lit(0).cast("long").alias("bucket"), "rest")
    left = units.where("size > 0")
    shift = HASH_BITS
    for _ in range(LEVELS):
        left = _inside(left, at, shift)
        shift -= LEVEL_BITS
        at = stage(_boundary(left, at, shift), "boundary")
    cuts = _last(_inside(left, at, shift), at)

    marked = _beside(_beside(units, budgets, "left"), cuts, "left")
    here, cut = F.struct("h", "label"), F.struct("last_h", "last_label")
    once_more = F.when(here < cut, F.col("n")).when(here == cut, F.col("extra")).otherwise(0)
    copies = F.col("base") + F.when(F.col("row") <= F.col("more"), 1).otherwise(0)
    given = marked.withColumn("more", once_more).withColumn("row", F.explode(F.expr("sequence(1L, n)")))
    given = given.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long"))
    return given.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeat_by_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    unit = ["__id", "__source", "__size"]
    taken = mix(docs, doc_id, text, source).groupBy(
        F.col("doc_id").alias(unit[0]), F.col("source").alias(unit[1]), F.col("size").alias(unit[2])
    ).agg(F.count("*").alias("__rows"), F.sum("copies").alias("__total"))
    met = (
        F.col(doc_id).eqNullSafe(F.col(unit[0]))
        & F.col(source).eqNullSafe(F.col(unit[1]))
        & (word_count(F.col(text)) == F.col(unit[2]))
    )
    given = docs.join(stage(taken.where("__total > 0"), "taken").hint("shuffle_hash"), met)
    single = given.where("__rows = 1").withColumn("__copies", F.col("__total"))
    # Rows that agree in all of these share what is taken of them.
    nth = F.row_number().over(Window.partitionBy(*unit).orderBy(F.lit(1)))
    share = F.floor(F.col("__total") / F.col("__rows")) + (nth <= F.col("__total") % F.col("__rows")).cast("long")
    several = given.where("__rows > 1").withColumn("__copies", share).where("__copies > 0")
    both = single.unionByName(several).withColumn("__copy", F.explode(F.expr("sequence(1L, __copies)")))
    return both.select(*docs.columns)


def _beside(left: DataFrame, per_source: DataFrame, how: str) -> DataFrame:
    """A join by source in which null equals null. The right side has a row per source."""
    right = per_source.withColumnRenamed("source", "__source")
    return left.join(right, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def _inside(units: DataFrame, at: DataFrame, shift: int) -> DataFrame:
    """The documents in the bucket of their source in which the budget runs out."""
    places = at.select("source", F.col("bucket").alias("__bucket"))
    return _beside(units, places, "inner").where(F.shiftright("h", shift) == F.col("__bucket")).drop("__bucket")


def _boundary(left: DataFrame, at: DataFrame, shift: int) -> DataFrame:
    """One level finer: the bucket in which the budget runs out, and what is left of it there."""
    buckets = left.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
        F.sum(F.col("size") * F.col("n")).alias("words")
    )
    return _crossing(buckets, at, ["bucket"]).select("source", "bucket", (F.col("rest") - F.col("gone")).alias("rest"))


def _last(left: DataFrame, at: DataFrame) -> DataFrame:
    """(source, last_h, last_label, extra): all before that document are taken once more, and
    of its copies as many as bring the sum nearest to the budget."""
    words = left.withColumn("words", F.col("size") * F.col("n"))
    extra = F.floor((F.col("rest") - F.col("gone")) / F.col("size") + 0.5).cast("long")
    return _crossing(words, at, ["h", "label"]).select(
        "source", F.col("h").alias("last_h"), F.col("label").alias("last_label"), F.least("n", extra).alias("extra")
    )


def _crossing(df: DataFrame, at: DataFrame, order: list[str]) -> DataFrame:
    """The row of each source in which the running sum of words reaches the budget."""
    before = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("gone", F.coalesce(F.sum("words").over(before), F.lit(0)))
    return _beside(summed, at.select("source", "rest"), "inner").where("gone < rest AND gone + words >= rest")
