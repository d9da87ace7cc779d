"""Text queries over the golden table, for many queries at once.

Intents, first that applies: invalid (blank), count, duplicates, city_filter, search, list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.config import ANSWER_SEARCH_FIELDS
from contactloom.functions import text
from contactloom.operators.matching import SEPARATOR
from contactloom.session import stage

DEFAULT_LIMIT, MAX_LIMIT = 10, 50
#: Lengths of the substrings of the phrase index. Long ones are rare, so that phrases that differ late share few values.
GRAMS = (0, 1, 2, 3, 4, 6, 8, 12, 16)

# Words of the intents.
COUNT_PHRASES = ["how many", "count", "number of customers"]
DUPLICATE_PHRASE = "duplicate"
CITY_PREFIXES = ["customers in ", "customer in ", "people in ", "users in "]
SEARCH_PREFIXES = ["search for ", "search ", "find ", "show ", "list "]
LIMIT_WORDS = ["show", "top", "first", "limit"]
GENERIC_WORD = "customers"


def _limit(normal: Column) -> Column:
    digits = F.regexp_extract(normal, rf"(?U)(?:^|\s)(?:{'|'.join(LIMIT_WORDS)})\s+(\d+)(?=\s|$)", 1)
    number = F.coalesce(F.expr("try_cast(_digits AS DECIMAL(38,0))"), F.lit(MAX_LIMIT))
    return digits, F.when(F.col("_digits") == "", DEFAULT_LIMIT).otherwise(
        F.least(F.greatest(number, F.lit(1)), F.lit(MAX_LIMIT)).cast("int")
    )


def with_intent(queries: DataFrame, column: str = "query") -> DataFrame:
    """Adds ``intent``, ``argument`` (city or search text) and ``row_limit``."""
    digits, limit = _limit(F.col("_normal"))
    out = (
        queries.withColumn(column, text.strip(F.coalesce(F.col(column), F.lit(""))))
        .withColumn("_normal", F.lower(column))
        .withColumn("_digits", digits)
        .withColumn("row_limit", limit)
    )
    normal = F.col("_normal")
    city_prefix = "^(?:" + "|".join(CITY_PREFIXES) + ")"
    search_prefix = "^(?:" + "|".join(SEARCH_PREFIXES) + ")"
    searched = text.strip(F.replace(
        F.when(normal.rlike(search_prefix), text.strip(F.regexp_replace(normal, search_prefix, ""))).otherwise(normal),
        F.lit(GENERIC_WORD), F.lit(""),
    ))
    counts = normal.contains(COUNT_PHRASES[0])
    for phrase in COUNT_PHRASES[1:]:
        counts = counts | normal.contains(phrase)
    out = out.withColumn("_search", searched).withColumn(
        "intent",
        F.when(F.col(column) == "", "invalid").when(counts, "count")
        .when(normal.contains(DUPLICATE_PHRASE), "duplicates")
        .when(normal.rlike(city_prefix), "city_filter")
        .when(F.col("_search") != "", "search").otherwise("list"),
    )
    argument = F.when(
        F.col("intent") == "city_filter", text.strip(F.regexp_replace(F.col(column), "(?i)" + city_prefix, ""))
    ).when(F.col("intent") == "search", F.col("_search"))
    return out.withColumn("argument", argument).drop("_normal", "_digits", "_search")


def _grams(value: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters; for size 0 the empty one."""
    if size == 0:
        return F.array(F.lit(""))
    places = F.sequence(F.lit(1), F.length(value) - size + 1)
    found = F.array_distinct(F.transform(places, lambda i: F.substr(value, i, F.lit(size))))
    return F.when(F.length(value) >= size, found).otherwise(F.array().cast("array<string>"))


def _holds(value: Column, phrase: Column, whole: bool) -> Column:
    """SQL pattern matching: ``%`` and ``_`` are wildcards, nothing is escaped."""
    pattern = phrase if whole else F.concat(F.lit("%"), phrase, F.lit("%"))
    plain = (value == phrase) if whole else value.contains(phrase)
    return F.when(phrase.rlike("[%_]"), F.like(value, pattern, F.lit("\x01"))).otherwise(plain)


def phrase_hits(values: DataFrame, phrases: DataFrame, whole: bool = False) -> DataFrame:
    """(id, argument): which of the values (id, texts ARRAY) hold which phrases (argument).

    An index by substrings: the longest literal part of a phrase is cut into substrings of
    the greatest length in ``GRAMS`` that fits, of which the one that fewest values have is
    joined with the same substrings of the values. Only these pairs are compared.
    """
    longest = F.array_max(F.transform(F.split("argument", "[%_]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("part"))))
    size = F.coalesce(*[F.when(longest["n"] >= n, F.lit(n)) for n in reversed(GRAMS)])
    asked = stage(phrases.select("argument", longest["part"].alias("part"), size.alias("size")), "asked")
    sizes = [r.size for r in asked.select("size").distinct().collect()]
    if not sizes:
        return values.select("id", F.lit("").alias("argument")).limit(0)
    cut = F.coalesce(*[F.when(F.col("size") == n, _grams(F.col("part"), n)) for n in sizes])
    wanted = stage(asked.select("argument", F.explode(cut).alias("gram")), "wanted")
    joined = F.array_join("texts", SEPARATOR)
    grams = F.array_distinct(F.flatten(F.array(*[_grams(joined, n) for n in sizes])))
    held = values.select("id", "texts", F.explode(grams).alias("gram"))
    held = stage(held.join(wanted.select("gram").distinct(), "gram", "left_semi"), "held")
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    # A substring that no value has is the rarest: its phrase finds nothing.
    rarest = wanted.join(counts, "gram", "left").groupBy("argument").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key")
    )
    keys = stage(rarest.where("key.n > 0").select("argument", "key.gram"), "keys")
    return held.join(keys, "gram").where(
        F.exists("texts", lambda t: _holds(t, F.col("argument"), whole))
    ).select("id", "argument")


def _first_ids(hits: DataFrame, by: list[str], order: Sequence[str] = ("id",)) -> DataFrame:
    """The first ids per argument. ``row_number() <= k`` is cut within every task before
    the shuffle, so an argument that hits everything moves only k rows per task."""
    window = W.partitionBy(*by).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= MAX_LIMIT)


def _found(golden: DataFrame, keyed: DataFrame) -> DataFrame:
    """(intent, key, rank, id) of the searches and city filters."""
    def of(intent: str) -> DataFrame:
        return keyed.where(F.col("intent") == intent).select(F.col("key").alias("argument")).distinct()

    # Phrases are looked up among the distinct texts; of each text that is hit, its first records are enough.
    texts = F.array_distinct(F.array_compact(F.array(*[F.lower(f) for f in ANSWER_SEARCH_FIELDS])))
    # Ids may repeat: a record counts once, however many of its texts are hit, and each record of an id counts.
    numbered = golden.select("id", F.monotonically_increasing_id().alias("_row"), texts.alias("texts"))
    held = numbered.select("id", "_row", F.explode("texts").alias("text"))
    values = held.select("text").distinct().select(F.col("text").alias("id"), F.array("text").alias("texts"))
    hits = stage(phrase_hits(values, of("search")).withColumnRenamed("id", "text"), "hits")
    holders = _first_ids(held.join(hits.select("text").distinct(), "text", "left_semi"), ["text"], ["id", "_row"])
    searched = holders.join(hits, "text").select("id", "_row", "argument").distinct().drop("_row")
    in_city = golden.where("city IS NOT NULL").select("id", F.lower("city").alias("city"))
    plain, wild = of("city_filter").where("NOT argument RLIKE '[%_]'"), of("city_filter").where("argument RLIKE '[%_]'")
    cities = in_city.select("city").distinct().select(F.col("city").alias("id"), F.array("city").alias("texts"))
    named = plain.select(F.col("argument").alias("city"), "argument").unionByName(
        phrase_hits(cities, wild, whole=True).select(F.col("id").alias("city"), "argument")
    )
    filtered = in_city.join(named, "city").select("id", "argument")
    return _first_ids(
        searched.withColumn("intent", F.lit("search")).unionByName(filtered.withColumn("intent", F.lit("city_filter"))),
        ["intent", "argument"],
    ).select("intent", F.col("argument").alias("key"), "rank", "id")


def answer(queries: DataFrame, golden: DataFrame, column: str = "query") -> DataFrame:
    """(query, intent, count, id): one row per result in id order of its limit; queries
    without results get one row with a null id. ``count`` is the number of results, or for
    the count intent the number of customers."""
    asked = with_intent(queries.select(column).distinct(), column)
    keyed = stage(asked.withColumn("key", F.coalesce(F.lower("argument"), F.lit(""))), "queries")
    has_argument = F.col("intent").isin("search", "city_filter")
    found = keyed.where(has_argument).join(_found(golden, keyed), ["intent", "key"])
    # What is the same for every query of an intent is at most ``MAX_LIMIT`` rows of it.
    same = None
    for intent, rows in (("list", golden), ("duplicates", golden.where("is_duplicate"))):
        top = rows.select("id").orderBy("id").limit(MAX_LIMIT)
        ranked = top.withColumn("rank", F.row_number().over(W.orderBy("id"))).withColumn("intent", F.lit(intent))
        same = ranked if same is None else same.unionByName(ranked)
    listed = keyed.where(~has_argument).join(F.broadcast(same), "intent").select(*found.columns)
    matched = stage(found.unionByName(listed).where(F.col("rank") <= F.col("row_limit")).select(column, "id"), "matched")
    sizes = matched.groupBy(column).agg(F.count("*").alias("n"))
    total = golden.agg(F.count("*").alias("total")).select(F.lit("count").alias("intent"), "total")
    return (
        keyed.join(sizes, column, "left")
        .join(F.broadcast(total), "intent", "left")
        .join(matched, column, "left")
        .select(column, "intent", F.coalesce("total", "n", F.lit(0)).alias("count"), "id")
    )
