"""Schema detection and mapping of source columns to canonical fields.

Rows with open columns are (file_id, source_row, raw MAP<STRING, STRING>); files of one
known layout are wide DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.config import DEFAULT, GOLDEN_FIELDS, Config
from contactloom.functions import text
from contactloom.operators.transform import computed_once
from contactloom.session import stage

# What reads as a boolean, a date, an integer, a float.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0"]
DATE_PATTERN = r"(?U)^\d{4}[-/]\d{2}[-/]\d{2}$|^\d{2}[-/]\d{2}[-/]\d{4}$"
INTEGER_PATTERN = r"(?U)^[+-]?\d+(_\d+)*$"
FLOAT_PATTERN = (
    r"(?Ui)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$|^[+-]?(nan|inf|infinity)$"
)
# Ties go to the type named first.
TYPES = ["integer", "float", "boolean", "date", "string"]


def canonical_name(c: Column, config: Config = DEFAULT) -> Column:
    """Canonical field of a source column, or its own name."""
    table = F.create_map(*[F.lit(x) for pair in config.alias_lookup().items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(c)), c)


def _canonical_names(keys: Column, config: Config) -> Column:
    """``canonical_name`` of each of an array of source columns: sets of aliases, as a map of them is searched entry by entry."""
    named: dict[str, list[str]] = {}
    for alias, canonical in config.alias_lookup().items():
        named.setdefault(canonical, []).append(alias)
    if not named:
        return keys

    def name(low: Column, place: Column) -> Column:
        known = F
        for canonical, aliases in named.items():
            known = known.when(low.isin(aliases), canonical)
        return F.coalesce(known, F.get(keys, place))

    return F.transform(F.transform(keys, F.lower), name)


def is_unknown(source: Column, canonical: Column, config: Config = DEFAULT) -> Column:
    return ~canonical.isin(list(config.aliases)) & (canonical == source) & ~source.startswith("_")


def sample_rows(raw: DataFrame, rows: int, by: str = "file_id", order: str = "source_row") -> DataFrame:
    """The first rows of each file. The rank is cut inside each task before the shuffle."""
    window = W.partitionBy(by).orderBy(order)
    return raw.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= rows).drop("_n")


def column_union(raw: DataFrame, by: str = "file_id") -> DataFrame:
    """(file, column): every column any row of the file has; rows may be sparse."""
    return raw.select(by, F.explode(F.map_keys("raw")).alias("column")).distinct()


def alias_table(columns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    named = columns.withColumn("canonical", canonical_name(F.col("column"), config))
    return named.withColumn("is_unknown", is_unknown(F.col("column"), F.col("canonical"), config))


def value_type(c: Column) -> Column:
    v = text.strip(c)
    return (
        F.when(F.lower(v).isin(BOOLEAN_WORDS), "boolean").when(v.rlike(DATE_PATTERN), "date")
        .when(v.rlike(INTEGER_PATTERN), "integer").when(v.rlike(FLOAT_PATTERN), "float").otherwise("string")
    )


def _kind(c: Column) -> Column:
    return F.when(~text.blank(c), value_type(c))


def _commonest(counts: dict[str, Column]) -> tuple[Column, Column]:
    """The type with most values (the earlier one on a tie), and the number of values."""
    top = F.greatest(*counts.values())
    kind = F.when(top == 0, "unknown")
    for t, n in counts.items():
        kind = kind.when(n == top, t)
    return kind, sum(counts.values(), F.lit(0))


def infer_types(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """The commonest type of the non-blank values per column; ``unknown`` without any.
    Five counters per column: one partial aggregate over any number of rows."""
    typed = values.select(*by, _kind(F.col(value)).alias("_type"))
    counted = typed.groupBy(*by).agg(*[F.count_if(F.col("_type") == t).alias(f"_{t}") for t in TYPES])
    kind, total = _commonest({t: F.col(f"_{t}") for t in TYPES})
    return counted.select(*by, kind.alias("inferred_type"), total.alias("value_count"))


def infer_column_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, inferred_type, value_count) of the columns of a wide table: one row of counters
    per task is all that is shuffled, and no cell becomes a row."""
    kinds = df.select(*[_kind(F.col(f"`{c}`").cast("string")).alias(f"_{n}") for n, c in enumerate(columns)])
    counted = kinds.agg(*[
        F.count_if(F.col(f"_{n}") == t).alias(f"_{n}_{t}") for n in range(len(columns)) for t in TYPES
    ])
    found = []
    for n, c in enumerate(columns):
        kind, total = _commonest({t: F.col(f"_{n}_{t}") for t in TYPES})
        found.append(F.struct(F.lit(c).alias("column"), kind.alias("inferred_type"), total.alias("value_count")))
    return counted.select(F.inline(F.array(*found)))


def map_columns(df: DataFrame, collision: str = "last", config: Config = DEFAULT) -> DataFrame:
    """Renames the columns of one layout. Where several become the same field, ``last``
    takes the last source column even if it is null, ``coalesce`` the last one filled."""
    lookup = config.alias_lookup()
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(c if c.startswith("_") else lookup.get(c.lower(), c), []).append(c)
    def value(sources):
        quoted = [F.col(f"`{s}`") for s in sources]
        return quoted[-1] if collision == "last" else F.coalesce(*reversed(quoted))
    return df.select(*[value(sources).alias(name) for name, sources in groups.items()])


#: Rows of a stored table from which on the names of its layouts are looked up, and layouts up to which they are.
SHAPED_ROWS, MAX_SHAPES = 1_000_000, 1_000


def shapes(table: DataFrame, raw: str = "raw") -> DataFrame | None:
    """(_keys) the layouts (lists of source columns) of a stored table, if it has many rows and few layouts."""
    if table.count() < SHAPED_ROWS:
        return None
    found = stage(table.select(F.map_keys(raw).alias("_keys")).distinct().limit(MAX_SHAPES + 1), "shapes")
    return found if found.count() <= MAX_SHAPES else None


def map_open_rows(
    df: DataFrame, raw: str = "raw", mapped: str = "mapped", config: Config = DEFAULT, layouts: DataFrame | None = None
) -> DataFrame:
    """The same for a map of open columns: canonical keys, the last source column wins. With ``layouts``, the ``shapes`` of
    the rows, names are found once for each layout."""
    if layouts is None:
        named = df.withColumn("_names", _canonical_names(F.map_keys(raw), config))
    else:
        known = layouts.withColumn("_names", _canonical_names(F.col("_keys"), config))
        named = df.join(F.broadcast(known), F.map_keys(df[raw]).eqNullSafe(known["_keys"])).drop("_keys")
    entries = F.arrays_zip(F.col("_names").alias("key"), F.map_values(raw).alias("value"))
    later = lambda i: F.slice("_names", i + 2, F.size("_names"))
    last = F.filter(entries, lambda e, i: ~F.array_contains(later(i), e["key"]))
    single = F.size(F.array_distinct("_names")) == F.size("_names")
    found = F.when(single, F.map_from_arrays("_names", F.map_values(raw))).otherwise(F.map_from_entries(last))
    return computed_once(computed_once(named, "named").withColumn(mapped, found).drop("_names"), "mapped")


def attributes(columns: DataFrame, by: str = "file_id", config: Config = DEFAULT) -> DataFrame:
    """Across files: field, label, source names and number of files, sorted by label.

    Columns are first reduced to distinct (field, source, file); a field has few source
    names but may have any number of files, which are therefore counted, not listed
    (``attribute_files`` has them as rows).
    """
    named = attribute_files(columns, by, config)
    per_source = named.groupBy("name", "source_name").agg(F.count("*").alias("n"))
    sources = per_source.groupBy("name").agg(F.array_sort(F.collect_set("source_name")).alias("source_names"))
    in_files = named.select("name", by).distinct().groupBy("name").agg(F.count("*").alias("file_count"))
    label = text.title(F.replace("name", F.lit("_"), F.lit(" ")))
    return sources.join(in_files, "name").withColumn("label", label).orderBy(F.lower("label"))


def attribute_files(columns: DataFrame, by: str = "file_id", config: Config = DEFAULT) -> DataFrame:
    shown = columns.where(~F.col("column").startswith("_"))
    return shown.select(
        canonical_name(F.col("column"), config).alias("name"), F.col("column").alias("source_name"), by
    ).distinct()


def requested_attributes(names: Sequence[str], config: Config = DEFAULT) -> list[str]:
    """Blank names dropped, duplicates dropped in order."""
    wanted = list(dict.fromkeys(n.strip() for n in names if n.strip()))
    if len(wanted) > config.max_attributes:
        raise ValueError(f"at most {config.max_attributes} attributes")
    return wanted


def project_attributes(df: DataFrame, names: Sequence[str], config: Config = DEFAULT) -> DataFrame:
    """The requested fields and the ``_`` columns: a column prune that reaches the scan."""
    wanted = set(requested_attributes(names, config))
    return df.select(*[c for c in df.columns if c in wanted or c.startswith("_")])


def split_extra(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Golden fields as columns, all other data as the map ``extra_fields``, null if none."""
    known = [c for c in df.columns if c in GOLDEN_FIELDS]
    others = [c for c in df.columns if c not in known and c not in keep and not c.startswith("_")]
    none = F.lit(None).cast("map<string,string>")
    extra = F.create_map(*[x for c in others for x in (F.lit(c), F.col(c).cast("string"))]) if others else none
    return df.select(*keep, *known, extra.alias("extra_fields"))


def schema_summary(raw: DataFrame, by: str = "file_id", config: Config = DEFAULT) -> DataFrame:
    """Per file: number of columns, unknown columns, canonical field -> type."""
    values = raw.select(by, F.explode("raw").alias("column", "value"))
    typed = infer_types(values, [by, "column"])
    named = alias_table(typed, config)
    entry = F.concat_ws(":", "canonical", "inferred_type")
    return named.groupBy(by).agg(
        F.count("*").alias("mapped_columns"),
        F.array_sort(F.collect_list(F.when(F.col("is_unknown"), F.col("column")))).alias("unknown_columns"),
        F.array_sort(F.collect_list(entry)).alias("type_map"),
    )
