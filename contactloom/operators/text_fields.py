"""Contact fields, label/value pairs and tables in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.config import DEFAULT, LABEL_VALUE_PATTERN, TEXT_PATTERNS, Config
from contactloom.functions import text

MAX_LABEL = 40
NO_LABEL_PATTERN = r"[A-Za-z _/\-]++(?!\s*+[:=])"


def field(c: Column, name: str) -> Column:
    """The first match of the field's pattern in the text."""
    return F.nullif(text.strip(F.regexp_extract(c, "(?U)" + TEXT_PATTERNS[name], 0)), F.lit(""))


def text_fields(df: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    return df.select(*keys, *[field(F.col(column), name).alias(name) for name in TEXT_PATTERNS])


def label_values(df: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """(keys..., label, value): every ``label: value`` pair; the last one of a label wins.

    Runs of label characters that no ``:`` or ``=`` follows cannot hold a label. The
    pattern takes each of them in one step instead of trying all their letters, which
    keeps it linear in the text; they come out with an empty label. The last pair is a
    partial aggregate per label, so texts and labels may be of any length and frequency.
    """
    pattern = F.lit("(?Ud)" + NO_LABEL_PATTERN + "|" + LABEL_VALUE_PATTERN)
    marked = F.when(F.contains(F.col(column), F.lit(":")) | F.contains(F.col(column), F.lit("=")), F.col(column))
    pairs = F.filter(
        F.arrays_zip(
            F.regexp_extract_all(marked, pattern, F.lit(1)).alias("label"),
            F.regexp_extract_all(marked, pattern, F.lit(2)).alias("value"),
        ),
        lambda p: p["label"] != "",
    )
    found = df.select(*keys, F.posexplode(pairs).alias("pos", "pair")).select(
        *keys, "pos", F.replace(F.lower(text.strip(F.col("pair.label"))), F.lit(" "), F.lit("_")).alias("label"),
        text.strip(F.col("pair.value")).alias("value"),
    )
    kept = found.where((F.col("label") != "") & (F.col("value") != "") & (F.length("label") < MAX_LABEL))
    return kept.groupBy(*keys, "label").agg(F.max_by("value", "pos").alias("value"))


def text_records(df: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """(keys..., label, value): the pairs, with the pattern fields in place of pairs of the
    same name."""
    pairs = label_values(df, keys, column)
    fields = text_fields(df, keys, column)
    cells = F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("value")) for n in TEXT_PATTERNS])
    found = fields.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where("value IS NOT NULL")
    rest = pairs.join(found.select(*keys, "label"), [*keys, "label"], "left_anti")
    return rest.unionByName(found)


def grid_rows(df: DataFrame, keys: list[str], grid: str = "grid") -> DataFrame:
    """(keys..., row_no, row MAP): rows of a table whose first row names the columns.

    Unnamed columns are ``col_<n>``, blank rows are dropped, short rows padded with null;
    of columns with the same name the last one counts. Grids of one row give nothing.
    """
    head = F.transform(
        F.element_at(grid, 1),
        lambda h, n: F.when(h.isNull() | (h == ""), F.concat(F.lit("col_"), n.cast("string"))).otherwise(text.strip(h)),
    )
    body = F.filter(
        F.slice(F.col(grid), 2, F.size(grid)), lambda r: F.exists(r, lambda c: ~text.blank(c))
    )
    named = df.where(F.size(grid) >= 2).select(*keys, head.alias("_head"), body.alias("_body"))
    rows = named.select(*keys, "_head", F.posexplode("_body").alias("_pos", "_cells"))
    entries = F.transform("_head", lambda h, n: F.struct(h.alias("key"), F.get("_cells", n).alias("value")))
    later = lambda n: F.slice("_head", n + 2, F.size("_head"))
    last = F.filter(entries, lambda e, n: ~F.array_contains(later(n), e["key"]))
    return rows.select(*keys, (F.col("_pos") + 1).alias("row_no"), F.map_from_entries(last).alias("row"))


def page_kinds(pages: DataFrame, doc: str, config: Config = DEFAULT) -> DataFrame:
    """Per document: pages read, with tables, with text, empty; ``is_scanned`` if all are
    empty; a warning if there are more pages than are read.

    ``pages`` is (doc, page_no from 1, has_table, text).
    """
    read = F.lit(True) if config.max_pages is None else F.col("page_no") <= config.max_pages
    is_table = F.coalesce(F.col("has_table"), F.lit(False))
    has_text = ~text.blank(F.col("text"))
    counted = pages.groupBy(doc).agg(
        F.max("page_no").alias("_pages"),
        F.count_if(read).alias("pages_total"),
        F.count_if(read & is_table).alias("table_pages"),
        F.count_if(read & ~is_table & has_text).alias("text_pages"),
        F.count_if(read & ~is_table & ~has_text).alias("empty_pages"),
    )
    whole = F.lit(True) if config.max_pages is None else F.col("_pages") <= config.max_pages
    warning = F.concat(
        F.lit("PDF has "), F.col("_pages").cast("string"), F.lit(f" pages; only first {config.max_pages} processed")
    )
    return counted.select(
        doc, "pages_total", "table_pages", "text_pages", "empty_pages",
        ((F.col("pages_total") > 0) & (F.col("empty_pages") == F.col("pages_total"))).alias("is_scanned"),
        F.when(~whole, warning).alias("warning"),
    )


def raw_text(c: Column, chars: int | None = None) -> Column:
    """What a text record keeps of its page: all of it, or the first ``chars``."""
    return c if chars is None else F.substring(c, 1, chars)
