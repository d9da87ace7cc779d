"""Explorer queries over the golden table: search, filters, sort, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.config import FILTER_FIELDS, SEARCH_FIELDS, SORTABLE_FIELDS
from contactloom.functions import text

DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 200


def search_condition(phrase: str, fields=SEARCH_FIELDS) -> Column:
    """Any of the fields contains the phrase, whatever the case."""
    hits = [F.coalesce(F.col(f).ilike(text.like_pattern(phrase)), F.lit(False)) for f in fields]
    return reduce(lambda a, b: a | b, hits)


def sort_order(sort: str, allowed=SORTABLE_FIELDS, id_column: str = "id") -> list[Column]:
    """``field`` ascending with nulls last, ``-field`` descending with nulls first; equal
    values are ordered by id."""
    name = sort.lstrip("-")
    if name not in allowed:
        raise ValueError(f"cannot sort by {name!r}; allowed: {sorted(allowed)}")
    first = F.col(name).desc_nulls_first() if sort.startswith("-") else F.col(name).asc_nulls_last()
    return [first, F.col(id_column).asc()]


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be between 1 and {MAX_PAGE_SIZE}")


def select_golden(
    golden: DataFrame,
    search: str | None = None,
    is_duplicate: bool | None = None,
    batch_id: int | None = None,
    owned_batches: DataFrame | None = None,
    **filters: str,
) -> DataFrame:
    """Matching records. Without ``is_duplicate`` only survivors; the exact filters and the
    batch reach the scan as pushed predicates."""
    unknown = set(filters) - set(FILTER_FIELDS)
    if unknown:
        raise ValueError(f"cannot filter by {sorted(unknown)}")
    out = golden.where(F.col("is_duplicate") == F.lit(bool(is_duplicate)))
    if batch_id is not None:
        out = out.where(F.col("batch_id") == batch_id)
        if owned_batches is not None:
            owned = owned_batches.where(F.col("batch_id") == batch_id).select("batch_id").limit(1)
            out = out.join(owned, "batch_id", "left_semi")
    for name, value in filters.items():
        if value:
            out = out.where(F.col(name) == value)
    phrase = (search or "").strip()
    return out.where(search_condition(phrase)) if phrase else out


def page(
    df: DataFrame,
    sort: str = "-created_at",
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    allowed=SORTABLE_FIELDS,
    id_column: str = "id",
    after: tuple | None = None,
) -> DataFrame:
    """One page. ``after`` is (sort value, id) of the last row seen: deep pages then start
    from a filter instead of an offset that sorts all earlier pages again."""
    check_page(page, page_size)
    order = sort_order(sort, allowed, id_column)
    if after is None:
        return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    value, last = after
    c, ids = F.col(sort.lstrip("-")), F.col(id_column)
    descending = sort.startswith("-")
    if value is None:
        beyond = (c.isNull() & (ids > last)) | (c.isNotNull() if descending else F.lit(False))
    else:
        past = c < F.lit(value) if descending else (c > F.lit(value)) | c.isNull()
        beyond = past | ((c == F.lit(value)) & (ids > last))
    return df.where(beyond).orderBy(*order).limit(page_size)


def page_meta(df: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    check_page(page, page_size)
    return df.agg(F.count("*").alias("count")).select(
        "count", F.lit(page).alias("page"), F.lit(page_size).alias("page_size"),
        F.greatest(F.lit(1), F.ceil(F.col("count") / page_size)).alias("total_pages"),
    )
