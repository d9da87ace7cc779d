"""User transforms over Arrow batches in which a row that fails stops no other."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StringType, StructType

FAILED, ERROR = "_transform_failed", "_transform_error"
Transform = Callable[[pa.RecordBatch], pa.RecordBatch]


def _typed(result: pa.RecordBatch, rows: int, fields: list[pa.Field]) -> list[pa.Array]:
    if result.num_rows != rows:
        raise ValueError(f"{result.num_rows} rows returned for {rows}")
    return [result.column(f.name).cast(f.type) for f in fields]


def _bisected(batch: pa.RecordBatch, transform: Transform, fields: list[pa.Field], keep: set[str]) -> Iterator[pa.RecordBatch]:
    """The batch in pieces that succeeded, and rows that fail alone."""
    todo = [batch]
    while todo:
        part = todo.pop()
        try:
            columns, error = _typed(transform(part), part.num_rows, fields), None
        except Exception as failure:  # whatever a user's function may raise
            if part.num_rows > 1:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
                continue
            columns = [part.column(f.name).cast(f.type) if f.name in keep else pa.nulls(1, f.type) for f in fields]
            error = f"{type(failure).__name__}: {failure}".encode("utf-8", "replace").decode()
        flags = [pa.array([error is not None] * part.num_rows), pa.array([error] * part.num_rows, pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *flags], names=[*[f.name for f in fields], FAILED, ERROR])


def apply_isolated(
    df: DataFrame, transform: Transform, keep: Sequence[str] = ("source_row", "upload_file_id"), schema: StructType | str | None = None
) -> DataFrame:
    """``df`` with ``transform`` applied to its Arrow batches, and ``_transform_failed`` and ``_transform_error``.

    ``transform`` gives, for a batch cut anywhere, a batch with as many rows and the columns of ``schema`` (those of
    ``df`` by default). If it raises, or returns what does not fit, the batch is halved until the rows that fail stand alone: f of
    n rows cost about f x log(n / f) more calls, and none if no row fails. A failing row goes on with the columns ``keep`` only, all
    others null, the flag set and the error's text; ``with_issues`` reports it as TRANSFORM_FAILED. No shuffle; a
    batch (``spark.sql.execution.arrow.maxRecordsPerBatch``) is held at a time.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema or df.schema
    fields = list(to_arrow_schema(kind))
    kept = set(keep) & {f.name for f in fields} & set(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from pa.Table.from_batches(_bisected(batch, transform, fields, kept)).combine_chunks().to_batches()

    out = StructType([*kind.fields]).add(FAILED, BooleanType()).add(ERROR, StringType())
    for field in out:
        field.nullable = True
    return df.mapInArrow(run, out)
