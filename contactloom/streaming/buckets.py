"""Tables that micro-batches add to and of which they read only what their keys can touch."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

NUMBER = "_number"


def folders(spark: SparkSession, path: str, committed: bool = True) -> list[str]:
    """Names of the folders below ``path``; of the written tables only those whose job ended."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    found = [s.getPath() for s in system.listStatus(place) if s.isDirectory()]
    return sorted(p.getName() for p in found if not committed or system.exists(hadoop.Path(p, "_SUCCESS")))


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches whose folder ``batch=<number>`` below ``path`` is complete."""
    return sorted(int(name[6:]) for name in folders(spark, path) if name.startswith("batch="))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class BucketLog:
    """Rows dealt to ``buckets`` by a hash of ``keys``, added by numbered micro-batches.

    A micro-batch writes the rows it adds, never those that are there. A bucket that has got more than
    ``deltas`` parts is written anew as one, together with the batch that would add the next, so a bucket is always few
    files and a row is rewritten once in ``deltas`` batches that touch its bucket. A manifest per
    batch (bucket, part), at most ``buckets`` x (``deltas`` + 1) rows, names the parts that are valid; it is
    written last, so a reader sees whole batches only. Its predecessor and the parts that it names are kept: a
    repeated batch finds the state it started from, and one that is complete changes nothing.

    With ``replace`` the latest row of a key counts, else all rows do. Choose ``buckets`` so that one holds about
    the size of a file. Keys are the unit that meets in a bucket: their rows must be few.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType | str | None, keys: Sequence[str],
        buckets: int = 64, replace: bool = False, deltas: int = 8,
    ):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.buckets, self.replace, self.deltas = buckets, replace, deltas

    def _bucket(self, rows: DataFrame):
        types = {f.name: f.dataType for f in (self.schema or rows.schema)}
        return F.pmod(F.xxhash64(*[F.col(k).cast(types[k]) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def manifest(self, before: int | None = None) -> dict[int, list[str]]:
        """The valid parts of each bucket, as of the last batch before number ``before``."""
        found = [n for n in numbers(self.spark, f"{self.path}/manifest") if before is None or n < before]
        parts = defaultdict(list)
        if found:
            for row in self.spark.read.parquet(f"{self.path}/manifest/batch={found[-1]}").collect():
                parts[row.bucket].append(row.part)
        return parts

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that hold any of these keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self._bucket(keys)).distinct().collect())

    def stored(self, before: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The rows as they lie in the valid parts, with the number of their batch."""
        parts = self.manifest(before)
        return self._parts([(b, p) for b, names in parts.items() if only is None or b in set(only) for p in names])

    def _parts(self, which: list[tuple[int, str]]) -> DataFrame:
        paths = [f"{self.path}/data/part={part}/bucket={bucket}" for bucket, part in which]
        if self.schema is None:
            if not paths:
                raise ValueError(f"nothing has been written to {self.path} yet")
            return self.spark.read.parquet(*paths)
        schema = StructType([*self.schema.fields]).add(NUMBER, IntegerType())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _latest(self, rows: DataFrame) -> DataFrame:
        if not self.replace:
            return rows
        others = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), NUMBER).alias("last"))
        return last.select(*self.keys, "last.*").select(*rows.columns)

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The table as of the last batch before ``before``; with ``keys`` only the buckets that hold any of them."""
        only = None if keys is None else self.touched(keys)
        return self._latest(self.stored(before, only)).drop(NUMBER)

    def append(self, rows: DataFrame, number: int) -> None:
        """Adds the rows of micro-batch ``number``, which are computed once."""
        done = numbers(self.spark, f"{self.path}/manifest")
        if number in done:
            return
        if self.schema is not None:
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        parts = self.manifest(number)
        self._write(rows.withColumn(NUMBER, F.lit(number)), str(number))
        new = [int(n[7:]) for n in folders(self.spark, f"{self.path}/data/part={number}", False) if n.startswith("bucket=")]
        full = [b for b in new if len(parts[b]) >= self.deltas]
        if full:
            whole = self._latest(self._parts([(b, p) for b in full for p in [*parts[b], str(number)]]))
            self._write(whole, f"{number}-whole")
        for bucket in new:
            parts[bucket] = [f"{number}-whole"] if bucket in full else [*parts[bucket], str(number)]
        listed = [(bucket, part) for bucket, names in parts.items() for part in names]
        manifest = self.spark.createDataFrame(listed, "bucket int, part string").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")
        self._drop_old([n for n in done if n < number], number)

    def _write(self, rows: DataFrame, part: str) -> None:
        dealt = rows.withColumn("bucket", self._bucket(rows)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/part={part}")

    def _drop_old(self, earlier: list[int], number: int) -> None:
        """Deletes what neither this batch's manifest nor its predecessor's names."""
        used = {p for before in (number, number + 1) for names in self.manifest(before).values() for p in names}
        for n in earlier[:-1]:
            _delete(self.spark, f"{self.path}/manifest/batch={n}")
        for name in folders(self.spark, f"{self.path}/data"):
            part = name[5:]
            if part not in used and int(part.split("-")[0]) < number:
                _delete(self.spark, f"{self.path}/data/{name}")
