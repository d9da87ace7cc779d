"""Incremental work with Structured Streaming: ingest, counts, matching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType, TimestampNTZType

from contactloom.config import DEFAULT, Config
from contactloom.operators import matching
from contactloom.operators.lookup import lookup_join, shuffled
from contactloom.operators.survivorship import golden_fold
from contactloom.operators.transform import transform_rows, with_issues
from contactloom.session import scratch, stage
from contactloom.streaming.buckets import BucketLog


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Processes what has arrived since the last run, then stops."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest(
    rows: DataFrame, out_path: str, checkpoint: str,
    keep: tuple[str, ...] = ("source_row", "upload_file_id"), config: Config = DEFAULT,
) -> None:
    """New contact rows (a streaming DataFrame) cleaned, checked and appended to a table.
    The column expressions are those of the batch job."""
    checked = with_issues(transform_rows(rows, keep, config), keep, config)
    run_available(checked.writeStream.format("parquet").option("path", out_path), checkpoint)


def _upsert(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch under its number: a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write


COUNTS = "window_start timestamp_ntz, event_type string, n bigint, errors bigint"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def running_counts(events: DataFrame, path: str, checkpoint: str, window: str = "1 day", delay: str = "1 hour") -> None:
    """Events per window and type, in UTC whatever the session's time zone. Late events
    within ``delay`` still count; the state of older windows is dropped. Every micro-batch
    writes the counts that changed; what they replace is dropped now and then, so that the table
    stays in proportion to the windows, however many batches there were."""
    if isinstance(events.schema["ts"].dataType, TimestampNTZType):
        # Watermarks need instants.
        events = events.withColumn("ts", F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {EPOCH}, ts))"))
    counts = (
        events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
        .withColumn("window_start", F.expr(f"timestampadd(MICROSECOND, unix_micros(w.start), {EPOCH})"))
        .select("window_start", "event_type", "n", "errors")
    )
    log = _counts(events.sparkSession, path)
    run_available(counts.writeStream.outputMode("update").foreachBatch(log.append), checkpoint)


def _counts(spark: SparkSession, path: str) -> BucketLog:
    return BucketLog(spark, path, COUNTS, ["window_start", "event_type"], buckets=8, replace=True)


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The current count per window and type."""
    return _counts(spark, path).read()


# --- matching against what is already there -------------------------------------------------------

OWNERS = "key_set int, key string, owner bigint"
FOUND = "rid bigint, primary_id bigint, key_set int"


def match_new(
    rows: DataFrame, owners_of: Callable[[DataFrame], DataFrame], key_sets, scope=(), record_id: str = "rid"
) -> tuple[DataFrame, DataFrame]:
    """(assignments, new owners) for rows that arrived after all records behind the owners. ``owners_of`` gives
    the owners of at least the keys (key_set, key) that it is called with.

    A new row with a key that is already owned is a duplicate and owns nothing. Only the
    rest is matched among itself, and each new row then takes its first key whose owner
    came earlier: the same result as one run over all rows, at the cost of the new ones.
    """
    keyed = matching.numbered(matching.keyed(rows, key_sets, scope, record_id))
    coded, keys = matching.coded(keyed, texts=True)
    holders, on = matching.holders_of(coded), ["key_set", "key"]
    known = owners_of(keys).join(shuffled(keys), on).select("key_set", F.col("code").alias("key"), "owner")
    known = stage(known, "known")
    new_edges = matching.edges(coded.drop("leads"))
    taken = lookup_join(new_edges, known, on, "holders", counts=holders).select("row").distinct()
    open_rows = stage(coded.drop("leads").join(taken, "row", "left_anti"), "free")
    fresh = stage(matching.code_owners(open_rows, holders), "fresh")
    hits = lookup_join(new_edges, known.unionByName(fresh), on, "holders", counts=holders)
    found = hits.where("owner < rid").groupBy("rid").agg(F.min(F.struct("key_set", "owner")).alias("hit"))
    assigned = keyed.select("rid").join(found, "rid", "left").select(
        "rid", F.coalesce("hit.owner", "rid").alias("primary_id"), F.col("hit.key_set").alias("key_set")
    )
    named = fresh.withColumnRenamed("key", "code").join(shuffled(keys), ["key_set", "code"]).select("key_set", "key", "owner")
    return assigned, named


def _refreshed(old: DataFrame, rows: DataFrame, assigned: DataFrame, fields: Sequence[str], record_id: str) -> DataFrame:
    """Golden records of the clusters that got rows: the fold goes on from the record it had come to.

    The fold's state after some records of a cluster is the merged record itself, so this equals a fold over all
    of them. A stored record stands first, under the identifier of its cluster's first row.
    """
    held = old.select("primary_id", F.col("primary_id").alias("rid"), *fields, F.col("source_count").alias("_count"))
    mine = rows.withColumnRenamed(record_id, "rid").join(assigned.select("rid", "primary_id"), "rid")
    members = mine.select("primary_id", "rid", *fields, F.lit(1).cast("bigint").alias("_count")).unionByName(held)
    folded = golden_fold(members, fields, count=F.col("_count"))
    before = old.select("primary_id", F.col("base_id").alias("_base"))
    base = F.when(F.col("base_id") == F.col("primary_id"), F.coalesce("_base", "base_id")).otherwise(F.col("base_id"))
    return folded.join(before, "primary_id", "left").select("primary_id", base.alias("base_id"), "source_count", *fields)


def merge_incrementally(
    rows: DataFrame, path: str, checkpoint: str, key_sets, scope=(), record_id: str = "rid",
    fields: Sequence[str] | None = None, buckets: int = 64,
) -> None:
    """Matches a stream of cleaned rows, ids rising with arrival, against the golden
    records so far. ``path`` holds the key owners and the assignments, and with ``fields`` the golden records, of
    which a micro-batch reads the ``buckets`` its keys and clusters fall into and writes those that change."""
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        owners = BucketLog(spark, f"{path}/owners", OWNERS, ["key_set", "key"], buckets)
        with scratch(spark):  # a stream runs for ever, its steps' tables must not stay
            arrived = stage(batch, "arrived")
            assigned, fresh = match_new(arrived, lambda keys: owners.read(number, keys), key_sets, scope, record_id)
            assigned = stage(assigned, "assigned")
            if fields:
                golden = _golden_log(spark, path, _golden_type(arrived, fields), buckets)
                clusters = assigned.select("primary_id").distinct()
                old = stage(golden.read(number, clusters).join(clusters, "primary_id", "left_semi"), "before")
                golden.append(_refreshed(old, arrived, assigned, fields, record_id), number)
            owners.append(fresh, number)
            _upsert(f"{path}/assigned")(assigned, number)
    run_available(rows.writeStream.foreachBatch(each), checkpoint)


def _golden_type(rows: DataFrame, fields: Sequence[str]) -> StructType:
    ids = StructType.fromDDL("primary_id bigint, base_id bigint, source_count bigint")
    return StructType([*ids.fields, *[rows.schema[f] for f in fields]])


def _golden_log(spark: SparkSession, path: str, schema: StructType | None, buckets: int = 64) -> BucketLog:
    return BucketLog(spark, f"{path}/golden", schema, ["primary_id"], buckets, replace=True)


def golden_records(spark: SparkSession, path: str) -> DataFrame:
    """(primary_id, base_id, source_count, fields...) of all clusters, as of the last complete micro-batch."""
    return _golden_log(spark, path, None).read()


def assignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FOUND + ", batch int").parquet(f"{path}/assigned").drop("batch")
