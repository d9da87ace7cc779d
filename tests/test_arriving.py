"""Buckets, golden records and uploads of streams; rows that fail a caller's step."""

import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contactloom.integrate import integrate
from contactloom.operators.isolate import apply_isolated
from contactloom.operators.matching import first_seen
from contactloom.operators.survivorship import golden_fold
from contactloom.streaming import ingest as st
from contactloom.streaming.buckets import BucketLog
from contactloom.streaming.uploads import stream_uploads, uploaded


def test_bucket_log_keeps_the_latest_in_few_parts(spark, tmp_path):
    log = BucketLog(spark, str(tmp_path), "k string, v bigint", ["k"], buckets=2, replace=True, deltas=3)
    for number in range(12):
        log.append(spark.createDataFrame([(f"k{n}", number * 10 + n) for n in range(number % 3, 6)], "k string, v long"), number)
        assert log.stored().count() <= 6 * 4
    assert {r.k: r.v for r in log.read().collect()} == {"k0": 90, "k1": 101, "k2": 112, "k3": 113, "k4": 114, "k5": 115}
    assert {r.k: r.v for r in log.read(before=11).collect()}["k2"] == 102


def test_bucket_log_repeats_a_batch(spark, tmp_path):
    log = BucketLog(spark, str(tmp_path), "k string", ["k"], buckets=2, deltas=1)
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    log.append(rows, 0)
    log.append(rows, 0)
    assert log.read().count() == 3
    log.append(rows, 1)
    shutil.rmtree(tmp_path / "manifest" / "batch=1")  # the batch failed before its end
    assert log.read().count() == 3
    log.append(rows, 1)
    log.append(rows.limit(0), 2)
    assert log.read().count() == 6 and log.read(before=0).count() == 0


def test_bytes_read_do_not_grow_with_untouched_owners(spark, tmp_path):
    log = BucketLog(spark, str(tmp_path), st.OWNERS, ["key_set", "key"], buckets=32)
    mine = spark.createDataFrame([(0, "me", 1)], st.OWNERS)
    log.append(mine, 0)
    others = spark.range(5000).select(F.lit(0).alias("key_set"), F.concat(F.lit("o"), F.col("id")).alias("key"), F.col("id").alias("owner"))
    read = []
    for number in range(1, 4):
        own = log.touched(mine)
        log.append(others.where(F.pmod(F.xxhash64("key_set", "key"), F.lit(32)) != own[0]), number)
        read.append(len(log.stored(only=own).inputFiles()))
    assert read == [1, 1, 1]
    assert [tuple(r) for r in log.read(keys=mine).where("key = 'me'").collect()] == [(0, "me", 1)]


def test_golden_records_in_small_deliveries(spark, tmp_path):
    """Rows in eight deliveries, one cluster in all of them, against one fold over all."""
    fields = ["email", "phone", "full_name", "city"]
    rows = [(n, f"e{n % 7 if n % 3 else 0}@x.yz" if n % 5 else None, f"{n % 11}00" if n % 4 else None,
             f"N{n % 13}" if n % 2 else None, f"C{n}" if n % 6 == 0 else None) for n in range(120)]
    df = spark.createDataFrame(rows, "rid long, email string, phone string, full_name string, city string")
    keys = (("email",), ("phone", "full_name"))
    source, state, mark = (str(tmp_path / n) for n in ("in", "state", "mark"))
    for n in range(8):
        df.where(F.col("rid").between(n * 15, n * 15 + 14)).write.mode("append").parquet(source)
        st.merge_incrementally(spark.readStream.schema(df.schema).parquet(source), state, mark, keys, fields=fields, buckets=4)
    whole = golden_fold(df.join(first_seen(df, keys).select("rid", "primary_id"), "rid"), fields)
    columns = ["primary_id", "base_id", "source_count", *fields]
    got = sorted(map(tuple, st.golden_records(spark, state).select(*columns).collect()))
    assert got == sorted(map(tuple, whole.select(*columns).collect()))


def _rows(run):
    columns = ["_file", "source_row", "email", "city", "error_count"]
    return sorted(map(tuple, run.checked.join(run.raw.select("rid", "_file"), "rid").select(*columns).collect()))


def test_uploads_equal_one_run_over_the_folder(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    contents = {
        "my contacts.csv": "email,city\nA@b.cd,Rome\nbad,Oslo\n", "list[1]{a}.csv": 'email;city\nx@y.zz;"two\nlines"\n',
        "w%20x.json": '{"rows": [{"email": "q@r.st"}]}', "broken.json": '{"rows": [', "e.ndjson": '{"email": "n@d.js"}\n{no\n', "empty list.json": "[]",
    }
    for number, (name, text) in enumerate(contents.items()):
        (folder / name).write_text(text)
        if number % 2:
            stream_uploads(spark, str(folder), out, mark, max_files=1 if number > 2 else 10)
    stream_uploads(spark, str(folder), out, mark)
    got, want = uploaded(spark, out), integrate(spark, str(folder))
    assert _rows(got) == _rows(want)
    assert sorted(map(tuple, got.errors.collect())) == sorted(map(tuple, want.errors.collect()))
    assert got.raw.select("rid").distinct().count() == got.raw.count()
    assert got.files.select("file_id").distinct().count() == got.files.count() == want.files.count()
    assert got.customers.count() == want.customers.count() and got.lineage.count() == want.lineage.count()


def test_failing_rows_go_on_alone(spark):
    df = spark.createDataFrame([(n, 1, None if n % 10 == 0 else str(n)) for n in range(1000)], "source_row long, upload_file_id int, v string")

    def double(batch):
        values = batch.column("v").to_pylist()
        if any(v is not None and v.endswith("7") for v in values):
            raise RuntimeError("seven")
        if any(v == "333" for v in values):
            return batch.slice(1)
        return batch.set_column(2, "v", pa.array([v and v * 2 for v in values], pa.string()))

    for rows in (df, df.repartition(7), df.limit(0)):
        got = {r.source_row: r for r in apply_isolated(rows, double).collect()}
        assert len(got) == rows.count()
        for n, row in got.items():
            bad = n % 10 == 7 or n == 333
            assert (row._transform_failed, row.v) == (bad, None if bad or n % 10 == 0 else str(n) * 2)
            assert (row._transform_error or "").startswith("RuntimeError: seven" if n % 10 == 7 else "ValueError" if bad else "")


def test_integrate_with_a_callers_step(spark, tmp_path):
    (tmp_path / "a.csv").write_text("email,city\na@b.cd,Rome\nboom@b.cd,Oslo\nc@b.cd,Bonn\n")

    def step(batch):
        if any(v.startswith("boom") for v in batch.column("email").to_pylist()):
            raise KeyError("boom")
        return batch

    run = integrate(spark, str(tmp_path), transform=step)
    assert sorted((r.source_row, r.error_code) for r in run.issues.where("severity = 'error'").collect()) == [(3, "TRANSFORM_FAILED")]
    assert run.customers.count() == 2
    with pytest.raises(ValueError):
        uploaded(spark, str(tmp_path / "none"))
