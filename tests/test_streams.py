"""Streams give what one batch gives; answers and pages keep their rules."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contactloom.config import DEFAULT
from contactloom.operators import explore, matching
from contactloom.operators.answers import answer, with_intent
from contactloom.plans import tables
from contactloom.streaming import ingest as st


def test_incremental_equals_one_run(spark, sf_dir):
    whole = matching.first_seen(tables.arrivals(spark, sf_dir), DEFAULT.file_match_keys)
    pieces = entry.queries()["incremental_merge"](spark, sf_dir)
    assert pieces.exceptAll(whole).count() == 0 and whole.exceptAll(pieces).count() == 0


def test_counts_over_several_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    ordered = events.withColumn("part", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy("ts"))).cache()
    for part in (1, 2, 3):
        ordered.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
        st.running_counts(spark.readStream.schema(events.schema).parquet(source), out, mark)
    got = {(r.window_start, r.event_type): r.n for r in st.latest_counts(spark, out).collect()}
    want = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().select("w.start", "event_type", "count").collect()
    assert got == {(r.start, r.event_type): r["count"] for r in want}


def test_rerun_without_news_adds_nothing(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df = spark.createDataFrame([(1, 1, " A@B.CD ")], "source_row int, upload_file_id int, email string")
    df.write.parquet(source)
    for _ in range(2):
        st.ingest(spark.readStream.schema(df.schema).parquet(source), out, mark)
    assert [(r.email, r.error_count) for r in spark.read.parquet(out).collect()] == [("a@b.cd", 0)]


GOLDEN = "id long, email string, phone string, full_name string, first_name string, last_name string, city string, state string, country string, is_duplicate boolean"


@pytest.mark.parametrize("query, intent, argument, limit", [
    ("how many customers", "count", None, 10), ("count customers", "count", None, 10), ("show customers", "list", None, 10),
    ("show 5 customers", "search", "5", 5), ("Customers in Chennai ", "city_filter", "Chennai", 10), ("search john", "search", "john", 10),
    ("find john@example.com", "search", "john@example.com", 10), ("show duplicate customers", "duplicates", None, 10),
    ("  ", "invalid", None, 10), (None, "invalid", None, 10), ("top 500 duplicates", "duplicates", None, 50),
    ("first 0 x", "search", "first 0 x", 1), ("limit 99999999999999999999999999999999999999999 x", "search", None, 50),
])
def test_intents(spark, query, intent, argument, limit):
    row = with_intent(spark.createDataFrame([(query,)], "query string")).first()
    assert (row.intent, row.row_limit) == (intent, limit)
    if argument is not None or intent not in ("search", "city_filter"):
        assert row.argument == argument


def test_answers(spark):
    golden = spark.createDataFrame([
        (n, f"user{n}@x.com", None, "Ann_Lee" if n == 3 else "AnnXLee", None, None, "Rome" if n % 2 else "Oslo", None, None, n == 4)
        for n in range(1, 31)], GOLDEN)
    asked = spark.createDataFrame([(q,) for q in (
        "search USER1", "customers in rome", "customers in r%e", "show duplicates", "list", "find ann_lee", "how many?", "search nobody",
        "top 3 customers in rome")], "query string")
    got = {}
    for r in answer(asked, golden).collect():
        got.setdefault(r.query, (r.intent, r["count"], []))[2].append(r.id)
    assert sorted(got["search USER1"][2]) == [1, 10, 11, 12, 13, 14, 15, 16, 17, 18]
    assert sorted(got["customers in rome"][2]) == sorted(got["customers in r%e"][2]) == list(range(1, 21, 2))
    assert got["show duplicates"] == ("duplicates", 1, [4])
    assert sorted(got["list"][2]) == list(range(1, 11)) or got["list"][0] == "search"
    assert len(got["find ann_lee"][2]) == 10
    assert got["how many?"] == ("count", 30, [None]) and got["search nobody"] == ("search", 0, [None])


def test_pages(spark):
    df = spark.createDataFrame([(n, None if n % 5 == 0 else f"c{n % 3}") for n in range(1, 31)], "id long, city string")
    for sort in ("city", "-city"):
        whole = [(r.city, r.id) for r in df.orderBy(*explore.sort_order(sort)).collect()]
        seen, after = [], None
        for number in range(1, 5):
            by_offset = [(r.city, r.id) for r in explore.page(df, sort, number, 8).collect()]
            by_key = [(r.city, r.id) for r in explore.page(df, sort, page_size=8, after=after).collect()]
            assert by_offset == by_key
            seen += by_key
            after = seen[-1]
        assert seen == whole
    with pytest.raises(ValueError):
        explore.page(df, "password")
    with pytest.raises(ValueError):
        explore.page(df, "city", 1, 201)


def test_scratch_deletes_what_is_staged_inside(spark):
    from contactloom import session

    kept = session.stage(spark.range(3), "kept")
    with session.scratch(spark):
        inside = session.stage(spark.range(5), "inside")
        path = session._staged[-1]
        assert inside.count() == 5
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    assert kept.count() == 3 and path not in session._staged
