"""What must not grow with files and tables: what a task holds, what is broadcast, what is compared."""

import io
import json

import pandas as pd
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from contactloom import session
from contactloom.config import Config
from contactloom.functions import text
from contactloom.operators import answers, batch, lookup, schema
from contactloom.sinks import export
from contactloom.sources import files, records, streams


class Watched(io.BytesIO):
    most = 0

    def read(self, size=-1):
        found = super().read(size)
        Watched.most = max(Watched.most, len(found))
        return found


def opened(text):
    return lambda: Watched(text.encode() if isinstance(text, str) else text)


ROWS = [{"id": n, "x": {"y": "é\"}]" * (n % 4), "z": [n, {"a": None}]}, "w": 1.5e-3 * n} for n in range(60)]
DOCUMENTS = [
    json.dumps(ROWS), json.dumps({"n": 12345, "codes": [1, 2], "rows": ROWS, "more": {"a": [1]}}, indent=2), json.dumps(ROWS[1]),
    "﻿" + json.dumps(ROWS, ensure_ascii=False), '{"rows": []}', "[]", " [1, \"a\", null, {\"a\": -12.5e+10}, true] ", "12345678", '"x"', "",
    json.dumps(ROWS)[:-1], json.dumps(ROWS) + "x", '{"a": [{"b": 1}] "c"', "\n".join(map(json.dumps, ROWS)), '{"a": 1}\r\n\n5\n{bad [1]\n{"a": 2}',
]


@pytest.mark.parametrize("number", range(len(DOCUMENTS)))
def test_json_does_not_depend_on_the_window(monkeypatch, number):
    whole = list(records.JSON(opened(DOCUMENTS[number])))
    for block in (1, 7, 64):
        monkeypatch.setattr(records, "BLOCK", block)
        assert list(records.JSON(opened(DOCUMENTS[number]))) == whole
    monkeypatch.undo()
    if number < 2:
        assert [(n, raw["id"]) for n, raw, _ in whole] == [(n + 1, str(n)) for n in range(60)]


def read_by_splits(text, size):
    """What the splits of a document give together, or nothing if they do not fit."""
    def at(place):
        stream = io.BytesIO(text.encode())
        stream.seek(place)
        return stream

    facts, items = [], []
    for split in range(-(-len(text.encode()) // size)):
        for attempt, *found in records._split_items(at, split, size):
            if len(found) == 2:
                items.append((split, attempt, *found))
            else:
                facts.append(("f", split, attempt, *found))
    chain = records._chain(size)(pd.DataFrame(facts, columns=["_file", "split", "attempt", "first", "next", "n", "wrapped", "ended"]))
    before = {(split, attempt): n for _, split, attempt, n in chain.itertuples(index=False)}
    return [records._record(before[s, a] + n, item) for s, a, n, item in items if (s, a) in before]


TRAPS = [{"id": n, "t": '},{"a": 1},{' * (n % 3), "l": [{"a": m} for m in range(n % 4)], "é": {"m": [{}, {}]}} for n in range(300)]


@pytest.mark.parametrize("block", [64, 1 << 20])
@pytest.mark.parametrize("size", [500, 1000, 1 << 20])
@pytest.mark.parametrize("text", [
    json.dumps(TRAPS), json.dumps({"n": [1, 2], "rows": TRAPS, "after": [{"b": 1}, {"b": 2}]}, indent=1), "﻿" + json.dumps(TRAPS, ensure_ascii=False)])
def test_splits_of_a_document_give_its_records(monkeypatch, text, size, block):
    monkeypatch.setattr(records, "BLOCK", block)
    assert read_by_splits(text, size) == list(records.JSON(opened(text)))


@pytest.mark.parametrize("text", [
    json.dumps(TRAPS)[:-1], json.dumps(TRAPS) + "x", json.dumps(TRAPS).replace('"id": 200', '"id" 200'), json.dumps({"rows": TRAPS})[:-1],
    json.dumps(TRAPS) + "}", json.dumps({"a": {"b": [{}]}, "t": "x" * 3000}), "\n".join(map(json.dumps, TRAPS))])
def test_splits_of_other_documents_do_not_fit(text):
    assert read_by_splits(text, 1000) == []


def test_large_documents_are_read_by_splits(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in put"
    folder.mkdir()
    mixed = [*TRAPS[:100], 5, None, *TRAPS[100:]]
    for name, text in (("good", json.dumps({"rows": TRAPS}, indent=1)), ("bad", json.dumps(TRAPS)[:-1]), ("mixed", json.dumps(mixed)), ("small", '[{"a": 1}, 2]')):
        (folder / f"{name}.json").write_text(text)

    def read():
        return sorted((r._file.rsplit("/")[-1], r._source_row or 0, sorted((r.raw or {}).items(), key=str), r.error or "")
                      for r in records.read_records(spark, str(folder), "json").collect())

    whole = read()
    monkeypatch.setattr(records, "LARGE", 1000)
    monkeypatch.setattr(records, "SPLIT", 1000)
    assert read() == whole
    monkeypatch.setattr(records, "JSON", lambda opened: iter([(None, None, "left to one task")]))
    alone = {name for name, _, _, error in read() if error == "left to one task"}
    assert {"bad.json", "small.json"} <= alone and "good.json" not in alone


def test_a_document_is_put_together_from_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "BLOCK", 1000)
    for n in (0, 1, 3000):
        rows = spark.range(n).selectExpr("id", "IF(id % 3 = 0, NULL, 'a\n\"é') AS name", "repeat('x', int(id % 50)) AS x").repartition(5).orderBy("id")
        assert export.write_json_document(rows, str(tmp_path / str(n))) == n
        [part] = (tmp_path / str(n)).glob("part-*")
        text = part.read_text()
        document = json.loads(text)
        assert document["count"] == n and [r["id"] for r in document["results"]] == list(range(n)) and text.count("\n") == n + 2
    assert document["results"][3] == {"id": 3, "name": None, "x": "xxx"} and document["results"][4]["name"] == 'a\n"é'


def test_records_of_a_document_are_not_made_by_the_task_that_writes_it(spark, tmp_path):
    task = F.udf(lambda x: TaskContext.get().partitionId(), "int")
    rows = spark.range(0, 400, 1, 4).select("id", task("id").alias("task"))
    export.write_json_document(rows, str(tmp_path / "out"))
    [part] = (tmp_path / "out").glob("part-*")
    assert {r["task"] for r in json.loads(part.read_text())["results"]} == {0, 1, 2, 3}


def test_json_and_xml_are_never_held_whole():
    many = [{"id": n, "text": "x" * 90} for n in range(60_000)]
    rows = "".join(f"<c><id>{r['id']}</id><text>{r['text']}</text></c>" for r in many)
    for parse, text in (
        (records.JSON, json.dumps({"rows": many})), (records.JSON, "\n".join(map(json.dumps, many))), (records.XML, f"<r>{rows}</r>"),
        (files._tags, f"<r>{rows}</r>"),
    ):
        Watched.most = 0
        assert sum(1 for _ in parse(opened(text))) == 60_000 and Watched.most <= 1 << 20 < len(text) / 5


def _documents(contents):
    names = [str(n) for n in range(len(contents))]
    return pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), pa.string()), pa.array(contents)], names=["_file", "path", "content"])


def test_errors_of_many_documents_are_one_batch():
    bad = [b"<r><a/><b/>", b"<r/>", b""] * 1000
    found = list(files._children(iter([_documents(bad)])))
    assert [batch.num_rows for batch in found] == [3000]
    errors = found[0].column("error").to_pylist()
    assert errors[:3] == [
        "XML parse error: no element found: line 1, column 11", "Could not detect record element in XML",
        "XML parse error: no element found: line 1, column 0"] and errors == errors[:3] * 1000


def test_a_document_of_few_children_is_read_once(monkeypatch):
    asked = []
    monkeypatch.setattr(files.streams, "opener", lambda path, content: lambda: asked.append(content) or io.BytesIO(content))
    document = b'<c:r xmlns:c="urn:x"><c:row/><note><c:row/></note><!-- x --><row/></c:r>'
    found = [row for batch in files._children(iter([_documents([document] * 2)])) for row in batch.to_pylist()]
    assert [(r["_file"], r["position"], r["tag"], r["nth"]) for r in found] == [
        (f, p, t, n) for f in "01" for p, t, n in [(1, "row", 1), (2, "note", 1), (3, "row", 2)]] and len(asked) == 2
    monkeypatch.setattr(files, "CHUNK", 2)
    again = [row for batch in files._children(iter([_documents([document] * 2)])) for row in batch.to_pylist()]
    assert again == found and len(asked) == 6


def test_contents_stay_out_of_spark(spark, tmp_path):
    (tmp_path / "a b%20#.json").write_text('[{"a": 1}]')
    found = streams.file_rows(spark, str(tmp_path))
    assert found.first().content is None and streams.open_file(found.first().path).read() == b'[{"a": 1}]'
    assert [r.raw for r in records.read_records(spark, str(tmp_path), "json").collect()] == [{"a": "1"}]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a b.xml").write_text("<r><c><n>1</n></c><o/><c><n>2</n></c></r>")
    read, _ = files.read_xml_folder(spark, str(tmp_path / "x"))
    assert sorted((r._source_row, r.n) for r in read["c"].collect()) == [(1, "1"), (3, "2")]


def test_tables_of_records_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookup, "MANY_KEYS", 5)
    rows = [(n, n % 2, f"u{n // 4}@x.com", {"k": str(n)}, 1) for n in range(40)]
    kind = "id bigint, batch_id int, email string, extra_fields map<string,string>, source_count bigint"
    counts = batch.merge_counts(batch.merge_batch(spark.createDataFrame(rows, kind), Config(batch_match_keys=(("email",),))))
    assert "Broadcast" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == [(0, 10, 10), (1, 10, 10)]


def test_phrases_are_compared_with_few_values(spark, monkeypatch):
    staged = {}
    monkeypatch.setattr(answers, "stage", lambda df, name="stage": staged.setdefault(name, session.stage(df, name)))
    values = spark.range(3000).select("id", F.array(F.format_string("user%05d@example.com", "id")).alias("texts"))
    phrases = spark.range(0, 3000, 3).select(F.format_string("user%05d@", "id").alias("argument"))
    hits = answers.phrase_hits(values, phrases).collect()
    assert sorted((r.id, r.argument) for r in hits) == [(n, f"user{n:05d}@") for n in range(0, 3000, 3)]
    assert staged["held"].join(staged["keys"], "gram").count() <= 3 * 1000


def test_many_records_of_one_text(spark):
    none = F.lit(None).cast("string")
    rows = spark.range(500).select(
        "id", F.lit("Ann").alias("first_name"), F.concat(F.lit("ann"), F.col("id").cast("string")).alias("email"), F.lit(False).alias("is_duplicate"),
        *[none.alias(c) for c in ("phone", "full_name", "last_name", "city", "state", "country")])
    asked = spark.createDataFrame([("search for ann",), ("find ann49, top 20",), ("find ann49",)], "query string")
    rows = rows.unionByName(rows.where("id = 490"))
    got = answers.answer(asked, rows).groupBy("query").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    found = {r["query"]: r.ids for r in got}
    assert found["search for ann"] == list(range(10)) and found["find ann49"] == [49, 490, 490, *range(491, 498)]


def test_tasks_do_not_grow_with_the_scan(spark, monkeypatch, tmp_path):
    spark.range(0, 50_000, 1, 2).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    assert session.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() == 50


@pytest.mark.parametrize(("children", "times"), [(3, 1), (4, 1), (5, 2)])
def test_record_tags_of_documents_up_to_a_chunk_take_one_reading(monkeypatch, children, times):
    monkeypatch.setattr(files, "CHUNK", 4)
    monkeypatch.setattr(streams, "BLOCK", 3)
    readings = []
    text = b"<r>" + b"<a/>" * (children - 2) + b"<b/><b/></r>"
    found = list(files._tags(lambda: readings.append(1) or io.BytesIO(text)))
    assert [t for _, t, _, _ in found] == ["a"] * (children - 2) + ["b"] * 2
    assert [n for _, _, n, _ in found] == [*range(1, children - 1), 1, 2] and len(readings) == times


def test_hot_keys_are_found_by_buckets(spark, monkeypatch):
    """Keys are counted one by one only in buckets of many rows."""
    rows = session.stage(spark.range(3000).selectExpr("id", "IF(id % 3 = 0, -1, id) AS key", "IF(id % 5 = 0, NULL, 'k') AS other"))
    facts = {"n": F.count("*"), "first": F.min("id")}
    kept, store = [], lookup.stage
    monkeypatch.setattr(lookup, "stage", lambda df, name: kept.append(store(df, name)) or kept[-1])
    cold = sorted(map(tuple, lookup.with_facts(rows, ["key", "other"], facts, 5000).select("id", "key", "other", "n", "first").collect()))
    assert kept == []
    hot = sorted(map(tuple, lookup.with_facts(rows, ["key", "other"], facts, 500).select("id", "key", "other", "n", "first").collect()))
    assert [r.key for r in kept[0].collect()] == [-1] and hot == cold and len(cold) == 2400
    assert {r[3] for r in cold if r[1] == -1} == {800} and {r[3] for r in cold if r[1] != -1} == {1}


def test_names_are_found_once_for_each_layout(spark, monkeypatch):
    raws = [{"E_Mail": "a", "Mobile": "1"}, {"Mobile": "1", "E_Mail": "a"}, {"mail": "b", "EMAIL": "c", "x": None}, {}, None] * 3
    rows = session.stage(spark.createDataFrame([(n, r) for n, r in enumerate(raws)], "rid bigint, raw map<string,string>"))
    plain = {r.rid: r.mapped for r in schema.map_open_rows(rows).collect()}
    assert schema.shapes(rows) is None
    monkeypatch.setattr(schema, "SHAPED_ROWS", 10)
    layouts = schema.shapes(rows)
    assert layouts.count() == 4
    mapped = schema.map_open_rows(rows, layouts=layouts)
    assert {r.rid: r.mapped for r in mapped.collect()} == plain and mapped.columns == ["rid", "raw", "mapped"] and plain[2]["email"] == "c"
    monkeypatch.setattr(schema, "MAX_SHAPES", 3)
    assert schema.shapes(rows) is None


def test_match_form_of_any_outer_character(spark):
    texts = [None, "", *[t for c in map(chr, [*range(0x180), 0x2003, 0x2028, 0x3000]) for t in (c, "A" + c, c + "A", "A" + c + "B", "A\n" + c)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    slow = F.nullif(F.lower(text.strip(F.col("t"))), F.lit(""))
    assert rows.where(~text.match_form(F.col("t")).eqNullSafe(slow)).count() == 0
