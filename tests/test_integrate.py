"""A folder of files of all formats, from bytes to golden records."""

import json
import zipfile

from pyspark.sql import functions as F

from contactloom.config import Config
from contactloom.integrate import extract, integrate, number_files, prepare
from contactloom.operators import schema
from contactloom.sinks import export


def test_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("First Name,surname,Email Address,phone,Tier\nANN,LEE,ANN@X.COM,,gold\nann,lee,ann@x.com,(555) 123-4567,\nBob,Ray,bad,,\n,,,,\n")
    (folder / "b.json").write_text(json.dumps({"customers": [
        {"name": "Ann Lee", "email": "ann@x.com", "address": {"city": "Rome"}, "town": "Oslo"}, 5]}))
    (folder / "c.ndjson").write_text('{"email": "cy@x.com", "country": "uk"}\n{bad\n')
    (folder / "d.xml").write_text('<r><c id="1"><email>cy@x.com</email><name>cy fox</name></c></r>')
    (folder / "e.xls").write_bytes(b"x")
    (folder / "f.xml").write_text("<r><c>")
    book = spark.createDataFrame([("dan@x.com", "+1 555 000 1111", 5)], "Email string, `Phone Number` string, points int")
    export.write_xlsx(book.coalesce(1), str(folder))
    run = integrate(spark, str(folder))
    errors = {(e._file.rsplit("/", 1)[-1], e.error[:15]) for e in run.errors.collect()}
    assert errors == {
        ("b.json", "Row 2: expected"), ("c.ndjson", "Line 2: JSON pa"), ("e.xls", "Unsupported fil"), ("f.xml", "XML parse error")}
    kept = {r.email: r for r in run.customers.where("NOT is_duplicate").collect()}
    assert set(kept) == {"ann@x.com", "cy@x.com", "dan@x.com"}
    ann = kept["ann@x.com"]
    assert (ann.full_name, ann.phone, ann.city, ann.source_count) == ("Ann Lee", "5551234567", "Oslo", 3)
    assert ann.extra_fields == {"Tier": "gold", "address__city": "Rome"}
    assert (kept["cy@x.com"].country, kept["cy@x.com"].full_name, kept["cy@x.com"].source_count) == ("GB", "Cy Fox", 2)
    assert kept["dan@x.com"].extra_fields == {"points": "5"}
    assert run.lineage.count() == 7 and run.lineage.where("NOT is_valid").count() == 1
    assert run.issues.where("error_code = 'INVALID_EMAIL'").count() == 1
    report = {r.file_id: (r.total_rows, r.valid_rows, r.duplicate_rows) for r in run.quality.collect()}
    assert report[1] == (3, 2, 1) and sum(t for t, _, _ in report.values()) == 7
    assert run.customers.agg(F.sum(F.when(~F.col("is_duplicate"), F.col("source_count")))).first()[0] == 6


def test_attributes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("email,phone,x\na@b.cd,5551234567,1\n")
    row = integrate(spark, str(tmp_path), attributes=["email", " email "]).customers.first()
    assert (row.email, row.phone, row.extra_fields) == ("a@b.cd", None, None)


def rows_of(spark, folder):
    rows, errors = extract(spark, str(folder))
    found = {}
    for r in rows.collect():
        found.setdefault(r._file.rsplit("/", 1)[-1], []).append((r._source_row, r.raw))
    return {k: [raw for _, raw in sorted(v, key=lambda x: x[0])] for k, v in found.items()}, {
        (e._file.rsplit("/", 1)[-1], e.error) for e in errors.collect()}


def test_json_of_every_layout(spark, tmp_path):
    people = [{"email": f"p{n}@x.com", "address": {"city": "Rome", "geo": {"lat": n + 0.5}}, "tags": ["a", n], "on": True} for n in range(50)]
    (tmp_path / "pretty.json").write_text(json.dumps(people, indent=2))
    (tmp_path / "wrapped.json").write_text(json.dumps({"meta": {"n": 1}, "names": ["x"], "z": people[:2], "a": people}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(p) for p in people[:3]) + "\nno json\n[1]\n")
    (tmp_path / "clash.json").write_text('{"a": {"b": 1}, "a__b": 2, "mobile": "1", "cell": "2", "mobile": "3"}')
    (tmp_path / "deep.json").write_text('{"a":' * 200_000 + "1" + "}" * 200_000)
    (tmp_path / "broken.json").write_text('[{"a": 1}, {"b": ')
    (tmp_path / "late.json").write_text('{"data": [{"a": 1}], "x" }')
    (tmp_path / "number.json").write_text("17")
    found, errors = rows_of(spark, tmp_path)
    assert len(found["pretty.json"]) == 50 and len(found["wrapped.json"]) == 2
    assert found["pretty.json"][3] == {
        "email": "p3@x.com", "address__city": "Rome", "address__geo__lat": "3.5", "tags": '["a",3]', "on": "true"}
    assert len(found["lines.json"]) == 3
    assert list(found["clash.json"][0].items()) == [("a__b", "2"), ("mobile", "3"), ("cell", "2")]
    assert errors == {
        ("lines.json", "Line 4: JSON parse error"), ("lines.json", "Row 4: expected object, got list — skipped"),
        ("deep.json", "JSON parse error: nested too deeply"), ("broken.json", "JSON parse error"), ("late.json", "JSON parse error"),
        ("number.json", "Unexpected top-level JSON type: int")}
    (tmp_path / "nested.json").write_text('{"a":' * 500 + "1" + "}" * 500)
    assert rows_of(spark, tmp_path)[0]["nested.json"] == [{"__".join("a" * 500): "1"}]


def test_xml_records_are_the_children_of_the_root(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<r xmlns="u:n"><grp><c>n</c></grp><c id="7">a<d e="f"> g </d></c><c><d/><h>1</h><h>2</h></c></r>')
    found, errors = rows_of(spark, tmp_path)
    assert found == {"a.xml": [{"@id": "7", "d@e": "f", "d": "g"}, {"h": "2"}]} and not errors


def test_damaged_and_odd_files_stop_nothing(spark, tmp_path):
    (tmp_path / "case.csv").write_text("Email,email,_id\na@b.cd,c@d.ef,9\n")
    book = spark.createDataFrame([("dan@x.com", 5)], "Email string, points int")
    export.write_xlsx(book.coalesce(1), str(tmp_path / "out"))
    source = next((tmp_path / "out").glob("*.xlsx"))
    (tmp_path / "UPPER.XLSX").write_bytes(source.read_bytes())
    with zipfile.ZipFile(source) as old, zipfile.ZipFile(tmp_path / "bad.xlsx", "w") as new:
        for name in old.namelist():
            data = old.read(name)
            new.writestr(name, data[: len(data) // 2] if "sheet" in name and "rels" not in name else data)
    (tmp_path / "cut.xlsx").write_bytes(source.read_bytes()[:200])
    source.unlink()
    found, errors = rows_of(spark, tmp_path)
    assert found["case.csv"] == [{"Email": "a@b.cd", "email": "c@d.ef", "_id": "9"}]
    assert found["UPPER.XLSX"] == [{"Email": "dan@x.com", "points": "5"}]
    assert {name for name, _ in errors} == {"bad.xlsx", "cut.xlsx"}
    row = integrate(spark, str(tmp_path)).customers.where("email = 'c@d.ef'").first()
    assert row.extra_fields == {"_id": "9"}


def test_cut_values_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"email,city\na@b.cd,{'x' * 300}\n")
    run = integrate(spark, str(tmp_path))
    assert len(run.customers.first().city) == 100
    issue = run.issues.where("error_code = 'VALUE_TRUNCATED'").first()
    assert (issue.field_name, issue.error_message, issue.severity) == ("city", "Truncated to 100 chars", "warning")


def test_large_json_is_read_whole(spark, tmp_path):
    """Beyond the size of one variant value."""
    with open(tmp_path / "a.json", "w") as out:
        out.write("[\n")
        out.write(",\n".join('{"n": %d, "pad": "%s"}' % (n, "x" * 1_400_000) for n in range(100)))
        out.write("\n]")
    rows, errors = extract(spark, str(tmp_path))
    assert rows.count() == 100 and errors.isEmpty()


def test_files_too_large_to_be_read_whole_stop_no_others(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"email": f"p{n}@x.com"} for n in range(100)]))
    (tmp_path / "b.json").write_text('[{"email": "b@x.com"}]')
    (tmp_path / "c.xml").write_text("<r>" + "<c><email>c@x.com</email></c>" * 50 + "</r>")
    (tmp_path / "d.csv").write_text("email\n" + "d@x.com\n" * 200)
    key = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        found, errors = rows_of(spark, tmp_path)
    finally:
        spark.conf.set(key, before)
    assert {name: len(rows) for name, rows in found.items()} == {"b.json": 1, "d.csv": 200}
    assert {(name, error.split(" (")[0]) for name, error in errors} == {
        ("a.json", "File too large to be read whole"), ("c.xml", "File too large to be read whole")}


def test_csv_line_breaks_as_asked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("email,phone\na@x.com,1\nb@x.com,2\n")
    for multi_line in (True, False):
        rows, errors = extract(spark, str(tmp_path), multi_line=multi_line)
        assert sorted(r.raw["email"] for r in rows.collect()) == ["a@x.com", "b@x.com"] and errors.count() == 0
    assert integrate(spark, str(tmp_path), multi_line=False).raw.count() == 2


def test_names_of_any_characters(spark, tmp_path):
    for name in ("my contacts", "list[1]", "list{1}", "100%", "a%20b", "é?*", "a+b"):
        (tmp_path / f"{name}.csv").write_text("email\nx@x.com\n")
        (tmp_path / f"{name}.JSON").write_text('[{"email": "x@x.com"}]')
        (tmp_path / f"{name}.xml").write_text("<r><c><email>x@x.com</email></c></r>")
        (tmp_path / f"{name}.ndjson").write_text('{"email": "x@x.com"}')
    (tmp_path / "_contacts.csv").write_text("email\nx@x.com\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / ".x.json").write_text("[]")
    (tmp_path / "_SUCCESS").write_text("")
    rows, errors = extract(spark, str(tmp_path))
    assert rows.where("raw['email'] = 'x@x.com'").count() == rows.count() == 28
    assert {e._file.rsplit("/", 1)[-1] for e in errors.collect()} == {"_contacts.csv", ".x.json"}


def test_values_that_break_readers(spark, tmp_path):
    big = "1" * 5000
    (tmp_path / "a.json").write_text('[{"email": "a\\ud800b", "\\udc00": 1}, {"n": ' + big + "}]")
    (tmp_path / "b.ndjson").write_text('{"email": "\\ud83d"}\n{"n": ' + big + "}\n")
    (tmp_path / "c.xml").write_bytes('<?xml version="1.0" encoding="shift_jis"?><r><c><a>1</a></c></r>'.encode("shift_jis"))
    (tmp_path / "d.xml").write_text('<?xml version="1.0" encoding="no-such"?><r><c><a>1</a></c></r>')
    (tmp_path / "e.csv").write_text("email\nok@x.com\n")
    found, errors = rows_of(spark, tmp_path)
    assert found["a.json"] == [{"email": "a�b", "�": "1"}, {"n": big}]
    assert found["b.ndjson"] == [{"email": "�"}, {"n": big}] and found["e.csv"] == [{"email": "ok@x.com"}]
    assert "d.xml" in {name for name, _ in errors} and {name for name, _ in errors} <= {"c.xml", "d.xml"}


def test_numbers_of_many_files(spark):
    sizes = spark.range(70_000).selectExpr("format_string('f%06d', id) AS _file", "id % 7 + 2 AS top")
    first = number_files(sizes.where("_file >= 'f000100'"))
    ids = {r._file: (r.file_id, r.ranges) for r in number_files(sizes.withColumn("top", F.expr("top + 1")), first).collect()}
    before = {r._file: (r.file_id, r.ranges) for r in first.collect()}
    assert len(ids) == 70_000 and all(ids[f][0] == n and ids[f][1][: len(r)] == r for f, (n, r) in before.items())
    assert sorted(n for n, _ in ids.values()) == list(range(1, 70_001))
    ranges = sorted((r.low, r["size"]) for _, found in ids.values() for r in found)
    assert all(a + n <= b for (a, n), (b, _) in zip(ranges, ranges[1:], strict=False))
    assert sum(n for _, n in ranges) == sum(i % 7 + 4 for i in range(70_000))


def test_rows_of_a_small_batch_are_cleaned_by_all_cores(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = "".join(f"u{n}@x.com,Ann,Lee\n" for n in range(2000))
    (folder / "a.csv").write_text("email,fname,surname\n" + lines)
    run = integrate(spark, str(folder))
    assert run.raw.rdd.getNumPartitions() == 1
    tasks = run.checked.groupBy(F.input_file_name()).count().collect()
    assert len(tasks) == spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in tasks) < 500 and run.checked.count() == 2000


def test_names_are_found_as_in_a_map_of_aliases(spark):
    config = Config(aliases={"email": ["E-Mail", "mail"], "city": ["Town"]})
    made = ["'MAIL','a','x','b','TOWN',null", "'mail','a','E-mail','b','Ä','c'", "", None, "'email','a','Mail',null"]
    raws = [f"cast({'null' if m is None else f'map({m})'} as map<string,string>)" for m in made]
    rows = spark.createDataFrame([(n,) for n in range(5)], "n int").coalesce(1).selectExpr(f"element_at(array({','.join(raws)}), n + 1) as raw")
    found = [r.mapped for r in schema.map_open_rows(rows, config=config).collect()]
    assert found == [{"email": "a", "x": "b", "city": None}, {"email": "b", "Ä": "c"}, {}, None, {"email": None}]
    same = schema.map_open_rows(rows, config=Config(aliases={})).selectExpr("to_json(raw) AS a", "to_json(mapped) AS b").collect()
    assert all(r.a == r.b for r in same)


def test_tables_stay_where_they_are_asked_for(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("email,fname\na@x.com,Ann\na@x.com,Bob\n")
    extracted, errors = extract(spark, str(folder))
    run = prepare(spark, extracted, errors, 1, kept=lambda name: f"{tmp_path}/kept/{name}")
    for name in ("raw", "checked", "within"):
        assert spark.read.parquet(f"{tmp_path}/kept/{name}").count() == getattr(run, name).count() == 2
