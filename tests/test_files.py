"""Readers on small files with the known traps."""

import zipfile

import pytest
from pyspark.sql import functions as F

from contactloom.operators import text_fields
from contactloom.sinks import export
from contactloom.sources import files, formats, xlsx


def write(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(path)


def test_csv_hygiene(spark, tmp_path):
    path = write(tmp_path, "a.csv", "﻿ name , email\n  Alice  ,a@x.com\n,,\n\n\"Bob\nLee\",b@x.com,extra\nCy\n")
    rows = files.read_csv(spark, path).orderBy("_source_row").collect()
    assert [(r._source_row, r.name, r.email, r._overflow) for r in rows] == [
        (2, "Alice", "a@x.com", False), (4, "Bob\nLee", "b@x.com", True), (5, "Cy", None, False)]
    report = files.csv_report(files.read_csv(spark, path)).first()
    assert (report.total_rows, report.error) == (3, "1 row(s) had more columns than the header — extras dropped")


def test_csv_folder_of_layouts(spark, tmp_path):
    write(tmp_path, "a.csv", "name;email\nAnn;a@x.com\n")
    write(tmp_path, "b.csv", "email|city\nb@x.com|Rome\n")
    write(tmp_path, "c.csv", "name\temail\nJosé\tc@x.com\n".encode("latin-1"))
    rows = files.read_csv_folder(spark, str(tmp_path)).collect()
    assert {(r.email, r.name, r.city, r._delimiter) for r in rows} == {
        ("a@x.com", "Ann", None, ";"), ("b@x.com", None, "Rome", "|"), ("c@x.com", "José", None, "\t")}
    assert {r._source_row for r in rows} == {2}


def test_ordinals_of_split_files(spark, tmp_path):
    path = write(tmp_path, "big.csv", "n,t\n" + "".join(f"{n},{'x' * 50}\n" for n in range(2, 4002)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.read_csv(spark, path, multi_line=False)
        assert rows.rdd.getNumPartitions() > 1
        assert rows.where(F.col("n").cast("int") != F.col("_source_row")).count() == 0
        assert rows.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, value string")


def test_json_documents(spark):
    docs = documents(spark, '[{"a":1},{"a":2}]', '{"customers":[{"a":3}],"n":1}', '{"a":4,"tags":["x"]}', "{bad", '{"rows": []}')
    items = files.json_items(docs, "id").select("id", "_source_row", F.to_json("item").alias("j")).collect()
    assert sorted((r.id, r._source_row, r.j) for r in items) == [
        (0, 1, '{"a":1}'), (0, 2, '{"a":2}'), (1, 1, '{"a":3}'), (2, 1, '{"a":4,"tags":["x"]}')]
    assert [(r.id, r.error) for r in files.json_errors(docs, "id").collect()] == [(3, "JSON parse error")]


def test_json_flatten(spark):
    items = files.json_items(documents(spark, '[{"address":{"city":"NY","geo":{"x":1}},"l":[1,{"y":2}],"n":null}]'), "id")
    got = {r.path: r.value for r in files.flatten_items(items, ["id"]).collect()}
    assert got == {"address__city": "NY", "address__geo__x": "1", "l": '[1,{"y":2}]', "n": None}


def test_ndjson(spark, tmp_path):
    path = write(tmp_path, "a.ndjson", '{"a":1}\n\n{bad\n5\n{"a":2}\n')
    rows, errors = files.read_ndjson(spark, path, "a int")
    assert sorted((r._source_row, r.a) for r in rows.collect()) == [(1, 1), (3, 2)]
    assert sorted(r.error for r in errors.collect()) == ["Line 3: JSON parse error", "Row 2: expected object, got int — skipped"]


def test_xml(spark, tmp_path):
    good = '<r xmlns="urn:x"><c id="7"><name> Ann </name><a k="1"><b>x</b></a><t>1</t><t>2</t></c><c><name>Bo</name></c><o/></r>'
    write(tmp_path, "a.xml", good)
    children = files.xml_children(spark.read.format("binaryFile").load(str(tmp_path)).withColumnRenamed("path", "_file"))
    assert files.xml_record_tags(children).first().record_tag == "c"
    kind = "`@id` string, name string, a struct<`@k`:string, b:string>, t array<string>"
    rows = files.flatten(files.read_xml(spark, str(tmp_path), "c", kind)).collect()
    assert rows[0].asDict() == {"@id": "7", "name": "Ann", "a@k": "1", "a__b": "x", "t": "2"}
    assert rows[1].name == "Bo"


def test_bad_xml(spark, tmp_path):
    write(tmp_path, "bad.xml", "<r><c>")
    write(tmp_path, "empty.xml", "<r/>")
    children = files.xml_children(spark.read.format("binaryFile").load(str(tmp_path)).withColumnRenamed("path", "_file")).collect()
    assert sorted(c.error[:15] for c in children) == ["Could not detec", "XML parse error"]


def test_xml_folder(spark, tmp_path):
    write(tmp_path, "a.xml", "<r><o/><c><n>1</n></c><o/><c><n>2</n></c><c><n>3</n></c></r>")
    write(tmp_path, "b.xml", "<r><c><n>8</n></c><c>")
    write(tmp_path, "d.xml", "<r><p><n>9</n></p></r>")
    records, errors = files.read_xml_folder(spark, str(tmp_path))
    assert sorted((r._source_row, r.n) for r in records["c"].collect()) == [(2, "1"), (4, "2"), (5, "3")]
    assert [(r._source_row, r.n) for r in records["p"].collect()] == [(1, "9")]
    assert [e._file.rsplit("/", 1)[-1] for e in errors.collect()] == ["b.xml"]


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & <b>", 2.5, True, None), (2, None, None, False, "z")], "id int, s string, d double, b boolean, x string")
    export.write_xlsx(df.coalesce(1).select("*"), str(tmp_path / "out"))
    rows = xlsx.read_xlsx(spark, str(tmp_path / "out")).orderBy("_file", "_source_row").collect()
    assert sorted((r._source_sheet, tuple(sorted(r.raw.items(), key=str))) for r in rows) == sorted([
        ("Customers", tuple(sorted({"id": "1", "s": "a & <b>", "d": "2.5", "b": "True", "x": None}.items(), key=str))),
        ("Customers", tuple(sorted({"id": "2", "s": None, "d": None, "b": "False", "x": "z"}.items(), key=str)))])


def test_xlsx_dates_and_headers(spark, tmp_path):
    from contactloom.sinks.xlsx import PARTS

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = (f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t> when </t></is></c></row>'
             '<row r="2"/><row r="4"><c r="A4"><v>7</v></c><c r="C4" s="1"><v>45322.5</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as book:
        for name, content in PARTS.items():
            book.writestr(name, content)
        book.writestr("xl/worksheets/sheet1.xml", sheet)
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rows = xlsx.read_xlsx(spark, str(tmp_path)).collect()
    good = [r for r in rows if r.error is None]
    assert [(r._source_row, r.raw) for r in good] == [(4, {"name": "7", "col_1": None, "when": "2024-01-31 12:00:00"})]
    assert len(rows) == 2 and [r.error for r in rows if r.error][0].startswith("Cannot open workbook")


@pytest.mark.parametrize("path, kind", [
    ("a/B.CSV", "csv"), ("x.ndjson", "json"), ("x.xls", None), ("noext", None), ("/d.csv/x", None), (".csv", None)])
def test_format(spark, path, kind):
    row = spark.range(1).select(formats.stored_format(F.lit(path)).alias("f"), formats.format_error(F.lit(path)).alias("e")).first()
    assert row.f == kind and (row.e is None) == (kind is not None)
    if path.endswith(".xls"):
        assert "legacy .xls is not supported" in row.e


def test_admission(spark):
    df = spark.createDataFrame([(1, "../a.csv", 10), (1, "b.csv", 0), (1, "..", 5), (2, "c.csv", 60 << 20), (3, "d.exe", 1)],
                               "batch_id int, path string, length long")
    got = {r.name: r.reason for r in formats.admission(df).collect()}
    assert got["a.csv"] is None and got["b.csv"] == "Uploaded file is empty." and got[".."] == "Invalid or missing filename."
    assert got["c.csv"].startswith("File too large") and got["d.exe"].startswith("Unsupported")
    crowded = {r.name: r.reason for r in formats.admission(df, per_batch=2).collect()}
    assert crowded["a.csv"] == "A batch may hold at most 2 files."


def test_labels_and_fields(spark):
    page = "Name: John Doe\nEmail: old\nPhone = x\nName: Jane\nwrite to j.d@example.com or +1 (555) 123-4567, 12345-6789"
    df = spark.createDataFrame([(1, page)], "id int, text string")
    got = {r.label: r.value for r in text_fields.text_records(df, ["id"]).collect()}
    assert got == {"name": "Jane", "email": "j.d@example.com", "phone": "+1 (555) 123-4567", "postal_code": "12345-6789"}


def test_grid(spark):
    df = spark.sql("SELECT 1 AS id, array(array(' A ', NULL, 'A'), array('1'), array(' ', NULL), array('2', '3', '4', '5')) AS grid")
    rows = text_fields.grid_rows(df, ["id"]).orderBy("row_no").collect()
    assert [(r.row_no, r.row) for r in rows] == [(1, {"col_1": None, "A": None}), (2, {"col_1": "3", "A": "4"})]


def test_scanned_pages(spark):
    df = spark.createDataFrame([(1, 1, False, " "), (1, 2, None, None), (2, 1, True, None), (2, 2, False, "x")],
                               "doc int, page_no int, has_table boolean, text string")
    got = {r.doc: (r.table_pages, r.text_pages, r.empty_pages, r.is_scanned) for r in text_fields.page_kinds(df, "doc").collect()}
    assert got == {1: (0, 0, 2, True), 2: (1, 1, 0, False)}
