"""Delimited files of odd names, encodings and layouts, cut into many splits."""

import csv
import io
import random

import pytest

from contactloom.sources import delimited
from contactloom.sources.delimited import ends_inside, read_delimited, steadiest


def name(file):
    return file.rsplit("/", 1)[-1]


def found(spark, folder):
    rows, errors = read_delimited(spark, str(folder))
    out = {}
    for r in rows.collect():
        out.setdefault(name(r._file), []).append((r._source_row, r.raw))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}, {(name(e._file), e.error) for e in errors.collect()}


def plain(content, sep):
    """What Python's own reader makes of it."""
    rows = [r for r in csv.reader(io.StringIO(content.lstrip("﻿"), newline=""), delimiter=sep) if r]
    names = [n.strip() for n in rows[0]]
    out = []
    for number, cells in enumerate(rows[1:], 2):
        raw = {n: None for n in names}
        raw |= {n: (c.strip() or None) for n, c in zip(names, cells, strict=False)}
        if any(v is not None for v in raw.values()):
            out.append((number, raw))
    return out


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1200")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_breaks_over_many_splits(spark, tmp_path, small_splits):
    pick = random.Random(4)
    want = {}
    for n in range(4):
        sep = ",;\t|"[n]
        made = io.StringIO(newline="")
        writer = csv.writer(made, delimiter=sep, lineterminator="\r\n" if n % 2 else "\n")
        writer.writerow(["id", "first\nname", "note", "id2"])
        for i in range(60):
            note = "".join(pick.choice(['a', '"', '\n', sep, ' ', 'é', '\n\n', 'long text ' * 6]) for _ in range(pick.randint(0, 9)))
            writer.writerow([i, f"x{i}", note, pick.choice(['5" pipe', "", "y"])])
        content = made.getvalue()
        (tmp_path / f"my file [{n}] 100%{{a}}.csv").write_bytes(content.encode())
        want[f"my%20file%20%5B{n}%5D%20100%25%7Ba%7D.csv"] = plain(content, sep)
    have, errors = found(spark, tmp_path)
    assert have == want and not errors


def test_stray_quotes(spark, tmp_path, small_splits):
    content = 'id,size,note\n1,5" pipe,"a, b"\n2,6",x\n3,"q"t,"two\nlines"\n\n4,"","""z"""\n'
    (tmp_path / "stray.csv").write_text(content)
    have, _ = found(spark, tmp_path)
    assert have["stray.csv"] == plain(content, ",")


def test_encodings(spark, tmp_path):
    content = "naïve,b\nÄ,1\n\"x\ny\",2\n"
    for label, encoding in (("le", "utf-16-le"), ("be", "utf-16-be"), ("mark", "utf-16"), ("latin", "latin-1"), ("u8", "utf-8-sig")):
        (tmp_path / f"{label}.csv").write_bytes(content.encode(encoding))
    have, errors = found(spark, tmp_path)
    assert have == dict.fromkeys(["le.csv", "be.csv", "mark.csv", "latin.csv", "u8.csv"], plain(content, ",")) and not errors


def test_long_header_and_open_quote(spark, tmp_path, monkeypatch):
    wide = ",".join(f"column number {n}" for n in range(12_000))
    (tmp_path / "wide.csv").write_text(wide + "\n" + ",".join(str(n) for n in range(12_000)) + "\n")
    (tmp_path / "open.csv").write_text('a,b\n1,2\n3,"never closed\n' + "more\n" * 500)
    monkeypatch.setattr(delimited, "MAX_RECORD", 1000)
    have, errors = found(spark, tmp_path)
    assert len(have["wide.csv"][0][1]) == 12_000 and have["wide.csv"][0][1]["column number 11999"] == "11999"
    assert have["open.csv"] == [(2, {"a": "1", "b": "2"})]
    assert [n for n, e in errors] == ["open.csv"]


def test_repeated_names_and_extra_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a, A ,a\n1,2,3\n4,5,6,7\n , ,\n8\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("only,header\n")
    have, errors = found(spark, tmp_path)
    assert have == {"a.csv": [(2, {"a": "3", "A": "2"}), (3, {"a": "6", "A": "5"})]}
    assert {n for n, _ in errors} == {"a.csv"}


def test_delimiters():
    assert steadiest("email\na@x.com\nb,c@x.com\n") == ","
    assert steadiest("a;b\n1,5;2,5\n3,5;4\n") == ";"
    assert steadiest('a|b\n"x|y, z|w";"q"|2\n1|2\n') == "|"
    assert steadiest("a\tb, c\n1\t2\n3\t4\n") == "\t"
    assert steadiest("") == ","


def test_line_functions():
    cases = {'a,b': (False, True), 'a,"b': (True, False), '"': (True, False), 'x"y,z': (False, False), '""': (False, True), '"""': (True, False)}
    for line, (out, inside) in cases.items():
        assert (ends_inside(line, ",", False), ends_inside(line, ",", True)) == (out, inside), line


def test_lines_of_quoted_files_are_stored_once(spark, tmp_path, monkeypatch):
    """Where records begin is found in the shuffle that composes the lines' functions: no second copy of all lines."""
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    written, store = [], delimited.stage
    monkeypatch.setattr(delimited, "stage", lambda df, name: written.append((name, "value" in df.columns)) or store(df, name))
    rows, _ = delimited.read_delimited(spark, str(tmp_path))
    assert sorted((r.raw["a"], r.raw["b"]) for r in rows.collect()) == [("1", "x\ny"), ("2", "z")]
    assert [name for name, lines in written if lines] == ["lines", "plain", "quotes", "found"]


def test_cells_are_made_once_and_errors_from_long_records_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2,3\n , ,4\n5,6\n7, ,8\n")
    rows, errors = read_delimited(spark, str(tmp_path))
    assert sorted(tuple(r.raw.values()) for r in rows.collect()) == [("1", "2"), ("5", "6"), ("7", None)]
    assert [e.error[:8] for e in errors.collect()] == ["2 row(s)"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("map_from_arrays") == 1


def test_quoted_lines_that_end_outside_are_records(spark, tmp_path, monkeypatch):
    """Quotes alone do not make a file one of records over line breaks."""
    (tmp_path / "a.csv").write_text('a,b\n1,"x, ""y"""\r\n"",""\n2,z"q\n')
    (tmp_path / "b.csv").write_text('"a,c";b\n1;"x;y"\n')
    (tmp_path / "c.csv").write_text("a\tb\n3\t4\n")
    monkeypatch.setattr(delimited, "_records", lambda lines: pytest.fail("lines are brought together"))
    have, errors = found(spark, tmp_path)
    assert have == {
        "a.csv": [(2, {"a": "1", "b": 'x, "y"'}), (4, {"a": "2", "b": 'z"q'})], "b.csv": [(2, {"a,c": "1", "b": "x;y"})],
        "c.csv": [(2, {"a": "3", "b": "4"})]} and not errors


def test_files_with_and_without_records_over_line_breaks(spark, tmp_path):
    for name, text in (("a", 'a,b\n1,"x\ny"\n2,z\n'), ("b", 'a,b\n1,"x"\n\n2,z\n'), ("c", 'a,b\n1,"x"\n2,z\n'), ("d", "a,b\n1,x\n2,z\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    have, errors = found(spark, tmp_path)
    rows = [(2, {"a": "1", "b": "x"}), (3, {"a": "2", "b": "z"})]
    assert have == {"a.csv": [(2, {"a": "1", "b": "x\ny"}), (3, rows[1][1])], "b.csv": rows, "c.csv": rows, "d.csv": rows} and not errors
