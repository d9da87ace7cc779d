"""Cleaning and rules, value by value."""

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from contactloom.config import Config
from contactloom.functions import text
from contactloom.operators import quality, schema
from contactloom.operators.transform import (
    invalid_rows, issue_counts, issue_rows, transform_rows, valid_rows, with_issues,
)


def column(spark, values):
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")


def apply(spark, values, fn):
    rows = column(spark, values).select("n", fn(F.col("v")).alias("o")).orderBy("n").collect()
    return [r.o for r in rows]


def test_strip_knows_all_white_space(spark):
    spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    assert apply(spark, [f"{s}a b{s}" for s in spaces], text.strip) == ["a b"] * len(spaces)
    assert apply(spark, spaces + ["", "x"], text.blank) == [True] * (len(spaces) + 1) + [False]
    assert apply(spark, [None], text.blank) == [True]


def test_title(spark):
    names = ["o'neil", "mary-jane", "3rd street", "ALICE SMITH", "jean  luc", "éric", "ÀÉ-çx", "x2y", "ǆabc", "中a", "a­b"]
    assert apply(spark, names, text.title) == [n.title() for n in names]


@pytest.mark.parametrize("value, expected", [
    ("ALICE SMITH", "Alice Smith"), ("alice smith", "Alice Smith"), ("McDonald", "McDonald"), ("  bob\x07 ", "Bob"),
    ("éric", "Éric"), ("123", "123"), ("\x01", None), (None, None), ("O'NEIL", "O'Neil"),
])
def test_name(spark, value, expected):
    assert apply(spark, [value], text.name) == [expected]


def test_composition_misses_nothing(spark):
    """Every code point that composition changes is sent to it, alone and after a letter."""
    changed = [chr(c) for c in range(0x80, sys.maxunicode + 1)
               if not 0xD800 <= c < 0xE000 and (unicodedata.normalize("NFC", chr(c)) != chr(c)
                                                or unicodedata.normalize("NFC", "a" + chr(c)) != "a" + chr(c))]
    assert apply(spark, changed, text.nfc) == [unicodedata.normalize("NFC", c) for c in changed]
    marked = ["a" + c for c in changed] + ["한", "ऩ"]
    assert apply(spark, marked, text.nfc) == [unicodedata.normalize("NFC", c) for c in marked]


@pytest.mark.parametrize("value, expected", [
    ("(555) 123-4567", "5551234567"), ("+1 555+2", "+1555+2"), ("n/a", None), ("٣٤-٥", "٣٤٥"), ("  ", None),
])
def test_phone(spark, value, expected):
    assert apply(spark, [value], text.phone) == [expected]


@pytest.mark.parametrize("value, expected", [
    ("united states", "US"), (" UK ", "GB"), ("Brazil", "BRAZIL"), ("", None), (None, None), ("u.s.a.", "US"),
])
def test_country(spark, value, expected):
    assert apply(spark, [value], text.country) == [expected]


def test_clean(spark):
    values = [" a\x00b ", "\x00", "plain", " x ", "a\x7f\x1f", None]
    assert apply(spark, values, text.clean) == ["ab", None, "plain", "x", "a", None]


def test_random_names(spark):
    rng = random.Random(7)
    letters = "abzAZ éÉß-' 1́ǅς"
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    def expected(v):
        v = unicodedata.normalize("NFC", v).strip()
        v = v.title() if v.isupper() or v.islower() else v
        return v or None
    # Upper-casing sharp s gives two letters in one engine only.
    pairs = [(g, expected(n)) for n, g in zip(names, apply(spark, names, text.name)) if "ß" not in n]
    assert [g for g, _ in pairs] == [w for _, w in pairs]


ROW = "source_row int, upload_file_id int, email string, phone string, first_name string, last_name string, full_name string, city string"


def test_transform_and_rules(spark):
    df = spark.createDataFrame([
        (2, 1, " ALICE@TEST.COM ", "(555) 123-4567", "ALICE", "SMITH", None, "x" * 150),
        (3, 1, "not-an-email", None, "Bob", None, " ", None),
        (4, 1, None, None, None, None, None, " "),
        (5, 2, "b@c.de", "12", "Al", "Ng", "Al Ng", "Rome"),
    ], ROW)
    clean = transform_rows(df, warnings=True)
    first = clean.where("source_row = 2").first()
    assert (first.email, first.phone, first.full_name, len(first.city)) == ("alice@test.com", "5551234567", "Alice Smith", 100)
    assert [w.message for w in first._warnings] == ["Truncated to 100 chars"]
    checked = with_issues(clean.drop("_warnings"))
    assert sorted(r.source_row for r in valid_rows(checked).collect()) == [2, 5]
    bad = {r.source_row: r._validation_errors for r in invalid_rows(checked).collect()}
    assert bad == {3: ["INVALID_EMAIL"], 4: ["EMPTY_ROW"]}
    codes = {(r.source_row, r.field_name, r.error_code, r.severity) for r in issue_rows(checked).collect()}
    assert (5, "phone", "INVALID_PHONE", "warning") in codes and (4, "email", "IMPORTANT_FIELD_MISSING", "warning") in codes
    assert {r.upload_file_id: (r.errors, r.warnings) for r in issue_counts(checked).collect()} == {1: (2, 5), 2: (0, 1)}


def test_required_and_failed_rows(spark):
    df = spark.createDataFrame([(1, 1, "a@b.cd", False), (2, 1, None, True), (3, 1, None, False)],
                               "source_row int, upload_file_id int, email string, _transform_failed boolean")
    checked = with_issues(df, config=Config(required=("email",)))
    got = {r.source_row: r._validation_errors for r in invalid_rows(checked).collect()}
    assert got == {2: ["TRANSFORM_FAILED"], 3: ["EMPTY_ROW", "REQUIRED_FIELD_MISSING"]}


def test_quality_report(spark):
    df = spark.createDataFrame([
        (1, 1, "a@b.cd", None), (2, 1, "a@b.cd", "5551234567"), (3, 1, "bad", None), (4, 2, "x", None),
    ], "source_row int, upload_file_id int, email string, phone string")
    checked = with_issues(df)
    report = quality.quality_report(checked, quality.duplicates_by_key(valid_rows(checked)))
    one, two = sorted(report.collect(), key=lambda r: r.upload_file_id)
    assert (one.total_rows, one.valid_rows, one.duplicate_rows, one.missing_fields_count) == (3, 2, 1, 19)
    assert (one.missing_pct, one.completeness_score, one.uniqueness_score) == (86.36, 13.64, 66.67)
    assert (two.valid_rows, two.missing_pct, two.completeness_score, two.uniqueness_score) == (0, 0.0, 100.0, 100.0)


@pytest.mark.parametrize("values, expected", [
    (["1", "0", "yes"], "boolean"), (["2024-01-31", "31/01/2024", "x"], "date"), (["12", "-7", "1_000"], "integer"),
    (["1.5", "nan", "1e5", ".5"], "float"), (["a", "1.5"], "float"), (["a", "12"], "integer"), (["", None, "  "], "unknown"),
    (["12d", "x"], "string"),
])
def test_infer_type(spark, values, expected):
    df = column(spark, values).select(F.lit("c").alias("column"), F.col("v").alias("value"))
    assert schema.infer_types(df, ["column"]).first().inferred_type == expected


def test_mapping(spark):
    df = spark.sql("SELECT 'a' AS `Email Address`, '1' AS `Phone Number`, 'x' AS custom, CAST(NULL AS STRING) AS email")
    assert schema.map_columns(df).first().asDict() == {"email": None, "phone": "1", "custom": "x"}
    assert schema.map_columns(df, collision="coalesce").first().email == "a"
    raw = spark.sql("SELECT map('Email', 'a', 'Town', 'b', 'email_address', 'c', 'x', 'd') AS raw")
    assert schema.map_open_rows(raw).first().mapped == {"city": "b", "email": "c", "x": "d"}


def test_split_extra(spark):
    df = spark.sql("SELECT 'a' AS email, 'z' AS tier, 1 AS _source_row")
    assert schema.split_extra(df).first().extra_fields == {"tier": "z"}
    assert schema.split_extra(df.drop("tier")).first().extra_fields is None
    with pytest.raises(ValueError):
        schema.requested_attributes([f"a{n}" for n in range(51)])
