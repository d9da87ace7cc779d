"""Matching, clustering and survivorship against one-record-at-a-time rules, also with
every key treated as hot and with no ordered finish."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import rules
from contactloom.config import BATCH_MATCH_KEYS, DEFAULT, FILE_MATCH_KEYS, GOLDEN_FIELDS
from contactloom.operators import batch, components, matching
from contactloom.operators.survivorship import golden_fold, golden_most_complete, merge_maps
from contactloom.plans import entities, inputs
from pyspark.sql import functions as F

FIELDS = ["email", "phone", "full_name", "first_name", "last_name", "postal_code"]
SCHEMA = "rid long, " + ", ".join(f"{f} string" for f in FIELDS)


def random_records(seed, n=120, values=9):
    rng = random.Random(seed)
    def one(field):
        return None if rng.random() < 0.35 else f"{field}{rng.randrange(values)}"
    return [{"rid": i, **{f: one(f) for f in FIELDS}} for i in rng.sample(range(10 * n), n)]


def frame(spark, records):
    return spark.createDataFrame([tuple(r[c] for c in ["rid", *FIELDS]) for r in records], SCHEMA)


@pytest.mark.parametrize("seed, hot, rest", [(1, None, 50_000), (2, None, 0), (3, 1, 0), (4, 1, 40)])
def test_first_seen(spark, seed, hot, rest):
    records = random_records(seed)
    got = matching.first_seen(frame(spark, records), FILE_MATCH_KEYS, min_hot_rows=hot, ordered_rest=rest).collect()
    assert {r.rid: (r.primary_id, r.key_set) for r in got} == rules.first_seen(records, FILE_MATCH_KEYS)


def test_first_seen_long_chain(spark):
    """Each record shares a key with the next only: rounds, then the ordered finish."""
    records = [
        {"rid": i, "email": f"e{i // 2}", "phone": f"p{(i + 1) // 2}", "full_name": "x", "first_name": None,
         "last_name": None, "postal_code": None} for i in range(300)
    ]
    got = matching.first_seen(frame(spark, records), FILE_MATCH_KEYS, ordered_rest=560).collect()
    assert {r.rid: (r.primary_id, r.key_set) for r in got} == rules.first_seen(records, FILE_MATCH_KEYS)


def test_first_seen_hot_key(spark):
    """A third of the records share an e-mail, with copies among them."""
    records = random_records(5, 300, 60)
    for r in records[:100]:
        r.update(email="hot", phone=None)
    got = matching.first_seen(frame(spark, records), FILE_MATCH_KEYS, min_hot_rows=5, ordered_rest=0).collect()
    assert {r.rid: (r.primary_id, r.key_set) for r in got} == rules.first_seen(records, FILE_MATCH_KEYS)


@pytest.mark.parametrize("hot", [None, 1])
def test_first_seen_repeated_ids(spark, hot):
    """Rows of one id with different keys, and one without an id: the rounds end, rows decide one by one."""
    rows = [(1, "a", "x"), (1, "b", None), (1, "b", None), (2, "b", "y"), (3, "c", "y"), (3, None, "x"), (4, "c", None), (None, "c", "x")]
    df = spark.createDataFrame(rows, "rid long, email string, phone string")
    got = matching.first_seen(df, (("email",), ("phone",)), min_hot_rows=hot).collect()
    assert sorted((r.rid or 0, r.primary_id or 0, r.key_set) for r in got) == [
        (0, 0, None), (1, 1, None), (1, 1, None), (1, 1, None), (2, 1, 0), (3, 1, 1), (3, 1, 1), (4, 3, 0)]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), partitions=st.integers(1, 5))
def test_first_seen_any_partitioning(spark, seed, partitions):
    records = random_records(seed, 60, 12)
    df = frame(spark, records).repartition(partitions)
    got = matching.first_seen(df, FILE_MATCH_KEYS, ordered_rest=0).collect()
    assert {r.rid: (r.primary_id, r.key_set) for r in got} == rules.first_seen(records, FILE_MATCH_KEYS)


@pytest.mark.parametrize("seed, hot", [(1, None), (2, 1)])
def test_components(spark, seed, hot):
    records = random_records(seed, 150, 60)
    got = components.cluster_transitively(frame(spark, records), FILE_MATCH_KEYS, min_hot_rows=hot).collect()
    assert {r.rid: r.primary_id for r in got} == rules.components(records, FILE_MATCH_KEYS)


def test_components_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")
    got = components.connected_components(links).collect()
    assert len(got) == 401 and {r.root for r in got} == {0}


@pytest.mark.parametrize("hot", [None, 1])
def test_chain_roots(spark, hot):
    parents = spark.createDataFrame([(i, i - 1 if i % 50 else None) for i in range(200)], "id long, merged_into_id long")
    got = components.chain_roots(parents, min_hot_rows=hot).collect()
    assert {r.id: r.root for r in got} == {i: i - i % 50 for i in range(200)}


@pytest.mark.parametrize("seed, hot, ranking", [(1, None, FIELDS), (2, 1, FIELDS), (3, None, FIELDS[:3])])
def test_golden_fold(spark, seed, hot, ranking):
    records = random_records(seed, 200, 1000)
    for r in records:
        r["primary_id"] = r["rid"] % 9
    df = spark.createDataFrame([(r["primary_id"], *[r[c] for c in ["rid", *FIELDS]]) for r in records], "primary_id long, " + SCHEMA)
    got = {r.primary_id: r for r in golden_fold(df, FIELDS, ranking, min_hot_rows=hot).collect()}
    for cluster in range(9):
        members = [r for r in records if r["primary_id"] == cluster]
        base, values = rules.fold(members, FIELDS, ranking)
        assert got[cluster].base_id == base
        assert {f: got[cluster][f] for f in FIELDS} == values
        assert got[cluster].source_count == len(members)


def test_most_complete(spark):
    df = spark.createDataFrame(
        [(1, 1, None, "p1"), (1, 2, "e2", "p2"), (1, 3, "e3", None)], "primary_id long, rid long, email string, phone string"
    )
    row = golden_most_complete(df, ["email", "phone"]).first()
    assert (row.base_id, row.email, row.phone, row.source_count) == (2, "e2", "p2", 3)


def test_merge_by_email_fills_phone(spark):
    records = [
        {"rid": 2, "email": "a@x.com", "phone": None, "full_name": "A", "first_name": None, "last_name": None, "postal_code": None},
        {"rid": 3, "email": "a@x.com", "phone": "5551234567", "full_name": None, "first_name": None, "last_name": None, "postal_code": None},
    ]
    df = frame(spark, records)
    members = df.join(matching.first_seen(df, FILE_MATCH_KEYS).select("rid", "primary_id"), "rid")
    row = golden_fold(members, FIELDS).first()
    assert (row.email, row.phone, row.full_name, row.source_count) == ("a@x.com", "5551234567", "A", 2)


def test_merge_by_name_and_postal_code(spark):
    records = [
        {"rid": 1, "email": "a@x.com", "phone": None, "full_name": None, "first_name": "Ann", "last_name": "Lee", "postal_code": "01234"},
        {"rid": 2, "email": None, "phone": None, "full_name": None, "first_name": "ann", "last_name": "LEE", "postal_code": "01234"},
    ]
    got = matching.first_seen(frame(spark, records), FILE_MATCH_KEYS).collect()
    assert {r.rid: r.primary_id for r in got} == {1: 1, 2: 1}


def test_empty_input(spark):
    assert matching.first_seen(frame(spark, []), FILE_MATCH_KEYS).count() == 0
    assert components.cluster_transitively(frame(spark, []), FILE_MATCH_KEYS).count() == 0


def test_maps(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS d, map('b', '3') AS p")
    assert df.select(merge_maps(F.col("d"), F.col("p")).alias("m")).first().m == {"a": "1", "b": "3"}


# --- merging across files ---

CUSTOMER = "id long, batch_id int, source_count long, extra_fields map<string,string>, email string, phone string, full_name string, city string"


def test_merge_batch_keeps_the_more_complete(spark):
    df = spark.createDataFrame([
        (1, 1, 2, {"a": "1"}, "x@y.z", None, None, None),
        (2, 1, 1, {"a": "2", "b": "3"}, "x@y.z", "555", "Ann Lee", "Rome"),
        (3, 2, 1, {}, "x@y.z", None, None, None),
    ], CUSTOMER)
    got = {r.id: r for r in batch.merge_batch(df).collect()}
    assert got[2].is_duplicate is False and got[2].source_count == 3
    assert got[2].extra_fields == {"a": "2", "b": "3"}
    assert got[1].is_duplicate and got[1].merged_into_id == 2
    assert got[3].is_duplicate is False and got[3].source_count == 1


def test_merge_batch_closure_finds_assembled_keys(spark):
    """Records 1 and 2 together have the name and city of record 3."""
    df = spark.createDataFrame([
        (1, 1, 1, None, "x@y.z", None, "Ann Lee", None),
        (2, 1, 1, None, "x@y.z", None, None, "Rome"),
        (3, 1, 1, None, None, None, "ann lee", "rome"),
    ], CUSTOMER)
    plain = {r.id: r for r in batch.merge_batch(df).collect()}
    assert [plain[n].merged_into_id for n in (1, 2, 3)] == [None, 1, None]
    closed = {r.id: r for r in batch.merge_batch(df, closure=True).collect()}
    assert [closed[n].merged_into_id for n in (1, 2, 3)] == [None, 1, 1]
    assert closed[1].source_count == 3


def test_batch_invariants(spark, sf_dir):
    customers = entities.file_customers(spark, sf_dir)
    for closure in (False, True):
        merged = batch.merge_batch(customers, closure=closure).cache()
        kept = merged.where("NOT is_duplicate")
        assert merged.count() == customers.count()
        assert kept.agg(F.sum("source_count")).first()[0] == inputs.valid(spark, sf_dir).count()
        dangling = merged.where("is_duplicate").join(
            kept.select(F.col("id").alias("merged_into_id")), "merged_into_id", "left_anti")
        assert dangling.count() == 0
        if closure:
            shared = matching.match_keys(kept, BATCH_MATCH_KEYS, ["batch_id"], "id").groupBy("key_set", "key").count()
            assert shared.where("count > 1").count() == 0


def test_fixture_numbers(spark, sf_dir):
    if not sf_dir.endswith("sf0.001"):
        pytest.skip("numbers of sf0.001")
    valid = inputs.valid(spark, sf_dir)
    found = matching.first_seen(valid, DEFAULT.file_match_keys, record_id="source_row")
    assert found.where("rid = primary_id").count() == 176
    assert found.groupBy("primary_id").count().agg(F.max("count")).first()[0] == 16
    linked = components.cluster_transitively(valid, DEFAULT.file_match_keys, record_id="source_row")
    assert linked.select("primary_id").distinct().count() == 164
    assert entities.file_customers(spark, sf_dir).count() == 654
    assert set(GOLDEN_FIELDS) <= set(batch.with_golden_fields(valid).columns)


def test_fixture_duplicates_per_file(spark):
    import __spark_entry__ as entry

    report = entry.queries()["quality_report_full"](spark, "/root/testdata/sf0.01").collect()
    got = {r.upload_file_id: (r.valid_rows, r.duplicate_rows, r.missing_fields_count, r.missing_pct, r.uniqueness_score) for r in report}
    assert got == {
        1: (2790, 1535, 9647, 31.43, 48.83), 2: (2790, 1338, 12437, 40.52, 55.40), 3: (2791, 1528, 9651, 31.44, 49.07),
        4: (2790, 1520, 9647, 31.43, 49.33), 5: (2790, 1525, 9647, 31.43, 49.17),
    }


def test_hot_keys_that_find_nothing_are_not_shuffled(spark):
    from contactloom.operators.lookup import lookup_join

    big = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 1 ELSE id END AS k", "id AS v").repartition(4)
    counts = big.groupBy("k").count().withColumnRenamed("count", "n")
    per_key = counts.where("k != 1 AND k % 2 = 0").selectExpr("k", "n", "k * 10 AS w")
    joined = lookup_join(big, per_key, ["k"], "n", min_hot_rows=100, counts=counts)
    assert sorted((r.k, r.w) for r in joined.collect()) == [(k, k * 10) for k in range(2000, 3000, 2)]
    left = lookup_join(big, per_key, ["k"], "n", "left", min_hot_rows=100, counts=counts)
    assert left.count() == 3000 and left.where("k = 1 AND w IS NULL").count() == 2000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "strategy=broadcast" in plan
