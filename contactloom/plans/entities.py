"""Match keys, clusters, golden records and batch merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.config import COMPLETENESS_FIELDS, DEFAULT, GOLDEN_FIELDS, Config
from contactloom.functions import rules
from contactloom.operators import matching
from contactloom.operators.batch import merge_batch, merge_counts, repoint_lineage, with_golden_fields
from contactloom.operators.components import chain_roots, cluster_transitively
from contactloom.operators.survivorship import golden_fold, golden_most_complete, merge_maps
from contactloom.plans import inputs as i
from contactloom.plans.registry import query
from contactloom.session import stage

FOLD_FIELDS = i.DATA_COLUMNS
EMAIL_ONLY = Config(batch_match_keys=(("email",),))


def _key_sql(key_set: int, parts: list[str], source="valid", scope: str = "") -> str:
    key = " || chr(31) || ".join(([f"CAST({scope} AS VARCHAR)"] if scope else []) + [f"lower({p})" for p in parts])
    where = " AND ".join(f"{p} IS NOT NULL" for p in parts)
    return f"SELECT source_row AS rid, {key_set} AS key_set, {key} AS key FROM {source} WHERE {where}"


KEYS_SQL = " UNION ALL ".join(
    _key_sql(n, parts) for n, parts in enumerate([["email"], ["phone", "full_name"], ["first_name", "last_name", "postal_code"]])
)


@query("match_keys", f"{i.WITH_VALID} {KEYS_SQL}")
def match_keys(spark, sf):
    return matching.match_keys(i.valid(spark, sf), DEFAULT.file_match_keys, record_id="source_row")


@query("dedup_first_seen", f"{i.first_seen_sql()} SELECT rid, primary_id, key_set FROM seen")
def dedup_first_seen(spark, sf):
    """Over all valid rows, without file limits."""
    return matching.first_seen(i.valid(spark, sf), DEFAULT.file_match_keys, record_id="source_row")


EMAIL_FIRST_SQL = """SELECT source_row AS rid, CASE WHEN email IS NULL THEN source_row
       ELSE min(source_row) OVER (PARTITION BY email) END AS primary_id FROM valid"""


@query("dedup_email", f"{i.WITH_VALID} {EMAIL_FIRST_SQL}")
def dedup_email(spark, sf):
    return matching.first_of_key(i.valid(spark, sf), F.col("email"), "source_row")


@query("dedup_components", f"""{i.WITH_VALID.replace('WITH', 'WITH RECURSIVE', 1)},
keys AS ({KEYS_SQL}),
star AS (SELECT rid, min(rid) OVER (PARTITION BY key_set, key) AS first_rid FROM keys),
links AS (SELECT rid AS u, first_rid AS v FROM star UNION SELECT first_rid, rid FROM star),
reach(node, other) AS (SELECT source_row, source_row FROM valid
                       UNION SELECT r.node, l.v FROM reach r JOIN links l ON r.other = l.u)
SELECT node AS rid, min(other) AS primary_id FROM reach GROUP BY node""")
def dedup_components(spark, sf):
    return cluster_transitively(i.valid(spark, sf), DEFAULT.file_match_keys, record_id="source_row")


def _email_members(spark, sf):
    rows = stage(i.valid(spark, sf), "valid")
    found = matching.first_of_key(rows, F.col("email"), "source_row")
    return rows.withColumnRenamed("source_row", "rid").join(found, "rid")


def fold_sql(source: str, cluster: str, ranking: list[str], fields: list[str], extra: str = "") -> str:
    """Ordered golden rule over ``source`` with columns ``rid`` and ``cluster``."""
    own = " + ".join(f"({f} IS NULL)::INT" for f in ranking)
    before = " + ".join(
        f"(NOT coalesce(max({f} IS NOT NULL) OVER w, false))::INT" for f in ranking
    )
    values = ", ".join(
        f"coalesce(arg_max({f}, rid) FILTER (replaces AND {f} IS NOT NULL), "
        f"arg_min({f}, rid) FILTER ({f} IS NOT NULL)) AS {f}" for f in fields
    )
    return f"""SELECT {cluster}, max(rid) FILTER (replaces) AS base_id, count(*) AS source_count, {values} {extra}
FROM (SELECT *, ({own}) < ({before}) OR rid = min(rid) OVER (PARTITION BY {cluster}) AS replaces FROM {source}
      WINDOW w AS (PARTITION BY {cluster} ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
GROUP BY {cluster}"""


EMAIL_MEMBERS_SQL = f"members AS (SELECT v.source_row AS rid, v.*, p.primary_id FROM valid v JOIN ({EMAIL_FIRST_SQL}) p ON p.rid = v.source_row)"


@query("golden_fold", f"""{i.WITH_VALID}, {EMAIL_MEMBERS_SQL}
{fold_sql('members', 'primary_id', FOLD_FIELDS, FOLD_FIELDS)}""")
def fold(spark, sf):
    return golden_fold(_email_members(spark, sf), FOLD_FIELDS)


_NULLS = " + ".join(f"({f} IS NULL)::BIGINT" for f in FOLD_FIELDS)


@query("golden_most_complete", f"""{i.WITH_VALID}, {EMAIL_MEMBERS_SQL},
ranked AS (SELECT *, ({_NULLS}) * 1000000000000 + rid AS r FROM members)
SELECT primary_id, arg_min(rid, r) AS base_id, count(*) AS source_count,
       {', '.join(f'arg_min({f}, r) FILTER ({f} IS NOT NULL) AS {f}' for f in FOLD_FIELDS)}
FROM ranked GROUP BY primary_id""")
def most_complete(spark, sf):
    return golden_most_complete(_email_members(spark, sf), FOLD_FIELDS)


@query("duplicate_pairs", f"""{i.WITH_VALID}
SELECT primary_id, rid AS duplicate_id FROM ({EMAIL_FIRST_SQL}) WHERE rid <> primary_id""")
def duplicate_pairs(spark, sf):
    found = matching.first_of_key(i.valid(spark, sf), F.col("email"), "source_row")
    return found.where("rid != primary_id").select("primary_id", F.col("rid").alias("duplicate_id"))


@query("completeness", f"""{i.WITH_CLEAN}
SELECT source_row, {' + '.join(f'({f} IS NOT NULL)::INT' for f in COMPLETENESS_FIELDS if f != 'state')} AS filled,
       {' + '.join(f'({f} IS NULL)::INT' for f in i.DATA_COLUMNS)} AS empty FROM clean""")
def completeness(spark, sf):
    rows = with_golden_fields(i.clean(spark, sf))
    return rows.select(
        "source_row", rules.filled_count(COMPLETENESS_FIELDS).alias("filled"),
        rules.null_count(i.DATA_COLUMNS).alias("empty"),
    )


@query("merge_maps", f"""{i.WITH_VALID}, pairs AS (SELECT primary_id, rid FROM ({EMAIL_FIRST_SQL}) WHERE rid <> primary_id)
SELECT d.source_row AS duplicate_id, p.created_date AS created_date,
       CASE WHEN p.source_row % 2 = 0 THEN p.loyalty_tier ELSE d.loyalty_tier END AS loyalty_tier
FROM pairs JOIN valid p ON p.source_row = primary_id JOIN valid d ON d.source_row = rid""")
def maps(spark, sf):
    rows = stage(i.valid(spark, sf), "valid")
    found = matching.first_of_key(rows, F.col("email"), "source_row").where("rid != primary_id")
    full = F.create_map(F.lit("created_date"), "created_date", F.lit("loyalty_tier"), "loyalty_tier")
    some = F.when(F.col("source_row") % 2 == 0, full).otherwise(F.create_map(F.lit("created_date"), "created_date"))
    dup = found.join(rows.select(F.col("source_row").alias("rid"), full.alias("dup_map")), "rid")
    sizes = found.groupBy("primary_id").agg(F.count("*").alias("n"))
    prim = stage(sizes.join(rows.select(F.col("source_row").alias("primary_id"), some.alias("prim_map")), "primary_id"), "prim")
    pairs = matching.lookup_join(stage(dup, "dup"), prim, ["primary_id"], "n")
    merged = merge_maps(F.col("dup_map"), F.col("prim_map"))
    return pairs.select(F.col("rid").alias("duplicate_id"), merged.alias("m")).select(
        "duplicate_id", F.col("m")["created_date"].alias("created_date"), F.col("m")["loyalty_tier"].alias("loyalty_tier")
    )


# --- merging across files -------------------------------------------------------------------------

def email_customers(spark, sf):
    """Valid rows as customers of the batch of their file, two open fields as a map."""
    extra = F.create_map(F.lit("created_date"), "created_date", F.lit("loyalty_tier"), "loyalty_tier")
    return i.valid(spark, sf).select(
        F.col("source_row").alias("id"), F.col("upload_file_id").alias("batch_id"), *[c for c in i.DATA_COLUMNS if c in GOLDEN_FIELDS],
        extra.alias("extra_fields"), F.lit(1).cast("bigint").alias("source_count"),
    )


def file_customers(spark, sf):
    """Golden records of each file by the first-seen rule; ids rise by file, then by row."""
    rows = stage(i.valid(spark, sf), "valid")
    found = matching.first_seen(rows, DEFAULT.file_match_keys, ["upload_file_id"], "source_row")
    members = rows.withColumnRenamed("source_row", "rid").join(found.select("rid", "primary_id"), "rid")
    golden = golden_fold(members, FOLD_FIELDS)
    of_file = rows.select(F.col("source_row").alias("primary_id"), "upload_file_id")
    extra = F.create_map(F.lit("created_date"), "created_date", F.lit("loyalty_tier"), "loyalty_tier")
    fields = [c for c in FOLD_FIELDS if c in GOLDEN_FIELDS]
    return golden.join(of_file, "primary_id").select(
        (F.shiftleft(F.col("upload_file_id").cast("bigint"), 48) + F.col("primary_id")).alias("id"),
        F.lit(1).alias("batch_id"), *fields, extra.alias("extra_fields"), "source_count",
    )


@query("merge_batch_closed")
def batch_closed(spark, sf):
    """As ``merge_batch``, until no two survivors share a key."""
    return merge_batch(file_customers(spark, sf), closure=True).drop("extra_fields")


_FILLED = [f for f in COMPLETENESS_FIELDS if f != "state"]
_SURVIVOR_FIELDS = [f for f in GOLDEN_FIELDS if f in i.DATA_COLUMNS]
BATCH_MEMBERS_SQL = """members AS (SELECT v.source_row AS rid, v.*, CASE WHEN email IS NULL THEN source_row
    ELSE min(source_row) OVER (PARTITION BY upload_file_id, email) END AS primary_id FROM valid v)"""
_OPEN = ", arg_max(created_date, rid) FILTER (replaces) AS created_date, arg_max(loyalty_tier, rid) FILTER (replaces) AS loyalty_tier"


_CUSTOMER_FIELDS = [f for f in FOLD_FIELDS if f in GOLDEN_FIELDS]
MERGE_SQL = f"""{i.first_seen_sql(scope='upload_file_id')},
in_file AS (SELECT source_row AS rid, valid.*, primary_id FROM valid JOIN seen ON rid = source_row),
of_file AS ({fold_sql('in_file', 'primary_id', FOLD_FIELDS, FOLD_FIELDS)}),
customers AS (SELECT CAST(upload_file_id AS BIGINT) * 281474976710656 + primary_id AS id, of_file.source_count AS sources,
                     {', '.join(f'of_file.{f}' for f in _CUSTOMER_FIELDS)}
              FROM of_file JOIN valid ON source_row = primary_id),
{i.first_seen_ctes('customers', 'id', DEFAULT.batch_match_keys, seen='met')},
in_batch AS (SELECT customers.*, rid, primary_id FROM customers JOIN met ON rid = id),
merged AS ({fold_sql('in_batch', 'primary_id', _FILLED, _SURVIVOR_FIELDS, ', sum(sources) AS total')})
SELECT b.id, 1 AS batch_id, CAST(CASE WHEN b.id = m.base_id THEN m.total ELSE b.sources END AS BIGINT) AS source_count,
       b.id <> m.base_id AS is_duplicate, CASE WHEN b.id <> m.base_id THEN m.base_id END AS merged_into_id,
       {', '.join(f'CASE WHEN b.id = m.base_id THEN m.{f} ELSE b.{f} END AS {f}' for f in _SURVIVOR_FIELDS)},
       {', '.join(f'CAST(NULL AS VARCHAR) AS {f}' for f in GOLDEN_FIELDS if f not in _SURVIVOR_FIELDS)}
FROM in_batch b JOIN merged m USING (primary_id)"""


@query("merge_batch", MERGE_SQL)
def batch(spark, sf):
    """Five files, merged within themselves, then across the batch."""
    merged = merge_batch(file_customers(spark, sf))
    return merged.drop("extra_fields")


@query("merge_batch_email", f"""{i.WITH_VALID}, {BATCH_MEMBERS_SQL},
gold AS ({fold_sql('members', 'primary_id', _FILLED, _SURVIVOR_FIELDS, _OPEN)})
SELECT m.rid AS id, m.upload_file_id AS batch_id, m.rid <> g.base_id AS is_duplicate,
       CASE WHEN m.rid <> g.base_id THEN g.base_id END AS merged_into_id,
       CASE WHEN m.rid = g.base_id THEN g.source_count ELSE 1 END AS source_count,
       {', '.join(f'CASE WHEN m.rid = g.base_id THEN g.{f} ELSE m.{f} END AS {f}' for f in _SURVIVOR_FIELDS + ['created_date', 'loyalty_tier'])}
FROM members m JOIN gold g USING (primary_id)""")
def batch_email(spark, sf):
    merged = merge_batch(email_customers(spark, sf), EMAIL_ONLY)
    return merged.select(
        "id", "batch_id", "is_duplicate", "merged_into_id", "source_count", *_SURVIVOR_FIELDS,
        F.col("extra_fields")["created_date"].alias("created_date"), F.col("extra_fields")["loyalty_tier"].alias("loyalty_tier"),
    )


@query("merge_counts", f"""{i.WITH_VALID}
SELECT upload_file_id AS batch_id, count(email) - count(DISTINCT email) AS merged,
       count(*) - count(email) + count(DISTINCT email) AS unique_left FROM valid GROUP BY 1""")
def counts(spark, sf):
    return merge_counts(merge_batch(email_customers(spark, sf), EMAIL_ONLY))


@query("merge_isolated", f"""{i.WITH_VALID}
SELECT source_row AS rid, CASE WHEN email IS NULL THEN source_row
       ELSE min(source_row) OVER (PARTITION BY upload_file_id, email) END AS primary_id FROM valid""")
def isolated(spark, sf):
    found = matching.first_seen(i.valid(spark, sf), (("email",),), ["upload_file_id"], "source_row")
    return found.select("rid", "primary_id")


PARENTS_SQL = """parents AS (
  SELECT source_row AS id, CASE
    WHEN email IS NOT NULL AND source_row > min(source_row) OVER (PARTITION BY upload_file_id, email)
      THEN min(source_row) OVER (PARTITION BY upload_file_id, email)
    WHEN phone IS NOT NULL AND source_row > min(source_row) OVER (PARTITION BY phone)
      THEN min(source_row) OVER (PARTITION BY phone) END AS merged_into_id FROM valid)"""


@query("merge_roots", f"""{i.WITH_VALID.replace('WITH', 'WITH RECURSIVE', 1)}, {PARENTS_SQL},
walk(id, pos) AS (SELECT id, id FROM parents
                 UNION ALL SELECT w.id, p.merged_into_id FROM walk w JOIN parents p ON p.id = w.pos
                 WHERE p.merged_into_id IS NOT NULL)
SELECT id, min(pos) AS root FROM walk GROUP BY id""")
def roots(spark, sf):
    return chain_roots(merge_parents(spark, sf))


def merge_parents(spark, sf):
    """Chains: a row points to the first of its e-mail in the file, such a first one to
    the first row with its phone."""
    rows = stage(i.valid(spark, sf), "valid")
    in_file = F.concat_ws(matching.SEPARATOR, "upload_file_id", "email")
    by_email = matching.first_of_key(rows, F.when(F.col("email").isNotNull(), in_file), "source_row")
    by_phone = matching.first_of_key(rows, F.col("phone"), "source_row")
    both = by_email.withColumnRenamed("primary_id", "e").join(by_phone.withColumnRenamed("primary_id", "p"), "rid")
    parent = F.when(F.col("e") < F.col("rid"), F.col("e")).when(F.col("p") < F.col("rid"), F.col("p"))
    return both.select(F.col("rid").alias("id"), parent.alias("merged_into_id"))


@query("repoint_lineage", f"""{i.WITH_VALID}, {BATCH_MEMBERS_SQL},
gold AS ({fold_sql('members', 'primary_id', _FILLED, ['email'])})
SELECT m.rid AS source_id, g.base_id AS customer_id FROM members m JOIN gold g USING (primary_id)""")
def repoint(spark, sf):
    customers = stage(email_customers(spark, sf), "customers")
    merged = stage(merge_batch(customers, EMAIL_ONLY), "merged")
    sources = customers.select(F.col("id").alias("source_id"), F.col("id").alias("customer_id"))
    return repoint_lineage(sources, merged)
