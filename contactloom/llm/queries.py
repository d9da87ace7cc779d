"""The registered queries of the corpus operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.byte_bpe import digest_documents
from contactloom.llm.dac import read_documents, write_ids
from contactloom.llm.line_runs import drop_repeated_lines
from contactloom.llm.merkle import CHUNK_WORDS, WORD, edited
from contactloom.llm.mixing import mix
from contactloom.llm.packing import pack_documents
from contactloom.llm.phrases import collocations
from contactloom.llm.quality_gate import judge
from contactloom.llm.secrets import BASE, scan
from contactloom.llm.sharding import shard_documents
from contactloom.llm.simhash import near_duplicates
from contactloom.llm.spelling import variants, vocabulary
from contactloom.llm.tokens import vocabulary_file
from contactloom.llm.url_equivalence import Rule, judge_urls
from contactloom.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql is not None:
        SQL[fn.__name__] = sql
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(_table(spark, sf_dir, "documents"), 16)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


_add(op1_ring)


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited(_table(spark, sf_dir, "documents"))
    return found.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


_add(op2_merkle, rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt
      FROM d),
n AS (SELECT doc_id, text, nxt, text[1:length(text) - length(text) // 4] || nxt[1:length(text) // 4] AS edited FROM o),
v AS (SELECT doc_id, 'a' AS kind, text AS body FROM n UNION ALL SELECT doc_id, 'b', edited FROM n
      UNION ALL SELECT doc_id, 'c', nxt FROM n),
p AS (SELECT doc_id, kind, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line
      FROM (SELECT doc_id, kind, string_split(body, chr(10)) AS parts FROM v)),
w AS (SELECT doc_id, kind, i, unnest(range(1, len(words) + 1)) AS j, unnest(words) AS word
      FROM (SELECT doc_id, kind, i, regexp_extract_all(line, '{WORD}') AS words FROM p)),
g AS (SELECT *, coalesce(sum((md5(word) < '4')::INT) OVER (PARTITION BY doc_id, kind, i ORDER BY j
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM w),
k AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, kind, i, run ORDER BY j) - 1) // {CHUNK_WORDS} AS piece FROM g),
u AS (SELECT doc_id, kind, i, min(j) AS j, string_agg(word, '' ORDER BY j) AS chunk FROM k
      GROUP BY doc_id, kind, i, run, piece),
h AS (SELECT p.doc_id, p.kind, p.i, sha256(coalesce(string_agg(sha256(u.chunk), '' ORDER BY u.j), '')) AS hash
      FROM p LEFT JOIN u ON p.doc_id = u.doc_id AND p.kind = u.kind AND p.i = u.i GROUP BY p.doc_id, p.kind, p.i),
e AS (SELECT *, coalesce(sum((hash < '4')::INT) OVER (PARTITION BY doc_id, kind ORDER BY i
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM h),
s AS (SELECT doc_id, kind, section, sha256(string_agg(hash, '' ORDER BY i)) AS hash FROM e GROUP BY doc_id, kind, section),
r AS (SELECT doc_id, kind, sha256(string_agg(hash, '' ORDER BY section)) AS root FROM s GROUP BY doc_id, kind),
t AS (SELECT doc_id, max(root) FILTER (kind = 'a') AS a, max(root) FILTER (kind = 'b') AS b, max(root) FILTER (kind = 'c') AS c
      FROM r GROUP BY doc_id),
q AS (SELECT doc_id, kind, list(hash ORDER BY i) AS p FROM h GROUP BY doc_id, kind),
c AS (SELECT doc_id, length(chunk) AS size, count(*) FILTER (kind = 'a') AS a, count(*) FILTER (kind = 'b') AS b,
             count(*) FILTER (kind = 'c') AS c FROM u GROUP BY doc_id, chunk),
m AS (SELECT doc_id, sum(size * least(a, b)) AS ab, sum(size * least(a, c)) AS ac, sum(size * a) AS a, sum(size * b) AS b,
             sum(size * c) AS c FROM c GROUP BY doc_id),
z AS (SELECT n.doc_id, n.text, n.edited, t.a AS fingerprint, t.b AS edited_fingerprint, t.c AS next_fingerprint,
             x.p AS p, y.p AS q, m.ab, m.ac, m.a, m.b, m.c
      FROM n JOIN t USING (doc_id) JOIN q AS x ON x.doc_id = n.doc_id AND x.kind = 'a'
      JOIN q AS y ON y.doc_id = n.doc_id AND y.kind = 'b' LEFT JOIN m ON m.doc_id = n.doc_id)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE WHEN a + b > 0 THEN (2 * ab)::DOUBLE / (a + b)::DOUBLE
            ELSE 0.0::DOUBLE END AS near_edited,
       CASE WHEN fingerprint = next_fingerprint THEN 1.0::DOUBLE WHEN a + c > 0 THEN (2 * ac)::DOUBLE / (a + c)::DOUBLE
            ELSE 0.0::DOUBLE END AS near_next,
       CASE WHEN fingerprint <> edited_fingerprint THEN coalesce(list_min(list_filter(range(1, len(p) + 1),
         lambda i: p[i] IS DISTINCT FROM q[i])), len(p) + 1) - 1 END::INT AS first_changed,
       CASE WHEN fingerprint <> edited_fingerprint THEN coalesce(list_max(list_filter(range(1, len(p) + 1),
         lambda i: p[i] IS DISTINCT FROM q[i + len(q) - len(p)])), 0) - 1 END::INT AS last_changed
FROM z
""")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


_add(op3_simhash)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


_add(op4_packing)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


_add(op5_mixing, r"""
WITH d AS (
  SELECT doc_id, source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '')) AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
r AS (SELECT *, (source_size * 3)::DOUBLE AS lim, (source_size * 3)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE
               - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
               / sum(weight) OVER (ORDER BY ratio, source NULLS LAST
                                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, (SELECT min_by(level, ratio) FROM l AS x WHERE x.ratio > x.level) AS found FROM l),
t AS (SELECT source, source_size,
             CASE WHEN found IS NULL OR weight * found >= lim THEN lim ELSE weight * found END AS target FROM f),
b AS (SELECT *, least(3, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS base FROM t),
e AS (SELECT d.*, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS rest,
             CAST('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '-') || '|' || d.size), 1, 15) AS BIGINT) AS h
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
g AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM e),
c AS (SELECT *, CASE WHEN size = 0 THEN 0
                     ELSE base + CASE WHEN gone + size < rest THEN 1
                                      WHEN gone < rest AND floor((rest - gone) / size + 0.5) >= 1 THEN 1
                                      ELSE 0 END END AS copies FROM g)
SELECT doc_id, source, size::BIGINT AS size, source_size, target, copies::BIGINT AS copies,
       (copies * size)::BIGINT AS taken FROM c
""")


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc.doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
    )


_add(op6_line_runs, r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line FROM d),
w AS (SELECT doc_id, i, line,
             len(list_filter(regexp_split_to_array(line, '[ 	

]+'), lambda x: x <> '')) AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
f AS (SELECT a.doc_id, a.i, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i
      AND b.upto - a.upto + a.words >= 50 GROUP BY ALL
      UNION
      SELECT b.doc_id, max(a.i) AS i, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i
      AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.i),
s AS (SELECT f.doc_id, f.i, f.e, parts[f.i:f.e] AS content FROM f JOIN d USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS nth FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i FROM o WHERE nth > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
             coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS text
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT doc_id, text, n_lines, n_removed FROM k
""")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_add(op7_quality)


def op8_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return read_documents(write_ids(documents, vocabulary_file("word_bpe_49k.json")))


_add(op8_dac)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(BASE))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


_add(op9_secrets)


URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).drop("component")


_add(op10_urls, r"""
WITH p AS (
  SELECT page_id, url, html,
         CASE WHEN contains(url, '://') THEN
           translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT p.page_id, p.host, p.path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
         max_by(verdict, length(rhost || rpath)) AS verdict
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
""")


def op11_dic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), least=100, top=2000, cover=100)


_add(op11_dic, r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
           FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
u AS (SELECT lang, k, phrase, f AS a, cut, array_to_string(ws[1:cut], ' ') AS first, array_to_string(ws[cut + 1:], ' ') AS rest
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT u.lang, u.phrase, a, cut, x.f AS l, y.f AS r, n.n,
             (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score
      FROM u JOIN f x ON u.lang = x.lang AND u.first = x.phrase JOIN f y ON u.lang = y.lang AND u.rest = y.phrase
             JOIN n ON u.lang = n.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, phrase, max(f) AS f FROM (
        SELECT lang, f, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (
          SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS m) WHERE m < k)) GROUP BY ALL),
o AS (SELECT m.* FROM m LEFT JOIN h ON m.lang = h.lang AND m.phrase = h.phrase WHERE h.f IS NULL OR 100 * h.f < 100 * m.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM z WHERE rank <= 2000
""")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(_table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.tiktoken"))


_add(op12_byte_bpe)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stage(vocabulary(_table(spark, sf_dir, "documents"), shortest=6, least=5, drop_every=199), "vocabulary")
    return variants(words, times=5)


_add(op13_spelling, r"""
WITH RECURSIVE
d AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
      FROM documents),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[a-zÀ-ÿ]+')) AS run FROM d),
q AS (SELECT id, run, count(*) AS times, hex(encode(id || ':' || run)) AS bytes FROM r WHERE length(run) >= 6 GROUP BY ALL),
nib(j, v) AS (SELECT j, v FROM (SELECT unnest(range(16)) AS j) t, LATERAL (
  SELECT list_reduce([j::BIGINT, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v) u),
tab AS (SELECT list(v ORDER BY j) AS t FROM nib),
h AS (SELECT id, run, times, xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(length(bytes)), lambda i: instr('0123456789ABCDEF', substr(bytes, CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END, 1))::BIGINT - 1)),
        lambda c, x: xor(c >> 4, t[(xor(c, x) & 15) + 1])), 4294967295) AS h FROM q, tab),
w AS (SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT times, CASE WHEN h % 199 = 0 THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
e AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
v AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM e),
b AS (SELECT a.word, c.word AS near, c.n FROM v a JOIN v c ON a.i = c.i AND a.less = c.less AND a.word <> c.word
      UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word
      UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
m AS (SELECT word, count(*) AS n_near, max(n) AS near_n, arg_min(near, (-n, near)) AS near FROM b GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
             CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN m USING (word)),
p AS (SELECT word, word AS upto, 0 AS depth FROM f
      UNION ALL SELECT p.word, f.form, depth + 1 FROM p JOIN f ON p.upto = f.word WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(upto, depth) AS root FROM p GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN z USING (word)
""")
