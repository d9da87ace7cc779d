import pytest
from pyspark.sql import functions as F

#: Names that operators use for columns of their own.
CLASHING = [
    "size", "shard", "slot", "arc", "part", "n", "h", "label", "bucket", "fp", "key", "first", "root", "line", "lines",
    "hash", "id", "r", "seg", "ends", "removed", "doc", "copies", "taken", "weight", "target", "kept", "n_words",
    "stratum", "spans", "start", "length", "ids", "offset", "sequence_id", "host", "path", "node", "rule", "verdict",
    "component", "next_text", "added", "tree", "sections", "sentences", "image", "position", "copy", "row",
]


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source[, lang]), with columns that clash."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a") for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        df = df.withColumn("n_chars", F.length("text").cast("long"))
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHING]).repartition(parts)

    return make


@pytest.fixture
def queried(spark, tmp_path):
    """The rows of a registered query over the given tables."""
    from contactloom.llm.queries import QUERIES

    def run(name, **tables):
        for table, df in tables.items():
            df.write.parquet(f"{tmp_path}/{table}.parquet")
        return [r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect()]

    return run


#: Nulls, empty and blank texts, ties, repeated rows, and a very long text.
HARD = [
    (1, "one two three\nfour five. six"),
    (1, "one two three\nfour five. six"),
    (1, "another text under the same name"),
    (2, None),
    (3, ""),
    (4, " \n\t \n"),
    (None, "nobody's words"),
    (None, "nobody's words"),
    (None, None),
    (5, "Ünï-cödé 日本語 🎉 text.\nMore"),
    (6, "word " * 30_000 + "end"),
    (7, "one two three\nfour five. six"),
]
