"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept, written as Parquet and read again,
and calls one of the corpus operators. ``run`` applies them all to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.common import word_count
from contactloom.llm.line_runs import drop_repeated_lines
from contactloom.llm.mixing import repeat_by_mix
from contactloom.llm.packing import pack_documents
from contactloom.llm.passages import drop_repeated_passages
from contactloom.llm.quality_gate import keep_good
from contactloom.llm.simhash import keep_one_each
from contactloom.llm.tokens import vocabulary_file
from contactloom.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out, and then those of passages that begin or end
    inside a line; documents of which nothing is left go."""
    cut = drop_repeated_lines(docs).where("n_removed < n_lines")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    lines = stage(cut.select("doc.doc_id", "text", "doc.lang", "doc.source", n_chars.alias("n_chars")), "lines")
    cut = drop_repeated_passages(lines).where(~F.col("cut") | (word_count(F.col("text")) > 0))
    n_chars = F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    return cut.select("doc.doc_id", "text", "doc.lang", "doc.source", n_chars.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest identifier."""
    return keep_one_each(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return repeat_by_mix(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return pack_documents(docs, vocabulary_file("byte_bpe_50k.json"), lean=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fingerprints and token ids are beyond SQL; the pipeline is tested against a plain program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), "corpus")
    return STAGES[-1][1](spark, docs, sf_dir)
