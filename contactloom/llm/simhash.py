"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most ``DISTANCE`` = 2 of 64 bits are cut into two segments
of 32 bits: one of them then differs in at most one bit. Each segment is indexed under
its 32 one-wildcard variants (the segment with one bit blanked), so such a pair meets
under at least one variant by plain equality; the whole fingerprints are then verified.

Only distinct fingerprints are indexed, so exact copies meet once. A variant held by one
fingerprint is dropped at once. One with up to ``SMALL`` is joined with itself and its pairs
are verified. Larger ones would give a number of pairs that grows with the square of a
group: their fingerprints are signed once more, by the fingerprints at most one bit away
(itself and its 64 neighbours). Two are linked exactly if they share such a signature, and
any two that share one are linked, so a link to the smallest holder of a signature says
the same as all pairs. No link is lost or added.

``DISTANCE`` is fixed by the method: with more differing bits no segment of two is that close.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import beside, one_of_each, text_key
from contactloom.llm.components import components
from contactloom.session import stage

DISTANCE = 2
SHINGLE = 3
SEED = 42
SMALL = 8
#: Shingles whose bits are counted at once; bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if it is set in more than half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        pairs = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
        hashes = [digest(joined[s:e], SEED) for s, e in pairs] if width > 1 else [digest(w, SEED) for w in words]
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), CHUNK):
        bits = np.unpackbits(values[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(values)).tolist())


def with_fingerprints(docs: DataFrame, doc_id: str, text: str, width: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp): a hash of the text and the fingerprint, as signed 64-bit numbers.
    Null text counts as empty."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    schema = kept.select("doc_id", "key", F.lit(0).cast("long").alias("fp")).schema

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            fps = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=schema.names)

    return kept.mapInArrow(sign, schema)


def _variants(fps: DataFrame) -> DataFrame:
    """(fp, key): each of the two segments with each of its bits blanked. A key holds the
    segment's number, the place of the blank and the other bits of the segment."""
    half = "CASE WHEN place < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END"
    key = F.expr(f"(({half}) & ~shiftleft(1L, place % 32)) | shiftleft(CAST(place AS LONG), 32)")
    return fps.select("fp", F.explode(F.expr("sequence(0, 63)")).alias("place")).select("fp", key.alias("key"))


def link(fps: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that give the components of all pairs
    with at most ``DISTANCE`` differing bits."""
    held = _variants(fps).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    held = stage(held.where("n > 1"), "variants")
    pairs = held.where("n = 2").select("a", "b")
    several = held.where("n > 2").select("key", "n")
    # The same plan at every size: the number of shared variants grows with the corpus.
    members = stage(_variants(fps).join(several.hint("merge"), "key"), "members")
    few = members.where(F.col("n") <= small).select("key", F.col("fp").alias("a"))
    pairs = pairs.unionByName(few.join(few.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    many = members.where(F.col("n") > small).select("fp").distinct()
    around = F.expr("concat(array(fp), transform(sequence(0, 63), p -> fp ^ shiftleft(1L, p)))")
    balls = many.select("fp", F.explode(around).alias("near"))
    centres = balls.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = balls.join(centres, "near").where("fp != b").select(F.col("fp").alias("a"), "b")
    return pairs.where(close).unionByName(stars).distinct()


def _classes(signed: DataFrame, small: int) -> DataFrame:
    """(fp, first): the first document of each component, struct(none, doc_id, key), for each fingerprint."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    prints = stage(signed.groupBy("fp").agg(F.min(place).alias("own")), "prints")
    roots = stage(components(link(prints.select("fp"), small)), "roots")
    labelled = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    firsts = labelled.groupBy("root").agg(F.min("own").alias("first"))
    return labelled.join(firsts, "root").select("fp", "first")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, small: int = SMALL
) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each of ``docs``.

    ``component_id`` is the smallest identifier reachable over links, itself included.
    Texts without words have fingerprint zero and are linked like any others. Rows without
    an identifier take part as links; where no member has one, the component is null.
    """
    signed = stage(with_fingerprints(docs, doc_id, text, width), "simhash")
    return signed.join(_classes(signed, small), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


def keep_one_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, small: int = SMALL
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component, the one with the smallest
    identifier stays (of several, the one with the smallest hash of the text; of equal ones, any)."""
    signed = stage(with_fingerprints(docs, doc_id, text, width), "simhash")
    firsts = _classes(signed, small).select("first").distinct()
    firsts = firsts.select(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__key"))
    counts = signed.groupBy(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key")).agg(F.count("*").alias("__rows"))
    same = F.col("__id").eqNullSafe(F.col("own_id")) & (F.col("__key") == F.col("own_key"))
    kept = stage(firsts.join(counts, same).select("__id", "__key", "__rows"), "kept")
    return one_of_each(beside(docs, kept, doc_id, text, "inner"), doc_id, text, "__rows").drop("__rows")
