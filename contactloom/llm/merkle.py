"""Merkle-tree fingerprints of documents, with DataFrame functions only.

A text is cut into paragraphs (lines), paragraphs into chunks of words, and paragraphs are gathered in sections. All
cuts follow the content, so an edit changes what is around it only: a chunk ends with a word whose MD5 begins with
one of four of the sixteen hexadecimal digits, and after 16 words at the latest; a section ends with a paragraph
whose hash begins so. A word is a run of non-blanks with the blanks behind it; each character of scripts
written without blanks is one. The hash of a chunk is the SHA-256 of its text; of a paragraph, of the hashes of its chunks;
of a section, of those of its paragraphs; the root, of those of its sections. Equal roots mean equal texts. Where roots
differ, the first and last sections that differ are opened, and the first and last paragraphs that differ in them
locate the edit (``changed``).

The fingerprint is the root. The likeness of two trees is found by descent: sections that agree from either end count
whole, those between are opened; so are their paragraphs; of the paragraphs that are left, chunks are matched
wherever they stand, as often as both trees hold them. It is twice the characters matched over the characters of
both texts, line breaks aside (1 for equal roots, 0 for other texts without characters). What agrees in both may be taken from both
without changing how much of the rest can be matched, so the descent gives the same as matching all chunks.

A null text counts as empty: one empty paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import let, ordered_buckets

_BLANK, _DENSE = r" \t\x0B\x0C\r", r"\x{2E80}-\x{10FFFF}"

#: A word with its blanks, at most 64 characters: every character of a line lies in exactly one.
WORD = rf"[{_DENSE}][{_BLANK}]{{0,32}}|[^{_BLANK}{_DENSE}]{{1,32}}[{_BLANK}]{{0,32}}|[{_BLANK}]{{1,32}}"

#: Words of a chunk at most. With 64 characters a word, the length of a chunk fits the bits that ``keys`` gives it.
CHUNK_WORDS = 16

_LENGTH_BITS = 12
_NO_KEYS = "array<bigint>"


def _cuts(end: Column) -> Column:
    """Whether a hash ends what it belongs to: one in four does."""
    return end < "4"


def chunks(paragraph: Column) -> Column:
    """The chunks of a line, in order; none for an empty line."""

    def cut(words: Column) -> Column:
        n = F.size(words)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | _cuts(F.md5(F.get(words, i - 1))))

        def pieces(e: Column, end: Column, k: Column) -> Column:
            first = F.when(k == 0, 0).otherwise(F.get(e, k - 1))
            return F.transform(
                F.sequence(first, end - 1, F.lit(CHUNK_WORDS)),
                lambda at: F.array_join(F.slice(words, at + 1, F.least(end - at, F.lit(CHUNK_WORDS))), ""),
            )

        found = let(ends, lambda e: F.flatten(F.transform(e, lambda end, k: pieces(e, end, k))))
        return F.when(n > 0, found).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(paragraph, F.lit(WORD), F.lit(0)), cut)


def _weight(keys: Column) -> Column:
    """Characters of the chunks with these keys."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda n, key: n + key.bitwiseAND((1 << _LENGTH_BITS) - 1))


def tree(text: Column) -> Column:
    """struct(root, sections array<struct<hash, first, paragraphs array<hash>>>, keys array<array<long>>) of a text
    that is not null. ``keys`` has a number for each chunk of each paragraph: a hash of its hash, then its length in 12 bits."""

    def paragraph(text: Column) -> Column:
        found = F.transform(chunks(text), lambda c: F.struct(F.sha2(c, 256).alias("hash"), F.length(c).alias("length")))
        return let(
            found,
            lambda c: F.struct(
                F.sha2(F.array_join(c.getField("hash"), ""), 256).alias("hash"),
                F.transform(c, lambda x: F.shiftleft(F.xxhash64(x.hash), _LENGTH_BITS) + x.length).alias("keys"),
            ),
        )

    def sections(hashes: Column) -> Column:
        n = F.size(hashes)
        numbers = F.sequence(F.lit(1), n)
        ends = F.filter(numbers, lambda i: (i == n) | _cuts(F.get(hashes, i - 1)))
        return let(
            ends,
            lambda e: F.transform(
                e,
                lambda end, k: let(
                    F.when(k == 0, 0).otherwise(F.get(e, k - 1)),
                    lambda first: let(
                        F.slice(hashes, first + 1, end - first),
                        lambda own: F.struct(
                            F.sha2(F.array_join(own, ""), 256).alias("hash"), first.alias("first"), own.alias("paragraphs")
                        ),
                    ),
                ),
            ),
        )

    def whole(paragraphs: Column) -> Column:
        return let(
            sections(paragraphs.getField("hash")),
            lambda s: F.struct(
                F.sha2(F.array_join(s.getField("hash"), ""), 256).alias("root"),
                s.alias("sections"),
                paragraphs.getField("keys").alias("keys"),
            ),
        )

    return let(F.transform(F.split(text, "\n", -1), paragraph), whole)


def _numbered(keys: Column) -> Column:
    """Keys such that the n-th copy of one differs from its other copies and equals the n-th copy elsewhere."""

    def copies(held: Column, starts: Column, at: Column, k: Column) -> Column:
        n = F.coalesce(F.get(starts, k + 1), F.size(held)) - at
        key = F.get(held, at)
        length = key.bitwiseAND((1 << _LENGTH_BITS) - 1)
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda nth: F.when(nth == 0, key).otherwise(F.shiftleft(F.xxhash64(key, nth), _LENGTH_BITS) + length),
        )

    def runs(held: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(held) - 1)
        starts = F.filter(numbers, lambda i: (i == 0) | (F.get(held, i) != F.get(held, i - 1)))
        return let(starts, lambda s: F.flatten(F.transform(s, lambda at, k: copies(held, s, at, k))))

    return F.when(F.size(keys) > 0, let(F.sort_array(keys), runs)).otherwise(F.array().cast(_NO_KEYS))


def likeness(a: Column, b: Column) -> Column:
    """Of two trees: 0 to 1."""

    def between(own: Column, other: Column) -> Column:
        """struct(head, tail): how many members agree from the beginning, and of the rest from the end."""
        rest = F.least(F.size(own), F.size(other))
        return let(
            _alike(own, other),
            lambda head: F.struct(
                head.alias("head"), F.least(_alike(F.reverse(own), F.reverse(other)), rest - head).alias("tail")
            ),
        )

    def opened(members: Column, same: Column) -> Column:
        return F.slice(members, same.getField("head") + 1, F.size(members) - same.getField("head") - same.getField("tail"))

    def paragraphs(tree: Column, same: Column) -> Column:
        """struct(hashes, keys) of the paragraphs of the sections that are opened."""
        return let(
            F.flatten(F.transform(opened(tree.getField("sections"), same), lambda s: s.paragraphs)),
            lambda hashes: F.struct(
                hashes.alias("hashes"),
                F.slice(
                    tree.getField("keys"),
                    F.coalesce(F.get(tree.getField("sections"), same.getField("head")).getField("first"), F.lit(0)) + 1,
                    F.size(hashes),
                ).alias("keys"),
            ),
        )

    def left(own: Column, other: Column) -> Column:
        """struct(own, other): keys of the chunks of the paragraphs that are opened."""
        return let(
            between(own.getField("hashes"), other.getField("hashes")),
            lambda same: F.struct(
                F.flatten(opened(own.getField("keys"), same)).alias("own"),
                F.flatten(opened(other.getField("keys"), same)).alias("other"),
            ),
        )

    def hashes(tree: Column) -> Column:
        return tree.getField("sections").getField("hash")

    def share(own: Column, other: Column, total: Column) -> Column:
        """``total``: characters of both. All are matched but those of opened paragraphs without a partner."""
        matched = _weight(F.array_intersect(_numbered(own), _numbered(other)))
        return F.when(total > 0, (total - _weight(own) - _weight(other) + 2 * matched) / total).otherwise(0.0)

    total = _weight(F.flatten(a.getField("keys"))) + _weight(F.flatten(b.getField("keys")))
    rest = let(
        between(hashes(a), hashes(b)),
        lambda same: let(
            F.struct(paragraphs(a, same).alias("a"), paragraphs(b, same).alias("b")),
            lambda p: left(p.getField("a"), p.getField("b")),
        ),
    )
    found = let(rest, lambda r: let(total, lambda n: share(r.getField("own"), r.getField("other"), n)))
    return F.when(a.getField("root") == b.getField("root"), 1.0).otherwise(found)


def _alike(a: Column, b: Column) -> Column:
    """How many leading members of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(F.array_position(same, F.lit(False)), lambda at: F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int"))


def changed(a: Column, b: Column) -> Column:
    """struct(first, last): the paragraphs (from 0) of tree ``a`` between what both trees begin and end
    with; last < first where ``b`` only has more. Null for equal trees."""

    def hashes(sections: Column) -> Column:
        return F.transform(sections, lambda s: s.hash)

    def inside(own: Column, other: Column, at: Column, turn) -> Column:
        """(section of a, number of its paragraphs that agree) at the place where sections stop to agree."""
        mine, theirs = F.get(own, at), F.get(other, at)
        return F.struct(
            mine.alias("section"),
            _alike(
                turn(F.coalesce(mine.getField("paragraphs"), F.array().cast("array<string>"))),
                turn(F.coalesce(theirs.getField("paragraphs"), F.array().cast("array<string>"))),
            ).alias("same"),
        )

    own, other = a.getField("sections"), b.getField("sections")
    back, back_other = F.reverse(own), F.reverse(other)
    head = let(_alike(hashes(own), hashes(other)), lambda at: inside(own, other, at, lambda x: x))
    tail = let(_alike(hashes(back), hashes(back_other)), lambda at: inside(back, back_other, at, F.reverse))
    total = F.aggregate(own, F.lit(0), lambda n, s: n + F.size(s.paragraphs))
    first = let(head, lambda h: F.coalesce(h.section.first + h.same, total))
    last = let(
        tail, lambda t: F.coalesce(t.section.first + F.size(t.section.paragraphs) - t.same - 1, F.lit(-1))
    )
    return F.when(a.getField("root") != b.getField("root"), F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, sections, keys), a row for each of ``docs``: the tree that the fingerprint is the root of."""
    found = docs.select(F.col(doc_id).alias("doc_id"), tree(F.coalesce(F.col(text), F.lit(""))).alias("tree"))
    return found.select("doc_id", F.col("tree.root").alias("fingerprint"), "tree.sections", "tree.keys")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): every document with the text of the next one by identifier; the
    last has the first. Null texts become empty. Rows without an identifier come first; equal
    identifiers are ordered by a hash of the text.

    Identifiers are cut into ranges of about equal size. The first document of each range is
    also added to the end of the range before, so no order runs through one task.
    """
    pieces = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        ordered_buckets(docs, doc_id, text, pieces).alias("bucket"), F.col(doc_id).alias("doc_id"), content.alias("text")
    )
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    # One row per range from here on: its first document, and the range that it follows.
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("first"))
    ring, whole = Window.orderBy("bucket"), Window.partitionBy()
    firsts = firsts.select(
        F.col("bucket").alias("own"), "first", F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(whole)).alias("back")
    )
    met = (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy(*order[1:]))
    heads = rows.join(F.broadcast(firsts), met).withColumn("nth", nth).where("nth = 1")
    heads = heads.select(F.col("back").alias("bucket"), "doc_id", "text", F.lit(True).alias("added"))
    both = rows.withColumn("added", F.lit(False)).unionByName(heads).repartition("bucket")
    inside = Window.partitionBy("bucket").orderBy("added", *order)
    return both.withColumn("next_text", F.lead("text").over(inside)).where(~F.col("added")).drop("bucket", "added")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against an edited copy, whose last quarter is replaced by the beginning of the next
    document: (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, first_changed,
    last_changed)."""
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = with_next(docs, doc_id, text).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn(
        "edited",
        F.concat(
            F.substr("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substr("next_text", F.lit(1), quarter)
        ),
    )
    trees = rows.select(
        "doc_id",
        "n_chars",
        "edited",
        tree(F.col("text")).alias("tree"),
        tree(F.col("edited")).alias("edited_tree"),
        tree(F.col("next_text")).alias("next_tree"),
    )
    where = changed(F.col("tree"), F.col("edited_tree"))
    return trees.select(
        "doc_id",
        "n_chars",
        "edited",
        F.col("tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        where.getField("first").alias("first_changed"),
        where.getField("last").alias("last_changed"),
    )
