"""Collocations: phrases of words that stand together more often than their parts would by chance.

Counts come from dynamic itemset counting. The texts are dealt into shards, which are scanned in turn
and over again. Single words are counted from the first scan. A longer phrase is counted from the scan
after which both its subphrases (without its last word, without its first) have reached the threshold,
while shorter ones are still being counted, and for one full cycle of shards. The work ends when no
phrase reaches the threshold any more; phrases that have come full circle below it are dropped.

Which phrases are active follows from those that have reached the threshold, and when. Tasks get these as
two bitmaps of hashes (all; those of the last cycle), whose size is fixed. A wrong hit costs a row, not
correctness: a phrase with a rare part is rare itself, and each phrase keeps a mask of the shards that it
has been counted in, so none counts twice. Nothing else is sent to the tasks. Within a buffer of texts a
phrase is counted once, and counts meet by key, so no frequent word or pair fills a task.

Texts are cut into words once. What the scans read is, for a buffer of texts of one language, its distinct words
and the numbers that its words have among them.

While counting, a phrase is 64 and 32 bits of a hash of its language and words. A last scan names those
that reached the threshold, in three parts: what a part has named is no longer looked for in the next, so that a
phrase gives a few rows and not one for each task. The last part is all texts that are left. Scores and ranks are then computed by exact decimal arithmetic on strings.

Null texts count as empty, a null language as "und". Repeated rows count each time. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import byte_ranges
from contactloom.operators.lookup import lookup_join
from contactloom.session import discard, stage

#: Words of the longest phrase; a kind must fit the low bits of a key.
LONGEST, KIND = 5, 7
#: Shards of a cycle.
SHARDS = 3
#: Bits of a bitmap of hashes; a power of two, 4 MB.
FILTER_BITS = 1 << 25
#: Bytes of text that are looked through at once for their languages and shards, and that are cut into words at once.
BUFFER, HELD = 8 << 20, 32 << 20
#: Phrases, repeats included, that a task sorts at once.
SORTED = 1 << 21
#: Ends of the parts of the texts in which names are looked for, in 64ths.
NAMING = (1, 8, 64)
#: Bits of a shard's mask and of a step's number where a phrase's state is one number; the rest is its occurrences.
MASK_BITS, STEP_BITS = 12, 6
#: Ranges that a language's candidates are ranked in before all of them are.
SLICES = 64

BLANK, BREAK = 1, 2
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[ord(c) for c in " \t"]] = BLANK
_CLASSES[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = BREAK

# Odd multipliers of two independent hashes.
LANES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def words_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each word, distinct words, whether it is the first of its piece) of all texts in a row."""
    lowered = pc.ascii_lower(texts).cast(pa.large_binary()).to_pylist()
    data = np.frombuffer(b"\n".join([b"", *lowered, b""]), np.uint8)
    kinds = _CLASSES[data]
    inside = kinds == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    pieces = np.cumsum(kinds == BREAK, dtype=np.int32)[starts]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    content = pa.py_buffer(np.ascontiguousarray(data[inside]))
    cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), content])
    numbered = cut.dictionary_encode()
    return numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), np.diff(pieces, prepend=-1) != 0


#: A buffer of texts of one language and shard, cut into words. ``firsts`` is a bit per word, ``words`` are joined by blanks.
CUT = "shard int, part int, lang string, n long, numbers binary, firsts binary, words binary"


def _cut(texts: DataFrame) -> DataFrame:
    """The words of texts (shard, part, lang, text), a row per buffer."""

    def row(key: tuple, own: list[pa.Array]) -> pa.RecordBatch | None:
        numbers, words, firsts = words_of(pa.chunked_array(own))
        if not len(numbers):
            return None
        small = np.uint16 if len(words) <= 1 << 16 else np.uint32
        values = [*key, len(numbers), numbers.astype(small).tobytes(), np.packbits(firsts).tobytes(), b" ".join(words)]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = [pa.array([v], t) for v, t in zip(values, types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "part", "lang", "n", "numbers", "firsts", "words"])

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for key in list(held):
            cut = row(key, held.pop(key))
            if cut is not None:
                yield cut

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for low, length in byte_ranges(batch.column("text"), BUFFER):
                some = batch.slice(low, length)
                grouped = pa.table([*some.columns[:3], pa.array(np.arange(length))], names=["shard", "part", "lang", "at"])
                for key in grouped.group_by(["shard", "part", "lang"], use_threads=False).aggregate([("at", "list")]).to_pylist():
                    own = some.column("text").take(pa.array(key["at_list"]))
                    held.setdefault((key["shard"], key["part"], key["lang"]), []).append(own)
                    size += own.nbytes
                if size >= HELD:
                    yield from rows(held)
                    size = 0
        yield from rows(held)

    return texts.select("shard", "part", "lang", "text").mapInArrow(scan, CUT)


def _mixed(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    one, two = (np.uint64(x) for x in LANES[lane])
    x = a * one + (b ^ (b >> np.uint64(32))) * two
    x = (x ^ (x >> np.uint64(29))) * one
    return x ^ (x >> np.uint64(32))


def _has(bitmap: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.zeros(len(keys), bool)
    at = keys & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Phrases:
    """Keys of the phrases of some texts of one language, length by length, those alone whose parts pass a filter."""

    def __init__(self, lang: str, numbers: np.ndarray, firsts: np.ndarray, words: list[bytes]):
        self.numbers, self.firsts, self.words = numbers, firsts, words
        seed = xxhash.xxh64_intdigest(lang.encode())
        digests = b"".join([xxhash.xxh3_128_digest(w, seed) for w in words])
        self.own = [np.ascontiguousarray(x) for x in np.frombuffer(digests, ">u8").reshape(-1, 2).T.astype(np.uint64)]

    def levels(self, every: np.ndarray | None, recent: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, first key) of phrases of two words and more whose subphrases are in ``every``, and one of
        them in ``recent``, if that is given."""
        if every is None:
            return
        size, single = len(self.numbers), self.own[0][self.numbers]
        a = single.copy()
        passed = _has(every, self.own[0])[self.numbers]
        late = None if recent is None else _has(recent, self.own[0])[self.numbers]
        for length in range(2, LONGEST + 1):
            both = passed[:-1] & passed[1:]
            if length == 2:
                both &= ~self.firsts[1:]
            at = np.flatnonzero(both)
            if not len(at):
                return
            keys = _mixed(a[at], single[at + length - 1], 0)
            active = slice(None) if late is None else late[at] | late[at + 1]
            yield length, at[active], keys[active]
            if length == LONGEST:
                return
            a[at] = keys
            passed = np.zeros(size, bool)
            passed[at] = _has(every, keys)
            if late is not None:
                late = np.zeros(size, bool)
                late[at] = _has(recent, keys)

    def second(self, places: np.ndarray, length: int) -> np.ndarray:
        """Second keys, shortened, of the phrases of one length at some places."""
        b = self.own[1][self.numbers[places]]
        for i in range(1, length):
            b = _mixed(b, self.own[1][self.numbers[places + i]], 1)
        return _short(b, length)

    def text(self, place: int, length: int) -> bytes:
        return b" ".join([self.words[i] for i in self.numbers[place : place + length].tolist()])


def _short(second: np.ndarray, length: int) -> np.ndarray:
    """32 bits of the second key with the length in the lowest."""
    return ((second >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFF ^ KIND) | np.uint32(length)).view(np.int32)


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each key, how often it occurs)."""
    low = np.uint64((1 << len(first).bit_length()) - 1)
    order = (np.sort(first & ~low | np.arange(len(first), dtype=np.uint64)) & low).astype(np.int64)
    a, b = first[order], second[order]  # by their high bits; which of equal keys comes first does not matter
    new = a[1:] != a[:-1]
    same_high = new & ((a[1:] ^ a[:-1]) <= low)
    if same_high.any() or (~new & (b[1:] != b[:-1])).any():  # equal in one key, or its high bits, only
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(np.concatenate(([True], new)))
    return order[at], np.diff(np.append(at, len(a)))


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Phrases]]:
    """(language, phrases) of each row (lang, n, numbers, firsts, words)."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, n, numbers, firsts, words = (batch.column(c)[i] for c in range(5))
            n, held = n.as_py(), numbers.as_buffer()
            numbers = np.frombuffer(held, np.uint16 if held.size == 2 * n else np.uint32).astype(np.int64)
            firsts = np.unpackbits(np.frombuffer(firsts.as_buffer(), np.uint8), count=n).view(bool)
            yield lang.as_py(), Phrases(lang.as_py(), numbers, firsts, words.as_py().split(b" "))


def _count(texts: DataFrame, single: bool, every: np.ndarray | None, recent: np.ndarray | None) -> DataFrame:
    """(a, b, n): how often the active phrases occur in each buffer or some buffers of texts cut into words."""

    def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        one, counts = distinct(a, b)
        return rows(a[one], b[one], counts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, found in _phrases(batches):
            if single:
                yield rows(found.own[0], _short(found.own[1], 1), np.bincount(found.numbers, minlength=len(found.words)))
            for length, at, a in found.levels(every, recent):
                if len(at):
                    if held and size + len(at) > SORTED:
                        yield counted(held)
                        size = 0
                    held.append((a, found.second(at, length)))
                    size += len(at)
        if held:
            yield counted(held)

    return texts.select("lang", "n", "numbers", "firsts", "words").mapInArrow(scan, "a long, b int, n long")


def _named(texts: DataFrame, every: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(a, b, lang, phrase): phrases in ``wanted``, words among them, whose parts are in ``every``."""

    def rows(lang: str, a: np.ndarray, b: np.ndarray, phrases: list) -> pa.RecordBatch:
        columns = [pa.array(a.view(np.int64)), pa.array(b), pa.array([lang] * len(a), pa.string()), pa.array(phrases, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "lang", "phrase"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in _phrases(batches):
            at = np.flatnonzero(_has(wanted, found.own[0]))
            yield rows(lang, found.own[0][at], _short(found.own[1][at], 1), [found.words[i].decode() for i in at.tolist()])
            for length, at, a in found.levels(every, None):
                hit = _has(wanted, a)
                at, a = at[hit], a[hit]
                if len(at):
                    b = found.second(at, length)
                    one, _ = distinct(a, b)
                    yield rows(lang, a[one], b[one], [found.text(i, length).decode() for i in at[one].tolist()])

    named = texts.select("lang", "n", "numbers", "firsts", "words").mapInArrow(scan, "a long, b int, lang string, phrase string")
    return named.distinct()


def _bitmaps(keys: DataFrame, since: int, bits: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """One bit for each key a of keys (a, reached), in an array of fixed size; and for those reached ``since`` a scan
    alone. None without keys."""
    place = F.col("a").bitwiseAND(F.lit(bits - 1)) + 1
    marked = keys.select("reached", F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("at"))
    built = [f"bitmap_construct_agg(at) FILTER (WHERE reached >= {low})" for low in (0, since)]
    found = marked.groupBy("part").agg(*[F.expr(b).alias(n) for b, n in zip(built, ("every", "recent"), strict=True)], F.max("reached").alias("last"))
    found = found.collect()  # at most bits / 32768 rows of 8 KB
    out = []
    for name, low in (("every", 0), ("recent", since)):
        if all(row["last"] < low for row in found):
            out.append(None)
            continue
        bitmap = np.zeros(bits // 8, np.uint8)
        for row in found:
            part = np.frombuffer(row[name], np.uint8)
            bitmap[(row.part - 1) * len(part) : row.part * len(part)] = part
        out.append(bitmap)
    return out[0], out[1]


def _merge(totals: DataFrame | None, found: DataFrame, step: int, least: int, shards: int) -> DataFrame:
    """(a, b, f, mask, born, reached) with the counts of one shard: occurrences so far, shards counted in, first
    scan, scan that reached the threshold. What has come full circle below it goes.

    A phrase seldom comes more than once from a task, so counts are not added up before the shuffle. What was known of it is one number there."""
    bit = F.lit(1 << step % shards)
    rows = found.select("a", "b", "n", F.lit(0).cast("long").alias("known"))
    if totals is not None:
        known, low = F.col("f"), (1 << STEP_BITS) - 1
        reached = F.coalesce(F.col("reached") + 1, F.lit(0))
        for value, bits in ((F.col("mask"), MASK_BITS), (F.col("born") + 1, STEP_BITS), (reached, STEP_BITS)):
            known = F.shiftleft(known, bits).bitwiseOR(value.cast("long"))
        rows = rows.unionByName(totals.select("a", "b", F.lit(0).cast("long").alias("n"), known.alias("known")))
    both = rows.repartition("a").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("known").alias("known"))
    if totals is None:
        f, mask, born, reached = F.lit(0).cast("long"), F.lit(0), F.lit(step), F.lit(None).cast("int")
    else:
        f = F.shiftright("known", MASK_BITS + 2 * STEP_BITS)
        mask = F.shiftright("known", 2 * STEP_BITS).bitwiseAND(F.lit((1 << MASK_BITS) - 1)).cast("int")
        born, reached = (F.shiftright("known", s).bitwiseAND(F.lit(low)).cast("int") for s in (STEP_BITS, 0))
        born, reached = (F.when(x > 0, x - 1) for x in (born, reached))
        born = F.coalesce(born, F.lit(step))
    both = both.select("a", "b", "n", f.alias("f"), mask.alias("mask"), born.alias("born"), reached.alias("reached"))
    fresh = (F.col("n") > 0) & (F.col("mask").bitwiseAND(bit) == 0)
    both = both.select(
        "a", "b", F.when(fresh, F.col("f") + F.col("n")).otherwise(F.col("f")).alias("f"),
        F.when(fresh, F.col("mask").bitwiseOR(bit)).otherwise(F.col("mask")).alias("mask"), "born", "reached",
    ).withColumn("reached", F.coalesce("reached", F.when(F.col("f") >= least, F.lit(step))))
    single = F.col("b").bitwiseAND(F.lit(KIND)) == 1
    circled = F.when(single, F.lit(step >= shards - 1)).otherwise(F.lit(step) - F.col("born") >= shards - 1)
    return both.where(F.col("reached").isNotNull() | ~circled)


def frequent_phrases(
    docs: DataFrame, least: int, text: str = "text", lang: str = "lang", shards: int = SHARDS, filter_bits: int = FILTER_BITS
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all phrases of 1 to 5 words with ``least`` occurrences, (lang, n) words per language)."""
    if not 0 < shards <= MASK_BITS:
        raise ValueError(f"{shards} shards are not 1 to {MASK_BITS}")
    content, kind = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(lang), F.lit("und"))
    dealt = docs.select(kind.alias("lang"), content.alias("text"), F.xxhash64(content, F.monotonically_increasing_id()).alias("h"))
    shard = F.pmod("h", F.lit(shards)).cast("int").alias("shard")
    place = F.pmod(F.shiftrightunsigned("h", 8), F.lit(NAMING[-1]))
    part = reduce(lambda x, low: x + (place >= low).cast("int"), NAMING[:-1], F.lit(0)).alias("part")
    texts = stage(_cut(dealt.select("lang", "text", part, shard)), "shards", by="shard")
    totals, step, every, recent = None, 0, None, None
    while step < shards or recent is not None:
        shard = texts.where(F.col("shard") == step % shards)
        merged = stage(_merge(totals, _count(shard, step < shards, every, recent), step, least, shards), "phrases")
        if totals is not None:
            discard(totals)
        totals, step = merged, step + 1
        part = totals.where(F.col("reached").isNotNull() & (F.col("b").bitwiseAND(F.lit(KIND)) < LONGEST))
        every, recent = _bitmaps(part, step - shards, filter_bits)
    reached = totals.where("reached IS NOT NULL")
    none = np.zeros(filter_bits // 8, np.uint8)
    every, _ = _bitmaps(reached, 0, filter_bits)
    left, met = reached, []
    for part in range(len(NAMING)):
        wanted, _ = _bitmaps(left, 0, filter_bits)
        those = texts.where(F.col("part") == part)
        named = stage(_named(those, none if every is None else every, none if wanted is None else wanted), "named")
        met.append(named.join(left.select("a", "b", "f"), ["a", "b"]).select("lang", "phrase", F.col("b").bitwiseAND(F.lit(KIND)).alias("k"), "f"))
        if part < len(NAMING) - 1:
            left = stage(left.join(named.select("a", "b"), ["a", "b"], "left_anti"), "unnamed")
    sizes = stage(texts.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    found = stage(reduce(DataFrame.unionAll, met), "frequent")
    discard(texts)
    discard(totals)
    return found, sizes


def _wide(column: str):
    return F.col(column).cast("decimal(15,0)")


def collocations(
    docs: DataFrame, least: int = 100, top: int = 2000, cover: int = 100, text: str = "text", lang: str = "lang",
    shards: int = SHARDS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language, by the score of their weakest cut.

    A phrase goes if a longer one that holds it occurs at least ``cover`` percent as often.
    """
    found, sizes = frequent_phrases(docs, least, text, lang, shards, filter_bits)
    candidates = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "*", F.expr("substring_index(phrase, ' ', cut)").alias("first"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest")
    )
    cuts = stage(cuts, "cuts")
    for part, name in (("first", "l"), ("rest", "r")):
        per_key = found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        met = cuts.groupBy("lang", part).agg(F.count("*").alias("__rows"))
        cuts = stage(lookup_join(cuts, per_key, ["lang", part], "__rows", counts=stage(met, "parts")), "cuts")
    cuts = cuts.join(F.broadcast(sizes), "lang")  # one row a language
    thousand = F.lit(1000).cast("decimal(4,0)")
    score = F.call_function("div", thousand * _wide("a") * _wide("n"), _wide("l") * _wide("r"))
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("w")
    ).select("lang", "phrase", "a", "n", "w.score", "w.l", "w.r")
    parts = F.split("phrase", " ", -1)
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(parts, i, m), " ")),
    ))
    longer = candidates.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("__f"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("__f").alias("__f"))
    covered = F.lit(100) * F.col("__f") >= F.lit(cover) * F.col("a")
    left = weakest.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("__f")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    slice_ = F.pmod(F.xxhash64("phrase"), F.lit(SLICES))
    near_top = F.row_number().over(Window.partitionBy("lang", slice_).orderBy(*order))
    left = left.withColumn("__nth", near_top).where(F.col("__nth") <= top).drop("__nth")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return left.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
