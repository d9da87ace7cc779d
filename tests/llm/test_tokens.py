import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contactloom.llm.dac import Image, read_documents, write_ids, write_image
from contactloom.llm.packing import cut_pieces, pack, pack_documents, sequences, shortest_pack_first
from contactloom.llm.tokens import tokenizer, vocabulary_file
from contactloom.session import stage

from .conftest import HARD

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = [
    "", " ", "  ", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "\n", "a\n", "\nb", "a\r\nb\r\n", "x\u00a0y", "x \u00a0y", "x\u00a0 \ny",
    "don't we'll, x.", "1,000.5, 3.", "日本語 テスト, 、。", "ΣΑΣ ς, İstanbul İ_ İ,", "<|endoftext|> x", "a,, b.. c", "\0 x", "e\u0301, e\u0301",
    "ſ K, ẞ.", "'s 't it's, 'll.", "_a _, a_.", "H\u0331 T\u0308x, I\u0307 E\u0301A",  "a\x1cb \x1d c", "\u200d, a\u200d.", "🎉🎉 🎉, !?",
]


def plain_ids(name, text):
    from tokenizers import Tokenizer

    if name not in plain_ids.loaded:
        plain_ids.loaded[name] = Tokenizer.from_file(vocabulary_file(name))
        plain_ids.loaded[name].encode_special_tokens = True
    library = plain_ids.loaded[name]
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


plain_ids.loaded = {}


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_ids_are_those_of_the_library(name):
    rng = random.Random(11)
    parts = ["ab", "Éc", " ", "\n", "\t", ".", ",", "'s", "12", "日", "é", "\u0301", "!!", "\r", "İ", "ß", "  ", "ǅ", "Word"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    array = pa.array(["cut off", *texts]).slice(1)
    words = tokenizer(vocabulary_file(name))
    for _ in range(2):  # unknown words, then known ones
        ids, ends = words.encode(array, 1)
        got = [p.tolist() for p in np.split(ids, ends[:-1])]
        assert got == [plain_ids(name, t) for t in texts]


def test_image_gives_any_id():
    rng = np.random.default_rng(2)
    ids = [rng.choice([0, 1, 255, 256, 49407, 65535, 65536, 2**24, 2**32 - 1], n).astype("<u4") for n in (0, 1, 700, 5000, 3)]
    names = [5, None, 7, -8, 2**62]
    image = Image(write_image(names, ids))
    whole = np.concatenate(ids)
    assert image.names == names and image.ends.tolist() == np.cumsum([len(x) for x in ids]).tolist()
    for n, x in enumerate(ids):
        assert (image.document(n) == x).all()
    places = rng.permutation(len(whole))[:999]
    assert (image.get(places) == whole[places]).all()
    empty = Image(write_image([], []))
    assert empty.names == [] and len(empty.get(np.array([], np.int64))) == 0


def test_written_ids_come_back_in_order(spark, documents, queried):
    rng = random.Random(4)
    rows = [(i * 7 - 300, " ".join(rng.choice(["abc", "Zürich", "x!", "\n"]) for _ in range(rng.randrange(80)))) for i in range(400)]
    got = {r.doc_id: r for r in read_documents(write_ids(documents(rows), vocabulary_file(WORDS), image_ids=500)).collect()}
    at = 0
    for name, text in sorted(rows):
        ids = np.array(plain_ids(WORDS, text), "<u4")
        assert tuple(got[name])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_written_ids_hard_rows_and_empty_table(spark, documents, queried):
    rows = queried("op8_dac", documents=documents(HARD))
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None, None, None, 1, 1, 1, 2, 3, 4, 5, 6, 7]
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(plain_ids(WORDS, t)) for _, t in HARD)
    assert read_documents(write_ids(documents([]), vocabulary_file(WORDS))).count() == 0


def test_one_identifier_may_fill_many_ranges(spark, documents):
    rows = [(5, f"copy {i}") for i in range(300)] + [(i, "other") for i in range(100)]
    found = read_documents(write_ids(documents(rows), vocabulary_file(WORDS))).collect()
    ends = sorted((r.start, r.start + r.n_tokens) for r in found)
    assert len(found) == 400 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == sorted(r[0] for r in rows)


def test_images_do_not_depend_on_how_rows_were_dealt(spark, documents):
    rows = [(7, f"text {i % 90} of one identifier") for i in range(200)] + [(None, "x"), (None, None), (3, "y")]
    vocabulary, found = vocabulary_file(WORDS), []
    for n in (1, 3, 11):
        dealt = documents(rows).orderBy(F.rand(n)).repartition(n)
        images = write_ids(dealt, vocabulary)
        found.append((sorted(bytes(r.image) for r in images.collect()), sorted(map(tuple, read_documents(images).collect()), key=repr)))
    assert found[0] == found[1] == found[2] and len(found[0][1]) == 203


def test_patterns_use_every_piece_once():
    rng = random.Random(5)
    for width in (8, 100, 2048):
        histogram = {n: rng.randrange(1, 500) for n in rng.sample(range(1, width + 1), min(width, 60))}
        patterns = shortest_pack_first(histogram, width)
        used = defaultdict(int)
        for count, lengths in patterns:
            assert sum(lengths) <= width and count > 0
            for n in lengths:
                used[n] += count
        assert used == histogram
    assert shortest_pack_first({}) == []


def test_shortest_pack_comes_first():
    # One 6, one 5 and two 3s: the first 3 joins the 5, which is filled least, the second the 6.
    assert sorted(shortest_pack_first({6: 1, 5: 1, 3: 2}, 9)) == [(1, [5, 3]), (1, [6, 3])]


def check_packed(pieces, ids_of, width):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= width
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for name, ids in ids_of.items():
        at = 0
        for p in sorted(by_doc[name], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    return sum(p["length"] for p in pieces) / (len(by_sequence) * width)


def test_documents_are_packed_tightly(spark, documents):
    rng = random.Random(6)
    rows = [(i, "token " * rng.randrange(150)) for i in range(1500)]
    ids_of = {i: plain_ids(BYTES, t) for i, t in rows}
    pieces = [r.asDict() for r in pack_documents(documents(rows), vocabulary_file(BYTES), width=64).collect()]
    assert check_packed(pieces, ids_of, 64) > 0.98


def test_sequences_hold_their_ids(spark, documents):
    rows = [(i, "some words " * (i % 9)) for i in range(60)]
    cut = stage(cut_pieces(documents(rows), vocabulary_file(BYTES), width=16, ids=True))
    found = sequences(pack(cut, 16), 16, padding=0).collect()
    assert all(len(r.ids) == 16 and sum(r.lengths) + r.ids.count(0) == 16 for r in found)
    want = sorted(x for i, t in rows for x in plain_ids(BYTES, t))
    assert sorted(x for r in found for x in r.ids[: sum(r.lengths)]) == want


def test_packing_hard_rows_and_empty_table(spark, documents, queried):
    rows = queried("op4_packing", documents=documents(HARD))
    plain = {i: plain_ids(BYTES, t) for i, t in HARD if i in (2, 3, 4, 5, 6, 7)}
    check_packed(rows, plain, 2048)
    assert sum(r["length"] for r in rows) == sum(len(plain_ids(BYTES, t)) for _, t in HARD)
    assert pack_documents(documents([]), vocabulary_file(BYTES)).count() == 0
