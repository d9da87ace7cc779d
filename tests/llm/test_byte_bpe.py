import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from contactloom.llm.byte_bpe import ByteBpe, decode_documents, encode_documents, read_ranks, states_before, word_starts
from contactloom.llm.tokens import vocabulary_file
from tests.llm.conftest import HARD

RANKS = vocabulary_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return ByteBpe(RANKS)


def agree(own, library, texts):
    ids, ends, upto = own.encode(pa.array(texts, pa.string()))
    low = 0
    for text, high in zip(texts, upto.tolist(), strict=True):
        mine, content = ids[low:high], text.encode()
        assert mine.tolist() == library.encode_ordinary(text), text[:200]
        assert own.decode(mine) == content
        cuts = [0, *ends[low:high].tolist()]
        assert all(content[cuts[i] : cuts[i + 1]] == own.decode(mine[i : i + 1]) for i in range(min(len(mine), 300)))
        assert cuts[-1] == len(content)
        low = high


def test_random_texts(own, library):
    pick = random.Random(3)
    parts = [*"'''streelvldm  \n\taBé日12!?-🎉\x1ć½", "'re", "'ve", "'ll", "  ", " '", "\r\n", " ", "\x00", "<|endoftext|>"]
    for _ in range(60):
        agree(own, library, ["".join(pick.choice(parts) for _ in range(pick.randint(0, 40))) for _ in range(100)])


def test_long_runs(own, library):
    agree(own, library, ["a" * 20_000, "ab" * 500, " " * 3000 + "x", "x" + "\n" * 3000, "日本語" * 1000, "'" * 500 + "s", "", "word " * 40_000])


def test_every_code_point(own, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    agree(own, library, ["".join(f"a{chr(c)} {chr(c)}1'{chr(c)}" for c in points[i : i + 4000]) for i in range(0, 0x14000, 4000)])


def test_scan_does_not_depend_on_lanes(own):
    points = np.frombuffer("I've  been 'there, we'll  say'r \n".encode("utf-32-le"), "<u4")
    kinds = own.classes[points]
    for lanes in (1, 2, 3, 7, 1000):
        assert (states_before(kinds, lanes) == states_before(kinds, 1)).all()
    assert len(word_starts(points, own.classes)) == len(points)


def test_ids_that_are_none(own):
    with pytest.raises(ValueError):
        own.decode(np.array([60_000]))


def test_query(documents, queried, library):
    rows = queried("op12_byte_bpe", documents=documents(HARD))
    want = []
    for doc_id, text, *_ in HARD:
        ids = library.encode_ordinary(text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (text or "").encode())]
        want.append((doc_id, len(ids), *digests))
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))) for r in rows)


def test_tables_of_ids(documents, library):
    rows = decode_documents(encode_documents(documents(HARD), RANKS), RANKS).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in HARD)
    for row in rows:
        assert row.ids == library.encode_ordinary(row.decoded.decode())
        assert row.ends[-1:] == [len(row.decoded)][: len(row.ids)]


def test_empty(documents, spark):
    none = documents([(1, "x")]).where("doc_id = 2")
    assert decode_documents(encode_documents(none, RANKS), RANKS).count() == 0
