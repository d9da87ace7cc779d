import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from contactloom.llm.passages import cut, drop_repeated_passages, runs

from .conftest import HARD


def plain_words(rows, least):
    """{(doc_id, text): words left}, by a look at every window of every document in order."""
    def signed(text):
        return (xxhash.xxh64_intdigest(text.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)

    docs = sorted({(i is None, i, signed(t or ""), t or "") for i, t in rows})
    first, out = {}, {}
    for d, (_, name, _, text) in enumerate(docs):
        words, gone = text.encode().split(), set()
        for i in range(len(words) - least + 1):
            at = first.setdefault(tuple(words[i : i + least]), (d, i))
            if at != (d, i):
                gone.update(range(max(i, at[1] + least) if at[0] == d else i, i + least))
        out[name, text] = [w.decode() for n, w in enumerate(words) if n not in gone]
    return out


def test_runs_depend_on_their_words_only():
    words = np.array([5, 6, 7, 8, 9] * 40, np.uint64)
    for n in (1, 2, 7, 25, 50):
        got = runs(words, n)
        assert len(got) == 201 - n and (got[:-5] == got[5:]).all() and len(set(got.tolist())) == 5
    assert len(runs(words[:3], 4)) == 0


@pytest.mark.parametrize("seed,least", [(1, 50), (2, 7), (3, 8)])
def test_passages_against_plain(spark, documents, seed, least):
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(9999)}é" for _ in range(rng.randrange(least - 2, 3 * least))] for _ in range(8)] + [["a"] * 3 * least]
    rows = []
    for i in range(80):
        own = []
        for _ in range(rng.randrange(5)):
            own += rng.choice(passages)[rng.randrange(3) :] + [f"own{rng.random()}"] * rng.randrange(3)
        rows.append((i * 7 % 80, "".join(w + rng.choice([" ", " ", "\t", "\n"]) for w in own)))
    rows += [(None, rows[3][1]), (5, rows[9][1]), rows[4]]
    got = drop_repeated_passages(documents(rows), least=least).collect()
    want = plain_words(rows, least)
    assert len(got) == len(rows) and any(r.cut for r in got)
    assert {(r.doc.doc_id, r.doc.text): r.text.split() for r in got} == want
    assert all(r.cut or r.text == r.doc.text for r in got)


def test_blanks_around_a_cut():
    assert cut("a b  c d\ne", [1], [3]) == "a d\ne"
    assert cut("a b c\n\nd é", [1, 2], [2, 3]) == "a \n\nd é"
    assert cut("é b c", [0, 1], [2, 3]) == ""


def test_hard_rows_and_empty_table(spark, documents):
    got = drop_repeated_passages(documents(HARD)).collect()
    assert len(got) == len(HARD)
    assert {r.text for r in got if r.cut} == {"word " * 50 + "end"}
    assert drop_repeated_passages(documents([])).count() == 0


def test_the_pipeline_cuts_passages_inside_lines(spark, documents, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one begins {passage} and ends"), (2, f"two\nhas other words {passage}\nbelow"), (3, passage)]
    docs = documents(rows).select(*corpus_pipeline.COLUMNS)
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: "two\nhas other words \nbelow"}
    assert all(r.n_chars == len(r.text) for r in got.values())
