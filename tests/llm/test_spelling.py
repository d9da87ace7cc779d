import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contactloom.llm.spelling import Acceptor, near_words, variants, vocabulary
from tests.llm.conftest import HARD


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_words(rows, least=5, drop_every=199):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % drop_every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= least}


def plain(counts, times=5):
    out, forms, close = [], {}, {}
    for w, n in counts.items():
        close[w] = [v for v in counts if near(w, v)]
        best = min(close[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= times * n else None
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(close[w]), counts.get(forms[w])))
    return sorted(out)


def columns(rows):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows)


def a_vocabulary(seed, size=400, alphabet="abé"):
    pick = random.Random(seed)
    words = {"".join(pick.choice(alphabet) for _ in range(pick.randint(6, 8))) for _ in range(size)}
    return {w: pick.choice([5, 6, 30, 30, 200, 1000]) for w in words}


@pytest.mark.parametrize("part_words", [3, 40, 20_000])
def test_every_partition_gives_the_same(spark, part_words):
    counts = a_vocabulary(part_words)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = [r.asDict() for r in variants(words, part_words=part_words).collect()]
    assert columns(found) == plain(counts)
    assert sum(n for *_, n, _ in plain(counts)) > 400


def test_short_words_and_deep_prefixes(spark):
    counts = dict.fromkeys(["a", "ab", "b", "abc", "aab", "aaab", "abab", "x" * 3000, "x" * 2999, "x" * 2998 + "yx", "ba"], 7)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    have = {r.word: r.n_near for r in near_words(words, part_words=2).collect()}
    assert have == {w: k for w in counts if (k := sum(near(w, v) for v in counts))}


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("in", "out", "up") for b in ("ward", "wards", "going"))
    acceptor = Acceptor(words)
    assert len(acceptor.arcs) < sum(map(len, words)) / 3
    assert sorted(acceptor.common(acceptor.start, acceptor.start)) == words
    assert sorted(map(sorted, acceptor.pairs(""))) == [[a + "ward", a + "wards"] for a in ("in", "out", "up")]


def test_query(documents, queried):
    pick = random.Random(2)
    stems = ["connection", "conection", "connections", "Ärgernis", "argument", "arguments", "kettle", "kettles", "kéttle"]
    rows = [(i, ", ".join(pick.choices(stems, [90, 3, 12, 20, 40, 6, 30, 3, 2], k=60))) for i in range(200)] + HARD
    counts = plain_words(rows)
    found = queried("op13_spelling", documents=documents(rows))
    assert columns(found) == plain(counts)
    assert any(r["form"] for r in found)


def test_dropped_code_points(documents):
    rows = [(i, "lettering mattress") for i in range(1500)]
    have = {r.word: r.n for r in vocabulary(documents(rows), least=1, drop_every=199).collect()}
    assert have == plain_words(rows, least=1)
    assert len(have) > 5


def test_chains(spark):
    counts = {"abcdefgh": 5 * 5**6, "abcdefg": 5 * 5**5, "abcdef": 5 * 5**4, "abcde": 5 * 5**3, "abcd": 5 * 25, "abc": 25, "ab": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r.root for r in variants(words).collect()} == {"abcdefgh"}


def test_empty(spark, documents):
    none = vocabulary(documents([(1, None), (2, ""), (None, "one two")]))
    assert variants(none).count() == 0
    assert variants(spark.createDataFrame([], "word string, n long")).select(F.count("*")).first()[0] == 0
