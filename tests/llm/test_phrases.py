import random
import re
from collections import Counter

import numpy as np
import pytest

from contactloom.llm import phrases
from contactloom.llm.phrases import collocations, distinct, frequent_phrases
from tests.llm.conftest import HARD


def plain_counts(rows):
    """{lang: (n, {words: f})}"""
    out = {}
    for text, lang in rows:
        n, f = out.setdefault(lang or "und", [0, Counter()])
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            out[lang or "und"][0] += len(words)
            for k in range(1, 6):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return out


def plain(rows, least, top, cover=100):
    out = []
    for lang, (n, f) in plain_counts(rows).items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            if longest[p] and 100 * longest[p] >= cover * a:
                continue
            score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def run(docs, **options):
    return sorted(tuple(r) for r in collocations(docs, **options).collect())


@pytest.mark.parametrize(("shards", "cover"), [(1, 100), (4, 70)])
def test_random_texts(documents, shards, cover):
    pick = random.Random(shards)
    words = ["The", "of", "a", "a", "bé", "c-d", "日", "e'f", "g", "h"]
    texts = ["".join(pick.choice(words) + pick.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(pick.randint(0, 80))) for _ in range(120)]
    rows = [(i, t, "a", pick.choice(["en", "en", "en", "fr", None])) for i, t in enumerate(texts)]
    want = plain([(r[1], r[3]) for r in rows], 7, 40, cover)
    assert len(want) > 60
    assert run(documents(rows, 4), least=7, top=40, cover=cover, shards=shards) == want


def test_full_bitmaps_change_nothing(documents):
    pick = random.Random(5)
    rows = [(i, " ".join(pick.choice("abcdefgh") for _ in range(60))) for i in range(60)]
    want = plain([(r[1], "en") for r in rows], 6, 100)
    assert run(documents(rows), least=6, top=100, filter_bits=1 << 15) == want
    counts, _ = frequent_phrases(documents(rows), 6)
    have = {tuple(r.phrase.split(" ")): r.f for r in counts.collect()}
    assert have == {p: f for p, f in plain_counts([(r[1], "en") for r in rows])["en"][1].items() if f >= 6}


def test_hard_rows(documents):
    rows = [(*r[:2], "a", "en") for r in HARD]
    assert run(documents(rows), least=2, top=100) == plain([(r[1], "en") for r in rows], 2, 100)


def test_hot_phrase_over_many_rows(documents):
    rows = [(i, "the same long passage stands here again") for i in range(400)] + [(i, f"x{i} y{i % 7} z") for i in range(800)]
    assert run(documents(rows, 11), least=50, top=100) == plain([(r[1], "en") for r in rows], 50, 100)


def test_empty(documents):
    assert run(documents([(1, None), (2, "")])) == []
    assert run(documents([(1, "x")]).where("doc_id = 2")) == []


def test_query(documents, queried):
    rows = [(i, "one two three. four five") for i in range(120)]
    found = queried("op11_dic", documents=documents(rows))
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r[c] for c in columns) for r in found) == plain([(r[1], "en") for r in rows], 100, 2000)


def test_texts_are_cut_into_words_once(documents, monkeypatch):
    scanned = []
    for name in ("_count", "_named"):
        scan = getattr(phrases, name)
        monkeypatch.setattr(phrases, name, lambda texts, *rest, scan=scan: scanned.append(texts.columns) or scan(texts, *rest))
    rows = [(i, "one two three. four five") for i in range(12)]
    assert run(documents(rows), least=10, top=9) == plain([(r[1], "en") for r in rows], 10, 9)
    assert len(scanned) > 6 and not any("text" in columns for columns in scanned)


def test_more_words_than_16_bits_number(documents):
    rows = [(1, " ".join(f"w{i} w{i % 50} of" for i in range(70_000)))]
    assert run(documents(rows), least=1000, top=200, shards=1) == plain([(rows[0][1], "en")], 1000, 200)


@pytest.mark.parametrize("shards", [0, 13])
def test_shards_that_a_state_cannot_hold(documents, shards):
    with pytest.raises(ValueError, match="shards"):
        collocations(documents([(1, "x")]), shards=shards)


@pytest.mark.parametrize("values", [[5, 5, 5], [1 << 40, (1 << 40) + 1, 1 << 40, 7], [0, (1 << 64) - 1, (1 << 64) - 2] * 3])
def test_distinct_keys_that_share_their_high_bits(values):
    first, second = np.array(values, np.uint64), np.arange(len(values), dtype=np.int32) % 2
    places, counts = distinct(first, second)
    have = {(int(first[p]), int(second[p])): int(n) for p, n in zip(places, counts, strict=True)}
    assert have == Counter(zip(values, second.tolist(), strict=True)) and len(places) == len(have)
