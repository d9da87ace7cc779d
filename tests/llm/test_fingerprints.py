import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contactloom.llm.components import components
from contactloom.llm.merkle import changed, edited, fingerprints, likeness, tree
from contactloom.llm.simhash import fingerprint, keep_one_each, link, near_duplicates

from .conftest import HARD


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_chunks(line):
    """Chunks of a line, read character by character."""
    words, blanks = [], " \t\x0b\x0c\r"
    for ch in line:
        dense = ord(ch) >= 0x2E80
        last = words[-1] if words else ""
        body = last.rstrip(blanks)
        if ch in blanks:
            fits = last and len(last) - len(body) < 32
        else:
            fits = last and last == body and not dense and ord(last[0]) < 0x2E80 and len(last) < 32
        if fits:
            words[-1] += ch
        else:
            words.append(ch)
    found, own = [], []
    for i, word in enumerate(words):
        own.append(word)
        if hashlib.md5(word.encode()).hexdigest()[0] in "0123" or len(own) == 16 or i == len(words) - 1:
            found.append("".join(own))
            own = []
    return found


def plain_root(text):
    sections, own = [], []
    paragraphs = [sha("".join(sha(c) for c in plain_chunks(p))) for p in (text or "").split("\n")]
    for i, p in enumerate(paragraphs):
        own.append(p)
        if p[0] in "0123" or i == len(paragraphs) - 1:
            sections.append(sha("".join(own)))
            own = []
    return sha("".join(sections))


def plain_likeness(a, b):
    if a == b:
        return 1.0
    own, other = (Counter(c for p in t.split("\n") for c in plain_chunks(p)) for t in (a, b))
    total = sum(len(c) * n for held in (own, other) for c, n in held.items())
    return 2 * sum(len(c) * n for c, n in (own & other).items()) / total if total else 0.0


def test_roots_tell_texts_apart(spark, documents):
    rows = [(i, "\n".join(f"paragraph {j * (i % 7)}" for j in range(i % 30))) for i in range(200)]
    got = {r.doc_id: r.fingerprint for r in fingerprints(documents(rows)).collect()}
    assert got == {i: plain_root(t) for i, t in rows}
    texts = dict(rows)
    assert all((got[a] == got[b]) == (texts[a] == texts[b]) for a in range(60) for b in range(60))


def test_changes_are_located(spark):
    base = [f"line {i}" for i in range(40)]
    cases = [
        (base, base, None),
        (base, base[:7] + ["new"] + base[8:], (7, 7)),
        (base, base[:7] + ["x"] + base[9:], (7, 8)),
        (base, base[:20] + base[25:], (20, 24)),
        (base, ["top", *base], (0, -1)),
        (base, [*base, "end"], (40, 39)),
        (base, ["all new"], (0, 39)),
    ]
    df = spark.createDataFrame([(i, "\n".join(a), "\n".join(b)) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {
        r.i: r.w and tuple(r.w)
        for r in df.select("i", tree(F.col("a")).alias("a"), tree(F.col("b")).alias("b")).select("i", changed(F.col("a"), F.col("b")).alias("w")).collect()
    }
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_likeness_is_that_of_all_chunks(spark):
    rng = random.Random(5)
    words = ["the", "of", "a", "é", "日本", "x" * 70, "🎉", "end.", " " * 70, "\t"]
    texts = ["", "\n", "a", "日本語" * 500, "same " * 900, "same " * 900 + "other", " ".join(f"w{i}" for i in range(3000))]
    texts += ["".join(rng.choice(words) + rng.choice([" ", "", "\n", " "]) for _ in range(rng.randrange(90))) for _ in range(80)]
    pairs = [(a, b) for a in texts[:12] for b in texts[:12]]
    for text in texts:  # an edit in the middle, a moved and a repeated part, a cut end
        at = rng.randrange(len(text) + 1)
        pairs += [(text, text[:at] + " new " + text[at:]), (text, text[at:] + text[:at]), (text, text + text), (text, text[: len(text) * 3 // 4])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    trees = df.select("i", tree(F.col("a")).alias("a"), tree(F.col("b")).alias("b"))
    got = {r.i: r for r in trees.select("i", "a.root", likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    assert all(got[i].root == plain_root(a) for i, (a, _) in enumerate(pairs))
    assert [got[i].x for i in range(len(pairs))] == pytest.approx([plain_likeness(a, b) for a, b in pairs])


def test_texts_without_sentences_stay_near_their_edits(spark, documents):
    rng = random.Random(9)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (60, 400, 20_000)]
    dense = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(3000))
    rows = list(enumerate([*prose, dense, "la " * 5000]))
    got = edited(documents(rows)).collect()
    assert all(r.near_edited > 0.55 and r.near_next < 0.05 for r in got)


def test_edited_pairs_with_every_next_document(spark, documents):
    rng = random.Random(3)
    rows = [(i * 3 - 40, "".join(rng.choice("aé日🎉 .\n") for _ in range(rng.randrange(60)))) for i in range(300)]
    rows[5] = (rows[5][0], None)
    got = {r.doc_id: r for r in edited(documents(rows, 7)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for i, (name, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        want = text[: len(text) - k] + following[:k]
        r = got[name]
        assert (r.n_chars, r.edited) == (len(text), want)
        assert (r.fingerprint, r.edited_fingerprint) == (plain_root(text), plain_root(want))
        assert (r.near_edited, r.near_next) == pytest.approx((plain_likeness(text, want), plain_likeness(text, following)))


def test_merkle_hard_rows_and_empty_table(spark, documents, queried):
    rows = queried("op2_merkle", documents=documents(HARD))
    assert len(rows) == len(HARD)
    assert {r["fingerprint"] for r in rows} == {plain_root(t) for _, t in HARD}
    assert edited(documents([])).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_against_plain():
    rng = random.Random(1)
    texts = [None, "", " \x0b", "A", "a B", "A b C", "x y z", "É e É e É"]
    texts += [" ".join(rng.choice(["Wa", "be", "ci", "dü"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert fingerprint(texts[-1] * 9000) == plain_fingerprint(texts[-1] * 9000)


def plain_classes(values):
    root = dict(enumerate(values))
    label = list(range(len(values)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in root]


@pytest.mark.parametrize("small", [1, 2, 8, 1000])
def test_links_give_the_components_of_all_pairs(spark, small):
    rng = random.Random(7)
    values = {0, 1, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):  # balls around centres, so that many share a variant
            value = centre
            for _ in range(rng.randrange(6)):
                value ^= 1 << rng.choice([rng.randrange(64), rng.randrange(4)])
            values.add(value)
    values = sorted(values)
    signed = [int(np.array([v], np.uint64).view(np.int64)[0]) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in components(link(fps, small)).collect()}
    classes = plain_classes(values)
    want = {}
    for i, c in enumerate(classes):
        want.setdefault(c, []).append(signed[i])
    for members in want.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 700)] + [(900, 900), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(500, 700), 500)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_hard_rows(spark, documents, queried):
    rows = queried("op3_simhash", documents=documents(HARD))
    assert len(rows) == len(HARD)
    prints = {t: f"{plain_fingerprint(t):016x}" for _, t in HARD}
    assert sorted(r["fingerprint"] for r in rows) == sorted(prints[t] for _, t in HARD)
    empties = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(empties) == 4 and {r["component_id"] for r in empties} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 7)} >= {1}
    assert near_duplicates(documents([])).count() == 0


def test_one_of_each_group_stays(spark, documents):
    text = " ".join(f"w{i}" for i in range(400))
    near = text.replace("w200", "changed")
    rows = [(9, text), (4, near), (4, near), (12, text), (20, "quite other words here"), (None, text), (30, None), (31, "")]
    kept = keep_one_each(documents(rows))
    assert (plain_fingerprint(text) ^ plain_fingerprint(near)).bit_count() <= 2
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id != 30) == [(4, near), (20, "quite other words here")]
    assert kept.count() == 3 and set(kept.columns) >= {"id", "key", "fp"}
