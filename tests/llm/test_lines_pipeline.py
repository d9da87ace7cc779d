import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from contactloom.llm.line_runs import drop_repeated_lines, stretches
from contactloom.llm.quality_gate import judge
from contactloom.llm.simhash import fingerprint

from .conftest import HARD


def test_stretches():
    import numpy as np

    assert stretches(np.array([3, 0, 2, 5]), 5) == [[3], [4], [4], [4]]
    assert stretches(np.array([1, 1]), 5) == [[], []]


def plain_removed(rows, least=50):
    """{doc_id: numbers of lines}: every run of lines with enough words that occurs earlier."""
    docs = sorted({(i is None, i, xxhash.xxh64_intdigest((t or "").encode(), 42) - (1 << 63), t or "") for i, t in rows})
    lines = [t.split("\n") for *_, t in docs]
    seen, gone = set(), [set() for _ in docs]
    for d, own in enumerate(lines):
        words = [len(x.encode().split()) for x in own]
        fresh = []
        for i in range(len(own)):
            for e in range(i + 1, len(own) + 1):
                if sum(words[i:e]) >= least:
                    run = tuple(own[i:e])
                    if run in seen:
                        gone[d].update(range(i, e))
                    fresh.append((i, run))
                    seen.add(run)
                    if sum(words[i + 1 : e]) >= least and sum(words[i : e - 1]) >= least:
                        break
        del fresh
    return {(d[1], d[3]): sorted(g) for d, g in zip(docs, gone, strict=True)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_lines_against_plain(spark, documents, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 0, 1, 2, 3, 5, 9, 20, 49, 50, 60)]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(1, 40))] for _ in range(6)]
    rows = []
    for i in range(120):
        own = []
        for _ in range(rng.randrange(4)):
            own += rng.choice(runs)[: rng.randrange(1, 60)]
            own += [f"only {i} {rng.random()}"] * rng.randrange(2)
        rows.append((i * 7 % 120, "\n".join(own)))
    want = plain_removed(rows)
    got = {(r.doc.doc_id, r.doc.text): r for r in drop_repeated_lines(documents(rows)).collect()}
    assert {k: r.removed for k, r in got.items()} == want
    for (_, text), r in got.items():
        assert r.text == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in set(r.removed))
        assert (r.n_lines, r.n_removed) == (len(text.split("\n")), len(r.removed))


def test_a_hot_line_and_long_copies(spark, documents):
    body = "\n".join(f"line {i} " + "w " * (i % 4) for i in range(300))
    rows = [(i, "\n".join(["hot"] * 30 + [f"own {i}"])) for i in range(300)] + [(1000 + i, body) for i in range(5)]
    got = {r.doc.doc_id: r for r in drop_repeated_lines(documents(rows)).collect()}
    assert all(got[i].n_removed == 0 for i in range(300)) and got[1000].n_removed == 0
    assert all(got[1000 + i].n_removed == 300 and got[1000 + i].text == "" for i in range(1, 5))


def test_line_runs_hard_rows_and_empty_table(spark, documents, queried):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [*HARD, (50, f"start\n{passage}\nend"), (51, f"{passage}\n{passage}"), (52, passage), (52, passage)]
    got = queried("op6_line_runs", documents=documents(rows))
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by_id[50]["n_removed"] == 0
    assert (by_id[51]["text"], by_id[51]["n_removed"], by_id[52]["text"]) == ("", 2, "")
    assert by_id[6]["n_removed"] == 0
    assert drop_repeated_lines(documents([])).count() == 0
    nulls = drop_repeated_lines(documents([(1, None), (2, "")])).collect()
    assert {(r.doc.doc_id, r.text, r.n_lines) for r in nulls} == {(1, None, 1), (2, "", 1)}


def corpus():
    rng = random.Random(9)
    rows = [(i, "\n".join(" ".join(f"v{rng.randrange(5000)}" for _ in range(30)) for _ in range(4)), f"s{i % 4}") for i in range(400)]
    rows += [(400 + i, rows[i][1], "s1") for i in range(40)]  # copies
    rows += [(500 + i, rows[i][1].replace(" v", " v0", 1), "s2") for i in range(40, 60)]  # near copies
    rows += [(600 + i, "too short", "s0") for i in range(30)]
    return rows


def test_pipeline_stage_by_stage(spark, documents, tmp_path):
    rows = corpus() + [(i and i + 900, t) for i, t in HARD]
    docs = documents(rows).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]

    def step(name, df):
        out = stages[name](spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        return spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")

    good = step("quality rules", docs)
    kept = [(r.doc_id, r.text) for r in judge(docs, labels).where("kept").join(docs, "doc_id").collect()]
    assert Counter((r.doc_id, r.text) for r in good.collect()) == Counter(kept)
    assert not {r.doc_id for r in good.collect()} & set(range(600, 630))

    lines = step("line dedup", good)
    assert not {r.doc_id for r in lines.collect()} & set(range(400, 440))
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = step("near dedup", lines)
    texts = {r.doc_id: r.text for r in lines.collect()}
    left = {r.doc_id: r.text for r in near.collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert left.items() <= texts.items()
    for i, value in prints.items():  # every document is left or close to a smaller one
        assert i in left or any((value ^ prints[j]).bit_count() <= 2 for j in prints if j != i)
    assert not any((prints[i] ^ prints[j]).bit_count() <= 2 for i in left for j in left if i < j)

    mixed = step("mixing", near)
    assert {r.doc_id for r in mixed.collect()} <= set(left) and mixed.columns == docs.columns
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    packed = step("packing", mixed)
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    copies = Counter(r.doc_id for r in mixed.collect())
    assert all(r.n == r.m * copies[r.doc_id] for r in whole.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_pipeline_on_an_empty_table(spark, documents, tmp_path):
    documents([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
