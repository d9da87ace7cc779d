import math
import zlib
from collections import Counter, defaultdict

import pytest

from contactloom.llm.mixing import mix, repeat_by_mix, source_targets
from contactloom.llm.sharding import place, ring, shard_documents

from .conftest import HARD


def test_ring_points_stay_when_a_shard_comes():
    assert set(ring(16)) < set(ring(17))


def test_place_against_plain_bounded_loads():
    cells = [(a, s, (a * 7 + s * 13) % 50 + 1, 1 + (a + s) % 3) for a in range(32) for s in range(20)]
    placed = place(cells, 4, virtual=8, slack=0.01)
    total = sum(c[2] for c in cells)
    capacity = math.ceil(total * 1.01 / 4)
    owners = [s for _, s in ring(4, 8)]
    room, sizes = [capacity] * 4, {(a, s): size for a, s, size, _ in cells}
    for arc, part, shard, home, hops, _ in placed:
        clockwise = list(dict.fromkeys(owners[(arc + i) % 32] for i in range(32)))
        fits = [s for s in clockwise if room[s] >= sizes[arc, part]]
        assert home == clockwise[0]
        assert shard == (fits[0] if fits else max(range(4), key=lambda s: room[s]))
        if fits:
            assert hops == clockwise.index(shard)
        room[shard] -= sizes[arc, part]


def test_shards_are_balanced_and_slots_gapless(spark, documents):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(3000)]
    found = shard_documents(documents(rows), 16).collect()
    assert len(found) == 3000
    load, slots = Counter(), defaultdict(list)
    for r in found:
        text = rows[r.doc_id][1].encode()
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(load.values()) / 16
    assert max(load.values()) <= mean * 1.001 + 1 and min(load.values()) > mean * 0.97
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_third_of_all_rows_is_one_document(spark, documents):
    rows = [(7, "copy")] * 1000 + [(i, "text %d" % i) for i in range(100, 2100)]
    load = Counter()
    for r in shard_documents(documents(rows), 8).collect():
        load[r.shard] += r.size
    assert max(load.values()) < 1.01 * min(load.values()) + 50


def test_hard_rows_and_empty_table(spark, documents, queried):
    rows = queried("op1_ring", documents=documents(HARD))
    assert len(rows) == len(HARD)
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t in HARD)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert shard_documents(documents([]), 16).count() == 0


def plain_targets(sizes):
    """Excess is reshared by weight, source by source, until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, capped = dict.fromkeys(names, 0.0), set()
    left = float(sum(sizes.values()))
    while left > 1e-9 and len(capped) < len(names):
        free = [s for s in names if s not in capped]
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in free:
            target[s] += share * weight[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                capped.add(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 10, "b": 10, "c": 1000}, {"b": 5, "a": 0, None: 90, "é": 3, "z": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_comes_near_its_targets(spark, documents):
    rows = [(i, "w " * (i * 31 % 40), f"s{i % 7}" if i % 3 else "hot") for i in range(4000)]
    got = mix(documents(rows)).collect()
    sums, target, largest = Counter(), {}, Counter()
    for r in got:
        assert r.size == i_size(rows[r.doc_id][1]) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sums[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += i_size(text)
    assert target == pytest.approx(plain_targets(sizes))
    assert all(abs(sums[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(documents(rows, 5)).collect()))


def i_size(text):
    return len((text or "").encode().split())


def test_mix_splits_copies_of_one_document(spark, documents):
    rows = [(1, "a b c d e", "x")] * 600 + [(i, "a b", "y") for i in range(10, 700)]
    got = mix(documents(rows)).collect()
    sums = Counter()
    for r in got:
        sums[r.source] += r.taken
    assert all(abs(sums[r.source] - r.target) <= 3 for r in got)
    given = repeat_by_mix(documents(rows)).collect()
    assert Counter(r.source for r in given) == {s: sum(r.copies for r in got if r.source == s) for s in "xy"}


def test_mix_hard_rows_and_empty_table(spark, documents, queried):
    rows = queried("op5_mixing", documents=documents([(*r, None if r[0] == 5 else f"s{(r[0] or 0) % 3}") for r in HARD]))
    assert len(rows) == len(HARD)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mix(documents([])).count() == 0
