"""Spelling variants: words one edit away from a more frequent word.

The vocabulary is an acceptor; composed with a transducer that makes one edit, and with the acceptor
again, it accepts the pairs of near words. A pair is enumerated at the state where its words part: both
come from the start to that state, one edit leads to two states, and from these both read the same rest.
Two words part at one place only, so each pair is found once.

The composed machine is enumerated in partitions of its initial states. Where a prefix has more words than
a partition may hold, it is unfolded: the edits at its end lead to pairs of words with the same prefix and
the same rest, which meet in a shuffle (as many as the alphabet has letters, and one more, at most), and the
longer prefixes go on, from where their words part. The empty prefix is always unfolded. Below a prefix with few enough words, a task
builds the minimised acceptor of these words and enumerates the composition; what two states have in common
and the edits at a state are computed once per state, however many words lead through it.

Null texts have no words; a null identifier counts as empty. Rows that repeat count each time. Words may be
of any length. Without words the result is empty.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.session import stage

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words below a prefix that one task enumerates.
PART_WORDS = 20_000


def vocabulary(
    docs: DataFrame, shortest: int = 6, least: int = 5, drop_every: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(word, n): runs of letters, lower-cased in ASCII, of ``shortest`` code points that occur ``least`` times. With
    ``drop_every``, one of so many runs of a document loses a code point first, chosen by a checksum."""
    lowered = F.translate(F.col(text), UPPER, LOWER)
    runs = F.filter(F.split(lowered, f"[^{LETTERS}]+", -1), lambda w: F.length(w) >= shortest)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    word = F.col("word")
    if drop_every:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        place = F.pmod("h", F.length("word")).cast("int")
        without = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.length("word")))
        word = F.when(F.pmod("h", F.lit(drop_every)) == 0, without).otherwise(word)
    counted = rows.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


class Acceptor:
    """The minimised acceptor of sorted distinct words: arcs and finality per state."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._register: dict[tuple, int] = {}
        open_arcs, open_final = [{}], [False]  # the states along the last word, not yet complete
        last = ""
        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            self._close(open_arcs, open_final, last, same)
            for _ in word[same:]:
                open_arcs.append({})
                open_final.append(False)
            open_final[-1] = True
            last = word
        self._close(open_arcs, open_final, last, 0)
        self.start = self._state(open_arcs[0], open_final[0])
        self._common: dict[tuple[int, int], list[str]] = {}
        self._edits: dict[int, list[tuple[str, str]]] = {}

    def _close(self, open_arcs: list[dict], open_final: list[bool], word: str, depth: int) -> None:
        while len(open_arcs) > depth + 1:
            state = self._state(open_arcs.pop(), open_final.pop())
            open_arcs[-1][word[len(open_arcs) - 1]] = state

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if key not in self._register:
            self._register[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self._register[key]

    def common(self, one: int, two: int) -> list[str]:
        """What is accepted from both states."""
        key = (one, two) if one < two else (two, one)
        if key not in self._common:
            out, todo = [], [(one, two, "")]
            while todo:
                s, t, read = todo.pop()
                if self.final[s] and self.final[t]:
                    out.append(read)
                others = self.arcs[t]
                todo += [(to, others[c], read + c) for c, to in self.arcs[s].items() if c in others]
            self._common[key] = out
        return self._common[key]

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of rests from ``state`` on that one edit of the first code point makes equal."""
        if state not in self._edits:
            arcs, out = list(self.arcs[state].items()), []
            for i, (a, to) in enumerate(arcs):
                for b, other in arcs[i + 1 :]:
                    out += [(a + rest, b + rest) for rest in self.common(to, other)]
                # One of the words lacks the code point; if its rest began with it, they would part later.
                out += [(a + rest, rest) for rest in self.common(to, state) if rest[:1] != a]
            self._edits[state] = out
        return self._edits[state]

    def pairs(self, prefix: str) -> Iterator[tuple[str, str]]:
        """All near pairs of words that part at the end of ``prefix`` or later."""
        state = self.start
        for c in prefix:
            state = self.arcs[state][c]
        todo = [(prefix, state)]
        while todo:
            read, state = todo.pop()
            for one, two in self.edits(state):
                yield read + one, read + two
            todo += [(read + c, to) for c, to in self.arcs[state].items()]


def _best(found: dict[str, list], word: str, other: str, n: int) -> None:
    mine = found[word]
    mine[0] += 1
    if mine[1] is None or (-n, other) < (-mine[1], mine[2]):
        mine[1], mine[2] = n, other


def _inside(parts: DataFrame, tasks: int) -> DataFrame:
    """(word, near, best (less, word)) from the pairs inside each prefix of parts (prefix, word, n)."""

    def enumerate_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((p, w, n) for f in frames for p, w, n in zip(f["prefix"], f["word"], f["n"], strict=True))
        for prefix, group in groupby(rows, key=lambda row: row[0]):
            counts = {word: n for _, word, n in group}
            if len(counts) < 2:
                continue
            found: dict[str, list] = defaultdict(lambda: [0, None, None])
            for one, two in Acceptor(list(counts)).pairs(prefix):
                _best(found, one, two, counts[two])
                _best(found, two, one, counts[one])
            if found:
                near, n, form = zip(*found.values(), strict=True)
                yield pd.DataFrame({"word": list(found), "near": near, "n": n, "form": form})

    dealt = parts.repartition(tasks, "prefix").sortWithinPartitions("prefix", "word")
    found = dealt.select("prefix", "word", "n").mapInPandas(enumerate_pairs, "word string, near long, n long, form string")
    return found.select("word", "near", F.struct((-F.col("n")).alias("less"), F.col("form").alias("word")).alias("best"))


def _unfolded(nodes: DataFrame) -> DataFrame:
    """The same from the pairs of nodes (word, n, depth) that part right after ``depth`` code points."""
    depth = F.col("depth")
    prefix = F.substring("word", F.lit(1), depth)
    without = F.struct(F.substring("word", depth + 2, F.length("word")).alias("rest"), F.substring("word", depth + 1, F.lit(1)).alias("c"))
    whole = F.struct(F.substring("word", depth + 1, F.length("word")).alias("rest"), F.lit("").alias("c"))
    ways = F.when(F.length("word") > depth, F.array(whole, without)).otherwise(F.array(whole))
    rows = nodes.select("word", "n", prefix.alias("prefix"), F.explode(ways).alias("way")).select("word", "n", "prefix", "way.*")
    one = F.struct((-F.col("n")).alias("less"), "word", "c")
    groups = rows.groupBy("prefix", "rest").agg(F.collect_list(one).alias("all")).where(F.size("all") > 1)
    # At most one word for each code point, and one without.
    first = F.substring("rest", 1, 1)

    def near(mine, other):
        # A word that lacks the code point parts later from one whose code point its rest begins with.
        later = ((mine.c == "") & (other.c == first)) | ((other.c == "") & (mine.c == first))
        return (mine.word != other.word) & ~(later & (first != ""))

    each = F.transform("all", lambda mine: F.struct(mine.word.alias("word"), F.filter("all", lambda other: near(mine, other)).alias("near")))
    found = groups.select(F.inline(each)).where(F.size("near") > 0)
    best = F.array_min(F.transform("near", lambda o: F.struct(o.less.alias("less"), o.word.alias("word"))))
    return found.select("word", F.size("near").cast("long").alias("near"), best.alias("best"))


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n_near, best): how many of words (word, n), which are distinct, are one edit away, and the most frequent
    of them as (less, word), less being its count below zero; the smallest of equals. Words without any are left out."""
    spark = words.sparkSession
    total = words.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // part_words))
    found, rest = [], words.withColumn("depth", F.lit(0))
    while True:
        found.append(stage(_unfolded(rest), "unfolded"))
        # A word that ends here has parted from all others.
        rest = rest.where(F.length("word") > F.col("depth"))
        rest = rest.select("word", "n", F.substring("word", F.lit(1), F.col("depth") + 1).alias("prefix"))
        sizes = rest.groupBy("prefix").agg(F.count("*").alias("words"), F.min("word").alias("low"), F.max("word").alias("high"))
        # No words part before the end of what they all begin with.
        same = F.filter(
            F.sequence(F.lit(1), F.least(F.length("low"), F.length("high"))),
            lambda i: F.substring("low", F.lit(1), i) == F.substring("high", F.lit(1), i),
        )
        sizes = stage(sizes.where(F.col("words") > part_words).select("prefix", F.size(same).alias("depth")), "prefixes")
        large = F.broadcast(sizes)  # at most one for each part_words words
        found.append(stage(_inside(rest.join(large, "prefix", "left_anti"), tasks), "inside"))
        if sizes.isEmpty():
            break
        rest = stage(rest.join(large, "prefix").select("word", "n", "depth"), "large")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, times: int = 5, part_words: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): the form is the most frequent near word, if it occurs
    ``times`` as often; the root is what forms lead to."""
    near = near_words(words, part_words).select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.less")).alias("near_n"))
    wins = F.col("near_n") >= F.lit(times) * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(wins, F.col("near")).alias("form"), F.when(wins, F.col("near_n")).alias("form_n"),
    )
    found = stage(found, "forms")
    # Counts grow by ``times`` with each form, so chains are short, and halved in each round.
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        roots = stage(roots, "roots")
        nexts = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if roots.join(nexts, "root", "left_semi").isEmpty():
            break
        roots = roots.join(nexts, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
