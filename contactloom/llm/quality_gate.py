"""Quality rules with risk-controlled thresholds.

Two fixed rules reject a document outright: fewer than ``MIN_WORDS`` words, or more than
half of its words in repeated three-word windows. Every other rule compares a score of the
document with a cutoff that is chosen from labelled documents, separately in each stratum
(language). The labels are halved by a hash of the identifier, and each half proposes to the other one: for each
tolerance, the strictest cutoff of each rule that rejects at most that share of the proposing half's good documents. The
other half, the holdout, decides: an exact binomial (Clopper-Pearson) bound must prove that all rules together reject at
most ``RISK`` of the good documents: had the true rate been larger, as few rejections among the n good documents of the
holdout would have a probability below the stratum's share of ``ERROR`` (Bonferroni over strata and the two directions;
within a direction tolerances are tested in rising order until one fails, which needs no correction). So with probability
1 - ``ERROR`` no stratum loses more than ``RISK`` of its good documents to these rules. Strata with so few labels that
not even a holdout without any rejection would prove it are told by their counts alone and form one stratum together, of which
the bound holds as a whole. If that proves nothing either, its documents face the fixed rules only. Labels of documents
that fail a fixed rule do not count.

Null and empty texts have no words and are rejected. A null stratum is a stratum of its own.
Labels that are null, repeated or without a document do no harm: a document counts as good if
all its labels say so, once; different texts of one identifier each count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import text_key
from contactloom.session import stage

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
RISK = 0.02
ERROR = 0.05
TOLERANCES = [0.0, 0.0005, 0.001, 0.002, 0.004]
SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))
SMALLS = bytes(range(97, 123))
MARKS = b"!?"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_small", "n_marks"]


def _grid(low: float, high: float, steps: int) -> list[float]:
    """``steps`` cutoffs in geometric progression."""
    return [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]


#: rule: (score, cutoffs from strict to lenient). A document is rejected if its score is above the cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", _grid(0.02, 1.0, 8)),
    "marks": ("n_marks / n_words", _grid(0.05, 1.0, 6)),
    "capitals": ("n_capitals / (n_capitals + n_small + 1)", _grid(0.1, 0.9, 6)),
    "repeats": ("n_repeat_words / n_words", _grid(0.1, 0.5, 6)),
    "lines": ("n_dup_lines / n_lines", _grid(0.1, 0.9, 6)),
    "length": ("word_chars / n_words", _grid(10.0, 40.0, 5)),
}


def features(text: str | None) -> tuple[int, ...]:
    """The counts named in ``FEATURES``, over the whole text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    lines = text.split("\n")
    filled = [line for line in lines if line.strip(BLANKS)]
    plain = len(data.translate(None, SYMBOLS))
    return (
        n,
        len(text) - sum(map(text.count, BLANKS)),
        len(data) - plain,
        len(filled) - len(set(filled)),
        _repeated(words),
        len(filled),
        len(data) - len(data.translate(None, CAPITALS)),
        len(data) - len(data.translate(None, SMALLS)),
        len(data) - len(data.translate(None, MARKS)),
    )


def _repeated(words: list[bytes]) -> int:
    """Words in three-word windows found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    last = dict(zip(words, range(n), strict=True))
    ids = np.fromiter(map(last.__getitem__, words), np.int64, n)
    pairs = ids[:-2] * n + ids[1:-1]
    if n > 2_000_000:  # three numbers below n no longer fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def measure(docs: DataFrame, doc_id: str, text: str, stratum: str) -> DataFrame:
    """(doc_id, key, stratum, the ``FEATURES``), a row for each of ``docs``; key is a hash of the text."""
    kept = docs.select(
        F.col(doc_id).alias("doc_id"),
        text_key(F.col(text)).alias("key"),
        F.col(stratum).cast("string").alias("stratum"),
        F.col(text).alias("text"),
    )
    schema = kept.select("doc_id", "key", "stratum", *[F.lit(0).cast("long").alias(f) for f in FEATURES]).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([features(t.as_py()) for t in batch.column(3)], np.int64).reshape(-1, len(FEATURES))
            columns = [pa.array(found[:, i]) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=schema.names)

    return kept.mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def tail(k: int, n: int, rate: float) -> float:
    """P(X <= k) for a binomial X: n draws at ``rate``."""
    if rate <= 0 or k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def calibrate(
    measured: DataFrame,
    labels: DataFrame,
    label_id: str = "doc_id",
    label: str = "quality",
    risk: float = RISK,
    error: float = ERROR,
) -> dict[str | None, dict[str, float]]:
    """{stratum: {rule: cutoff}}: what is proven to be safe; empty where nothing is.

    What reaches the driver is, by stratum and half, how many good documents exceed how many
    cutoffs of each rule: at most one row for each combination of cutoffs.
    """
    asked = labels.select(F.col(label_id).alias("doc_id"), F.col(label).alias("good")).groupBy("doc_id").agg(
        F.min("good").alias("good")
    )
    # Texts that share an identifier share its label; each distinct one counts, however the rows were dealt.
    known = measured.where(~base_failed()).join(asked.where("good = 1"), "doc_id").dropDuplicates(["doc_id", "key", "stratum"])
    exceeded = [
        reduce(lambda a, b: a + b, [(F.expr(score) > F.lit(c)).cast("int") for c in cutoffs]).alias(rule)
        for rule, (score, cutoffs) in RULES.items()
    ]
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")
    rows = known.select("stratum", half, *exceeded).groupBy("stratum", "half", *RULES).count().collect()
    labelled = {s: [r for r in rows if r.stratum == s] for s in {r.stratum for r in rows}}
    level = error / max(1, len(labelled))
    least = labels_needed(risk, level / 2)
    short = [s for s, own in labelled.items() if min(_good(own, h) for h in (0, 1)) < least]
    parts = [([s], own) for s, own in labelled.items() if s not in short]
    if short:
        parts.append((short, [r for s in short for r in labelled[s]]))
    level = error / max(1, len(parts))
    return {s: cutoffs for members, own in parts for cutoffs in [_certified(own, risk, level)] for s in members}


def labels_needed(risk: float, level: float) -> int:
    """Good labels of which none may exceed a cutoff for it to be certified."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def _good(rows, half: int) -> int:
    return sum(r["count"] for r in rows if r.half == half)


def _certified(rows, risk: float, level: float) -> dict[str, float]:
    """{rule: cutoff}: each half proposes, the other one certifies at half the error. Tolerances are tested in rising order at the full
    level until one fails (fixed sequence: no division by their number); of both directions the one that came further counts, then the
    one whose certifying half exceeds less."""
    best, cutoffs = None, {}
    for proposing in (0, 1):
        own, others = ([r for r in rows if r.half == h] for h in (proposing, 1 - proposing))
        total = sum(r["count"] for r in others)
        for step, tolerance in enumerate(TOLERANCES):
            places = _propose(own, tolerance)
            hit = sum(r["count"] for r in others if any(_over(r, rule, at) for rule, at in places.items()))
            if tail(hit, total, risk) > level / 2:
                break
            if best is None or (step, -hit) > best:
                best = (step, -hit)
                cutoffs = {rule: RULES[rule][1][at] for rule, at in places.items()}
    return cutoffs


def _over(row, rule: str, at: int) -> bool:
    """Whether the documents of the row exceed the rule's cutoff number ``at``, counted from the strictest."""
    return row[rule] > at


def _propose(rows, tolerance: float) -> dict[str, int]:
    """{rule: number of its strictest cutoff that rejects at most this share}."""
    allowed = tolerance * sum(r["count"] for r in rows)
    places = {}
    for rule, (_, cutoffs) in RULES.items():
        for at in range(len(cutoffs)):
            if sum(r["count"] for r in rows if _over(r, rule, at)) <= allowed:
                places[rule] = at
                break
    return places


def _verdict(cutoffs: dict[str | None, dict[str, float]]) -> Column:
    """True where no cutoff of the document's stratum is exceeded."""
    fails = [
        F.col("stratum").eqNullSafe(F.lit(stratum)) & (F.expr(RULES[rule][0]) > F.lit(cutoff))
        for stratum, safe in cutoffs.items()
        for rule, cutoff in safe.items()
    ]
    return ~reduce(lambda a, b: a | b, fails, F.lit(False))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """(doc_id, key, stratum, the ``FEATURES``, base_failed, kept), a row for each of ``docs``."""
    measured = stage(measure(docs, doc_id, text, stratum), "quality")
    cutoffs = calibrate(measured, labels, risk=risk, error=error)
    failed = base_failed()
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", F.when(failed, False).otherwise(F.coalesce(_verdict(cutoffs), F.lit(True)))
    )


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept."""
    judged = judge(docs, labels, doc_id, text, stratum).where("NOT kept")
    failed = judged.select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("stratum").alias("__stratum")
    ).distinct()
    met = (
        F.col(doc_id).eqNullSafe(F.col("__id"))
        & (text_key(F.col(text)) == F.col("__key"))
        & F.col(stratum).cast("string").eqNullSafe(F.col("__stratum"))
    )
    return docs.join(failed.hint("shuffle_hash"), met, "left_anti")
