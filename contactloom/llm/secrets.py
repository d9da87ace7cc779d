"""Secrets found by one automaton for all rules.

All rules are compiled into one deterministic automaton (``automaton.py``), which reads
every byte of a batch of texts once and says where matches of which rules end. Only
there a second automaton, of the rule read backwards, finds where the match begins: as far
left as it can, but not before the end of the rule's last match. All rules end in a run of
characters, so matches are as long as the run, and those that begin further left end first.

Base rules, in this order, are ``assign``, ``access`` and ``hex``; matches that are too short are
dropped, after they have used up their text. Further rules (``EXTRA``) add private key heads, web
tokens, and keys of well-known services. Spans are in code points, ends exclusive.

A null text has no spans. Texts are read whole; a batch is cut into buffers of about ``BUFFER``
bytes of whole texts, and one longer text has its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.automaton import (
    STOP,
    Automaton,
    backwards,
    chars,
    compile_rules,
    either,
    many,
    maybe,
    run,
    seq,
    some,
    word,
)
from contactloom.llm.common import byte_ranges, worker_state

BUFFER = 8 << 20
_VALUE = chars("A-Za-z0-9+/_.=-")
_URL64 = chars("A-Za-z0-9_-")
_NAMES = either(
    *[word(w, any_case=True) for w in ("password", "passwd", "secret", "token")],
    seq(word("api", any_case=True), maybe(chars("_")), word("key", any_case=True)),
)
_HEAD = seq(_NAMES, maybe(chars("\"'")), many(chars(" ")), chars(":="), many(chars(" ")), maybe(chars("\"'")))

BASE = ["assign", "access", "hex"]
EXTRA = ["pem", "jwt", "forge", "chat", "cloud"]
#: kind: (expression, least length, and how many of its last characters must at least have
#: ended a match, one after the other; where that is 1, short matches use up their text)
RULES: dict[str, tuple[tuple, int, int]] = {
    "assign": (seq(_HEAD, some(_VALUE)), 12, 1),
    "access": (seq(word("AKIA"), some(chars("A-Z0-9"))), 18, 14),
    "hex": (some(chars("0-9a-f")), 16, 16),
    "pem": (seq(word("-----BEGIN "), many(chars("A-Z ")), word("PRIVATE KEY"), some(chars("-"), 5)), 0, 1),
    "jwt": (seq(word("eyJ"), some(_URL64), word(".eyJ"), some(_URL64), chars("."), some(_URL64)), 40, 1),
    "forge": (seq(word("gh"), chars("pousr"), word("_"), some(chars("A-Za-z0-9"))), 40, 1),
    "chat": (seq(word("xox"), chars("abprs"), word("-"), some(chars("A-Za-z0-9-"))), 24, 1),
    "cloud": (seq(word("AIza"), some(_URL64)), 39, 35),
}
KINDS = list(RULES)


def _compiled() -> tuple[Automaton, dict[str, Automaton], Automaton]:
    """All rules together, each read backwards, and the head of ``assign``; compiled once per worker."""
    state = worker_state()
    if "secrets" not in state:
        state["secrets"] = (
            compile_rules([tree for tree, _, _ in RULES.values()], anywhere=True),
            {kind: compile_rules([backwards(tree)], anywhere=False) for kind, (tree, _, _) in RULES.items()},
            compile_rules([_HEAD], anywhere=False),
        )
    return state["secrets"]


def _longest(automaton: Automaton, data: bytes | memoryview, at: int, stop: int, step: int) -> int:
    """How far from ``at`` in direction ``step`` a match can reach before ``stop``; -1 for none."""
    state, best, count = 0, -1, 0
    table, classes, width = automaton.table, automaton.classes, automaton.n_classes
    while at != stop:
        state = int(table[state * width + int(classes[data[at]])])
        if state == automaton.dead:
            break
        at += step
        count += 1
        if automaton.accepts[state]:
            best = count
    return best


def find(texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """The spans (kind, start, end) of each text, by start and then by kind as listed."""
    together, reverse, head = _compiled()
    encoded = [(t or "").encode() for t in texts]
    stop = bytes([STOP])
    data = np.frombuffer(stop.join(encoded) + stop, np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(e) + 1 for e in encoded])))
    accepts = together.accepts[run(together, data)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for rule, kind in enumerate(KINDS):
        hit = (accepts >> np.uint32(rule) & np.uint32(1)).astype(bool)
        _, least, run_least = RULES[kind]
        ends = np.flatnonzero(hit[:-1] & ~hit[1:]) + 1
        begins = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
        ends = ends[ends - begins >= run_least]
        owners = np.searchsorted(starts, ends - 1, side="right") - 1
        floor = 0
        for end, owner in zip(ends.tolist(), owners.tolist(), strict=True):
            low = max(floor, int(starts[owner]))
            length = _longest(reverse[kind], data, end - 1, low - 1, -1)
            if length < 0:
                continue
            floor, start = end, end - length
            if kind == "assign":  # what counts is the value
                length -= _longest(head, data, start, end, 1)
            if length >= least:
                out[owner].append((kind, start - int(starts[owner]), end - int(starts[owner])))
    for i, spans in enumerate(out):
        if spans:
            if not encoded[i].isascii():
                points = np.concatenate(([0], np.cumsum((np.frombuffer(encoded[i], np.uint8) & 0xC0) != 0x80)))
                spans[:] = [(kind, int(points[s]), int(points[e])) for kind, s, e in spans]
            spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), a row for each of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    span = "array<struct<kind:string,start:int,end:int>>"
    schema = rows.select("doc_id", F.lit(None).cast(span).alias("spans")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, length in byte_ranges(batch.column(1), BUFFER):
                part = batch.slice(low, length)
                found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in find(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(search, schema)
