"""Regular expressions compiled into one deterministic automaton over bytes.

Expressions are trees built by the few functions below. ``compile_rules`` joins the
expressions of all rules into one nondeterministic automaton that may begin anywhere,
makes it deterministic by subset construction, merges equivalent states by partition refinement,
and lays the result out as a transition array over classes of bytes that no rule tells apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Ends every text in a buffer; it occurs in no UTF-8 text and no rule matches it.
STOP = 0xFF


def chars(spec: str) -> tuple:
    """One byte of those given, e.g. ``chars("A-Za-z_")``; a dash between two is a range."""
    out, i = set(), 0
    while i < len(spec):
        if i + 2 < len(spec) and spec[i + 1] == "-":
            out.update(range(ord(spec[i]), ord(spec[i + 2]) + 1))
            i += 3
        else:
            out.add(ord(spec[i]))
            i += 1
    return ("set", frozenset(out))


def word(text: str, any_case: bool = False) -> tuple:
    return seq(*[chars(c.lower() + c.upper() if any_case else c) for c in text])


def seq(*parts: tuple) -> tuple:
    return ("seq", parts)


def either(*parts: tuple) -> tuple:
    return ("or", parts)


def maybe(part: tuple) -> tuple:
    return ("or", (part, ("seq", ())))


def many(part: tuple) -> tuple:
    """Any number of times."""
    return ("many", part)


def some(part: tuple, least: int = 1) -> tuple:
    """At least that many times."""
    return seq(*[part] * least, many(part))


def backwards(tree: tuple) -> tuple:
    """The expression that matches the same strings read from their ends."""
    kind, inner = tree
    if kind == "seq":
        return ("seq", tuple(backwards(p) for p in reversed(inner)))
    if kind == "or":
        return ("or", tuple(backwards(p) for p in inner))
    return ("many", backwards(inner)) if kind == "many" else tree


class _Nfa:
    def __init__(self):
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Adds an expression that begins in ``start``; the state in which it ends."""
        kind, inner = tree
        if kind == "set":
            end = self.state()
            self.steps[start].append((inner, end))
            return end
        if kind == "seq":
            for part in inner:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in inner:
                branch = self.state()
                self.free[start].append(branch)
                self.free[self.add(part, branch)].append(end)
            return end
        loop = self.state()
        self.free[start].append(loop)
        self.free[self.add(inner, loop)].append(loop)
        end = self.state()
        self.free[loop].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for other in self.free[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """State 0 is the start. ``classes``: byte -> class; ``table``: state * n_classes + class -> next state;
    ``accepts``: state -> bit mask of the rules that match here; ``dead``: no rule can match any more, or -1."""

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    n_classes: int
    dead: int


def compile_rules(trees: list[tuple], anywhere: bool) -> Automaton:
    """One automaton for all rules; with ``anywhere`` a match may begin at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    finals = {nfa.add(tree, start): rule for rule, tree in enumerate(trees)}
    sets = sorted({s for steps in nfa.steps for s, _ in steps}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    samples = {c: b for b, c in reversed(list(enumerate(classes.tolist())))}

    first = nfa.closure([start])
    numbers, order, table = {first: 0}, [first], []
    for states in order:
        row = []
        for c in range(len(kinds)):
            b = samples[c]
            reached = {end for s in states for accepted, end in nfa.steps[s] if b in accepted}
            target = nfa.closure(reached | {start}) if anywhere else nfa.closure(reached)
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            row.append(numbers[target])
        table.append(row)
    if anywhere:  # nothing crosses the end of a text
        for row in table:
            row[classes[STOP]] = 0
    masks = [sum(1 << finals[s] for s in states if s in finals) for states in order]
    return _minimise(classes, table, masks, not anywhere)


def _minimise(classes, table, masks, with_dead: bool) -> Automaton:
    """Merges states that no continuation tells apart."""
    group = {m: i for i, m in enumerate(dict.fromkeys(masks))}
    block = [group[m] for m in masks]
    while True:
        names: dict[tuple, int] = {}
        finer = [names.setdefault((block[s], *[block[t] for t in row]), len(names)) for s, row in enumerate(table)]
        if len(names) == len(set(block)):
            break
        block = finer
    block = finer  # numbered by first occurrence, so the start is 0
    width = len(table[0])
    merged = np.zeros((max(block) + 1, width), np.uint16)
    accepts = np.zeros(max(block) + 1, np.uint32)
    for s, row in enumerate(table):
        merged[block[s]] = [block[t] for t in row]
        accepts[block[s]] = masks[s]
    dead = -1
    if with_dead:
        stuck = [s for s in range(len(merged)) if not accepts[s] and (merged[s] == s).all()]
        dead = stuck[0] if stuck else -1
    return Automaton(classes, merged.reshape(-1), accepts, width, dead)


def run(automaton: Automaton, data: np.ndarray, lane: int = 1024) -> np.ndarray:
    """The state after each byte of ``data``, beginning in the start state.

    The bytes are cut into lanes that are stepped side by side. Each lane but the first
    guesses that it begins in the start state; where the lane before ends in another one, the
    states are put right from there until they agree again, so the result is exact.
    """
    n, width = len(data), automaton.n_classes
    kinds = automaton.classes[data]
    lanes = -(-n // lane)
    grid = np.full(lanes * lane, automaton.classes[STOP], np.uint8)
    grid[:n] = kinds
    columns = np.ascontiguousarray(grid.reshape(lanes, lane).T)
    rows = (automaton.table.astype(np.uint32) * width).astype(np.uint32)  # next state as a row of the table
    found = np.empty((lane, lanes), np.uint32)
    state = np.zeros(lanes, np.uint32)
    for i in range(lane):
        state = rows[state + columns[i]]
        found[i] = state
    states = np.ascontiguousarray(found.T).reshape(-1)[:n]
    table = automaton.table
    for k in range(1, lanes):
        before = int(states[k * lane - 1]) // width
        at = k * lane
        while before and at < n:
            before = int(table[before * width + int(kinds[at])])
            if states[at] == before * width:
                break
            states[at] = before * width
            at += 1
    return states // width
