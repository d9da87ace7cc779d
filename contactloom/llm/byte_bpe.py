"""Byte-level BPE by a rank file: token ids of whole texts, and texts of token ids.

Texts are cut into words without a regular expression. Each code point has a class; each class is a
function between the states of a small automaton; functions are composed by an associative scan.
As all compositions form a small monoid, a function is one byte, and composing two is a look-up. The
scan runs over lanes of a buffer of many texts side by side: once to compose each lane, once over
the lanes, once to give each code point the state before it. A boundary follows from that state
and the class: before the code point, or before its predecessor (white space gives its last blank to
the word after it, and an apostrophe with "r" is only a contraction if an "e" comes next).

Words are slices of the buffer. Distinct ones are looked up in the worker's table; new ones are merged
together: all words of one length in an array, in each round one pair per word, that with the lowest
rank. Long words are merged one by one with a heap.

Of every id the byte where it ends in its text is kept, so that any range of ids can be decoded or
pointed to without the ones before.

A null text counts as empty and has no ids. Rows that repeat, or share an identifier, are encoded row by
row. Strings of special tokens are ordinary text. A very long text is one buffer of its own, about 30
bytes a code point at its peak.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import byte_ranges, worker_state

#: Bytes of text that are encoded at once.
BUFFER = 2 << 20
#: Words in the table of a worker, besides the vocabulary; it starts anew when full.
TABLE = 300_000
#: Longer words are merged one by one.
SHORT = 64
#: Lanes of a buffer.
LANES = 4096

# Classes of code points. The end stands after each text; the pad at the end of a buffer changes nothing.
SPACE, BLANK, OTHER, QUOTE, NUMBER, LETTER, ENDING, R_OR_V, E, EL, STOP, PAD = range(12)
# States: what stands before. "Begin" is also what follows a contraction.
BEGIN, LETTERS, NUMBERS, OTHERS, ONE_SPACE, ONE_BLANK, SPACES, BLANKS, QUOTED, QUOTED_R, QUOTED_L = range(11)
STATES = 11
_LETTERS = (LETTER, ENDING, R_OR_V, E, EL)
# What a step says about boundaries.
HERE, BEFORE = 1, 2


def _step(state: int, kind: int) -> tuple[int, int]:
    """(next state, boundaries) for one code point."""
    if kind == PAD:
        return state, 0
    late = 0
    if state == QUOTED:
        if kind == ENDING:
            return BEGIN, 0
        if kind == R_OR_V:
            return QUOTED_R, 0
        if kind == EL:
            return QUOTED_L, 0
        if kind in (OTHER, QUOTE):
            return OTHERS, 0
    if state in (QUOTED_R, QUOTED_L):
        if kind == (E if state == QUOTED_R else EL):
            return BEGIN, 0
        late, state = BEFORE, LETTERS  # no contraction: the quote stands alone, its letter begins a word
    if kind == STOP:
        return BEGIN, HERE | late
    if kind in (SPACE, BLANK):
        one, more = (ONE_SPACE, SPACES) if kind == SPACE else (ONE_BLANK, BLANKS)
        if state in (ONE_SPACE, ONE_BLANK, SPACES, BLANKS):
            return more, 0
        return one, HERE | late
    if state in (SPACES, BLANKS):
        late = BEFORE
    joined = state in (ONE_SPACE, SPACES)
    if kind in _LETTERS:
        return LETTERS, late | (0 if joined or state == LETTERS else HERE)
    if kind == NUMBER:
        return NUMBERS, late | (0 if joined or state == NUMBERS else HERE)
    if joined or state == OTHERS:
        return OTHERS, late
    return (QUOTED if kind == QUOTE else OTHERS), late | HERE


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of a class, product of two elements, state after an element from "begin" on, boundaries of
    (state, class)). The elements are all functions that classes compose to; 0 is the identity."""
    steps = [[_step(s, k) for s in range(STATES)] for k in range(PAD + 1)]
    makers = [tuple(to for to, _ in row) for row in steps]
    elements = {tuple(range(STATES)): 0}
    queue = list(elements)
    for one in queue:
        for made in makers:
            both = tuple(made[s] for s in one)
            if both not in elements:
                elements[both] = len(elements)
                queue.append(both)
    if len(queue) > 255:
        raise AssertionError("too many functions for one byte")
    product = np.array([[elements[tuple(b[s] for s in a)] for b in queue] for a in queue], np.uint8)
    of_class = np.array([elements[m] for m in makers], np.uint8)
    after = np.array([e[BEGIN] for e in queue], np.uint8)
    cuts = np.array([[steps[k][s][1] for k in range(PAD + 1)] for s in range(STATES)], np.uint8)
    return of_class, product, after, cuts


def states_before(kinds: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The state before each code point, by a scan over compositions of functions."""
    of_class, product, after, _ = monoid()
    width = max(1, -(-len(kinds) // lanes))
    padded = np.full(width * -(-len(kinds) // width), PAD, np.uint8)
    padded[: len(kinds)] = kinds
    # Lanes stand side by side, so that each step reads one row.
    items = np.ascontiguousarray(of_class[padded].reshape(-1, width).T)
    flat, size = product.ravel(), len(product)
    whole = np.zeros(items.shape[1], np.intp)
    for row in items:  # each lane's function
        whole = flat[whole * size + row].astype(np.intp)
    shift = 1
    while shift < len(whole):  # functions of all lanes up to each
        whole[shift:] = flat[whole[:-shift] * size + whole[shift:]]
        shift *= 2
    upto = np.concatenate(([0], whole[:-1])).astype(np.intp)
    out = np.empty(items.shape, np.uint8)
    for i, row in enumerate(items):
        out[i] = after[upto]
        upto = flat[upto * size + row].astype(np.intp)
    return out.T.ravel()[: len(kinds)]


def word_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a word begins at each of ``points``, in which ``STOP_POINT`` stands after each text."""
    kinds = classes[points]
    cuts = monoid()[3].ravel()[states_before(kinds).astype(np.int16) * (PAD + 1) + kinds]
    starts = (cuts & HERE) > 0
    starts[:-1] |= (cuts[1:] & BEFORE) > 0
    return starts


#: Stands for the end of a text in an array of code points: no code point.
STOP_POINT = 0x110000


def code_point_classes() -> np.ndarray:
    """The class of each code point (and of ``STOP_POINT``), by the Unicode version of the tokenizer library."""
    import tiktoken

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], "<u4")
    every = points.tobytes().decode("utf-32-le")
    single = {bytes([i]): i for i in range(256)}
    out = np.full(STOP_POINT + 1, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        library = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        out[np.frombuffer(bytes(library.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
    for letters, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", ENDING), ("rv", R_OR_V), ("e", E), ("l", EL)):
        out[[ord(c) for c in letters]] = kind
    out[STOP_POINT] = STOP
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe:
    """Holds the words a worker has met; ``encode`` gives the ids of texts, ``decode`` the bytes of ids."""

    def __init__(self, path: str, entries: int = TABLE):
        self.ranks = read_ranks(path)
        self.entries = entries
        self.classes = code_point_classes()
        self.known = {token: np.uint32(rank).tobytes() for token, rank in self.ranks.items()}
        self.table: dict[bytes, bytes] = {}
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        tokens = sorted(self.ranks.items(), key=lambda item: item[1])
        highest = tokens[-1][1] + 1
        sizes = np.zeros(highest, np.int64)
        sizes[[rank for _, rank in tokens]] = [len(token) for token, _ in tokens]
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.pool = np.frombuffer(b"".join(token for token, _ in tokens), np.uint8)
        pairs = {}
        for token, rank in tokens:
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_ranks = pairs
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, byte where each id ends in its text, number of ids up to the end of each
        text). Texts must not be null."""
        content = [t.encode("utf-32-le") for t in texts.to_pylist()]
        stop = np.uint32(STOP_POINT).tobytes()
        points = np.frombuffer(stop.join([*content, b""]), "<u4")
        starts = word_starts(points, self.classes)
        stops = points == STOP_POINT
        widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        widths[stops] = 0
        first = np.flatnonzero(starts & ~stops)
        upto = np.cumsum(widths, dtype=np.int64)
        text_ends = upto[stops]
        edges = np.append((upto - widths)[first], upto[-1] if len(upto) else 0)
        of_text = np.searchsorted(first, np.flatnonzero(stops))  # words up to the end of each text
        del points, widths, upto, starts
        # The texts' own bytes, cut at the words.
        own = texts.cast(pa.large_binary())
        data = pa.py_buffer(b"".join(own.to_pylist()))
        cut = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edges), data])
        numbered = cut.dictionary_encode()
        found = self._look_up(numbered.dictionary.to_pylist())
        number = numbered.indices.to_numpy().astype(np.int64)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        counts = sizes[number]
        ends = np.cumsum(counts)
        ids = pool[ranges((np.cumsum(sizes) - sizes)[number], counts)]
        of_text = np.concatenate(([0], ends))[of_text]
        bytes_upto = np.cumsum(self.sizes[ids])
        per_text = np.diff(of_text, prepend=0)
        before = np.repeat(np.concatenate(([0], text_ends[:-1])), per_text)
        return ids, bytes_upto - before, of_text

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for. Ids that are no rank are an error."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("not an id of this vocabulary")
        return self.pool[ranges(self.starts[ids], self.sizes[ids])].tobytes()

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        if len(self.table) > self.entries:
            self.table.clear()
        known, table = self.known, self.table
        found = [known.get(w) or table.get(w) for w in words]
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            for i, ids in zip(gaps, self._merge([words[i] for i in gaps]), strict=True):
                found[i] = ids
                if len(words[i]) <= SHORT:
                    table[words[i]] = ids
        return found

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words that are no tokens."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) > SHORT:
                out[i] = np.array(self._merge_long(word), "<u4").tobytes()
            else:
                by_size.setdefault(len(word), []).append(i)
        for size, which in by_size.items():
            letters = np.frombuffer(b"".join(words[i] for i in which), np.uint8).reshape(-1, size)
            ids, which = self.of_byte[letters], np.array(which)
            none = len(self.ranks) + 1 + len(self.sizes)
            while len(ids):
                pairs = ids[:, :-1] << 32 | ids[:, 1:]
                at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
                rank = np.where(self.pairs[at] == pairs, self.merged[at], none)
                best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
                lowest = rank[np.arange(len(ids)), best] if rank.shape[1] else np.full(len(ids), none)
                done = lowest == none
                for i, row in zip(which[done].tolist(), ids[done].astype("<u4"), strict=True):
                    out[i] = row.tobytes()
                ids, which, best, lowest = ids[~done], which[~done], best[~done], lowest[~done]
                if len(ids):
                    ids[np.arange(len(ids)), best] = lowest
                    column = np.arange(ids.shape[1] - 1)
                    ids = np.take_along_axis(ids, column + (column > best[:, None]), axis=1)
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """Ids of one word: pairs in a heap by rank, then by place; neighbours as linked lists."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = self.pair_ranks.get
        heap = []
        for i in range(len(ids) - 1):
            found = rank(ids[i] << 32 | ids[i + 1])
            if found is not None:
                heap.append((found, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            found, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j == len(ids) or ids[j] != right:
                continue
            ids[i], ids[j] = found, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else len(ids)
                if b < len(ids):
                    new = rank(ids[a] << 32 | ids[b])
                    if new is not None:
                        heapq.heappush(heap, (new, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out))
    return out


def coder(path: str) -> ByteBpe:
    """One per worker and file."""
    loaded = worker_state().setdefault("byte_bpe", {})
    if path not in loaded:
        loaded[path] = ByteBpe(path)
    return loaded[path]


def encode_documents(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, ends): token ids of each text, and the byte where each ends."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbers = F.array().cast("array<int>")
    schema = rows.select("doc_id", numbers.alias("ids"), numbers.alias("ends")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)
        for batch in batches:
            for low, length in byte_ranges(batch.column(1), BUFFER):
                part = batch.slice(low, length)
                ids, ends, upto = own.encode(part.column(1))
                offsets = pa.array(np.concatenate(([0], upto)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=schema.names)

    return rows.mapInArrow(encode, schema)


def digest_documents(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the decimal ids, joined by a space, and of the bytes
    they decode to. Ids are encoded, decoded and digested in the same task; they do not travel."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)
        for batch in batches:
            for low, length in byte_ranges(batch.column(1), BUFFER):
                part = batch.slice(low, length)
                ids, _, upto = own.encode(part.column(1))
                decimals, decoded = [], []
                for first, last in zip([0, *upto.tolist()], upto.tolist(), strict=False):
                    mine = ids[first:last]
                    decimals.append(hashlib.sha256(" ".join(map(str, mine.tolist())).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(mine)).hexdigest())
                columns = [part.column(0), pa.array(np.diff(upto, prepend=0)), pa.array(decimals, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(digest, schema)


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` (doc_id, ids, ...) with ``decoded``, the bytes that the ids stand for; null ids count as none."""
    kept = encoded.select("*", F.lit(b"").alias("decoded")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)
        at = kept.names.index("ids")
        for batch in batches:
            lists = batch.column(at)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            flat, upto = lists.flatten().to_numpy(), np.cumsum(sizes)
            texts = [own.decode(flat[end - size : end]) for end, size in zip(upto.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=kept.names)

    return encoded.mapInArrow(decode, kept)
