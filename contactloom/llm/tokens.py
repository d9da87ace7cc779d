"""Token ids of whole texts, by a public tokenizer file and the tokenizers library.

Both supported kinds of tokenizer cut a text into words before they look up ids, so ids of
a word do not depend on the words around it. Words repeat; each is encoded once per worker
and then looked up. New words are encoded together, as one text, whose ids are cut where words
begin or end. A text in which white space does not simply stand between two words is encoded whole.

Two kinds are told apart by the file: byte-level vocabularies whose words begin with their
space, and those that drop white space and mark the ends of words.
"""

from __future__ import annotations

import json
import os
import re
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from contactloom.llm.common import worker_state

#: Entries of the word table of a worker, which starts anew when full: about 200 MB.
TABLE = 900_000
#: New words that are encoded as one text.
TOGETHER = 2000
END = 1
#: Letters and then marks: two words to the tokenizer. An apostrophe may belong to letters after it.
_ENDED = re.compile(r"(\n?[^\W\d_]+)([!-&(-/:-@\[-`{-~]+)\Z")


class WordTokenizer:
    """Holds the words a worker has met; ``encode`` gives the ids of texts."""

    def __init__(self, path: str, entries: int = TABLE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are ordinary text
        with open(path, encoding="utf-8") as f:
            mark = json.load(f)["model"].get("end_of_word_suffix")
        self.plain = bool(mark)
        self.entries = entries
        vocabulary = self.library.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, or begin one
        for token, number in vocabulary.items():
            self.edge[number] = token.endswith(mark) if mark else token.startswith("Ġ")
        self.newline = np.zeros(len(self.edge), bool)
        if "Ċ" in vocabulary:
            self.newline[vocabulary["Ċ"]] = True
        self.table: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text ends. ``end`` is put after each text.

        Words are numbered by Arrow, looked up once per distinct word, and their ids are
        gathered by number. Texts must not be null.
        """
        if len(self.table) > self.entries:
            self.table.clear()
            self.marks.clear()
        # Without "plain", a newline takes the place of the space before a word, and the first word of
        # a text has neither. With it, blanks of ASCII are white space to every rule of the tokenizer.
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " " if self.plain else " \n"), " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        numbered = cut.flatten().dictionary_encode()
        numbers, words = numbered.indices.to_numpy().copy(), numbered.dictionary.to_pylist()
        look = self.table.get
        found = list(map(look, words))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        self._learn({words[i] for i in gaps})
        for i in gaps:
            found[i] = look(words[i])
        unknown = np.array([i for i in gaps if found[i] is None], np.int64)
        if not self.plain:
            first = numbers[at[:-1]]
            heads, which = np.unique(first, return_inverse=True)
            numbers[at[:-1]] = len(words) + which
            found += self._ids([words[i] for i in heads.tolist()])
        whole = np.zeros(0, np.int64)
        if len(unknown):
            odd = np.isin(numbers, unknown)
            whole = np.flatnonzero(np.add.reduceat(odd, at[:-1]) > 0)
            for i in unknown.tolist():
                found[i] = b""
        ids, ends = _gather(found, numbers, at)
        if len(whole):
            own = self._ids([texts[i].as_py() for i in whole.tolist()])
            ids, ends = _replace(ids, ends, whole, own)
        if end is not None:
            ids = np.insert(ids, ends, np.uint32(end))
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: set[str]) -> None:
        """Enters new words. Those that begin with more white space, or are nothing else, depend on
        what comes before them; they stay unknown, and their texts are encoded whole."""
        table, marks = self.table, self.marks
        ended, folded, simple, lined, single = [], [], set(), set(), set()
        plain = self.plain
        for word in fresh:
            if word.isalpha() and (not plain or word.isascii()):
                if plain and not word.islower():  # the tokenizer does not tell cases apart
                    folded.append(word)
                    word = word.lower()
                    if word in table:
                        continue
                simple.add(word)
                continue
            found = _ENDED.match(word)
            if found and (not plain or word.isascii() or found[1].lower().isalpha()):
                stem, mark = found.groups()
                ended.append((word, stem, mark))
                if mark not in marks:
                    marks[mark] = self._ids([mark])[0]
                if stem in table:
                    continue
                word = stem
            body = word[word[:1] == "\n" :]
            if self._letters(body):
                (simple if len(body) == len(word) else lined).add(word)
            elif plain or body and not body[0].isspace():
                single.add(word)
        single |= self._together(list(simple), "" if self.plain else " ", self.edge)
        single |= self._together(list(lined), "", self.newline)
        rest = list(single)
        table.update(zip(rest, self._ids([w if self.plain or w[:1] == "\n" else " " + w for w in rest]), strict=True))
        for word in folded:
            table[word] = table[word.lower()]
        for word, stem, mark in ended:
            table[word] = table[stem] + marks[mark]

    def _letters(self, word: str) -> bool:
        """Letters only: one word to the tokenizer, with one edge."""
        return word.isalpha() and (not self.plain or word.isascii() or word.lower().isalpha() and is_normalized("NFC", word))

    def _together(self, words: list[str], lead: str, edge: np.ndarray) -> set[str]:
        """Enters words from a few texts of many of them; gives back those whose edges don't agree."""
        failed: set[str] = set()
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        between = lead or (" " if self.plain else "")
        texts = [lead + between.join(g) for g in groups]
        for group, data in zip(groups, self._ids(texts), strict=True):
            at = np.flatnonzero(edge[np.frombuffer(data, "<u4")]) * 4
            if len(at) != len(group):
                failed.update(group)
                continue
            cuts = [0, *(at + 4).tolist()] if self.plain else [*at.tolist(), len(data)]
            self.table.update(zip(group, [data[s:e] for s, e in zip(cuts, cuts[1:])], strict=True))
        return failed


def _gather(found: list[bytes], numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words by number, in a row, and the ends of the texts whose words begin ``at``."""
    pool = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(sizes) - sizes
    own = sizes[numbers]
    upto = np.concatenate(([0], np.cumsum(own)))
    source = np.repeat(starts[numbers] - upto[:-1], own)
    source += np.arange(len(source))
    return pool[source], upto[at[1:]]


def _replace(ids: np.ndarray, ends: np.ndarray, whole: np.ndarray, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same with the ids of some texts replaced."""
    parts = np.split(ids, ends[:-1])
    for i, data in zip(whole.tolist(), own, strict=True):
        parts[i] = np.frombuffer(data, "<u4")
    return np.concatenate(parts), np.cumsum([len(p) for p in parts])


def tokenizer(path: str, entries: int = TABLE) -> WordTokenizer:
    """One per worker and file, with room for ``entries`` words."""
    loaded = worker_state().setdefault("tokenizers", {})
    if path not in loaded:
        loaded[path] = WordTokenizer(path, entries)
    loaded[path].entries = entries
    return loaded[path]


def forget() -> None:
    """Gives back the memory of the word tables of this worker."""
    worker_state().pop("tokenizers", None)
    pa.default_memory_pool().release_unused()


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
