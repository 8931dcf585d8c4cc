"""Counts of word pieces by a linear longest-match automaton.

Greedy longest match cuts a word into the longest piece that starts it, then the longest that continues it, and so on. The
automaton is a trie of the pieces with, for each node, a failure link and the number of pieces that are final when it is followed
(they are popped), so each byte is read once and no piece is built. Here the links are unrolled: a table gives, for each node and
byte, the next node and how many pieces were popped on the way, and all words of a batch take their steps together.

Pieces are byte strings; those for word starts and for continuations may differ. Where a vocabulary marks word ends, a marked piece
matches only up to the end of a word and any other only before it, with at least a byte after it. A word that cannot be cut counts
as one unknown piece. Words are runs of other characters than ASCII white space, of the lower-cased text.

Defined results: null, empty and blank texts have no words and no pieces; repeated rows are counted one by one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import slices
from meshloom.llm.tokens import byte_letters, default_path

END_OF_WORD = "</w>"
#: Bytes of text whose words take their steps together.
CHUNK = 8 << 20
#: So many words at most go on one by one when the others of a chunk have ended.
LAST_WORDS = 8


def load_marked(path: str | None = None) -> tuple[list[bytes], list[bytes] | None]:
    """The pieces of a byte-level vocabulary file: those without the mark of word ends, and those with it (None if none has it)."""
    with open(path or default_path(), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    inner, ends = set(), set()
    for x in vocabulary:
        word = x.removesuffix(END_OF_WORD)
        if word and all(c in letters for c in word):
            (inner if word == x else ends).add(bytes(letters[c] for c in word))
    return sorted(inner), sorted(ends) or None


def load_pieces(path: str | None = None) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, with marks of word ends taken off."""
    inner, ends = load_marked(path)
    return sorted({*inner, *(ends or [])})


class Automaton:
    """Counts the pieces of words; `starts` are pieces for word starts, `continuations` for the rest (the same if not given).

    If `ends` are given, those alone match up to the end of a word, and the others only before it.
    """

    _made: dict[str, Automaton] = {}

    def __init__(self, starts: Iterable[bytes], continuations: Iterable[bytes] | None = None, ends: Iterable[bytes] | None = None) -> None:
        child: list[dict[int, int]] = [{}]
        final, marked = [False], set()

        def grow(root: int, pieces: Iterable[bytes], end: bool = False) -> None:
            for piece in pieces:
                node = root
                for b in piece:
                    if b not in child[node]:
                        child[node][b] = len(child)
                        child.append({})
                        final.append(False)
                    node = child[node][b]
                if end:
                    marked.add(node)
                else:
                    final[node] = True

        grow(0, starts)
        rest = 0
        if continuations is not None:
            rest = len(child)
            child.append({})
            final.append(False)
            grow(rest, continuations)
        if ends is not None:
            ends = list(ends)
            for root in {0, rest}:
                grow(root, ends, end=True)
        n = len(child)
        self.dead, self.root = n, 0
        # bytes in no piece share a column
        used = sorted({b for x in child for b in x})
        self.columns = len(used) + 1
        self.column = np.zeros(256, np.int64)
        self.column[used] = np.arange(1, len(used) + 1)
        fail, pops = [-1] * n, [0] * n
        table, popped = np.full((n + 1, self.columns), n, np.int32), np.zeros((n + 1, self.columns), np.int32)
        last = np.full(n + 1, -1, np.int32)  # pieces popped at the end of the word; -1: it cannot be cut
        last[rest] = 0
        level = [0] if rest == 0 else [0, rest]
        done: set[int] = set(level)
        parent = {c: (u, b) for u, x in enumerate(child) for b, c in x.items()}
        while level:
            for v in level:
                if v in parent:
                    # where v leads if it is no piece itself: the longest piece before its last byte popped, the rest read anew
                    u, b = parent[v]
                    z, count = fail[u], pops[u]
                    while z >= 0 and b not in child[z]:
                        count += pops[z]
                        z = fail[z]
                    fail[v], pops[v] = (child[z][b], count) if z >= 0 else (-1, 0)
                    if v in marked:
                        last[v] = 1
                    elif ends is not None and fail[v] >= 0 and last[fail[v]] >= 0:
                        last[v] = last[fail[v]] + pops[v]
                    if final[v]:
                        fail[v], pops[v] = rest, 1
                if fail[v] >= 0:
                    table[v] = table[fail[v]]
                    popped[v] = np.where(table[v] != n, popped[fail[v]] + pops[v], 0)
                    if ends is None and last[fail[v]] >= 0:
                        last[v] = last[fail[v]] + pops[v]
                for b, c in child[v].items():
                    table[v, self.column[b]], popped[v, self.column[b]] = c, 0
            level = [c for v in level for c in child[v].values() if c not in done]
            done.update(level)
        if rest == 0:
            last[0] = 0
        # a step's next node and popped pieces in one entry
        self.bits = int(popped.max()).bit_length()
        kind = np.int32 if (n << self.bits) < 1 << 31 else np.int64
        self.table, self.last = ((table.astype(kind) << self.bits) | popped.astype(kind)).reshape(-1), last

    @classmethod
    def of(cls, path: str | None) -> Automaton:
        """One for each vocabulary file and worker process."""
        key = path or ""
        if key not in cls._made:
            inner, ends = load_marked(path)
            cls._made[key] = cls(inner, ends=ends)
        return cls._made[key]

    def count(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Pieces of each word, data[start : start + length]; -1 for words that cannot be cut."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state, popped = np.full(len(start), self.root, np.int64), np.zeros(len(start), np.int64)
        column, mask = self.column[data], (1 << self.bits) - 1
        together = int(length[LAST_WORDS]) if len(length) > LAST_WORDS else 0
        active = np.searchsorted(-length, -np.arange(1, together + 1), "right")  # words longer than t
        for t, n in enumerate(active):
            step = self.table[state[:n] * self.columns + column[start[:n] + t]]
            popped[:n] += step & mask
            state[:n] = step >> self.bits
        table = memoryview(self.table)
        for i in range(min(LAST_WORDS, len(length))):
            node, count = int(state[i]), int(popped[i])
            for c in column[start[i] + together : start[i] + length[i]].tolist():
                entry = table[node * self.columns + c]
                node, count = entry >> self.bits, count + (entry & mask)
            state[i], popped[i] = node, count
        end = self.last[state]
        out = np.empty(len(start), np.int64)
        out[order] = np.where(end < 0, -1, popped + end)
        return out


def _chunks(texts: list[str]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        data = text.lower().encode("utf-8", "replace")
        if part and size + len(data) > CHUNK:
            yield part
            part, size = [], 0
        part.append(data)
        size += len(data) + 1
    if part:
        yield part


def count_texts(automaton: Automaton, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, pieces (an unknown word is one) and unknown words of each text."""
    found = []
    for part in _chunks(texts):
        data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        pieces = automaton.count(data, start, stop - start)
        ends = np.cumsum([len(x) + 1 for x in part])
        text = np.searchsorted(ends, start, "right")
        n = len(part)
        found.append((np.bincount(text, minlength=n), np.bincount(text, np.where(pieces < 0, 1, pieces), n).astype(np.int64), np.bincount(text, pieces < 0, n).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def count_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of(path)
        for part in (x for b in batches for x in slices(b, rows=10_000)):
            counts = count_texts(automaton, [x or "" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in counts)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")


def op3(docs: DataFrame) -> DataFrame:
    return count_pieces(docs)
