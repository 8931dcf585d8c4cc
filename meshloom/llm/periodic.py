"""Runs of repeated words, found by Crochemore's partition refinement.

Positions of a text are in one class at level l if the l words from there on are equal. Level 1 goes by the words; level l + 1
splits every class by the classes of the next positions. Only small classes are used for that, that is all parts but the largest
of each class that was split before (what is left of a class follows the largest part), so a position is looked at O(log n)
times. Each class is a linked list in the order of positions. If the next member of a class at level l is l positions further on,
a square of period l starts there, and it is primitive, as a shorter period would show a nearer member. Squares of one period at
neighbouring positions make up a run.

The steps of a level are array operations over a batch of documents: words are told apart by document, so classes never span two.
A document ends in a position of its own class. Levels end where no next member is near enough for a run of LEAST_TIMES periods.

Defined results: null, empty and blank texts have no words and no runs; a null doc_id is numbered as the empty text; repeated rows
are judged one by one; an empty table gives no rows; other columns are ignored by `find_runs` and carried along by `collapse_rows`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshloom.llm.common import slices

#: A run has so many words at least, and so many periods.
LEAST_WORDS = 6
LEAST_TIMES = 4
#: Bytes of text whose documents are refined together.
BATCH_BYTES = 8 << 20


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., then those of start[1] and so on, length[k] of each."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins, for keys that lie together."""
    new = np.ones(len(keys[0]), bool)
    np.not_equal(keys[0][1:], keys[0][:-1], out=new[1:])
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return new


def _lengths(begins: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(len(begins), np.int64)
    np.subtract(begins[1:], begins[:-1], out=out[:-1])
    out[-1:] = n - begins[-1:]
    return out


class Partition:
    """Classes of positions with equal factors, refined level by level."""

    def __init__(self, words: np.ndarray, document: np.ndarray, most: np.ndarray) -> None:
        """words: a class for each position, other than in other documents; most: the longest period that counts, by document."""
        n = len(words)
        order = np.argsort(words, kind="stable")
        cuts = np.flatnonzero(_begins(words[order]))
        self.members, self.place = order, np.empty(n, np.int64)  # classes are segments of members
        self.place[order] = np.arange(n)
        sizes = _lengths(cuts, n)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: len(cuts)], self.size[: len(cuts)] = cuts, sizes
        self.classes = len(cuts)
        self.of = np.empty(n, np.int64)
        self.of[order] = np.repeat(np.arange(len(cuts)), sizes)
        self.after, self.before = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        joined = np.flatnonzero(self.of[order[1:]] == self.of[order[:-1]])
        self.after[order[joined]], self.before[order[joined + 1]] = order[joined + 1], order[joined]
        self.most, self.document = most[document], document
        self.first = _begins(document)
        self.mark = np.zeros(n, bool)
        self.level = 1
        self.waiting: dict[int, list[np.ndarray]] = {}
        self.near = 0  # positions whose next member is near enough
        self.small = np.arange(n)
        found = order[joined]
        self._wait(found)
        self.near += self._count(found)

    def _count(self, at: np.ndarray) -> int:
        return int(np.count_nonzero((self.after[at] >= 0) & (self.after[at] - at <= self.most[at])))

    def _wait(self, at: np.ndarray) -> None:
        """Positions to look at again at the level of their distance to the next member."""
        gap = self.after[at] - at
        keep = (self.after[at] >= 0) & (gap <= self.most[at]) & (gap >= self.level)
        at, gap = at[keep], gap[keep]
        if len(at):
            order = np.argsort(gap, kind="stable")
            at, gap = at[order], gap[order]
            cuts = np.flatnonzero(_begins(gap))
            for part, distance in zip(np.split(at, cuts[1:]), gap[cuts].tolist(), strict=True):
                self.waiting.setdefault(distance, []).append(part)

    def squares(self) -> np.ndarray:
        """Positions, in order, where a square of this level's length starts."""
        parts = self.waiting.pop(self.level, None)
        if parts is None:
            return np.empty(0, np.int64)
        at = np.unique(np.concatenate(parts))
        return at[self.after[at] - at == self.level]

    def refine(self) -> None:
        """To the next level."""
        if self.level & (self.level - 1) == 0:
            # distances only grow, so documents without near members are done with
            at = np.flatnonzero((self.after >= 0) & (self.after - np.arange(len(self.after)) <= self.most))
            live = np.zeros(int(self.document[-1]) + 1, bool)
            live[self.document[at]] = True
            self.small = self.small[live[self.document[self.small]]]
        self.level += 1
        at = self.small[~self.first[self.small]] - 1
        at = np.sort(at[self.size[self.of[at]] > 1])
        self.small = np.empty(0, np.int64)
        if not len(at):
            return
        pair = self.of[at] * self.classes + self.of[at + 1]
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        own = self.of[at]
        begins = np.flatnonzero(_begins(pair))
        length = _lengths(begins, len(at))
        parent = own[begins]
        heads = np.flatnonzero(_begins(parent))  # the first part of each class
        parts = _lengths(heads, len(parent))
        rest = self.size[parent[heads]] - np.add.reduceat(length, heads)
        longest = np.maximum.reduceat(length, heads)
        # the first of the longest parts of a class stays if nothing else would, and is not small unless the rest is longer
        of_parent = np.repeat(np.arange(len(heads)), parts)
        is_longest = np.flatnonzero(length == longest[of_parent])
        chosen = is_longest[np.searchsorted(is_longest, heads)]
        stays, small = np.zeros(len(begins), bool), np.ones(len(begins), bool)
        stays[chosen[rest == 0]] = True
        small[chosen[rest < longest]] = False
        small_rest = parent[heads[(rest > 0) & (rest < longest)]]
        if not stays.all():
            moved = np.repeat(~stays, length)
            self._move(at[moved], own[moved], np.repeat(np.arange(len(begins)), length)[moved])
        keep = np.repeat(small & ~stays, length)
        self.small = np.concatenate([at[keep], self.members[_ranges(self.start[small_rest], self.size[small_rest])]])

    def _move(self, at: np.ndarray, own: np.ndarray, part: np.ndarray) -> None:
        """Positions, sorted by class, part and place, go to classes of their own, one for each part."""
        # out of the lists of their classes: what stands before and after a chain of them is joined
        order = np.lexsort((at, own))
        line = at[order]
        head = np.ones(len(line), bool)
        head[1:] = self.after[line[:-1]] != line[1:]
        tail = np.ones(len(line), bool)
        tail[:-1] = head[1:]
        left, right = self.before[line[head]], self.after[line[tail]]
        changed = left[left >= 0]
        touched = np.concatenate([at, changed])
        self.near -= self._count(touched)
        self.after[changed] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        # lists of their own
        same = part[1:] == part[:-1]
        self.after[at], self.before[at] = -1, -1
        self.after[at[:-1][same]], self.before[at[1:][same]] = at[1:][same], at[:-1][same]
        self.near += self._count(touched)
        self._wait(touched)
        # segments: the moved ones take the end of their class's, those that stood there take their places
        cuts = np.flatnonzero(_begins(own))
        count, parent = _lengths(cuts, len(own)), own[cuts]
        end = self.start[parent] + self.size[parent]
        slots = _ranges(end - count, count)
        self.mark[at] = True
        there = self.members[slots]
        there = there[~self.mark[there]]
        self.mark[at] = False
        holes = self.place[at]
        holes = holes[holes < np.repeat(end - count, count)]
        self.members[holes], self.place[there] = there, holes
        self.members[slots], self.place[at] = at, slots
        self.size[parent] -= count
        begins = np.flatnonzero(_begins(part))
        new = np.arange(self.classes, self.classes + len(begins))
        self.classes += len(begins)
        self.start[new], self.size[new] = slots[begins], _lengths(begins, len(part))
        self.of[at] = np.repeat(new, self.size[new])


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """For each text, given as its words, the (start, length, period) of its runs, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(x) for x in texts], np.int64)
    if not len(texts) or sizes.max() < LEAST_WORDS:
        return out
    document = np.repeat(np.arange(len(texts)), sizes + 1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    word = pa.array([w for x in texts for w in x]).dictionary_encode()
    numbers = np.full(len(document), len(word.dictionary), np.int64)  # what ends a document is a word of its own
    ends = np.zeros(len(document), bool)
    ends[begin + sizes] = True
    numbers[~ends] = word.indices.to_numpy()
    numbers += document * (len(word.dictionary) + 1)
    partition = Partition(numbers, document, sizes // LEAST_TIMES)
    while partition.near:
        period = partition.level
        squares = partition.squares()
        if len(squares):
            cut = (np.diff(squares, prepend=-2) != 1) | (np.diff(document[squares], prepend=-1) != 0)
            start = squares[cut]
            last = squares[np.append(np.flatnonzero(cut)[1:] - 1, len(squares) - 1)]
            length = last - start + 2 * period
            for k in np.flatnonzero(length >= max(LEAST_WORDS, LEAST_TIMES * period)):
                d = int(document[start[k]])
                out[d].append((int(start[k] - begin[d]), int(length[k]), period))
        partition.refine()
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that lie in no run after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for part in (x for b in batches for x in slices(b, column, rows=1 << 20, size=BATCH_BYTES)):
        texts = part.column(column).cast(pa.binary()).to_pylist()
        yield part, [(x or b"").split() for x in texts]  # bytes split at ASCII white space alone


def collapse_rows(docs: DataFrame) -> DataFrame:
    """docs with every run of their texts cut to its first period, words joined by one space; texts without a run are as they were."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches, at):
            found = runs_of(texts)
            if any(found):
                old = part.column(at).to_pylist()
                new = [b" ".join(collapsed(w, r)).decode() if r else x for x, w, r in zip(old, texts, found, strict=True)]
                part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
            yield part

    return docs.mapInArrow(run, docs.schema)


def planted(doc_id, words: list) -> list:
    """The words, or for a tenth of all doc_ids those from some place on repeated with some period."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def find_runs(docs: DataFrame, change=None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): one row per document.

    start to exponent_milli are those of the longest run, the first of the smallest period among equals; null if there is none.
    change, if given, makes of (doc_id, words) the words to look at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches, 1):
            if change:
                texts = [change(i, w) for i, w in zip(part.column(0).to_pylist(), texts, strict=True)]
            rows = []
            for words, found in zip(texts, runs_of(texts), strict=True):
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
                listing = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                kept = b" ".join(collapsed(words, found))
                rows.append((len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], names=list(NAMES))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def op12(docs: DataFrame) -> DataFrame:
    return find_runs(docs, planted)
