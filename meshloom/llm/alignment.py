"""Alignment of the tokens of two tokenizers, and how often two of their ids meet in the corpus.

A text is a line of bytes that both tokenizers cut into tokens. Two pointers go over the cumulative ends of both: the tokens under
them overlap, which is a link, and the one that ends first moves on; where both end, a group is closed. Links are counted by pair
of ids over the corpus, and the counts, with the highest of each id of the second tokenizer, are joined back to the documents.

Neither tokenizer joins a space to a character before it that isn't white space: the first's pattern starts a new piece there, and
no piece of the second holds a space after another character (checked when the model is loaded). So texts are cut there, all cuts
being common ends, and each different part is encoded and aligned once as long as a worker remembers it.

Counts: a document's pairs are written with it, as ids and counts. All counts are one grouped sum. The HOT_PAIRS most frequent
pairs at most are sent to all tasks; links of the others, if there are any, are shuffled to their counts. Hot pairs, which may be in
every document, are never shuffled, and what is sent is bounded.

Defined results: texts that are null or empty, and those that either tokenizer doesn't give back byte by byte, have no tokens;
repeated rows are counted one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import frequent, materialize, row_numbers, slices
from meshloom.llm.tokencount import byte_letters

#: The tokenizers in production; parameters of `align`.
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Before such a space both tokenizers begin anew.
CUT = re.compile(r"(?<=\S) ")
#: ASCII characters, besides the space itself, after which a space is none of these.
BLANKS = [f"{c} " for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"]
#: Letters that all versions of Unicode class alike, and ASCII: texts of these are cut alike by both libraries that know the first tokenizer's pattern.
LATIN = re.compile("[\\x00-~À-ÖØ-öø-ɏ]*")
#: Parts of texts in each of the two generations that a worker remembers, and the longest of them.
CACHED, LONG = 40_000, 64
#: Pairs that are sent to all tasks: 25 MB.
HOT_PAIRS = 1 << 20
SPACE = "▁"


def cut(text: str) -> list[str]:
    """Parts of a text, without the space before each but the first."""
    plain = text.isascii() and not text.startswith(" ") and not any(x in text for x in BLANKS)
    return text.split(" ") if plain else CUT.split(text)


def merge(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j, closes) between tokens with these cumulative ends, which are the same at last; closes: both end there.

    Two pointers, i and j, meet each end of either side in turn; here all their steps are made at once, as each pointer has passed
    as many tokens of its side as end before.
    """
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    ends = np.zeros((2, int(first[-1]) + 1), bool)
    ends[0, first], ends[1, second] = True, True
    at = np.flatnonzero(ends[0] | ends[1])
    i, j = (np.cumsum(x[at]) - x[at] for x in ends)
    return i, j, ends[0, at] & ends[1, at]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(FIRST), public_tokenizers.path(SECOND)


class Aligner:
    """Aligns texts part by part."""

    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, first: str, second: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True  # their strings in a text are plain text
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = byte_letters()
        known = {i: bytes(letters[c] for c in x) for x, i in self.first.get_vocab(with_added_tokens=False).items() if all(c in letters for c in x)}
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}", x) for x in pieces):
            raise ValueError(f"{second} has pieces that go on after a space, so texts cannot be cut there")
        self.blank = self.second.piece_to_id(SPACE)
        second_bytes = [bytes([int(x[3:5], 16)]) if self.second.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(pieces)]
        # of each side: bytes, their number, and the id as text before a comma or the end of a group's side
        self.sides = []
        for own, mark in (([known.get(i, b"") for i in range(self.first.get_vocab_size())], "|"), (second_bytes, ";")):
            ids = [str(i) for i in range(len(own))]
            self.sides.append((own, np.array([len(x) for x in own]), np.array([[f"{i}," for i in ids], [i + mark for i in ids]], object)))
        self.lossless = {bytes([i]) for i in range(256)} <= set(known.values())  # byte-level pieces then give back any text
        self.plain = self._plain(first, known)
        self.cache: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def _plain(self, path: str, known: dict[int, bytes]):
        """Encodes LATIN text as the first tokenizer does, faster: ids are in the order of merges, so they are ranks; None if they aren't."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = ["".join(x) if isinstance(x, list) else x.replace(" ", "") for x in model["merges"]]
        if len(known) != len(merged) + 256 or any(model["vocab"][x] != i for i, x in enumerate(merged, 256)):
            return None
        return tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in known.items()}, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, paths: tuple[str, str]) -> Aligner:
        """One for each pair of files and worker process."""
        if paths not in cls._made:
            cls._made[paths] = cls(*paths)
        return cls._made[paths]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each text by both tokenizers."""
        plain = self.plain
        first = [plain(f" {x}") if plain and LATIN.fullmatch(x) else None for x in texts]
        rest = [i for i, x in enumerate(first) if x is None]
        for i, e in zip(rest, self.first.encode_batch_fast([f" {texts[i]}" for i in rest], add_special_tokens=False), strict=True):
            first[i] = e.ids
        return first, [x or [self.blank] for x in self.second.encode(texts, num_threads=1)]

    def checked(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of `encode` as 32-bit integers; None for texts that either tokenizer doesn't give back."""
        first, second = (own for own, _, _ in self.sides)
        out: list[tuple[bytes, bytes] | None] = []
        for text, a, b in zip(texts, *self.encode(texts), strict=True):
            data = f" {text}".encode()
            same = data == b"".join([second[i] for i in b]) and (self.lossless or data == b"".join([first[i] for i in a]))
            out.append((array("i", a).tobytes(), array("i", b).tobytes()) if same else None)
        return out

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """What `checked` gives for whole texts, part by part; None for null and empty ones too."""
        parts = [cut(x) if x else None for x in texts]
        if len(self.cache) > CACHED:
            self.cache, self.older = {}, self.cache  # what is used again comes back
        new = {p for x in parts if x for p in x}.difference(self.cache)
        known = new.intersection(self.older)
        self.cache.update((p, self.older[p]) for p in known)
        new = list(new - known)
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            self.cache.update(zip(some, self.checked(some), strict=True))
        found = [x and list(map(self.cache.__getitem__, x)) for x in parts]
        for p in new:
            if len(p) > LONG:
                self.cache.pop(p)
        return [tuple(map(b"".join, zip(*x, strict=True))) if x and None not in x else None for x in found]

    def aligned(self, ids: list[tuple[bytes, bytes]]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray]:
        """For texts of these ids: numbers of tokens of either side and of groups, the groups as text, the links as pairs of ids, and where those of each text begin and end."""
        flat, ends, upto = [], [], []
        for side, (_, sizes, _) in enumerate(self.sides):
            flat.append(np.frombuffer(b"".join([x[side] for x in ids]), np.int32))
            ends.append(np.cumsum(sizes[flat[-1]]))
            upto.append(np.cumsum([0, *(len(x[side]) // 4 for x in ids)]))
        i, j, closes = merge(*ends)
        links = np.stack([flat[0][i], flat[1][j]], axis=1)
        # a group's tokens of the first side stand before those of the second
        last = [x[closes] for x in (i, j)]  # of each group
        group = [np.repeat(np.arange(len(x)), np.diff(x, prepend=-1)) for x in last]
        listing = np.empty(len(flat[0]) + len(flat[1]), object)
        earlier = np.append(-1, last[1])[group[0]] + 1, last[0][group[1]] + 1
        for side in (0, 1):
            closing = np.zeros(len(flat[side]), np.int8)
            closing[last[side]] = 1
            listing[np.arange(len(flat[side])) + earlier[side]] = self.sides[side][2][closing, flat[side]]
        at = (upto[0] + upto[1]).tolist()
        names = ["".join(listing[at[k] : at[k + 1]].tolist())[:-1] for k in range(len(ids))]
        return [np.diff(upto[0]), np.diff(upto[1]), np.diff(np.searchsorted(last[0], upto[0]))], names, links, np.searchsorted(i, upto[0])


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, a, b, n): one row per document.

    groups lists the ids of each group; a[i] and b[i] are linked n[i] times. row tells rows apart once the table is written.
    """
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, numbers = Aligner.of(paths), row_numbers()
        for part in (x for b in batches for x in slices(b, rows=1000, size=1 << 20)):
            found = aligner.ids(part.column(1).to_pylist())
            counts, groups, links, begin = aligner.aligned([x or (b"", b"") for x in found])
            text = np.repeat(np.arange(len(found)), np.diff(begin))
            # the different pairs of each text
            bits = [max(1, len(own).bit_length()) for own, _, _ in aligner.sides]
            key = np.sort((np.repeat(np.arange(len(found)), np.diff(begin)) << sum(bits)) | (links[:, 0].astype(np.int64) << bits[1]) | links[:, 1])
            cut_at = np.flatnonzero(np.diff(key, prepend=-1))
            pair, text = key[cut_at], key[cut_at] >> sum(bits)
            a, b = ((pair >> bits[1]) & ((1 << bits[0]) - 1)).astype(np.int32), (pair & ((1 << bits[1]) - 1)).astype(np.int32)
            n, offsets = np.diff(np.append(cut_at, len(key))).astype(np.int32), pa.array(np.searchsorted(text, np.arange(len(found) + 1)).astype(np.int32))
            columns = [pa.array([next(numbers) for _ in found], pa.int64()), part.column(0), *(pa.array(c, pa.int64()) for c in (*counts, np.diff(begin))), pa.array(groups, pa.string())]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (a, b, n)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "n"])
        aligner.cache, aligner.older = {}, {}  # the worker may do other things next

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, n array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, times, best): how often each pair of ids is linked in all of `align`'s rows; best: the most of its second id. code: a << 32 | b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)

        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            a, b, n = (batch.column(k).flatten().to_numpy() for k in range(3))
            codes, at = np.unique((a.astype(np.int64) << 32) | b, return_inverse=True)
            found.append((codes, np.bincount(at, n, len(codes)).astype(np.int64)))
            if sum(len(x) for x, _ in found) > 1 << 21:
                found = [summed()]
                if len(found[0][0]) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.pop()], names=["code", "n"])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], names=["code", "n"])

    counts = aligned.select("a", "b", "n").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("times"))
    counts = materialize(counts.withColumn("second", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))), "pairs")
    most = counts.groupBy("second").agg(F.max("times").alias("most"))  # a row for each id of the second vocabulary
    return materialize(counts.join(most, "second").select("code", "times", (F.col("times") == F.col("most")).alias("best")), "pair-counts")


def link_scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """`align`'s columns but the links, with n_best and count_sum over each document's links. aligned must be a written table."""
    hot = frequent(counts, "times", HOT_PAIRS)
    links = aligned.select("row", F.inline(F.arrays_zip("a", "b", "n"))).select("row", F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("code"), "n")
    parts = [links.join(F.broadcast(hot), "code")]
    if not hot.count() == counts.count():
        # what is not sent is rare, so that its links may be shuffled
        parts.append(links.join(F.broadcast(hot.select("code")), "code", "left_anti").join(counts, "code"))
    sums = [x.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")) for x in parts]
    found = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    plain = [c for c in aligned.columns if c not in ("a", "b", "n")]
    out = aligned.select(*plain).join(found, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
    return out.drop("row")


def op13(docs: DataFrame) -> DataFrame:
    hashed = F.when(F.col("groups") != "", F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = materialize(align(docs).withColumn("groups", hashed).withColumnRenamed("groups", "groups_sha256"), "aligned")
    return link_scores(aligned, pair_counts(aligned))
