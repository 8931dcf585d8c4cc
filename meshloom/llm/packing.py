"""Best-fit packing of token sequences after a dominance reduction.

The packing depends on how many pieces there are of each length and on nothing else, so the driver plans it on a histogram of at
most `capacity` rows, and pieces find their places by their rank among the pieces of their length:

1. Reduction after Martello and Toth: a set of pieces that dominates every other set with its largest piece is fixed for good.
   Used are the exact complement (j and C - j), the lonely piece (nothing fits beside it), the only companion (no two others
   fit beside j: take the largest that fits) and the best companion (no three others fit, and one piece is as long as the best
   two). Each holds for as many bins as both lengths last, as taking pieces away only narrows what else would fit.
2. Best-fit decreasing over what remains, on groups of equal bins.

Defined results: null and empty texts are one piece that holds the end id alone; an empty table gives no rows; repeated rows are
packed as often as they occur; columns of other names are ignored by `encode_pieces` and carried along by `pack`, whatever they
are called.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from meshloom.llm.common import materialize, slices
from meshloom.llm.tokens import WordEncoder, default_path

CAPACITY = 2048
END_ID = 0
#: Where a piece was numbered, and its number there among those of its length.
PART, NTH = "__meshloom_part", "__meshloom_nth"
#: Counts of partitions that are broadcast, of about 100 bytes each there; more of them are joined.
BROADCAST_COUNTS = 1_000_000
#: (length, first rank, rank after the last, first bin, pieces of this length in each bin, offset of the first of them)
Entry = tuple[int, int, int, int, int, int]


class _Plan:
    """Counts of pieces by length, and the entries made so far."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        if any(not 1 <= k <= capacity for k in counts):
            raise ValueError(f"lengths must lie in 1..{capacity}")
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for k, n in counts.items():
            self.left[k] += n
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        self.bins = 0
        self.entries: list[Entry] = []

    def place(self, length: int, bins: int, first: int, each: int, offset: int) -> None:
        rank = int(self.used[length])
        self.entries.append((length, rank, rank + bins * each, first, each, offset))
        self.used[length] += bins * each
        self.left[length] -= bins * each

    def fix(self, bins: int, *lengths: int) -> None:
        """New bins with one piece of each of these lengths."""
        offset = 0
        for length, same in itertools.groupby(lengths):
            each = len(list(same))
            self.place(length, bins, self.bins, each, offset)
            offset += each * length
        self.bins += bins

    def shortest(self, n: int, without: int) -> list[int]:
        """The n shortest pieces that are left, when one of `without` is put aside."""
        out: list[int] = []
        for length in np.flatnonzero(self.left):
            out += [int(length)] * min(n - len(out), int(self.left[length]) - (length == without))
            if len(out) >= n:
                break
        return out

    def longest_within(self, room: int, without: int) -> int:
        """The length of the longest other piece that fits, or 0."""
        there = np.flatnonzero(self.left[: max(room, 0) + 1])
        for length in there[::-1]:
            if length != without or self.left[length] > 1:
                return int(length)
        return 0

    def best_pair(self, room: int, without: int) -> int:
        """The largest sum of two other pieces within room, or 0."""
        there = [int(x) for x in np.flatnonzero(self.left[: max(room, 0) + 1])]
        spare = {x: int(self.left[x]) - (x == without) for x in there}
        there, best = [x for x in there if spare[x] > 0], 0
        for x in there:
            k = bisect.bisect_right(there, room - x) - 1
            while k >= 0 and there[k] == x and spare[x] < 2:
                k -= 1
            if k >= 0:
                best = max(best, x + there[k])
        return best

    def reduce(self) -> None:
        c = self.capacity
        self.fix_all(c)
        for j in range(c - 1, (c - 1) // 2, -1):
            k = c - j
            n = int(self.left[j] // 2 if j == k else min(self.left[j], self.left[k]))
            if n:
                self.fix(n, j, k)
        changed = True
        while changed:
            changed = False
            for j in (int(x) for x in np.flatnonzero(self.left)[::-1]):
                while self.left[j]:
                    room, short = c - j, self.shortest(3, j)
                    if not short or short[0] > room:
                        self.fix_all(j)
                    elif len(short) < 2 or short[0] + short[1] > room:
                        self.pair(j, self.longest_within(room, j))
                    elif (len(short) < 3 or sum(short) > room) and (k := self.longest_within(room, j)) >= self.best_pair(room, j):
                        self.pair(j, k)
                    else:
                        break
                    changed = True
                if self.left[j] and j + sum(self.shortest(3, j)) <= c:
                    break  # shorter pieces leave more room still

    def fix_all(self, j: int) -> None:
        """Bins that hold pieces of length j alone: one each, as two would not fit."""
        if self.left[j]:
            self.fix(int(self.left[j]), j)

    def pair(self, j: int, k: int) -> None:
        n = int(self.left[j] // 2 if j == k else min(self.left[j], self.left[k]))
        self.fix(n, j, k)

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that has room; bins with equal room are filled group by group."""
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]  # by room: (first bin, bins)
        filled = np.zeros(self.capacity + 1, dtype=bool)

        def put(room: int, first: int, bins: int) -> None:
            if room and bins:
                groups[room].append((first, bins))
                filled[room] = True

        for length in (int(x) for x in np.flatnonzero(self.left)[::-1]):
            while n := int(self.left[length]):
                room = length + int(np.argmax(filled[length:]))
                if not filled[room]:
                    room, bins = self.capacity, -(-n // (self.capacity // length))
                    put(room, self.bins, bins)
                    self.bins += bins
                first, bins = groups[room].pop()
                filled[room] = bool(groups[room])
                each, offset = room // length, self.capacity - room
                if whole := min(bins, n // each):
                    self.place(length, whole, first, each, offset)
                    put(room - each * length, first, whole)
                    first, bins, n = first + whole, bins - whole, n - whole * each
                if bins and n:
                    self.place(length, 1, first, n, offset)
                    put(room - n * length, first, 1)
                    first, bins = first + 1, bins - 1
                put(room, first, bins)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Entry], int]:
    """Entries that place every piece, and the number of bins."""
    p = _Plan(counts, capacity)
    p.reduce()
    p.best_fit()
    return p.entries, p.bins


class _Numbers:
    """Numbers the pieces of each length in the order in which a task sees them."""

    def __init__(self, capacity: int) -> None:
        self.part, self.seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)

    def columns(self, lengths: np.ndarray) -> list[pa.Array]:
        if len(lengths) and not 1 <= lengths.min() <= lengths.max() < len(self.seen):
            raise ValueError(f"lengths must lie in 1..{len(self.seen) - 1}")
        order = np.argsort(lengths, kind="stable")
        line, nth = lengths[order], np.empty(len(lengths), dtype=np.int64)
        nth[order] = self.seen[line] + np.arange(len(line)) - np.searchsorted(line, line, "left")
        self.seen += np.bincount(lengths, minlength=len(self.seen))
        return [pa.array(np.full(len(lengths), self.part), pa.int32()), pa.array(nth)]


def encode_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, PART, NTH): each text's ids with the end id, those of over `capacity` ids cut into pieces."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, step, numbers = WordEncoder.of(path), end_id.to_bytes(4, "little"), 4 * capacity, _Numbers(capacity)
        for part in (x for b in batches for x in slices(b)):
            rows, of = [], []
            for k, ids in enumerate(encoder.encode([x or "" for x in part.column(1).to_pylist()])):
                ids += end
                rows += [(i // step, i // 4, ids[i : i + step]) for i in range(0, len(ids), step)]
                of += [k] * (len(rows) - len(of))
            piece, start, some = zip(*rows, strict=True)
            lengths = np.array([len(x) // 4 for x in some], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths), pa.array(some, pa.binary()), *numbers.columns(lengths)],
                names=["doc_id", "piece", "start", "length", "ids", PART, NTH],
            )
        encoder.cache.clear()  # the worker may do other things next

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary, {PART} int, {NTH} long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def number(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with PART and NTH, written."""
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(capacity)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *numbers.columns(b.column(at).to_numpy().astype(np.int64))], names=[*b.schema.names, PART, NTH])

    plain = pieces.toDF(*[f"c{i}" for i in range(len(pieces.columns))])  # names may hold dots
    schema = StructType([*plain.schema.fields, StructField(PART, IntegerType()), StructField(NTH, LongType())])
    return materialize(plain.mapInArrow(run, schema), "numbered").toDF(*pieces.columns, PART, NTH)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which has a column length in 1..capacity; other columns are carried along.

    Pieces are numbered and written first, unless PART and NTH are there: those must come from one run, so pieces must be a written
    table then. A piece's rank is its number in its partition and the count of its length in earlier ones, whose table is broadcast up
    to BROADCAST_COUNTS rows and joined beyond that, with the same ranks. Columns named sequence_id and offset are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    if PART not in pieces.columns or NTH not in pieces.columns:
        pieces = number(pieces.drop(PART, NTH), capacity)
    sizes = materialize(pieces.groupBy(F.col("length").cast("long").alias("_length"), F.col(PART).alias("_part")).agg(F.count(F.lit(1)).alias("n_rows")), "counts")
    counts = {r["_length"]: r["n"] for r in sizes.groupBy("_length").agg(F.sum("n_rows").alias("n")).collect()}  # at most `capacity` rows
    entries, _ = plan(counts, capacity)
    places = spark.createDataFrame(entries or [(0, 0, 0, 0, 1, 0)], "_length long, _lo long, _hi long, _first long, _each long, _offset long")
    earlier = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = sizes.select("_length", "_part", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("_base"))
    if sizes.count() <= BROADCAST_COUNTS:
        bases = F.broadcast(bases)
    names = {c: f"c{i}" for i, c in enumerate(pieces.columns)}
    rows = pieces.toDF(*names.values()).withColumn("_length", F.col(names["length"]).cast("long")).withColumn("_part", F.col(names[PART]))
    p, e = rows.join(bases, ["_length", "_part"]).withColumn("_rank", F.col("_base") + F.col(names[NTH])).alias("p"), F.broadcast(places).alias("e")  # the plan has a few entries for each length
    found = p.join(e, (F.col("p._length") == F.col("e._length")) & (F.col("p._rank") >= F.col("e._lo")) & (F.col("p._rank") < F.col("e._hi")))
    k = F.col("p._rank") - F.col("e._lo")
    return found.select(
        *[F.col(f"p.{n}").alias(c) for c, n in names.items() if c not in (PART, NTH)],
        (F.col("e._first") + F.floor(k / F.col("e._each"))).alias("sequence_id"),
        (F.col("e._offset") + F.pmod(k, F.col("e._each")) * F.col("p._length")).alias("offset"),
    )


def op5(docs: DataFrame) -> DataFrame:
    """The digest of the packing: ids are checked by their crc32, which is all of them that is written."""
    pieces = encode_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(pieces, "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
