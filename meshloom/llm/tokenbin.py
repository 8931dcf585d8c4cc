"""Token ids in binary shards, with a minimal perfect hash index from document keys to offsets.

A shard file holds the raw ids of its documents in ascending doc_id order (little-endian, 16 bits each where the vocabulary
allows it, else 32), then its index, then a footer:

    payload | levels | fingerprints | rows | starts | keys' first rows | footer (FOOTER, 64 bytes)

The index is a cascade of bit arrays: a key that falls alone on a bit of a level is placed there, the others go on to the next
level; the number of bits set before a key's bit is its slot, so slots are 0..n-1 without gaps. A slot stores 32 bits of another
hash of its key, by which foreign keys are told apart, and where the key's documents lie. A look-up is a handful of bit probes.

Documents are encoded where they are read, dealt to shards by ranges of (doc_id, a hash of the text, a hash of the row's place) and
sorted within a shard, so that a doc_id with any number of rows fills several shards. Bounds of the ranges come from a sample of
SAMPLED rows a shard and MOST_SAMPLED in all. A shard is cut into parts of at most PART_BYTES of payload between documents. Files
appear whole or not at all.

Defined results: null and empty texts hold the end id alone; null doc_ids come first and are one key; rows with equal doc_id are
kept one by one, in the order of hashes of their texts; an empty table writes no files and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.common import fresh_dir, runs, slices
from meshloom.llm.files import open_dir, replaced
from meshloom.llm.tokens import WordEncoder, default_path

END_ID = 2
SHARD_BYTES = 64 << 20
#: Rows that bounds come from: for each shard, and at most. There are no more shards than MOST_SAMPLED / 4.
SAMPLED = 32
MOST_SAMPLED = 1 << 20
PART_BYTES = 256 << 20
GAMMA = 2.0
MOST_LEVELS = 32
MAGIC = b"TOKSHARD"
FOOTER = struct.Struct("<8sIIQQQQQQ")  # magic, version, width, documents, tokens, keys, index offset, index length, payload length


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Slots 0..n-1 for n different 64-bit keys."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest  # bits, and the keys that no level placed, sorted
        self.before, total = [], 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.before.append(total + np.concatenate([[0], np.cumsum(counts)]))
            total += int(counts.sum())
        self.placed = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < MOST_LEVELS:
            size = max(64, -(-int(GAMMA * len(keys)) // 64) * 64)
            at = (mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Of each key; some slot or -1 for foreign ones."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[left], k) % np.uint64(64 * len(bits))).astype(np.int64)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[k][at >> 6] + low)[hit]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.placed + at[hit]
        return out

    def dump(self) -> bytes:
        head = struct.pack("<II", len(self.levels), len(self.rest)) + struct.pack(f"<{len(self.levels)}Q", *map(len, self.levels))
        return head + b"".join(x.astype("<u8").tobytes() for x in [*self.levels, self.rest])

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        n, rest = struct.unpack_from("<II", data)
        sizes, at, levels = struct.unpack_from(f"<{n}Q", data, 8), 8 + 8 * n, []
        for size in [*sizes, rest]:
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(levels[:-1], levels[-1]), at


def key_of(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit keys of doc_ids; null is a key of its own."""
    return np.where(null, mix(np.zeros(1, np.uint64), 77)[0], mix(ids.astype(np.int64).view(np.uint64), 76))


def index_bytes(ids: np.ndarray, null: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int]:
    """The index of documents in order, and the number of keys."""
    keys = key_of(ids, null)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    hashed = PerfectHash.build(keys[first])
    slot = hashed.slots(keys[first])
    prints, row, count = np.empty(len(first), "<u4"), np.empty(len(first), "<u8"), np.empty(len(first), "<u8")
    prints[slot] = mix(keys[first], 99) & np.uint64(0xFFFFFFFF)
    row[slot], count[slot] = first, np.diff(np.concatenate([first, [len(keys)]]))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    return b"".join([hashed.dump(), prints.tobytes(), row.tobytes(), count.tobytes(), starts.tobytes()]), len(first)


class Shard:
    """A shard file, opened for look-ups."""

    def __init__(self, system, path: str) -> None:
        self.file = system.open_input_file(path)
        size = self.file.size()
        magic, _, self.width, self.docs, self.tokens, self.keys, at, length, _ = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        data = self.file.read_at(length, at)
        self.hash, at = PerfectHash.load(data)
        self.prints = np.frombuffer(data, "<u4", self.keys, at)
        self.row = np.frombuffer(data, "<u8", self.keys, at + 4 * self.keys).astype(np.int64)
        self.count = np.frombuffer(data, "<u8", self.keys, at + 12 * self.keys).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", self.docs + 1, at + 20 * self.keys).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first row and the number of rows of each key; 0 rows for keys that aren't there."""
        slot = self.hash.slots(keys)
        known = slot >= 0
        if self.keys:
            known &= self.prints[slot] == (mix(keys, 99) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return np.where(known, self.row[slot] if self.keys else 0, 0), np.where(known, self.count[slot] if self.keys else 0, 0)

    def ids(self, row: int) -> bytes:
        """The ids of the document in this row as unsigned 32-bit integers."""
        a, b = int(self.starts[row]), int(self.starts[row + 1])
        raw = self.file.read_at((b - a) * self.width, a * self.width)
        return raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


#: What documents are sorted by: null doc_ids first, then doc_id, text, and the row's place.
ORDER = ("known", "doc_id", "text_hash", "place_hash")


def _ordered(docs: DataFrame) -> DataFrame:
    key = F.col("doc_id").cast("long")
    return docs.select(F.when(key.isNull(), 0).otherwise(1).alias("known"), F.coalesce(key, F.lit(0).cast("long")).alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.xxhash64(F.monotonically_increasing_id()).alias("place_hash"), "text")


def encode(docs: DataFrame, path: str, end_id: int, wide: bool, bounds: list[tuple]) -> DataFrame:
    """(shard, *ORDER, ids): ids in the payload's width, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.of(path), end_id.to_bytes(4, "little")
        for part in (x for b in batches for x in slices(b, 4)):
            ids = [x + end for x in encoder.encode([x or "" for x in part.column(4).to_pylist()])]
            if not wide:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            shard = [bisect.bisect_left(bounds, k) for k in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *part.columns[:4], pa.array(ids, pa.binary())], names=["shard", *ORDER, "ids"])
        encoder.cache.clear()  # the worker may do other things next

    return _ordered(docs).mapInArrow(run, "shard int, known int, doc_id long, text_hash long, place_hash long, ids binary")


def _bounds(docs: DataFrame) -> list[tuple]:
    """Where each shard but the last ends, in ORDER."""
    n_bytes, n_rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n = min(MOST_SAMPLED // 4, max(4 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(n_bytes / SHARD_BYTES)))
    share = min(SAMPLED * n, MOST_SAMPLED) / max(n_rows, 1)
    chosen = F.shiftrightunsigned(F.xxhash64("place_hash"), 1) < F.lit(min((1 << 63) - 1, int(min(share, 1.0) * (1 << 63))))
    sample = _ordered(docs).where(chosen).select(*ORDER).toArrow()  # about MOST_SAMPLED rows at most
    keys = sorted(zip(*(sample.column(i).to_pylist() for i in range(4)), strict=True))
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []


def write(docs: DataFrame, uri: str, path: str | None = None, end_id: int = END_ID) -> dict:
    """Writes the shards below uri; returns the manifest: bounds of the shards, and their parts in order with what they hold."""
    path = path or default_path()
    wide = WordEncoder.of(path).tokenizer.get_vocab_size() > 1 << 16
    bounds = _bounds(docs)
    rows = encode(docs, path, end_id, wide, bounds)
    dealt = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_dir(uri)
        width = 4 if wide else 2
        for shard, parts in runs(batches):
            for number, (name, ids, null, sizes) in enumerate(_write_parts(system, folder, shard, parts, width)):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())], names=["shard", "part", "name", "docs", "tokens"])

    known = F.when(F.col("known") == 1, F.col("doc_id")).alias("doc_id")
    parts = dealt.select("shard", known, "ids").mapInArrow(run, "shard int, part int, name string, docs long, tokens long").collect()  # a row for each file
    at, files = 0, {}
    for p in sorted(parts):
        files.setdefault(p["shard"], []).append((p["name"], at))
        at += p["tokens"]
    return {"uri": uri, "bounds": bounds, "files": files, "tokens": at}


def _write_parts(system, folder: str, shard: int, batches: Iterator[pa.RecordBatch], width: int):
    """Writes a shard's parts; yields (name, doc_ids, nulls, sizes) of each."""
    number, pending = 0, None
    while True:
        name, ids, null, sizes, total = f"{shard:07d}-{number:03d}.tok", [], [], [], 0
        if pending is None and (pending := next(batches, None)) is None:
            return
        with replaced(system, f"{folder}/{name}") as out:
            while pending is not None and total < PART_BYTES:
                raw = pending.column(2)
                length = np.array([len(x.as_buffer()) for x in raw])
                fit = max(1, int(np.searchsorted(np.cumsum(length), PART_BYTES - total, "right")))
                for x in raw.slice(0, fit):
                    out.write(x.as_buffer())
                column = pending.column(1).slice(0, fit)
                ids.append(column.fill_null(0).to_numpy())
                null.append(column.is_null().to_numpy(zero_copy_only=False))
                sizes.append(length[:fit] // width)
                total += int(length[:fit].sum())
                pending = pending.slice(fit) if fit < pending.num_rows else next(batches, None)
            all_ids, all_null, all_sizes = np.concatenate(ids), np.concatenate(null), np.concatenate(sizes)
            index, keys = index_bytes(all_ids, all_null, all_sizes)
            out.write(index)
            out.write(FOOTER.pack(MAGIC, 1, width, len(all_ids), int(all_sizes.sum()), keys, total, len(index), total))
        yield name, all_ids, all_null, all_sizes
        number += 1


def lookup(keys: DataFrame, manifest: dict) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document whose doc_id is among keys (doc_id), by the index; ids in 32 bits.

    Keys go to the shards whose ranges may hold them; each shard is opened once and its keys are probed in order.
    """
    uri, files, bounds = manifest["uri"], manifest["files"], manifest["bounds"]
    ends = [x[:2] for x in bounds]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                k = (0, 0) if key is None else (1, key)
                found += [(shard, key) for shard in range(bisect.bisect_left(ends, k), bisect.bisect_right(ends, k) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int64())], names=["shard", "doc_id"])

    dealt = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(deal, "shard int, doc_id long")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_dir(uri)
        for shard, parts in runs(batches):
            opened = [(Shard(system, f"{folder}/{name}"), start) for name, start in files.get(shard, [])]
            for batch in parts:
                column = batch.column(1)
                null, ids = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy()
                key = key_of(ids, null)
                for file, base in opened:
                    first, count = file.find(key)
                    rows = np.repeat(first, count) + _steps(count)
                    whose = np.repeat(np.arange(len(key)), count)
                    for i in range(0, len(rows), 512):
                        some, of = rows[i : i + 512], whose[i : i + 512]
                        raw = [file.ids(int(r)) for r in some]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[of], pa.int64(), mask=null[of]), pa.array(base + file.starts[some], pa.int64()), pa.array(file.starts[some + 1] - file.starts[some], pa.int64()), pa.array(raw, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _steps(count: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in turn."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes all documents and looks all of them up again."""
    manifest = write(docs, fresh_dir(spark, "tokens"))
    return lookup(docs.select("doc_id"), manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
