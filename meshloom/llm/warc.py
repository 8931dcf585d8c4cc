"""Web archives with a two-level capture index.

Writing: each task writes its pages as WARC/1.1 records, every record a gzip member of its own, in files of at most FILE_BYTES.
Of pages with equal payloads (of at least a minimum size) the one with the largest page_id is a response record with the payload,
the others are revisit records that name it.

Index: captures (reversed-host URL key, page_id, place of the record) are sorted by key into ranges; each range becomes a file of
compressed blocks of BLOCK captures, and a sparse directory holds each block's first key and place. A look-up finds the range by
the ranges' first keys, the block by binary search in the range's directory, the capture by binary search in the block, and reads
the record's bytes alone.

Defined results: a null html is an empty payload; a null url has the empty key; null page_ids are kept, and are smaller than any
other; rows that repeat the largest page_id of a payload are responses all of them; an empty table writes nothing and gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import math
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.common import fresh_dir, materialize, runs, slices
from meshloom.llm.files import open_dir, replaced

LEAST_PAYLOAD = 0
FILE_BYTES = 256 << 20
BLOCK = 128
#: Captures in a range of the index, on average, and at least this many ranges a core.
RANGE = 200_000
LEVEL = 4
CACHED_BLOCKS = 64
#: Records that a look-up returns together.
LOOKED_UP = 1000
DATE = "2024-01-01T00:00:00Z"
SEP = "\x1f"


def surt(url: str | None) -> str:
    """A URL's key: host labels reversed, then path and query; without scheme, user, port, fragment and a leading www.

    What has no host is its own key. Line feeds and SEP, which part the index's lines and fields, are left out.
    """
    url = (url or "").replace(SEP, "").replace("\n", "")
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    if not host:
        return url
    labels = host.removeprefix("www.").split(".")
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(labels))}){tail}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha: str, refers: int | None) -> bytes:
    """A WARC record as one gzip member; a revisit has no payload of its own, but its digest and length."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n", LEVEL, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    content = rest[: int(headers["Content-Length"])]
    return headers, content.partition(b"\r\n\r\n")[2]


def deduplicated(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, url, html, and refers_to: the largest page_id of an equal payload, null for responses.

    Only digests and ids are shuffled to find it; pages that share no payload are not joined by it.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = rows.select("page_id", F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("n"))
    keyed = materialize(keyed, "digests")
    shared = keyed.where(F.col("n") >= least).groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("m")).where("m > 1 AND top IS NOT NULL")
    below = F.col("page_id").isNull() | (F.col("page_id") < F.col("top"))
    revisits = keyed.where(F.col("n") >= least).join(shared, "sha").where(below).select(F.col("page_id").alias("_id"), F.col("sha").alias("_of"), F.col("top").alias("refers_to"))
    revisits = materialize(revisits.distinct(), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_of"))
    joined = rows.withColumn("_sha", F.unhex(F.sha1(payload))).join(revisits, same, "left")
    return joined.select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, uri: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Writes the archives; returns the captures (surt, page_id, file, offset, length) as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, folder = open_dir(uri)
        batches, pending = (x for b in batches for x in slices(b, 2)), None
        while True:
            name, at, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
            pending = next(batches, None) if pending is None else pending
            if pending is None:
                return
            with replaced(system, f"{folder}/{name}") as out:
                info = gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n", LEVEL, mtime=0)
                out.write(info)
                at += len(info)
                while pending is not None and at < FILE_BYTES:
                    for page_id, url, html, refers in zip(*(c.to_pylist() for c in pending.columns), strict=True):
                        payload = (html or "").encode("utf-8", "replace")
                        member = record("response" if refers is None else "revisit", page_id, url, payload, digest(payload), refers)
                        out.write(member)
                        rows.append((surt(url), page_id, name, at, len(member)))
                        at += len(member)
                    pending = next(batches, None)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["surt", "page_id", "file", "offset", "length"])

    written = deduplicated(pages, least).mapInArrow(run, "surt string, page_id long, file string, offset long, length long")
    return materialize(written, "captures")


def write_index(captures: DataFrame, uri: str) -> list[tuple[str, str]]:
    """Writes the two-level index; returns (first key, file) of each range, in order: one entry for RANGE captures.

    A key with many captures fills several ranges that all start with it, so that ranges are put in order by the whole first capture.
    """
    spark = captures.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, math.ceil(captures.count() / RANGE))
    ordered = captures.withColumn("shard", F.lit(0)).select("shard", "surt", "page_id", "file", "offset", "length").repartitionByRange(n, "surt", "page_id", "file", "offset").sortWithinPartitions("surt", F.col("page_id").asc_nulls_first(), "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, folder = open_dir(uri)
        name, first, block, keys, places, at = f"{uuid.uuid4().hex}.cdx", None, [], [], [], 0

        def flush() -> None:
            nonlocal at, block
            data = zlib.compress("\n".join(block).encode("utf-8", "surrogatepass"), LEVEL)
            out.write(data)
            keys.append(block[0].split(SEP, 1)[0])
            places.append((at, len(data)))
            at, block = at + len(data), []

        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        with replaced(system, f"{folder}/{name}") as out:
            while batch is not None:
                for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    first = row if first is None else first
                    block.append(SEP.join("" if x is None else str(x) for x in row))
                    if len(block) == BLOCK:
                        flush()
                batch = next((b for b in batches if b.num_rows), None)
            if block:
                flush()
            directory = zlib.compress("\n".join(f"{k}{SEP}{a}{SEP}{n}" for k, (a, n) in zip(keys, places, strict=True)).encode("utf-8", "surrogatepass"), LEVEL)
            out.write(directory)
            out.write(at.to_bytes(8, "little") + len(directory).to_bytes(8, "little"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip((*first[:4], name), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)],
            names=["first", "page_id", "archive", "offset", "file"],
        )

    found = ordered.mapInArrow(run, "first string, page_id long, archive string, offset long, file string").collect()  # a row for each range
    found.sort(key=lambda r: (r["first"], r["page_id"] is not None, r["page_id"] or 0, r["archive"], r["offset"]))
    return [(r["first"], r["file"]) for r in found]


class Range:
    """A range of the index: its directory is held, its blocks are read as they are asked for."""

    def __init__(self, system, path: str) -> None:
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        at, length = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little")
        rows = [x.split(SEP) for x in zlib.decompress(self.file.read_at(length, at)).decode("utf-8", "surrogatepass").split("\n")]
        self.keys, self.places = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.blocks: OrderedDict[int, list[list[str]]] = OrderedDict()

    def block(self, k: int) -> list[list[str]]:
        if k not in self.blocks:
            at, n = self.places[k]
            self.blocks[k] = [x.split(SEP) for x in zlib.decompress(self.file.read_at(n, at)).decode("utf-8", "surrogatepass").split("\n")]
            if len(self.blocks) > CACHED_BLOCKS:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(k)
        return self.blocks[k]

    def captures(self, key: str) -> Iterator[list[str]]:
        """The captures of a key, found by binary search among the blocks and in the block."""
        k = max(bisect_left(self.keys, key) - 1, 0)  # the key may begin in the block before the first that starts with it
        while k < len(self.keys) and self.keys[k] <= key:
            rows = self.block(k)
            at = bisect_left(rows, key, key=lambda r: r[0])
            while at < len(rows) and rows[at][0] == key:
                yield rows[at]
                at += 1
            k += 1


def lookup(urls: DataFrame, archive: str, index: str, ranges: list[tuple[str, str]]) -> DataFrame:
    """(surt, page_id, payload_bytes, payload_digest, record_type, refers_to) of every capture of the given URLs (url).

    Keys are sorted into the index's ranges, and each range is searched by one task, key by key, in order.
    """
    firsts, names = [r[0] for r in ranges], [r[1] for r in ranges]
    spark = urls.sparkSession
    if not ranges:
        return spark.createDataFrame([], "surt string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

    @F.pandas_udf("string")
    def key_of(url):
        return url.map(surt)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a key may lie in several ranges: from the last that starts below it to the last that starts with it
        for batch in batches:
            rows = [(r, k) for k in batch.column(0).to_pylist() for r in range(max(bisect_left(firsts, k) - 1, 0), bisect_right(firsts, k) or 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.string())], names=["shard", "surt"])

    keys = urls.select(key_of(F.coalesce("url", F.lit(""))).alias("surt")).distinct().mapInArrow(deal, "shard int, surt string")
    dealt = keys.repartition(len(ranges), "shard").sortWithinPartitions("shard", "surt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, folder), (_, cdx) = open_dir(archive), open_dir(index)
        opened: OrderedDict = OrderedDict()
        waiting: list[tuple] = []
        for shard, parts in runs(batches):
            found = Range(system, f"{cdx}/{names[shard]}")
            for key in (k for batch in parts for k in batch.column(1).to_pylist()):
                places = found.captures(key)
                while some := list(itertools.islice(places, LOOKED_UP)):
                    out = []
                    for _, page_id, name, at, n in some:
                        if name not in opened:
                            opened[name] = system.open_input_file(f"{folder}/{name}")
                            if len(opened) > CACHED_BLOCKS:
                                opened.popitem(last=False)[1].close()
                        opened.move_to_end(name)
                        headers, payload = parse(opened[name].read_at(int(n), int(at)))
                        sha = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind, size, refers = headers["WARC-Type"], int(headers["X-Payload-Length"]), None
                        if kind == "response":
                            if digest(payload) != sha or len(payload) != size:
                                raise ValueError(f"page {page_id} in {name} is damaged")
                        else:
                            refers = int(headers["WARC-Refers-To"][len("<urn:page:") : -1])
                        out.append((key, int(page_id) if page_id else None, size, sha, kind, refers))
                    waiting += out
                    if len(waiting) >= LOOKED_UP:
                        yield rows_of(waiting)
                        waiting = []
        if waiting:
            yield rows_of(waiting)

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], names=["surt", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return dealt.select("shard", "surt").mapInArrow(run, "surt string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(flatten(list_transform(range(8), lambda g: list_transform([15, 10, 5, 0], lambda s:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(x, 1 + 5 * g, 5))::BIGINT >> s) & 31)]))), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


def op6(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages and looks all of them up again by URL."""
    archive, index = fresh_dir(spark, "warc"), fresh_dir(spark, "cdx")
    ranges = write_index(write(pages, archive), index)
    return lookup(pages.select("url"), archive, index, ranges).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
