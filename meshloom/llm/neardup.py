"""Near-duplicate groups by SetSketch registers, banded, estimated jointly by likelihood, and verified on full sets.

A document's set holds the distinct 2-word (or n-word) shingles of its words, A-Z lower-cased. Steps:

1. Sketch: register i of a set is the smallest of exponential variates that hash i draws for its members, rounded to a power of
   BASE and truncated to 16 bits. Registers of a union are maxima of registers, and equal ones are the likelier the more alike
   two sets are. Sets that are equal make one class; one representative of each goes on.
2. Bands of ROWS registers make bucket keys. Each bucket of two or more links its members to its head, the one that meets most
   others in its buckets, so a bucket of n gives n - 1 candidates, however large it is.
3. Candidates pass the size bound (exact: 80 % Jaccard needs 80 % in size) and the joint estimate: the likelihood of how many
   registers are larger, smaller and equal, given both cardinalities, against that of the threshold. What is left is confirmed
   on full sets: exact Jaccard of 64-bit shingle hashes.
4. Components by least-id propagation. Links that the heads did not show can only matter between components. In buckets of up to
   SMALL members all such pairs are candidates. In larger ones, let P be the head, x a member that P does not link, y another, and
   A and R what a set adds to P and leaves out. With d(x, y) the size of the symmetric difference, x and y link if and only if
   d(x, y) <= f * (|x| + |y|), f = (1 - t) / (1 + t); d(x, y) = d(x, P) + d(y, P) - 2 * shared, shared being what the differences
   from P have in common. So they must share c = (d(x, P) + d(y, P) - f * (|x| + |y|)) / 2 of their differences, and c > 0, as
   d(x, P) > f * (|x| + |P|). In any one order of shingles, the first that they share then lies among the first d(x, P) - c + 1 of
   x and d(y, P) - c + 1 of y: an equi-join on these gives all candidates, without pairing off the bucket. The order puts what is
   added first, as what is left out is drawn from few.

With 40 bands of 6, a pair at Jaccard 0.8 shares no bucket with probability (1 - 0.8 ** 6) ** 40 = 6e-6.

Defined results: null, empty and blank texts have an empty set, n_shingles 0, and are linked with nothing; with fewer words than
a shingle the whole sequence is the one member; rows with equal doc_id are one document per row, and share a component if their
sets are linked; rows with a null doc_id are linked as any other; a null doc_id is never smallest unless all are null; an empty
table gives no rows; other columns are ignored. Rows are told apart by a 64-bit hash of doc_id and text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import WORD, materialize

BANDS = 40
ROWS = 6
REGISTERS = BANDS * ROWS
#: SetSketch: ratio of the exponential spacing, rate of the variates, largest register.
BASE = 1.001
RATE = 20.0
LARGEST = (1 << 16) - 1
#: In buckets of up to so many members, all pairs between components are candidates.
SMALL = 12
#: Members that meet one copy of their head's set.
SALTED = 1000
#: Bits of the map of documents whose texts are needed again.
BITMAP = 1 << 26
#: Candidates go if the joint estimate makes the threshold unlikely by this many units of log-likelihood: about 6 deviations.
MOST_LOG_RATIO = 18.0
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
GOLDEN = 0x9E3779B97F4A7C15


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = SPLIT.findall((text or "").encode("utf-8", "surrogatepass").translate(UPPER))
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix64(out * np.uint64(GOLDEN) + h[i : i + n] + np.uint64(i + 1))
    return np.unique(out)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    k = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(GOLDEN))
    return (k[:REGISTERS] | np.uint64(1)).astype(np.uint32) | np.uint32(1), k[REGISTERS:].astype(np.uint32)


FACTORS, SHIFTS = _coefficients()


def registers(members: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of hashes."""
    low = (members & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        # two 32-bit halves: a product whose high bits depend on all of the member
        x = low[i : i + 512, None] * FACTORS + SHIFTS
        x ^= x >> np.uint32(15)
        x += high[i : i + 512, None]
        x *= FACTORS
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        np.minimum(least, x.min(axis=0), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    k = np.floor(1.0 - np.log(variate) / math.log(BASE))
    # the middle of the range stands for 1e5 members, so sets of 1 to 1e18 fit below LARGEST
    return np.clip(k, 0, LARGEST).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = regs.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    for i in range(ROWS):
        out = mix64(out ^ (parts[:, i] + np.uint64(i << 20)))
    return out


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


GRID = np.linspace(0.0, 1.0, 201)


def log_likelihood(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, jaccard: np.ndarray) -> np.ndarray:
    """Of a Jaccard index, given how many registers of A are larger, smaller and equal, and both cardinalities."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)
    j = np.minimum(jaccard, most)
    up, down = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
    same = np.maximum(1 - up - down, 1e-12)
    return more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + equal * np.log(same)


def unlikely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """True for pairs of sketches whose joint likelihood speaks against a Jaccard index of the threshold or more."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    args = [x.astype(np.float64)[:, None] for x in (more, less, equal, n_a, n_b)]
    curve = log_likelihood(*args, GRID[None, :])
    above = curve[:, GRID >= threshold - 1e-9].max(axis=1)
    return curve.max(axis=1) - above > MOST_LOG_RATIO


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(row_key, doc_id, n_shingles, set_key, regs, keys): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                n, set_key, regs, keys = [], [], [], []
                for text in part.column(1):
                    members = shingles(text.as_py(), size)
                    n.append(len(members))
                    if len(members):
                        r = registers(members)
                        set_key.append(xxhash.xxh3_128_digest(members.tobytes()))
                        regs.append(r.tobytes())
                        keys.append(band_keys(r).view(np.int64))
                    else:
                        set_key.append(None), regs.append(None), keys.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(set_key, pa.binary()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["row_key", "doc_id", "n_shingles", "set_key", "regs", "keys"])

    schema = f"row_key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_key binary, regs binary, keys array<long>"
    return docs.select("row_key", "text", "doc_id").mapInArrow(run, schema)


def _sets(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(rep, members): the full sets of the representatives in pairs (a, b), made anew from their texts."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                sets = [shingles(x.as_py(), size).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], names=["rep", "set_key", "members"])

    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted")
    texts = _maybe_in(docs.select(F.col("row_key").alias("rep"), "text"), wanted).join(wanted, "rep", "left_semi")
    found = texts.mapInArrow(members, "rep long, set_key binary, members binary")
    # of equal rows, one
    return materialize(found.join(reps.select("rep", "set_key"), ["rep", "set_key"], "left_semi").dropDuplicates(["rep"]).drop("set_key"), "sets")


def _maybe_in(rows: DataFrame, wanted: DataFrame, flag: str | None = None) -> DataFrame:
    """rows without most of those whose rep isn't in wanted, so that few texts are shuffled; with a flag, all of them, flagged.

    wanted is sent as a bitmap of BITMAP bits of a hash, 4 KB a row: 8 MB at most, whatever the number of ids. The fuller it is the
    more rows pass; the join that follows decides.
    """
    at = F.pmod(F.xxhash64("rep"), F.lit(BITMAP)) + 1
    bits = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__meshloom_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__meshloom_bits"))
    marked = rows.withColumn("__meshloom_at", at).withColumn("__meshloom_bucket", F.bitmap_bucket_number("__meshloom_at")).withColumn("__meshloom_place", F.bitmap_bit_position("__meshloom_at"))
    found = marked.join(F.broadcast(bits), "__meshloom_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(__meshloom_bits, CAST(__meshloom_place div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    there = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod("__meshloom_place", F.lit(8)))), F.lit(2)) == 1, F.lit(False))
    return found.select(*rows.columns, there.alias(flag)) if flag else found.where(there).select(*rows.columns)


def _verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of representatives whose sets pass the joint estimate and the exact test."""
    bound = threshold[0] / threshold[1]
    lean = reps.select("rep", "regs", F.col("n_shingles").alias("n"))
    p = pairs.join(lean.toDF("a", "regs_a", "n_a"), "a").join(lean.toDF("b", "regs_b", "n_b"), "b")
    p = p.where(f"{threshold[1]} * least(n_a, n_b) >= {threshold[0]} * greatest(n_a, n_b)")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
                n_a, n_b = (part.column(c).to_numpy() for c in ("n_a", "n_b"))
                yield part.select(["a", "b"]).filter(pa.array(~unlikely(a, b, n_a, n_b, bound)))

    left = materialize(p.mapInArrow(likely, "a long, b long"), "likely")

    sets = _sets(left, reps, docs, size)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(threshold[1] * both >= threshold[0] * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = left.join(sets.toDF("a", "ma"), "a").join(sets.toDF("b", "mb"), "b")
    return materialize(found.mapInArrow(exact, "a long, b long"), "links")


def _differences(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """(head, rep, n_head, n, linked, added, removed) of the pairs (a, b, m), a being the head of m at most, on full sets.

    A head's set is laid out once for each SALTED of its members, who meet one of these.
    """
    sets = _sets(pairs, reps, docs, size)
    salts = F.ceil(F.col("m") / SALTED).cast("int")
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int"))
    heads = pairs.groupBy("a").agg(F.max("m").alias("m"))
    head_sets = sets.toDF("a", "ma").join(heads, "a").select("a", "ma", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                n_a, n_b, linked, added, removed = [], [], [], [], []
                for x, y in zip(part.column("ma"), part.column("mb"), strict=True):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    plus, minus = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                    both = len(x) - len(minus)
                    n_a.append(len(x)), n_b.append(len(y)), added.append(plus.view(np.int64)), removed.append(minus.view(np.int64))
                    linked.append(threshold[1] * both >= threshold[0] * (len(x) + len(y) - both))
                lists = [pa.array(v, pa.list_(pa.int64())) for v in (added, removed)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(linked, pa.bool_()), *lists], names=["head", "rep", "n_head", "n", "linked", "added", "removed"])

    found = pairs.join(sets.toDF("b", "mb"), "b").join(head_sets, ["a", "salt"])
    return materialize(found.mapInArrow(compare, "head long, rep long, n_head long, n long, linked boolean, added array<long>, removed array<long>"), "differences")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of the links (a, b) reaches.

    Each round hooks every node to the least label among its neighbours and then jumps to its label's label; labels and links
    are written after each round, and the rounds end when no link joins two labels: about log(diameter) of them.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("id"), "l"), "labels")
    while True:
        # parents' parents, then the links between what they stand for
        up = labels.toDF("l", "up")
        labels = materialize(labels.join(up, "l", "left").select("id", F.coalesce("up", "l").alias("l")), "labels")
        moved = both.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a != b").distinct()
        moved = materialize(moved, "moved")
        jumped = labels.join(labels.toDF("l", "up"), "l").where("up != l").isEmpty()
        if moved.isEmpty() and jumped:
            return labels.toDF("id", "component")
        hooks = moved.groupBy("a").agg(F.min("b").alias("m")).where("m < a").toDF("id", "m")
        labels = materialize(labels.join(hooks, "id", "left").select("id", F.least("l", F.coalesce("m", "l")).alias("l")), "labels")


def _with_components(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows with c, the component of rep."""
    return rows.join(comp.toDF("rep", "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))


def _small_cross(buckets: DataFrame, comp: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): pairs within a small bucket that lie in two components."""
    named = materialize(_with_components(buckets, comp), "named")
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    rows = named.join(mixed, "key", "left_semi")
    met = rows.join(rows.select("key", F.col("rep").alias("o"), F.col("n").alias("m"), F.col("c").alias("d")), "key")
    return met.where(f"rep < o AND c != d AND {threshold[1]} * least(n, m) >= {threshold[0]} * greatest(n, m)").select(F.col("rep").alias("a"), F.col("o").alias("b")).distinct()


def _large_cross(differences: DataFrame, comp: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): pairs around a head that lie in two components, one of them not linked to the head, and share what they must."""
    f = (threshold[1] - threshold[0]) / (threshold[1] + threshold[0])
    both = F.concat("added", "removed")
    named = _with_components(differences, comp).select("head", "rep", "n", "c", "linked", F.size(both).alias("d"), both.alias("e"), "n_head")
    # no partner leaves more than this many places to look at: sizes differ by the threshold at most, and d(y, P) >= d(x, P) - f (|x| + |y|)
    reach = F.floor(f * F.col("n") * (1 + threshold[1] / threshold[0]) + 1e-9)
    near = F.floor((F.col("d") - f * (F.col("n_head") - F.col("n"))) / 2 + 1e-9)  # of y: c > (d(y, P) + f (|P| - |y|)) / 2

    def places(rows: DataFrame, most: Column, names: tuple[str, ...]) -> DataFrame:
        cut = F.slice("e", F.lit(1), F.greatest(F.lit(0), F.least(most.cast("int") + 1, F.size("e"))))
        return rows.select("head", "rep", "n", "c", "d", F.posexplode(cut).alias("p", "e")).toDF("head", *names, "e")

    probes = places(named.where("NOT linked"), reach, ("vx", "nx", "cx", "dx", "px"))
    index = places(named, F.least(reach, near), ("vy", "ny", "cy", "dy", "py"))
    share = (F.col("dx") + F.col("dy") - f * (F.col("nx") + F.col("ny"))) / 2 - 1e-9
    sized = F.expr(f"{threshold[1]} * least(nx, ny) >= {threshold[0]} * greatest(nx, ny)")
    fits = (F.col("px") <= F.col("dx") - share) & (F.col("py") <= F.col("dy") - share)
    x, y = probes.alias("x"), index.alias("y")
    met = x.join(y, (F.col("x.head") == F.col("y.head")) & (F.col("x.e") == F.col("y.e")) & (F.col("cx") != F.col("cy")) & sized & fits)
    return met.select(F.least("vx", "vy").alias("a"), F.greatest("vx", "vy").alias("b")).distinct()


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _grouped(docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """(row_key, doc_id, n_shingles, component_id, kept_row): one row per document; kept_row is the row_key that stands for the component."""
    docs = docs.select(_row_key().alias("row_key"), "doc_id", "text")
    sketched = materialize(sketch(docs, size), "sketches")
    # of each class the row that represents it, and the one with the smallest doc_id
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    classes = sketched.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("row_key").alias("rep"), F.min(first).alias("first"))
    classes = materialize(classes, "classes")
    reps = sketched.join(classes.select("set_key", F.col("rep").alias("row_key")), ["set_key", "row_key"], "left_semi").dropDuplicates(["row_key"])
    reps = materialize(reps.select(F.col("row_key").alias("rep"), "set_key", "n_shingles", "regs", "keys"), "reps")
    spread = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    counts = spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = materialize(spread.join(counts, "key"), "met")
    scored = met.join(met.groupBy("rep").agg(F.sum("m").alias("score")), "rep")
    heads = scored.groupBy("key").agg(F.max_by("rep", F.struct("score", F.bitwise_not("rep"))).alias("head"))
    buckets = materialize(met.join(heads, "key"), "buckets")
    stars = buckets.where("rep != head").groupBy(F.col("head").alias("a"), F.col("rep").alias("b")).agg(F.max("m").alias("m"))
    stars = materialize(stars, "stars")
    differences = _differences(stars.where(f"m > {SMALL}").select("a", "b", "m"), reps, docs, size, threshold)
    links = _verify(stars.where(f"m <= {SMALL}").select("a", "b"), reps, docs, size, threshold)
    links = materialize(links.union(differences.where("linked").select("head", "rep")), "links")
    comp = components(links)
    more = _small_cross(buckets.where(f"m > 2 AND m <= {SMALL}").select("key", "rep", "n"), comp, threshold)
    more = materialize(more.union(_large_cross(differences, comp, threshold)).distinct(), "more")
    if not more.isEmpty():
        found = _verify(more, reps, docs, size, threshold)
        if not found.isEmpty():
            comp = components(materialize(links.union(found), "links"))
    # every document: the first row of its class representative's component
    named = materialize(_with_components(classes, comp).select("set_key", "c", "first"), "named-classes")
    firsts = named.groupBy("c").agg(F.min("first").alias("first"))
    chosen = materialize(named.select("set_key", "c").join(firsts, "c").select("set_key", "first"), "chosen")
    out = sketched.select("row_key", "doc_id", "n_shingles", "set_key").join(chosen, "set_key", "left")
    alone = F.col("set_key").isNull()
    return out.select(
        "row_key",
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.when(alone, F.col("row_key")).otherwise(F.col("first.row_key")).alias("kept_row"),
    )


def group(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document; (8, 10) links at a Jaccard index of 8/10 or more."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return _grouped(docs, size, threshold).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_rows(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of docs that stand for their group, with their columns as they were; of repeated rows one stays.

    Rows without a word are copies of nothing; those that have no doc_id either all stay. Only rows that may be dropped or repeated
    are shuffled, all others pass.
    """
    flag, nothing = "__meshloom_maybe", F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(WORD)
    groups = _grouped(docs, size, (8, 10)).groupBy("row_key").agg(F.min("kept_row").alias("kept_row"), F.count(F.lit(1)).alias("m"))
    groups = materialize(groups.where("m > 1 OR row_key != kept_row").select(F.col("row_key").alias("rep"), (F.col("row_key") == F.col("kept_row")).alias("stays")), "dropped")
    packed = docs.select(F.struct(*docs.columns).alias("__meshloom_row"), _row_key().alias("rep"), nothing.alias("__meshloom_nothing"))
    marked = _maybe_in(packed, groups.select("rep"), flag)
    odd = marked.where(f"{flag} AND NOT __meshloom_nothing").join(groups, "rep", "left")
    twice = odd.where("stays").dropDuplicates(["rep"])
    kept = [marked.where(f"__meshloom_nothing OR NOT {flag}"), odd.where("stays IS NULL"), twice]
    return reduce(DataFrame.union, [x.select("__meshloom_row") for x in kept]).select("__meshloom_row.*")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, coalesce(len(s), 0) AS n FROM g),
e AS (SELECT doc_id, unnest(s) AS x FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, c) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id)
SELECT n.doc_id, n::BIGINT AS n_shingles, coalesce(m.c, n.doc_id) AS component_id, n.doc_id = coalesce(m.c, n.doc_id) AS kept
FROM n LEFT JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = n.doc_id
"""


def op9(docs: DataFrame) -> DataFrame:
    return group(docs, size=2)
