"""Log-probabilities of texts by prediction by partial matching over bytes, with pretrained statistics, beside a unigram base.

A text is its words, A-Z lower-cased, joined by one space, then END; before it stand ORDER ENDs. Training texts fill a trie of
contexts of up to ORDER bytes. A byte's code starts at the longest context seen: if the byte was seen there n times, of N in all
and D different ones, it costs log(2 N / (2 n - 1)), else the escape log(2 N / D), and coding goes on in the context one byte
shorter, without the bytes that the longer one has seen (symbol exclusion): they leave N and D. After the empty context, the bytes
not yet excluded cost alike. A context that excludes all of the next one's bytes is passed free of charge.

Statistics are frozen, so the cost of a byte depends on itself and the ORDER before it: one number for each different string of
ORDER + 1 bytes (a gram) in the corpus. Steps:

1. Count grams and words of all documents, in training and in all, within tasks and then by one grouped sum.
2. Nodes of the trie: counts of all suffixes of the grams, grouped by context. What a context excludes from the next is a join of
   nodes with the nodes one byte shorter.
3. Costs: grams seen in training have theirs in their own node; others go down the trie, a join for each order.
4. Scores: the HOT_GRAMS and HOT_WORDS most frequent at most are sent to all tasks, which look them up. A document's other grams
   and words are written with it and shuffled to their costs. Frequent ones are never shuffled, and what is sent is bounded; what
   is counted and shuffled grows with the corpus.

The base is the sum over words and one end of each text of log10((c + 0.1) / (N + 0.1 * (V + 1))), c being the token's count in the
training texts, N that of all tokens there, V that of different ones.

Defined results: null, empty and blank texts are an END alone; without training texts all bytes cost log10(256); a null doc_id
counts as the empty text for its remainder; repeated rows are scored one by one; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import Lookup, frequent, lists, materialize, row_numbers, slices

ORDER = 5
END = b"\n"
#: Grams and words that are sent to all tasks: 17 MB and about 20 MB.
HOT_GRAMS = 1 << 20
HOT_WORDS = 1 << 18
#: Longer words are counted by a 128-bit hash, after a space, which no word holds.
LONG_WORD = 48
#: Bytes of text that are looked at together; longer texts are cut between words.
PART = 2 << 20
#: Bits of a text's place in a part beside a gram: a part is made of one slice's rows, of which there are 1000 at most.
TEXT_BITS = 63 - 8 * (ORDER + 1)
#: Different grams or words that a task gathers before it passes them on.
GATHERED = 1 << 20
#: Bits of a context in the trie's key; its order stands above.
CONTEXT_BITS = 8 * ORDER
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACE, WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]")
LOG_2 = math.log10(2.0)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(10)) == 0


def key_of(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b" " + xxhash.xxh3_128_digest(word)


class Text:
    """A part of a document: its words, and its bytes after those before it."""

    def __init__(self, row: int, words: list[bytes], before: bytes, ends: bool) -> None:
        self.row, self.words, self.before, self.ends = row, words, before, ends
        self.data = b" ".join(words) + (END if ends else b" ")


def _texts(rows: list[bytes | None], most: int) -> Iterator[Text]:
    """The texts of rows, longer ones than most in parts that are cut behind white space."""
    for row, text in enumerate(rows):
        text, before, start, ends = (text or b"").translate(LOWER), END * ORDER, 0, False
        while not ends:
            space = SPACE.search(text, start + most)
            stop = space.end() if space else len(text)
            ends = not WORD.search(text, stop)
            words = text[start:stop].split()
            if words or ends:
                part = Text(row, words, before, ends)
                yield part
                before = (before + part.data)[-ORDER:]
            start = stop


def _parts(rows: list[bytes | None], most: int = PART) -> Iterator[list[Text]]:
    part, size = [], 0
    for x in _texts(rows, most):
        if part and size + len(x.data) > most:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x.data)
    if part:
        yield part


def _grams(part: list[Text]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of the texts, and the text it is in."""
    data = np.frombuffer(b"".join([y for x in part for y in (x.before, x.data)]), np.uint8).astype(np.int64)
    grams = np.zeros(len(data) - ORDER, np.int64)
    for i in range(ORDER + 1):
        grams <<= 8
        grams |= data[i : i + len(grams)]
    sizes = np.array([len(x.data) for x in part])
    own = np.repeat(np.arange(len(part)), sizes)
    return grams[np.arange(len(own)) + own * ORDER], own


def _tally(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each is there, or the sum of its n."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")  # sorted runs are merged
        keys, n = keys[order], n[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[start], np.diff(start, append=len(keys)) if n is None else np.add.reduceat(n, start) if len(start) else n


class Gathered:
    """Counts of grams, in training and in all, merged when there are many; a gram's lowest bit tells the two apart meanwhile."""

    def __init__(self) -> None:
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, grams: np.ndarray, train: np.ndarray) -> None:
        self.found.append(_tally(grams << 1 | train))

    def take(self, all_of_it: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.found and (all_of_it or sum(len(x) for x, _ in self.found) > 2 * GATHERED):
            self.found = [_tally(*[np.concatenate(x) for x in zip(*self.found, strict=True)])]
            if all_of_it or len(self.found[0][0]) > GATHERED:
                keys, n = self.found.pop()
                yield _tally(keys >> 1)[0], _tally(keys >> 1, np.where(keys & 1, n, 0))[1], _tally(keys >> 1, n)[1]


def count(docs: DataFrame, train: Column) -> DataFrame:
    """(gram, word, n, n_all): how often each gram and each word's key is found where train holds, and in all; the other one is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = Gathered(), (Counter(), Counter())

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            for keys, n, n_all in grams.take(last):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(len(keys), pa.binary()), pa.array(n), pa.array(n_all)], names=names)
            if last or len(words[0]) + len(words[1]) > GATHERED:
                for k, own in enumerate(words):
                    n = pa.array(own.values(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.array(map(key_of, own), pa.binary()), n if k else pa.array(np.zeros(len(own), np.int64)), n], names=names)
                    own.clear()

        names = ["gram", "word", "n", "n_all"]
        for batch in (x for b in batches for x in slices(b, size=PART)):
            own = batch.column(0).to_pylist()
            for part in _parts(batch.column(1).cast(pa.binary()).to_pylist()):
                flag = np.array([own[x.row] for x in part])
                codes, text = _grams(part)
                grams.add(codes, flag[text])
                for x in part:
                    words[own[x.row]].update(x.words)
                    if x.ends:
                        words[own[x.row]][END] += 1
                yield from out(False)
        yield from out(True)

    found = docs.select(train.alias("train"), "text").mapInArrow(run, "gram long, word binary, n long, n_all long")
    return materialize(found.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")), "counts")


def _low(code: Column, bits: int) -> Column:
    return code.bitwiseAND(F.lit((1 << bits) - 1))


def _node(order: int, context: Column) -> Column:
    return context.bitwiseOR(F.lit(order << CONTEXT_BITS)) if order else F.lit(0).cast("long")


def trie(grams: DataFrame) -> DataFrame:
    """(node, n, d, kids, out): contexts of each order; kids maps next bytes to counts, out is what it excludes of the next shorter one's n."""
    seen = grams.where("n > 0")
    suffixes = F.explode(F.array(*[F.struct(_node(k, _low(F.shiftright("gram", 8), 8 * k)).alias("node"), _low(F.col("gram"), 8).cast("int").alias("next")) for k in range(ORDER + 1)]))
    counted = seen.select(suffixes.alias("x"), "n").groupBy("x.node", "x.next").agg(F.sum("n").alias("n"))
    nodes = counted.groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.map_from_entries(F.collect_list(F.struct("next", "n"))).alias("kids"))
    nodes = materialize(nodes, "nodes")
    order = F.shiftright("node", CONTEXT_BITS)
    shorter = F.lit(0).cast("long")
    for k in range(2, ORDER + 1):
        shorter = F.when(order == k, _node(k - 1, _low(F.col("node"), 8 * (k - 1)))).otherwise(shorter)
    # ORDER 1 contexts are 256 at most; a longer context has 256 ones that are a byte longer at most
    next_one = nodes.select(F.col("node").alias("shorter"), F.col("kids").alias("theirs"))
    out = F.aggregate(F.map_keys("kids"), F.lit(0).cast("long"), lambda x, b: x + F.element_at("theirs", b))
    longer = nodes.where(order > 0).withColumn("shorter", shorter).join(next_one, "shorter").select("node", "n", "d", "kids", out.alias("out"))
    return materialize(longer.unionByName(nodes.where(order == 0).withColumn("out", F.lit(0).cast("long"))), "trie")


def costs(grams: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gram, n_all, bits): the code length of each gram's last byte after those before it."""
    own = nodes.where(F.shiftright("node", CONTEXT_BITS) == ORDER).select("node", F.col("n").alias("all"), F.explode("kids").alias("next", "n"))
    seen = own.select(F.shiftleft(_low(F.col("node"), CONTEXT_BITS), 8).bitwiseOR(F.col("next").cast("long")).alias("gram"), F.col("n").alias("n_all"), F.log2(2 * F.col("all") / (2 * F.col("n") - 1)).alias("bits"))
    zero = F.lit(0).cast("long")
    left = grams.where("n = 0").select("gram", "n_all", F.lit(0.0).alias("bits"), zero.alias("n_out"), zero.alias("d_out"), F.lit(False).alias("found"))
    for k in range(ORDER, -1, -1):
        node = nodes.where(F.shiftright("node", CONTEXT_BITS) == k).select("node", "n", "d", "kids", "out")
        left = left.withColumn("node", _node(k, _low(F.shiftright("gram", 8), 8 * k)))
        met = left.join(F.broadcast(node) if k <= 1 else node, "node", "left")  # 257 nodes of 256 bytes at most
        n, d = F.col("n") - F.col("n_out"), F.col("d") - F.col("d_out")
        hit = F.element_at("kids", _low(F.col("gram"), 8).cast("int"))
        here = ~F.col("found") & F.col("n").isNotNull()
        cost = F.when(here & hit.isNotNull(), F.log2(2 * n / (2 * hit - 1))).when(here & (d > 0), F.log2(2 * n / d)).otherwise(0.0)
        left = met.select(
            "gram",
            "n_all",
            (F.col("bits") + cost).alias("bits"),
            F.coalesce("out", zero).alias("n_out"),
            # the next one excludes what this context has seen; a context never seen excludes nothing
            F.coalesce("d", zero).alias("d_out"),
            (F.col("found") | (here & hit.isNotNull())).alias("found"),
        )
    rest = F.when(F.col("found"), 0.0).otherwise(F.log2(256 - F.col("d_out")))
    return materialize(seen.unionByName(left.select("gram", "n_all", (F.col("bits") + rest).alias("bits"))), "costs")


def score_texts(docs: DataFrame, train: Column) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score): one row per document; learned: train, true of those to learn from."""
    spark = docs.sparkSession
    counted = count(docs, train)
    grams, words = counted.where("gram IS NOT NULL").drop("word"), counted.where("word IS NOT NULL").select("word", "n")
    cost = costs(grams, trie(grams))
    total, kinds = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    weight = lambda c: np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    hot = frequent(cost, "n_all", HOT_GRAMS).select("gram", "bits").toArrow()
    hot_words = frequent(words.where(F.col("n") > 0), "n", HOT_WORDS).where(F.length("word") <= LONG_WORD).toArrow()
    times = hot_words.column("n").to_numpy()
    # texts that don't end within a part have no end to look up
    sent = spark.sparkContext.broadcast((Lookup(hot.column(0).to_numpy()), hot.column(1).to_numpy(), {w: k for k, w in enumerate(hot_words.column("word").to_pylist())}, np.append(weight(times.astype(np.float64)), 0.0)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "learned", "n_tokens", "n_known", "base", "bits", "gram", "gram_n", "word", "word_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, bits, place, logs = sent.value
        numbers, get = row_numbers(), place.get
        for batch in (x for b in batches for x in slices(b, size=PART)):
            ids = [next(numbers) for _ in range(batch.num_rows)]
            for part in _parts(batch.column(1).cast(pa.binary()).to_pylist()):
                size = len(part)
                codes, text = _grams(part)
                some, n = _tally(codes << TEXT_BITS | text)
                code, owner = some >> TEXT_BITS, some & ((1 << TEXT_BITS) - 1)
                at, there = lookup.find(code)  # in order, so that neighbours are looked up together
                sums = np.bincount(owner, np.where(there, bits[at] if len(bits) else 0.0, 0.0) * n, size)
                rare = np.flatnonzero(~there)
                rare = rare[np.argsort(owner[rare], kind="stable")]
                code, owner, n = code[rare], owner[rare], n[rare]
                tokens = [x.words + [END] if x.ends else x.words for x in part]
                lengths = np.array([len(x) for x in tokens])
                flat = [w for x in tokens for w in x]
                found = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
                of = np.repeat(np.arange(size), lengths)
                base, known = np.bincount(of, logs[found], size), np.bincount(of, found >= 0, size).astype(np.int64)
                unknown = Counter(zip(of[found < 0].tolist(), [flat[i] for i in np.flatnonzero(found < 0)], strict=True))
                whose = np.array([k for k, _ in unknown], np.int64)  # in the order of texts
                columns = [pa.array([ids[x.row] for x in part], pa.int64()), batch.column(2).take(pa.array([x.row for x in part])), batch.column(0).take(pa.array([x.row for x in part]))]
                columns += [pa.array(lengths, pa.int64()), pa.array(known), pa.array(base), pa.array(sums), lists(code, owner, size), lists(n.astype(np.int32), owner, size)]
                offsets = lists(np.fromiter(unknown.values(), np.int32, len(unknown)), whose, size)
                columns += [pa.ListArray.from_arrays(offsets.offsets, pa.array([key_of(w) for _, w in unknown], pa.binary())), offsets]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"row long, doc_id {kind}, learned boolean, n_tokens long, n_known long, base double, bits double, gram array<long>, gram_n array<int>, word array<binary>, word_n array<int>"
    found = materialize(docs.select(train.alias("train"), "text", "doc_id").mapInArrow(run, schema), "scores")
    none = F.lit(None)
    rare = found.select("row", F.explode(F.arrays_zip("gram", "gram_n")).alias("x")).select("row", "x.gram", "x.gram_n").join(cost.select("gram", F.col("bits").alias("each")), "gram")
    rare = rare.select("row", F.lit(0).alias("n_known"), F.lit(0.0).alias("base"), (F.col("each") * F.col("gram_n")).alias("bits"))
    odd = found.select("row", F.explode(F.arrays_zip("word", "word_n")).alias("x")).select("row", "x.word", "x.word_n").join(words, "word")
    odd = odd.select("row", F.when(F.col("n") > 0, F.col("word_n")).otherwise(0).alias("n_known"), (F.col("word_n") * F.log10((F.col("n") + 0.1) / (total + 0.1 * (kinds + 1)))).alias("base"), F.lit(0.0).alias("bits"))
    plain = ["row", "doc_id", "learned", "n_tokens", "n_known", "base", "bits"]
    more = rare.unionByName(odd).withColumns({"doc_id": none.cast(kind), "learned": none.cast("boolean"), "n_tokens": F.lit(0).cast("long")}).withColumn("n_known", F.col("n_known").cast("long"))
    sums = found.select(*plain).unionByName(more.select(*plain)).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("learned").alias("learned"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "bits")])
    return sums.select("doc_id", "learned", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (-F.col("bits") * LOG_2).alias("score"))


def op11(docs: DataFrame) -> DataFrame:
    out = score_texts(docs, ~held_out(F.col("doc_id")))
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
