"""Language of a text by prediction by partial matching over bytes, with frozen statistics.

Each language has a context tree of up to three preceding bytes. A byte that follows a context n of N times costs -log2(n / (N + d))
bits, d being the number of different bytes seen there; any other costs the escape, -log2(d / (N + d)), and what it costs in the
context one byte shorter; a context never seen escapes free of charge; without context all bytes cost alike. The language with
the fewest bits for the whole text wins. Since statistics are frozen after training, the cost of a byte depends on itself and the
three before it alone. So the trees are unrolled: for each order there is a hash table of the contexts and bytes that any language
has seen, with their cost in each language, and one of the contexts with their escapes; a batch of texts is scored by look-ups.
The tables hold all that was seen and nothing else; languages share them in groups of GROUP.

Training takes at most about SAMPLE_DOCS different labelled texts of each language and SAMPLE_ALL in all, chosen by a hash of the
text, each whole; every label is learned. Texts are lower-cased.

The score is the probability of the language among those learned, times the share that its code saves of eight bits a byte: junk
costs nearly as much as no model at all. `keep_rows` wants a probability of LEAST_SCORE, and bits a byte within a bound for each
language, learned from training documents that are scored by a model of the others.

Defined results: `und` with score 0 for null texts and texts without a letter, and for all texts if nothing could be learned; ties
go to the language first in order; a null doc_id counts as the empty text for its remainder; repeated rows agree; an empty table
gives no rows; other columns are ignored by `predict` and carried along by `keep_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import materialize, slices

SAMPLE_DOCS = 500
SAMPLE_ALL = 50_000
#: Languages whose costs stand side by side in a table.
GROUP = 16
ORDER = 3
PAD = b" " * ORDER
#: Positions that are scored at once.
WINDOW = 1 << 19
UNKNOWN = "und"
#: Documents whose language is less probable are rejected by `keep_rows`.
LEAST_SCORE = 0.5
#: So are those whose bits a byte lie further than this from their language's towards a foreign one's, and above this many times
#: their language's own, by this many bits.
TOWARDS_FOREIGN = 2 / 3
LEAST_TIMES = 2.0
SLACK = 64.0
LETTER = regex.compile(r"\p{L}")


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(3))


def as_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _grams(data: np.ndarray) -> np.ndarray:
    """Codes of each byte with the three before it."""
    x = data.astype(np.uint32)
    return (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of the texts of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(as_bytes(text))
            for lang, texts in by.items():
                parts = [_grams(np.frombuffer(PAD + x, np.uint8)) for x in texts if x]
                if parts:
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """Rows of values for 32-bit keys, found by hashing; keys that aren't there have the last row, which is zero."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = np.uint32(32 - max(4, (2 * len(keys)).bit_length()))
        self.keys = np.append(keys.astype(np.uint32), np.uint32(0))
        self.values = np.vstack([values, np.zeros((1, values.shape[1]))]).astype(np.float32)
        self.slots = np.full(1 << (32 - int(self.shift)), len(keys), np.int32)
        left = np.arange(len(keys))
        at = self._home(self.keys[left])
        while len(left):
            free = self.slots[at] == len(keys)
            self.slots[at[free]] = left[free]  # of several, the last stays
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; that after the last for foreign ones."""
        none = len(self.keys) - 1
        at = self._home(keys)
        row = self.slots[at]
        left = np.flatnonzero((self.keys[row] != keys) & (row != none))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            row[left] = self.slots[at[left]]
            left = left[(self.keys[row[left]] != keys[left]) & (row[left] != none)]
        return row


class Trees:
    """The context trees of some languages, unrolled."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        size = len(counts)
        costs = np.full((256, size), 8.0)  # without context: all bytes alike
        shorter, seen_shorter = costs, np.arange(256)
        self.costs, self.escapes = [], []
        for order in range(ORDER + 1):
            mask = (1 << (8 * (order + 1))) - 1
            own = []
            for gram, n in counts:
                keys, at = np.unique(gram & mask, return_inverse=True)
                own.append((keys, np.bincount(at, n, len(keys))))
            seen = np.unique(np.concatenate([k for k, _ in own]))
            contexts = np.unique(seen >> 8)
            escape, cost = np.zeros((len(contexts), size)), np.empty((len(seen), size))
            suffix = np.searchsorted(seen_shorter, seen & (mask >> 8)) if order else seen
            for k, (keys, n) in enumerate(own):
                at = np.searchsorted(contexts, keys >> 8)
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                there = kinds > 0
                escape[there, k] = np.log2((total + kinds)[there] / kinds[there])
                cost[:, k] = escape[np.searchsorted(contexts, seen >> 8), k] + shorter[suffix, k]
                cost[np.searchsorted(seen, keys), k] = np.log2((total + kinds)[at] / n)
            self.costs.append(Table(seen, cost))
            self.escapes.append(Table(contexts, escape))
            shorter, seen_shorter = cost, seen
        self.uniform = 8.0

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Of each byte with the three before it, in each language."""
        row = self.costs[ORDER].find(grams)
        out = self.costs[ORDER].values[row]
        left = np.flatnonzero(row == len(self.costs[ORDER].keys) - 1)
        for order in range(ORDER, -1, -1):
            if not len(left):
                return out
            codes = grams[left] & np.uint32((1 << (8 * (order + 1))) - 1)
            if order < ORDER:
                row = self.costs[order].find(codes)
                known = row < len(self.costs[order].keys) - 1
                out[left[known]] += self.costs[order].values[row[known]]
                left, codes = left[~known], codes[~known]
            out[left] += self.escapes[order].values[self.escapes[order].find(codes >> np.uint32(8))]
        out[left] += self.uniform
        return out


class Model:
    """Code lengths of texts in the languages learned."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        own = [counts[x] for x in self.langs]
        self.trees = [Trees(own[i : i + GROUP]) for i in range(0, len(own), GROUP)]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        length = np.array([len(x) for x in texts], np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        # one text after the other, each after its padding, in windows that share the bytes of a context
        data = np.frombuffer(b"".join([y for x in texts for y in (PAD, x)]), np.uint8)
        ends = np.cumsum(length + ORDER)
        for at in range(0, len(data) - ORDER, WINDOW):
            grams = _grams(data[at : at + WINDOW + ORDER])
            place = np.arange(at + ORDER, at + ORDER + len(grams))
            first, last = np.searchsorted(ends, [place[0], place[-1]], "right")
            begin = ends[first : last + 1] - length[first : last + 1]
            lo, hi = np.maximum(begin, place[0]) - place[0], np.minimum(ends[first : last + 1], place[-1] + 1) - place[0]
            there = np.flatnonzero(hi > lo)
            cuts = np.stack([lo[there], hi[there]], axis=1).reshape(-1)
            for k, tree in enumerate(self.trees):
                cost = np.vstack([tree.bits(grams), np.zeros((1, len(tree.costs[0].values[0])), np.float32)])
                sums = np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)[::2] if len(cuts) else 0.0
                out[first + there, k * GROUP : k * GROUP + cost.shape[1]] += sums
        return out

    def judge(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its probability, all being equally likely beforehand."""
        best = bits.argmin(axis=1)
        odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0))
        return best, 1.0 / odds.sum(axis=1)


def _sample(docs: DataFrame) -> DataFrame | None:
    """(lang, text) of the documents to train on: labelled ones whose remainder isn't 1; None if there are none."""
    spread = F.shiftrightunsigned(F.xxhash64("text"), 1) / float(1 << 63)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 1)).select("lang", "text", spread.alias("spread"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("m"), F.approx_count_distinct("spread", 0.01).alias("n"))
    counts = counts.collect()  # a row for each label
    if not counts:
        return None
    each = min(SAMPLE_DOCS, max(1, SAMPLE_ALL // len(counts)))
    limits = docs.sparkSession.createDataFrame([(r["lang"], each / max(r["n"], 1)) for r in counts], "lang string, share double")
    # copies of a text are one text
    return known.join(F.broadcast(limits), "lang").where("spread < share").dropDuplicates(["lang", "spread"]).select("lang", "text")


def _learn(sample: DataFrame) -> Model | None:
    table = count_grams(sample).toArrow()  # at most the grams of the sample
    langs, gram, n = (table.column(i).to_numpy() for i in range(3))
    counts = {lang: (gram[langs == lang], n[langs == lang]) for lang in sorted(set(langs))}
    return Model(counts) if counts else None


def train(docs: DataFrame) -> Model | None:
    """A model of the labelled documents whose remainder isn't 1; None if there are none."""
    sample = _sample(docs)
    return None if sample is None else _learn(sample)


def train_bounded(docs: DataFrame) -> tuple[Model | None, np.ndarray]:
    """The model of `train`, and the most bits a byte of each of its languages.

    Each half of the training documents is scored by a model of the other half, as their own model knows them too well. A language's
    own rate is the median of what its documents take; a foreign one's is what the documents of the language that is most like
    another take in the others. A language that only one half has is scored by the others, which makes its bound a wide one; without any
    score there is no bound.
    """
    sample = _sample(docs)
    if sample is None:
        return None, np.zeros(0)
    sample = materialize(sample.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))), "training")
    model = _learn(sample)
    if model is None:
        return None, np.zeros(0)
    rates = None
    for half in (0, 1):
        own = _learn(sample.where(F.col("half") != half))
        if own:
            found = _rates(sample.where(F.col("half") == half), own)
            rates = found if rates is None else rates.union(found)
    medians = [] if rates is None else rates.groupBy("lang").agg(F.median("rate").alias("rate"), F.median("other").alias("other")).collect()  # a row for each language
    own, foreign = {r["lang"]: r["rate"] for r in medians}, min((r["other"] for r in medians), default=8.0)
    return model, np.array([max(LEAST_TIMES * x, x + TOWARDS_FOREIGN * (foreign - x)) for x in (own.get(lang, np.inf) for lang in model.langs)])


def _rates(docs: DataFrame, model: Model) -> DataFrame:
    """(lang, rate, other): bits a byte of each text with a letter, in the best language, and in the best but its own (8 if there is none)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in slices(b)):
            rows = [(lang, as_bytes(x)) for lang, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if LETTER.search(x)]
            if rows:
                rate = sent.value.bits([x for _, x in rows]) / np.array([[len(x)] for _, x in rows])
                mine = np.array([[lang == x for x in sent.value.langs] for lang, _ in rows])
                other = np.where(mine, np.inf, rate).min(axis=1)
                columns = [pa.array([lang for lang, _ in rows], pa.string()), pa.array(rate.min(axis=1)), pa.array(np.where(np.isinf(other), 8.0, other))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "rate", "other"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, rate double, other double")


def _judged(model: Model | None, texts: pa.Array) -> Iterator[tuple[int, int, float, float, int]]:
    """Of texts with a letter: row, language, its probability, its bits, and bytes."""
    texts = texts.to_pylist()
    known = [i for i, x in enumerate(texts) if model and x and LETTER.search(x)]
    if known:
        data = [as_bytes(texts[i]) for i in known]
        bits = model.bits(data)
        best, probability = model.judge(bits)
        yield from zip(known, best.tolist(), probability.tolist(), bits.min(axis=1).tolist(), map(len, data), strict=True)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score): one row per document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in (x for b in batches for x in slices(b)):
            langs, scores = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows
            for i, best, probability, bits, size in _judged(own, part.column(1)):
                langs[i], scores[i] = own.langs[best], probability * max(0.0, 1.0 - bits / (8 * size))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is known with LEAST_SCORE or more and by its bits a byte, with their columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(train_bounded(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bound = sent.value
        for part in (x for b in batches for x in slices(b, at)):
            keep = [i for i, best, probability, bits, size in _judged(model, part.column(at)) if probability >= LEAST_SCORE and bits <= bound[best] * size + SLACK]
            yield part.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def op1(docs: DataFrame) -> DataFrame:
    out = predict(docs, train(docs))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
