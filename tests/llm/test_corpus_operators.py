"""Language-model scores, runs of repeated words and the alignment of two tokenizers against their definitions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np

from meshloom.llm import alignment, lmscore, periodic
from tests.llm.test_packing_mixing import edge_docs

DATA = "/root/testdata/sf0.001"


def lowered(text):
    return (text or "").encode().translate(lmscore.LOWER).split()


def context_counts(texts):
    """For each context of each text the counts of what follows it."""
    seen = {}
    for words in texts:
        data = lmscore.END * lmscore.ORDER + b" ".join(words) + lmscore.END
        for i in range(lmscore.ORDER, len(data)):
            for k in range(lmscore.ORDER + 1):
                seen.setdefault(data[i - k : i], Counter())[data[i]] += 1
    return seen


def bits_by_definition(seen, words):
    data, total = lmscore.END * lmscore.ORDER + b" ".join(words) + lmscore.END, 0.0
    for i in range(lmscore.ORDER, len(data)):
        excluded = set()
        for k in range(lmscore.ORDER, -1, -1):
            here = {b: n for b, n in seen.get(data[i - k : i], {}).items() if b not in excluded}
            if here:
                n, d = sum(here.values()), len(here)
                if data[i] in here:
                    total += math.log2(2 * n / (2 * here[data[i]] - 1))
                    break
                total += math.log2(2 * n / d)
            excluded |= set(seen.get(data[i - k : i], ()))
        else:
            total += math.log2(256 - len(excluded))
    return total


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def check_scores(docs):
    rows = [(r.doc_id, lowered(r.text)) for r in docs.collect()]
    training = [w for i, w in rows if not held(i)]
    seen, counts = context_counts(training), Counter(w for x in training for w in [*x, b"\n"])
    total, kinds = sum(counts.values()), len(counts)
    found = lmscore.op11(docs).collect()
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    wanted = []
    for i, words in rows:
        tokens = [*words, b"\n"]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
        wanted.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, -bits_by_definition(seen, words) * math.log10(2)))
    assert len(found) == len(wanted)
    for r, w in zip(sorted(found, key=key), sorted(wanted, key=key), strict=True):
        assert tuple(r)[:5] == w[:5] and np.allclose(tuple(r)[5:], w[5:], rtol=1e-9), (r, w)


def test_scores_are_those_of_the_definition(spark):
    check_scores(spark.read.parquet(f"{DATA}/documents.parquet").limit(60).select("doc_id", "text"))


def test_scores_are_the_same_with_next_to_nothing_sent(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "HOT_GRAMS", 40)
    monkeypatch.setattr(lmscore, "HOT_WORDS", 5)
    rows = [(i, " ".join(random.Random(i).choices(["the", "The", "a", "wörter", "zz" * 40, "x1", f"only{i}"], k=i % 30))) for i in range(80)]
    check_scores(spark.createDataFrame(rows, "doc_id long, text string"))


def test_scores_of_odd_rows(spark):
    check_scores(edge_docs(spark))
    empty = edge_docs(spark).limit(0)
    assert lmscore.op11(empty).count() == 0
    lone = lmscore.score_texts(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), lmscore.held_out(lmscore.F.lit(7)) & lmscore.F.lit(False)).first()
    assert lone.n_known == 0 and lone.base_score == 0.0 and math.isclose(lone.score, -3 * math.log10(256))


def test_long_texts_are_scored_in_parts():
    rng = random.Random(2)
    for _ in range(300):
        texts = ["".join(rng.choices("ab  \n", k=rng.randint(0, 60))).encode() for _ in range(4)]
        whole = {}
        for part in lmscore._parts(texts, 7):
            grams, own = lmscore._grams(part)
            for g, k in zip(grams.tolist(), own.tolist(), strict=True):
                whole.setdefault(part[k].row, []).append(g)
            assert all(x.words or x.ends for x in part)
        for k, text in enumerate(texts):
            assert whole[k] == [g for part in lmscore._parts([text]) for g in lmscore._grams(part)[0].tolist()]


def test_held_out_texts_take_few_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.score for r in lmscore.op11(docs).collect() if r.held_out}
    size = sum(len(b" ".join(lowered(r.text))) + 1 for r in docs.collect() if r.doc_id in rows)
    assert -sum(rows.values()) / lmscore.LOG_2 < 2.25 * size  # a fifth less than without contexts of several bytes


def runs_by_definition(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            own = words[i : i + length]
            if j > i and length >= max(6, 4 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_the_definition():
    rng = random.Random(1)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 12)):
            n, k = rng.randint(0, 70), rng.choice([0, 1, 2, 5])
            words = [b"w%d" % rng.randint(0, k) for _ in range(n)]
            texts.append(periodic.planted(rng.randint(0, 99), words) if rng.random() < 0.7 else words)
        assert periodic.runs_of(texts) == [runs_by_definition(x) for x in texts]


def test_runs_of_documents(spark):
    for docs in (spark.read.parquet(f"{DATA}/documents.parquet"), edge_docs(spark)):
        rows = docs.select("doc_id", "text").collect()
        wanted = []
        for i, text in rows:
            words = (text or "").encode().split()
            h = zlib.crc32(("" if i is None else str(i)).encode())
            if h % 10 == 0 and words:
                a = h // 10 % len(words)
                p = 1 + (len(words) - a) // (3 + h // 10 % 8)
                words = [words[k] if k < a else words[a + (k - a) % p] for k in range(len(words))]
            runs = runs_by_definition(words) if len(words) < 1500 else periodic.runs_of([words])[0]
            gone = {k for s, n, q in runs for k in range(s + q, s + n)}
            best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None, None, None)
            text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
            wanted.append((i, len(runs), *best, runs and 1000 * best[1] // best[2] or None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
        assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in periodic.op12(docs).collect())


def test_runs_in_rows_are_cut_to_a_period(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, None), (3, " plain  text "), (4, "")], "period long, text string")
    assert [tuple(r) for r in periodic.collapse_rows(docs).orderBy("period").collect()] == [(1, "x a b y"), (2, None), (3, " plain  text "), (4, "")]
    assert periodic.op12(edge_docs(spark).limit(0)).count() == 0


def plainly_aligned(aligner, text):
    """Ids of the whole text by both libraries, groups and links by two pointers; None without tokens."""
    if not text:
        return None
    a, b = aligner.first.encode(f" {text}", add_special_tokens=False).ids, aligner.second.encode(text) or [aligner.blank]
    sizes = [[len(own[i]) for i in ids] for ids, (own, _, _) in zip((a, b), aligner.sides, strict=True)]
    if any(b"".join(own[i] for i in ids) != f" {text}".encode() for ids, (own, _, _) in zip((a, b), aligner.sides, strict=True)):
        return None
    i = j = x = y = 0
    groups, links, left, right = [], [], [], []
    while i < len(a):
        links.append((a[i], b[j]))
        end_a, end_b = x + sizes[0][i], y + sizes[1][j]
        if end_a <= end_b:
            left.append(str(a[i]))
            i, x = i + 1, end_a
        if end_b <= end_a:
            right.append(str(b[j]))
            j, y = j + 1, end_b
        if end_a == end_b:
            groups.append(f"{','.join(left)}|{','.join(right)}")
            left, right = [], []
    return a, b, groups, links


def test_parts_align_as_whole_texts_do():
    rng, aligner = random.Random(7), alignment.Aligner.of(alignment.default_paths())
    letters = [*"abAB'’s.,!?_ \n\t\x0b\x1c\x85\xa0 éÉßİΣς中١²Ⅷ́#&<|>0▁\x00\r   ", "<|endoftext|>", "'ll", "don't ", "<s>", "</s>", "<0x41>", "\r\n", " ;\r", "  "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(4000)]
    found = aligner.ids(texts)
    counts, groups, links, begin = aligner.aligned([x or (b"", b"") for x in found])
    for k, text in enumerate(texts):
        wanted = plainly_aligned(aligner, text)
        a, b, own, pairs = wanted or ([], [], [], [])
        assert (wanted is None) == (found[k] is None)
        assert [c[k] for c in counts] == [len(a), len(b), len(own)] and groups[k] == ";".join(own)
        assert [tuple(x) for x in links[begin[k] : begin[k + 1]].tolist()] == pairs


def check_alignment(docs):
    aligner = alignment.Aligner.of(alignment.default_paths())
    rows = [(r.doc_id, plainly_aligned(aligner, r.text)) for r in docs.collect()]
    counts = Counter(x for _, w in rows if w for x in w[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    wanted = []
    for i, w in rows:
        a, b, groups, links = w or ([], [], [], [])
        hashed = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        wanted.append((i, len(a), len(b), len(groups), len(links), hashed, sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)))
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in alignment.op13(docs).collect())


def test_alignment_counts(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(80).select("doc_id", "text")
    check_alignment(docs)
    check_alignment(edge_docs(spark))
    assert alignment.op13(edge_docs(spark).limit(0)).count() == 0
    monkeypatch.setattr(alignment, "HOT_PAIRS", 100)
    check_alignment(docs)


def test_base_scores_by_sql(spark):
    con = duckdb.connect()
    sql = f"""
    WITH d AS (SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), chr(10)) AS w FROM '{DATA}/documents.parquet'),
    t AS (SELECT doc_id, unnest(w) AS w FROM d),
    c AS (SELECT w, count(*) AS c FROM t WHERE doc_id NOT IN (SELECT unnest(?)) GROUP BY w),
    s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
    SELECT doc_id, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base_score FROM t LEFT JOIN c USING (w), s GROUP BY doc_id
    """
    out = [i for (i,) in con.execute(f"SELECT doc_id FROM '{DATA}/documents.parquet'").fetchall() if held(i)]
    wanted = {r[0]: r[1:] for r in con.execute(sql, [out]).fetchall()}
    found = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lmscore.op11(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert found.keys() == wanted.keys()
    assert all(found[k][:3] == wanted[k][:3] and math.isclose(found[k][3], wanted[k][3], rel_tol=1e-9) for k in found)


def test_grams_are_gathered_by_sorting(monkeypatch):
    """Counts in training and in all, over parts that are merged and passed on; no hash table of grams is made."""
    rng, gathered = np.random.default_rng(5), lmscore.Gathered()
    monkeypatch.setattr(lmscore, "GATHERED", 50)
    wanted, found = (Counter(), Counter()), (Counter(), Counter())
    for part in range(12):
        grams, train = rng.integers(0, 40 + 10 * part, 200) * (1 << 40) + 7, rng.random(200) < 0.5
        wanted[0].update(grams[train].tolist())
        wanted[1].update(grams.tolist())
        gathered.add(grams, train)
        for keys, n, n_all in gathered.take(part == 11):
            assert (np.diff(keys) > 0).all()
            found[0].update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
            found[1].update(dict(zip(keys.tolist(), n_all.tolist(), strict=True)))
    assert +found[0] == wanted[0] and found[1] == wanted[1] and not gathered.found
    assert [x.tolist() for x in lmscore._tally(np.array([], np.int64))] == [[], []]
