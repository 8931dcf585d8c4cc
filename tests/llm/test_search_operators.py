"""Near-duplicates, top-k search, web archives and the pipeline."""

import importlib.util
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import langid, mixing, neardup, quality, queries, topk, warc
from meshloom.llm.common import fresh_dir
from tests.llm.test_packing_mixing import EDGES, edge_docs

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    found = queries.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in wanted.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in found.collect()) == want


def near_copies(seed):
    """Families of texts with edits, so that some links run through members that the head does not link."""
    rng, out = random.Random(seed), []
    for family in range(6):
        base = [f"w{family}x{rng.randint(0, 10**6)}" for _ in range(80)]
        for _ in range(rng.choice([1, 2, 5, 40])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
            out.append(" ".join(words))
            if rng.random() < 0.3:
                base = words
    return [*out, *out[:3], "A b", "a B", "one"]


@pytest.mark.parametrize(("small", "size"), [(12, 2), (2, 2)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, small, size):
    monkeypatch.setattr(neardup, "SMALL", small)
    texts = near_copies(small)
    docs = spark.createDataFrame([*enumerate(texts), (9000, None), (9001, ""), (9002, " ")], "doc_id long, text string").selectExpr("*", "'r' AS rep", "0 AS key")
    sets = [set(neardup.shingles(t, size).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i: (len(sets[i]), root(i)) for i in range(len(texts))} | {i: (0, i) for i in (9000, 9001, 9002)}
    rows = neardup.group(docs, size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicate_edges(spark):
    docs = edge_docs(spark)
    assert neardup.op9(docs).count() == len(EDGES)
    kept = neardup.keep_rows(docs)
    assert kept.columns == docs.columns and sum(r.doc_id == 6 for r in kept.collect()) == 1
    assert neardup.op9(docs.where("false")).count() == 0


def test_near_duplicates_without_ids_and_with_shared_ids(spark):
    rng = random.Random(3)
    a, b, c, d, e = ([f"w{rng.randint(0, 10**9)}" for _ in range(100)] for _ in range(5))
    text = lambda words, end="": " ".join([*words, *end.split()])
    rows = [(None, text(a)), (None, text(a)), (None, text(a, "more")), (7, text(b)), (7, text(c)), (8, text(c, "more")), (9, text(b, "more")), (None, text(d)), (4, text(d, "more")), (7, text(e)), (None, ""), (None, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.op9(docs).collect()}
    assert got == {(None, 99, None, True), (None, 100, None, True), (7, 99, 7, True), (8, 100, 7, False), (9, 100, 7, False), (None, 99, 4, False), (4, 100, 4, True), (None, 0, None, True)}
    kept = sorted(r.n for r in neardup.keep_rows(docs).collect())
    assert len([n for n in kept if n < 3]) == 1 and kept[1:] == [3, 4, 8, 9, 10, 11]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for j in (0.9, 0.5, 0.2):
        k = round(500 * 2 * j / (1 + j))
        pool = rng.integers(0, 2**62, 1000 - k).astype(np.uint64)
        a, b = neardup.registers(np.unique(pool[:500])), neardup.registers(np.unique(pool[-500:]))
        assert abs((a == b).mean() - j) < 0.15
        assert (neardup.registers(np.unique(pool)) == np.maximum(a, b)).all()
        assert neardup.unlikely(a[None], b[None], np.array([500]), np.array([500]), 0.8)[0] == (j < 0.6)


def brute_top(rows, k=20, every=20):
    """Of (id, vector) rows with whole numbers as components, by arithmetic of any length."""
    out = []
    for i, (qid, q) in enumerate(rows):
        if qid % every == 0:
            scored = [(-max(-(2**63) + 1, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q, v, strict=True)))), x) for j, (x, v) in enumerate(rows) if j != i and len(v) == len(q)]
            out += [(qid, r + 1, x, -s) for r, (s, x) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def clustered(n=3000, dim=8):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, dim))
    v = (centers[rng.integers(0, 12, n)] + 0.02 * rng.normal(size=(n, dim))) * 10
    v[n // 3 : n // 2] = v[n // 3]
    return v


def tree_of(points, every=1):
    ids = np.arange(len(points))[::every]
    return topk.Tree.load(topk.Tree.build(points[::every], ids, ids).dump())


@pytest.mark.parametrize("kind", ["clustered", "embeddings", "scales", "equal"])
def test_top_k_search_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "embeddings":
        v = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()])
    else:
        v = {"clustered": clustered(), "scales": rng.normal(size=(1500, 3)) * np.exp(3 * rng.normal(size=(1500, 1))), "equal": np.zeros((100, 4))}[kind]
    points = np.floor(64 * v)
    q, c = tree_of(points, 20), tree_of(points)
    best = topk.Best(len(q.points), 20)
    topk.search(q, c, best)
    got = sorted((int(q.ids[i]), r + 1, int(best.id[i, r]), int(best.score[i, r])) for i in range(len(q.ids)) for r in range(20))
    assert got == brute_top(list(enumerate(points.tolist())))
    pairs = len(q.points) * len(points)
    if kind == "embeddings":
        # a search over the tree, whose points are about equally far apart: its bounds are those of single points
        assert (c.kids > 0).any() and best.scored < 0.05 * pairs
    if kind == "clustered":
        assert best.scored + best.bounded < 0.25 * pairs and (c.kids > 0).sum() > 10


def test_cover_trees_cover_and_separate():
    points = np.floor(64 * clustered())
    t = tree_of(points)
    for node in range(len(t.kids)):
        mine = t.points[t.lo[node] : t.hi[node]]
        assert np.sqrt(((mine - t.points[t.center[node]]) ** 2).sum(axis=1)).max() <= t.radius[node] + 1e-6
        kids = t.children(np.array([node]))
        if len(kids):
            assert sorted(t.rows(kids).tolist()) == list(range(t.lo[node], t.hi[node])) and (t.radius[kids] <= t.radius[node] / 2).all()
            gap = np.sqrt(((t.centers(kids)[:, None] - t.centers(kids)[None]) ** 2).sum(axis=2))
            assert gap[~np.eye(len(kids), dtype=bool)].min() > t.radius[node] / 2


def test_top_k_over_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 1)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 40)
    v = clustered(2000)
    table = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.op10(table).collect())
    assert got == brute_top([(i, x) for i, x in enumerate(np.floor(64 * v).tolist())])


def test_top_k_with_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-100, 100)) * 10.0 ** rng.choice([0, 0, 0, 3, 7, 9, 12, 200]) for _ in range(3)]) for i in range(60)]
    table = spark.createDataFrame([*rows, (40, [1e308, -1e308, 1e308])], "vec_id long, embedding array<double>")
    whole = [(i, [int(64 * x) for x in v]) for i, v in rows] + [(40, [int(1.7e308), -int(1.7e308), int(1.7e308)])]
    assert sorted(tuple(r) for r in topk.op10(table).collect()) == brute_top(whole)


def test_sketches_find_nearly_all_pairs_at_the_threshold():
    """Of pairs at a Jaccard index of 0.8, those that no band shows or the joint estimate turns down."""
    rng = np.random.default_rng(7)
    n, missed, a_regs, b_regs, sizes = 1500, 0, [], [], []
    for _ in range(n):
        half = int(rng.integers(2, 40))
        pool = rng.integers(0, 2**63, 10 * half, dtype=np.int64).astype(np.uint64)  # 8 of 10 shared, one apart on either side
        a, b = np.unique(pool[: 9 * half]), np.unique(np.concatenate([pool[: 8 * half], pool[9 * half :]]))
        a_regs.append(neardup.registers(a)), b_regs.append(neardup.registers(b)), sizes.append(len(a))
        missed += not np.isin(neardup.band_keys(a_regs[-1]), neardup.band_keys(b_regs[-1])).any()
    sizes = np.array(sizes)
    missed += neardup.unlikely(np.array(a_regs), np.array(b_regs), sizes, sizes, 0.8).sum()
    assert missed <= 1


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [2.0, 2.0]), (6, [2.0, 2.0]), (None, [9.0, 9.0]), (40, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = sorted(tuple(r) for r in topk.op10(table).collect())
    assert got == [(0, 1, 6, 24576), (0, 2, 6, 24576), (0, 3, 20, 6144), (20, 1, 6, 8192), (20, 2, 6, 8192), (20, 3, 0, 6144)]
    assert topk.op10(table.where("false")).count() == 0


def test_archives(spark):
    rows = [(1, "http://www.Example.com/a?b=1#c", "<p>é</p>"), (2, "http://x.org/", "same"), (9, "http://y.org/", "same"), (3, None, None), (4, "http://x.org/", ""), (None, "http://x.org/", "same"), (9, "http://y.org/", "same"), (5, "not a url", "z" * 100000)]
    pages = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, length int, sha string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.op6(spark, pages).collect()}
    sha = lambda x: warc.digest(x.encode())
    assert got == {
        (1, "response", None, 9, sha("<p>é</p>")),
        (2, "revisit", 9, 4, sha("same")),
        (9, "response", None, 4, sha("same")),
        (3, "revisit", 4, 0, sha("")),
        (4, "response", None, 0, sha("")),
        (None, "revisit", 9, 4, sha("same")),
        (5, "response", None, 100000, sha("z" * 100000)),
    }
    assert warc.op6(spark, pages).count() == len(rows)
    assert warc.op6(spark, pages.where("false")).count() == 0
    assert warc.surt("http://www.Example.com/a?b=1#c") == "com,example)/a?b=1"
    odd = ["no host\nbut a line feed", "http://[bad\nhost/", "\n", "a\x1fb\nc", "http://x.org/a\nb", "\r\n", None]
    pages = spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(odd)], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.op6(spark, pages).collect()) == list(range(len(odd)))


def test_index_finds_single_urls(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i // 14}", f"p{i}") for i in range(100)], "page_id long, url string, html string")
    archive, index = fresh_dir(spark, "warc"), fresh_dir(spark, "cdx")
    ranges = warc.write_index(warc.write(pages, archive), index)
    found = warc.lookup(spark.createDataFrame([("http://h3.org/2",), ("http://none.org/",)], "url string"), archive, index, ranges)
    assert sorted(r.page_id for r in found.collect()) == [i for i in range(100) if i % 7 == 3 and i // 14 == 2]


def test_archives_with_keys_that_fill_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 10)
    hot = ["http://hot.org/", None]
    rows = [(i, hot[i % 3] if i % 3 < 2 else f"http://{'abhoxz'[i % 6]}{i}.org/", f"p{i}") for i in range(600)]
    pages = spark.createDataFrame([*rows, (None, "http://hot.org/", "q"), (None, None, "q2")], "page_id long, url string, html string")
    archive, index = fresh_dir(spark, "warc"), fresh_dir(spark, "cdx")
    ranges = warc.write_index(warc.write(pages, archive), index)
    firsts = [r[0] for r in ranges]
    assert firsts == sorted(firsts) and firsts.count("org,hot)/") > 5 and firsts.count("") > 5
    found = [r.page_id for r in warc.lookup(pages.select("url"), archive, index, ranges).collect()]
    assert sorted(found, key=lambda x: -1 if x is None else x) == [None, None, *range(600)]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes, now = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, DATA)
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    edge = edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge, DATA).columns == edge.columns
    assert corpus_pipeline.STAGES[-1][1](spark, edge, DATA).where("offset < 0 OR offset + length > 2048").count() == 0


def test_stages_keep_columns_of_any_name(spark):
    names = ["_row", "rep", "__first", "__copies", "stays", "n_rows", "size", "key", "_text", "common", "m"]
    docs = edge_docs(spark).select("doc_id", "text", "source", "lang", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for stage in (neardup.keep_rows, mixing.mix_rows, lambda d: quality.judge_rows(d, least_words=1), langid.keep_rows):
        rows = stage(docs)
        assert rows.columns == docs.columns and all(tuple(r)[4:] == tuple(range(len(names))) for r in rows.collect())


def test_near_duplicates_keep_what_grouping_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 5 = 0"))
    kept = [r.doc_id for r in neardup.keep_rows(docs).collect()]
    assert sorted(kept) == sorted({r.doc_id for r in neardup.group(docs).where("kept").collect()})


def test_rows_are_judged_by_their_own_label(spark):
    rng = random.Random(6)
    words = {x: ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(60)] for x in (f"l{i}" for i in range(40))}
    prose = lambda x: " ".join(rng.choices(words[x][:12] * 4 + words[x], k=220))
    rows = [(i, prose(f"l{i % 40}"), f"l{i % 40}") for i in range(400)]
    rows += [(400, "## $$ " * 150, "l3"), (400, "## $$ " * 150, None), (401, rows[5][1], "none of them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality.op8(docs).collect()
    own = [r for r in found if r.doc_id < 400]
    assert all(r.word_distance is not None and r.char_distance is not None for r in own) and sum(r.kept for r in own) >= 390
    assert not any(r.kept for r in found if r.doc_id == 400)
    kept = sorted((r.doc_id, r.lang or "") for r in quality.judge_rows(docs).collect())
    assert kept == sorted((r.doc_id, x or "") for r, x in ((r, rows[r.doc_id][2] if r.doc_id < 400 else "none of them") for r in found) if r.kept)
    predicted = {r.doc_id: r.lang_pred for r in langid.op1(docs.where("doc_id < 400")).collect()}
    assert sum(predicted[i] == rows[i][2] for i in range(400)) >= 380 and set(predicted.values()) == set(words)
