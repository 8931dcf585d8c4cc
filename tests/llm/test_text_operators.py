"""Language ID, token counts, token files, quality rules and shards."""

import functools
import json
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest

from meshloom.llm import langid, quality, sharding, tokenbin, tokencount
from meshloom.llm.common import fresh_dir
from meshloom.llm.tokens import WordEncoder, default_path
from tests.llm.test_packing_mixing import EDGES, edge_docs, ids_of

DATA = "/root/testdata/sf0.001"


def test_word_by_word_encoding_is_whole_text_encoding():
    rng = random.Random(3)
    letters = list("abAB'’s.,!?_ \n\t\x0b\x1c\x85\xa0éÉßİΣς中١²Ⅷ́#&<|>0") + ["<|endoftext|>", "'ll", "don't "]
    assert WordEncoder.of(default_path()).check(["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)])


def test_words_of_latin_letters_are_encoded_by_the_model_alone():
    encoder, sent = WordEncoder(default_path()), []
    rng, letters = random.Random(9), "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(3000)] + list(letters)
    assert encoder.check([*texts, " ".join(texts), "ÀÉ ªº µ e\u0301 ÷ é÷é l'été d'ÿ"])
    tokenizer = encoder.tokenizer

    class Counted:
        def encode_batch_fast(self, words, **more):
            sent.extend(words)
            return tokenizer.encode_batch_fast(words, **more)

    encoder.tokenizer = Counted()
    encoder.cache.clear()
    list(encoder.encode(texts))
    assert not sent


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.op1(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in rows)


def tree_bits(trained, text):
    """Code length by definition; trained: for each order the counts of bytes after a context."""
    data, total = langid.PAD + text, 0.0
    for i in range(3, len(data)):
        cost = 8.0
        for k in (0, 1, 2, 3):
            seen = trained[k].get(data[i - k : i], {})
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                cost = -np.log2(seen[data[i]] / (n + d))
            elif n:
                cost -= np.log2(d / (n + d))
        total += cost
    return total


def counted(texts):
    out = [{} for _ in range(4)]
    for text in texts:
        data = langid.PAD + text
        for i in range(3, len(data)):
            for k in range(4):
                c = out[k].setdefault(data[i - k : i], Counter())
                c[data[i]] += 1
    return out


def grams_of(texts):
    return tuple(x.astype(np.int64) for x in np.unique(np.concatenate([langid._grams(np.frombuffer(langid.PAD + t, np.uint8)) for t in texts]), return_counts=True))


def test_language_bits_are_those_of_the_context_trees(monkeypatch):
    rng = random.Random(1)
    # languages of several scripts: more than 128 byte values, more than 20,000 contexts of three bytes, more than one group
    letters = [[chr(x) for x in range(a, a + 200)] for a in (0xC0, 0x400, 0x4E00, 0xAC00, 0x1F300)]
    letters[0] += [chr(x) for x in range(0x21, 0x7F)]
    texts = {f"l{k}": ["".join(rng.choices(letters[k % 5] + [" "], k=3000)).encode() for _ in range(3)] for k in range(6)}
    texts["few"] = [b"abracadabra abra"]
    monkeypatch.setattr(langid, "GROUP", 3)
    model = langid.Model({k: grams_of(v) for k, v in texts.items()})
    grams = np.unique(np.concatenate([grams_of(v)[0] for v in texts.values()]))
    assert len(np.unique(grams & 255)) > 128 and len(np.unique(grams >> 8)) > 20_000
    trained = {k: counted(v) for k, v in texts.items()}
    probes = [b"", b"abra", b"abracadabra \xff\xfe", *(texts["l2"][0][:100], texts["l5"][1][50:300]), "".join(rng.choices(sum(letters, []), k=200)).encode(), bytes(rng.randrange(256) for _ in range(300))]
    want = [[tree_bits(trained[k], t) for k in model.langs] for t in probes]
    assert np.allclose(model.bits(probes), want, rtol=1e-5)
    monkeypatch.setattr(langid, "WINDOW", 37)
    assert np.allclose(model.bits(probes), want, rtol=1e-5)


def test_language_sample_is_bounded_and_by_text(spark):
    rows = [(None, f"text number {i % 7 if i % 2 else i} of many", "en") for i in range(5000)] + [(None, f"t {i}", f"odd{i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid._sample(docs).collect()
    by = Counter(r.lang for r in found)
    assert len({(r.lang, r.text) for r in found}) == len(found) and by["en"] <= 1.2 * langid.SAMPLE_DOCS
    again = spark.createDataFrame([(i, t, x) for i, (_, t, x) in enumerate(rows) if zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long, text string, lang string")
    assert {r.text for r in langid._sample(again).where("lang = 'en'").collect()} & {r.text for r in found}


def test_language_edges(spark):
    docs = edge_docs(spark)
    rows = {(r.doc_id, r.lang_pred) for r in langid.op1(docs).collect()}
    assert (2, "und") in rows and (3, "und") in rows and (4, "und") in rows and (1, "en") in rows
    assert langid.op1(docs.where("false")).count() == 0
    assert langid.keep_rows(docs).columns == docs.columns and langid.keep_rows(docs).count() == 5
    assert {r.lang_pred for r in langid.op1(docs.drop("lang").withColumn("lang", docs.text.cast("string").substr(1, 0))).where("doc_id = 2").collect()} == {"und"}


def test_scores_tell_prose_from_junk(spark):
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [(10**6 + i, "".join(rng.choices("qwertzuiopasdfghjklyxcvbnm ", k=400)), None) for i in range(50)]
    rows = langid.op1(docs.union(spark.createDataFrame(junk, docs.schema))).collect()
    assert max(r.score for r in rows if r.doc_id >= 10**6) < np.quantile([r.score for r in rows if r.doc_id < 10**6], 0.001)


def test_language_of_a_very_long_text(spark):
    text = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'de' AND n_chars > 200").first().text
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").union(spark.createDataFrame([(10**6, (text + " ") * (20_000_000 // len(text)), None)], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.op1(docs).where("doc_id = 1000000").collect()] == ["de"]


def test_language_stage_rejects_what_was_not_learned(spark):
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    clean = [r for r in docs if r.text and re.search("[^\\W\\d_]", r.text)]
    lost = "de"
    noise = [(10**6 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz" + " " * (i % 2 * 5), k=rng.randint(20, 2000))), None) for i in range(100)]
    foreign = [r for r in clean if r.lang == lost and len(r.text) >= 100]
    schema = "doc_id long, text string, lang string"
    kept = {r.doc_id for r in langid.keep_rows(spark.createDataFrame([*map(tuple, clean), *noise], schema)).collect()}
    assert not any(i in kept for i, _, _ in noise) and all(r.doc_id in kept for r in clean)
    other = [tuple(r) for r in clean if r.lang != lost]
    kept = {r.doc_id for r in langid.keep_rows(spark.createDataFrame([*other, *((r.doc_id, r.text, None) for r in foreign)], schema)).collect()}
    assert foreign and sum(r.doc_id in kept for r in foreign) <= 0.05 * len(foreign) and all(i in kept for i, _, _ in other)


def greedy(word, pieces):
    i = n = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return -1
        i, n = j, n + 1
    return n


def test_token_counts(spark):
    rng = random.Random(0)
    for _ in range(60):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        words = [bytes(rng.choices(b"abcd", k=rng.randint(1, 12), weights=[4, 4, 4, 0.2])) for _ in range(100)]
        length = np.array([len(w) for w in words])
        got = tokencount.Automaton(pieces).count(np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length)
        assert got.tolist() == [greedy(w, pieces) for w in words]
    known = set(tokencount.load_pieces())
    rows = tokencount.op3(edge_docs(spark)).collect()
    want = []
    for doc_id, text, _ in EDGES:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").lower().encode())
        want.append((doc_id, len(words), sum(greedy(w, known) for w in words), 0))
    assert Counter(map(tuple, rows)) == Counter(want)


def greedy_to_end(word, inner, ends):
    i = n = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in (ends if j == len(word) else inner)), None)
        if j is None:
            return -1
        i, n = j, n + 1
    return n


def test_token_counts_with_marked_word_ends(spark):
    rng = random.Random(1)
    for _ in range(200):
        inner, ends = ({bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))} for _ in range(2))
        words = [bytes(rng.choices(b"abcd", k=rng.randint(1, 12), weights=[4, 4, 4, 0.2])) for _ in range(100)]
        length = np.array([len(w) for w in words])
        got = tokencount.Automaton(inner, ends=ends).count(np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length)
        assert got.tolist() == [greedy_to_end(w, inner, ends) for w in words]
    with open(default_path(), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = tokencount.byte_letters()
    pieces = {bytes(letters[c] for c in x.removesuffix("</w>")) + b"\n" * x.endswith("</w>") for x in vocabulary if all(c in letters for c in x.removesuffix("</w>"))}
    inner, ends = {x for x in pieces if x[-1:] != b"\n"}, {x[:-1] for x in pieces if x[-1:] == b"\n"}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in tokencount.op3(docs).collect()}
    cut = functools.cache(lambda w: greedy_to_end(w, inner, ends))
    for r in docs.collect():
        counts = [cut(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").lower().encode())]
        assert found[r.doc_id] == (len(counts), sum(counts), 0)


def test_token_files(spark):
    docs = edge_docs(spark)
    uri = fresh_dir(spark, "tokens")
    manifest = tokenbin.write(docs, uri)
    rows = tokenbin.lookup(docs.select("doc_id"), manifest).orderBy("start").collect()
    want = sorted(((r[0] is not None, r[0] or 0, zlib.crc32(b)), r[0], b) for r in EDGES for b in [array("I", ids_of(r[1], 2)).tobytes()])
    assert [(r.doc_id, bytes(r.ids)) for r in rows] == [(i, b) for _, i, b in want]
    assert [r.start for r in rows] == [0, *np.cumsum([len(b) // 4 for _, _, b in want])[:-1]]
    strange = spark.createDataFrame([(99,), (1,), (1,)], "doc_id long")
    assert [r.doc_id for r in tokenbin.lookup(strange, manifest).collect()] == [1]
    assert tokenbin.op4(spark, docs.where("false")).count() == 0


def test_token_files_with_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(tokenbin, "SHARD_BYTES", 500)
    rows = [(None, f"text {i % 40}") for i in range(400)] + [(7, f"other {i}") for i in range(300)] + [(i, "same") for i in range(100)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    manifest = tokenbin.write(docs, fresh_dir(spark, "tokens"))
    found = tokenbin.lookup(docs.select("doc_id"), manifest).orderBy("start").collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == Counter((i, array("I", ids_of(t, 2)).tobytes()) for i, t in rows)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    order = [(r.doc_id is not None, r.doc_id or 0) for r in found]
    assert order == sorted(order)
    held = np.diff([start for files in manifest["files"].values() for _, start in files] + [manifest["tokens"]])
    assert held.max() < 0.2 * manifest["tokens"]  # neither null nor 7 gathers in one shard


def test_token_counts_of_very_long_words_and_many_pops(spark):
    piece = [b"a", b"a" * 200, b"b"]
    words = [b"a" * 3_000_000, b"a" * 199 + b"b", b"ab" * 50]
    length = np.array([len(w) for w in words])
    got = tokencount.Automaton(piece).count(np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length)
    assert got.tolist() == [15000, 200, 100]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**62, 20000)).astype(np.uint64)
    built = tokenbin.PerfectHash.build(keys)
    again, _ = tokenbin.PerfectHash.load(built.dump())
    assert sorted(again.slots(keys).tolist()) == list(range(len(keys)))
    assert tokenbin.PerfectHash.build(keys[:0]).slots(keys[:2]).tolist() == [-1, -1]


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(spark, monkeypatch):
    rng = random.Random(2)
    texts = [x[1] for x in EDGES] + [rng.choice([" ", "\n"]).join(rng.choices(["ab", "Cd", "e#", "&", "é1", "the", "|x|"], k=rng.randint(0, 160))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "1 AS n_words", "'c' AS chars")
    want = [(i, *brute_quality(t)) for i, t in enumerate(texts)]
    for few in (128, 0):
        monkeypatch.setattr(quality, "FEW_WINDOWS", few)
        rows = quality.op8(docs).orderBy("doc_id").collect()
        assert [tuple(r)[:7] for r in rows] == want
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality.op8(docs.where("false")).count() == 0


def test_quality_drops_junk_and_keeps_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.op8(docs).collect()
    junk = [r for r in rows if r.n_words >= 50 and r.n_symbols > r.n_words]
    prose = [r for r in rows if not r.base_failed and r.n_words >= 100 and r.n_symbols == 0 and r.n_dup_lines == 0]
    assert junk and not any(r.kept for r in junk)
    assert sum(r.kept for r in prose) >= 0.97 * len(prose)
    kept = quality.judge_rows(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_pipeline_takes_common_words_from_all_documents(spark, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    seen, common = [], quality.common_words
    monkeypatch.setattr(quality, "common_words", lambda *a: seen.append(common(*a)) or seen[-1])
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{chr(97 + x)}" for x in range(26)], range(1, 27), k=30)) for _ in range(600)]
    docs = spark.createDataFrame([(i, "X" if i % 3 else "Y", x) for i, x in enumerate(texts)], "doc_id long, lang string, text string")
    counts = {s: Counter(w for i, x in enumerate(texts) if ("X" if i % 3 else "Y") == s for w in x.split()) for s in "XY"}
    wanted = {s: sorted(c, key=lambda w: (-c[w], w))[: quality.TOP_WORDS] for s, c in counts.items()}
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 2)
    corpus_pipeline.quality_rules(spark, docs, DATA)
    assert seen == [wanted] and quality.common_words(docs, 2) != wanted


def test_shards_fit_their_limit(spark):
    rng = random.Random(4)
    docs = [(i // 2, "x" * rng.randint(0, 400)) for i in range(400)] + [(7, f"hot {i}" * 5) for i in range(200)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 2000).collect()
    assert len(rows) == len(docs) and all(r.shard_bytes <= 2000 for r in rows)
    names = {r.shard for r in rows}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for parent in {n[:-1] for n in names if n}:
        assert sum(r.bytes for r in rows if r.shard.startswith(parent)) > 2000
    uri = fresh_dir(spark, "shards")
    edge = edge_docs(spark)
    sharding.write_shards(edge, uri, 4000)
    assert spark.read.parquet(uri).drop("__meshloom_shard").count() >= len(EDGES)
    assert sharding.op7(edge.where("false")).count() == 0 and sharding.op7(edge).count() == len(EDGES)
