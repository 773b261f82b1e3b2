"""Resampling, lexical search and the quality classifier against brute force, and odd inputs."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mooring.llm import quality_classifier, resampling, search
from mooring.llm.byte_words import words
from mooring.llm.catalog import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_by_hand(text):
    return WORD.findall(lower(text))


def with_odd_columns(docs):
    return docs.select("*", F.lit(1).alias("a.b"), F.lit(2).alias("score"), F.lit(3).alias("rank"),
                       F.lit(4).alias("query"), F.lit(5).alias("n_words"), F.lit(6).alias("x"))


def test_words_by_bytes(odd_docs):
    for row in odd_docs.collect():
        data = None if row.text is None else row.text.encode()
        assert [w.decode() for w in words(data)] == words_by_hand(row.text)


# ---- resampling

def resampled_by_hand(rows, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    def features(text):
        ws = words_by_hand(text)
        return [zlib.crc32(" ".join(ws[i:i + n]).encode()) % buckets
                for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets)
                                                / ((s[b] + 1) * (t_all + buckets)))) for b in found)
        name = f"{seed}:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words_by_hand(text))])
    able = sorted((r for r in out if r[5] >= least),
                  key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 97, 35)])
def test_resampling_equals_brute_force(make_docs, longest, buckets, percent):
    rng = random.Random(longest)
    vocabulary = ["alpha", "Beta", "ça", "x1", "中", "the", "of", "Ω"]
    texts = [rng.choice(" .-\n").join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
             for _ in range(200)]
    target = [" ".join(rng.choice(vocabulary[:3]) for _ in range(30)) for _ in range(5)] + [None]
    got = resampling.resample(make_docs(texts), make_docs(target), longest=longest, buckets=buckets,
                              percent=percent)
    want = resampled_by_hand(list(enumerate(texts)), target, longest, buckets, percent=percent)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert 0 < sum(r[4] is not None for r in want.elements())


def test_resampling_of_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] * 3
    docs = with_odd_columns(odd_docs.union(odd_docs).union(odd_docs))
    got = resampling.resample(docs, odd_docs, min_words=1, percent=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == resampled_by_hand(
        rows, [r.text for r in odd_docs.collect()], least=1, percent=50)
    assert resampling.resample(no_docs, odd_docs).count() == 0
    assert Counter(tuple(r) for r in resampling.resample(docs, no_docs).collect()) == (
        resampled_by_hand(rows, []))


# ---- search

def found_by_hand(rows, items, k=50):
    """rows: (doc_id, text); items: (item_id, text). A list per item of (doc_id, score)."""
    bags = [(d, Counter(words_by_hand(t))) for d, t in rows]
    sizes = [sum(b.values()) for _, b in bags]
    n_all, l_all = sum(map(bool, sizes)), sum(sizes)
    out = []
    for _, text in items:
        scores = [0] * len(bags)
        for term in set(words_by_hand(text)):
            df = sum(term in b for _, b in bags)
            w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1)))
            for i, (_, b) in enumerate(bags):
                if b[term]:
                    m = 100 - 50 + (50 * sizes[i] * n_all) // l_all
                    scores[i] += w * ((1_000_000_000 * b[term]) // (1000 * b[term] + 20 * m))
        best = sorted(((-s, d is None, d or 0) for s, (d, _) in zip(scores, bags) if s > 0))[:k]
        out.append([(None if none else d, -s) for s, none, d in best])
    return out


def grouped(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: r.rank):
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(got[r.item_id])
    return got


@pytest.mark.parametrize("chunk_docs, block_terms", [(16_384, 200_000), (37, 12)])
def test_search_equals_brute_force(make_docs, monkeypatch, chunk_docs, block_terms):
    monkeypatch.setattr(search, "CHUNK_DOCS", chunk_docs)
    monkeypatch.setattr(search, "BLOCK_TERMS", block_terms)
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for _ in range(900)]
    texts += texts[:120] * 2  # ties
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))) for _ in range(15)]
    items += ["", None, "nowhere at all", "W1 w1,w1", "w3"]
    got = grouped(search.search(make_docs(texts), make_docs(items).withColumnRenamed(
        "doc_id", "item_id"), k=20))
    want = found_by_hand(list(enumerate(texts)), list(enumerate(items)), 20)
    assert got == {i: found for i, found in enumerate(want) if found}


def test_accumulators_stop_and_scores_stay_whole():
    """Common terms make no accumulators once the rare ones have filled the k best."""
    rng = np.random.default_rng(5)
    docs, terms = 3_000, 12
    share = 0.9 / 1.9 ** np.arange(terms)
    holds = rng.random((terms, docs)) < share[:, None]
    term, doc = np.nonzero(holds)
    repeats = rng.integers(1, 6, len(term))
    length = [int(n) for n in rng.integers(5, 60, docs)]
    weights = np.array([search.weight(docs, int(h.sum())) for h in holds], np.int64)
    chunk = search.Chunk(np.repeat(term, repeats), np.repeat(doc, repeats), length, weights, docs,
                         sum(length))
    whole = np.zeros(docs, np.int64)
    np.add.at(whole, chunk.at, chunk.gain)
    rare_first = list(range(terms))[::-1]
    for k in (1, 10, 50):
        at, scores = chunk.search(rare_first, k)
        kth = np.sort(whole)[-k]
        assert (scores == whole[at]).all()
        assert set(np.flatnonzero(whole >= kth)) == set(at)
        bar = int(np.sort(whole)[-5])
        assert set(chunk.search(rare_first, k, bar)[0]) == set(
            np.flatnonzero(whole >= max(bar, kth)))
    # With few wanted, most documents never get an accumulator.
    made = []
    plain = np.partition
    try:
        np.partition = lambda a, kth: (made.append(len(a)), plain(a, kth))[1]
        chunk.search(rare_first, 1)
    finally:
        np.partition = plain
    assert made and max(made) < 0.7 * docs


def test_search_of_odd_documents(odd_docs, no_docs, make_docs):
    docs = with_odd_columns(odd_docs.union(odd_docs))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = make_docs([(1, "A b c word"), (2, None), (3, ""), (4, "é ß 中文 line"), (None, "same")])
    found = search.search(docs, with_odd_columns(items.withColumnRenamed("doc_id", "item_id")))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    want = found_by_hand(rows, [(r.doc_id, r.text) for r in items.collect()])
    assert grouped(found) == {i: w for i, w in zip([1, 2, 3, 4, None], want) if w}
    renamed = items.withColumnRenamed("doc_id", "item_id")
    assert search.search(no_docs, renamed).count() == 0
    assert search.search(docs, renamed.limit(0)).columns == found.columns
    # A repeated item has rows for each time.
    assert search.search(docs, renamed.union(renamed)).count() == 2 * found.count()


# ---- quality

def test_quality_scores_equal_a_plain_computation(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality_classifier.judge(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = {d: quality_classifier.statistics((t or "").encode()) for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in texts}
    taught = [(r.doc_id, r.quality) for r in labels.collect()
              if r.doc_id in texts and not held[r.doc_id] and r.quality is not None]
    rows = np.array([x[d] for d, _ in taught])
    label = np.array([q for _, q in taught])
    scale = rows.std(axis=0)
    scale[scale < 1e-9] = 1
    rows = (rows - rows.mean(axis=0)) / scale
    covariances = [np.cov(rows[label == k].T, bias=True) for k in (0, 1)]
    share = [(label == k).mean() for k in (0, 1)]
    pooled = sum(s * c for s, c in zip(share, covariances))

    def log_density(k, z):
        c = 0.6 * covariances[k] + 0.4 * pooled
        c = 0.9 * c + 0.1 * np.trace(c) / len(c) * np.eye(len(c))
        apart = z - rows[label == k].mean(axis=0)
        return (np.log(share[k]) - 0.5 * np.linalg.slogdet(c)[1]
                - 0.5 * apart @ np.linalg.inv(c) @ apart)

    origin = np.array([x[d] for d, _ in taught]).mean(axis=0)
    for d in texts:
        z = (x[d] - origin) / scale
        apart = np.clip(log_density(1, z) - log_density(0, z), -700, 700)
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-apart)), rel=1e-5, abs=1e-9)
        assert got[d].held_out == held[d] and got[d].predicted == (got[d].score >= 0.7)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op12_quality"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_quality_of_odd_documents_and_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(0, 1), (1, 0), (1, 0), (3, 1), (6, 1), (6, 0), (7, 0), (8, 1), (9, None), (10, 7), (None, 1),
         (11, 1)], "doc_id long, quality int").withColumn("a.b", F.lit(0)).withColumn("x", F.lit(0))
    got = quality_classifier.judge(with_odd_columns(odd_docs), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
    assert quality_classifier.judge(no_docs, labels).count() == 0
    for some, want in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0),
                       (labels.where("quality = 0"), 0.0)):
        assert {r.score for r in quality_classifier.judge(odd_docs, some).collect()} == {want}


def test_whole_texts_are_scored(make_docs):
    """Junk at the end of a long text counts."""
    clean = "Some words of a clean text go on here. " * 3_000
    a, b = (quality_classifier.statistics(t.encode()) for t in (clean, clean + "x### " * 9_000))
    assert b[quality_classifier.STATISTICS.index("symbols")] > a[
        quality_classifier.STATISTICS.index("symbols")] + 0.2
