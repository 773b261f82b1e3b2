"""Columns with dots, blanks and clashing names pass every operator; vectors of doubles; equal rows."""
import collections

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mooring.llm import (
    bpe, embedding_dedup, language, ngram_lm, packing, pii, quality_rules, sharding, simhash,
)

NAMES = ["a.b", "c d", "row", "t", "_row", "_text", "_own", "quality", "language", "score", "_bucket",
         "_rows", "_place", "slot", "h`x"]


@pytest.fixture(scope="module")
def odd(make_docs):
    rng = np.random.default_rng(2)
    words = "the of and to with from when river mountain stone light water garden".split()
    texts = [" ".join(rng.choice(words, 90)) + f" a{i}@b.org" for i in range(12)] + [None, "", "x"]
    docs = make_docs(texts)
    names = [n for n in NAMES if "`" not in n]
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def test_language_and_quality_and_pii_and_simhash_keep_columns(odd):
    for kept in (language.keep(odd, language.learn(odd)), quality_rules.keep(odd),
                 pii.redact(odd, pii.learn(odd)), simhash.keep(odd)):
        assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
        for row in kept.collect():
            assert [row[n] for n in odd.columns[5:]] == list(range(len(odd.columns) - 5))


def test_quality_and_language_verdicts_beside_odd_columns(odd):
    judged = quality_rules.judge(odd.drop("quality"))
    assert judged.columns == [*odd.drop("quality").columns, "quality"] and judged.count() == 15
    told = language.identify(odd.drop("language"), language.learn(odd))
    assert told.columns == [*odd.drop("language").columns, "language"] and told.count() == 15


def test_tokens_and_scores_carry_odd_columns(odd):
    columns = ["doc_id", "a.b", "c d"]
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(odd, path, pattern, columns)
    assert coded.columns == [*columns, "ids"]
    assert bpe.decode(coded, path, pattern, columns).columns == [*columns, "data"]
    assert bpe.round_trip(odd, path, pattern, columns).count() == 15
    packed = packing.pack_documents(odd, columns, with_ids=True)
    assert packed.columns[:3] == columns and packed.count() >= 15
    scored = ngram_lm.score(odd, ngram_lm.train(odd), columns)
    assert scored.columns[:3] == columns and scored.count() == 15


def test_vectors_of_doubles_keep_their_precision(spark):
    """Cosines that differ from the threshold by less than a float can tell."""
    angle = np.arccos(0.98)
    rows = [(0, [1.0, 0.0], 1), (1, [float(np.cos(angle - 1e-9)), float(np.sin(angle - 1e-9))], 1),
            (2, [float(np.cos(-angle - 1e-9)), float(np.sin(-angle - 1e-9))], 1), (3, None, 1),
            (4, [0.0, 0.0], 1), (5, [1.0, 0.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn(
        "a.b", F.lit(0))
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    assert [found[i].n_links for i in range(6)] == [1, 1, 0, 0, 0, 0]
    assert [found[i].component_id for i in range(6)] == [0, 0, 2, 3, 4, 5]


def test_equal_rows_spread_over_buckets(spark, make_docs):
    docs = make_docs([(7, "one and the same text")] * 4_000)
    scattered = sharding._scattered(docs, 40, 1)
    sizes = [r["count"] for r in scattered.groupBy("_bucket").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 200
    written = sharding.read_shards(spark, sharding.shard(docs), docs.schema)
    assert {r["count"] for r in written.groupBy("shard").count().collect()} == {100}


def test_a_seed_gives_one_result(spark, make_docs, tmp_path):
    make_docs([f"text number {i}" for i in range(500)]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))

    def places(seed):
        rows = sharding.read_shards(spark, sharding.shard(
            docs, shards=7, seed=seed, bucket_bytes=1_000), docs.schema).collect()
        return {(r.shard, r.slot): r.row.doc_id for r in rows}

    first = places(3)
    assert first == places(3) != places(4)
    # The law by hand: whole, counts at most one apart, slots without gaps.
    assert sorted(first.values()) == list(range(500))
    sizes = collections.Counter(s for s, _ in first)
    assert set(sizes.values()) == {71, 72}
    assert all((s, k) in first for s, n in sizes.items() for k in range(n))
