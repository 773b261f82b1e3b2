"""Embedding links where the overlapping shards do not reach the recall."""
import numpy as np

from mooring.llm import embedding_dedup


def test_pairs_are_whole_where_the_largest_overlap_finds_too_few(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MAX_OVERLAP", 1)
    monkeypatch.setattr(embedding_dedup, "exact_pairs", lambda nodes, threshold, exact=(
        embedding_dedup.exact_pairs): exact(nodes, threshold, 70))
    rng = np.random.default_rng(5)
    x = (np.ones(8) + 0.02 * rng.normal(size=(200, 8))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)],
                                  "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(frame, shard_rows=10, overlap=1).collect()
    unit = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (np.arange(200)[:, None] % 2 == np.arange(200) % 2)
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((near.sum(axis=1) - 1).tolist()))
