"""The stored candidate dataset: all its columns, and rows in an order that compresses."""
import pytest
from pyspark.sql import functions as F

from mooring.constants import CANDIDATE_ROW
from mooring.operators.candidates import PARTS, SPREAD, candidates, cluster_parts
from mooring.operators.labelling import candidate_row, label_dataset
from mooring.plans import storage
from mooring.sources import sinks
from builders import make_nodes, make_pods


def small_fleet(spark, pods=600):
    nodes = [(k, 4000 + 500 * (k % 7), (8 + k % 5) << 30, 10 * k, k << 24, k % 9) for k in range(40)]
    arrivals = [(e, 0, e % 50, 100 + 50 * (e * 7 % 11), (1 + e * 5 % 3) << 28) for e in range(pods)]
    return make_pods(spark, arrivals), make_nodes(spark, nodes)


@pytest.mark.parametrize("name", ["sink_parquet", "sink_csv", "sink_outputs", "src_dataset"])
def test_sinks_store_all_columns(spark, monkeypatch, name):
    stored = {}
    monkeypatch.setattr(storage, "labelled",
                        lambda spark, sf, parts=None: label_dataset(*small_fleet(spark, 30), parts))
    monkeypatch.setattr(storage.fleet, "pods", lambda *a: small_fleet(spark, 30)[0])
    for writer in ("write_csv", "write_parquet"):
        real = getattr(sinks, writer)

        def spy(df, path, *args, real=real, writer=writer, **kw):
            stored[writer] = df.columns, df.count()
            return real(df, path, *args, **kw)

        monkeypatch.setattr(sinks, writer, spy)
    assert getattr(storage, name)(spark, None).count() == (2 if name == "sink_outputs" else 30)
    wanted = {"sink_csv": ["write_csv"], "sink_outputs": ["write_csv", "write_parquet"]}
    assert sorted(stored) == wanted.get(name, ["write_parquet"])
    assert all(found == (CANDIDATE_ROW, 30 * 40) for found in stored.values())


def test_rows_in_order_are_stored_smaller_and_whole(spark, tmp_path):
    rows = candidate_row(label_dataset(*small_fleet(spark))).coalesce(1)
    sizes = []
    for name, order in (("a", ()), ("b", sinks.CANDIDATE_ORDER)):
        path = sinks.write_parquet(rows, str(tmp_path / name), order=order)
        sizes.append(sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet")))
        back = spark.read.parquet(path)
        assert back.exceptAll(rows).count() == 0 and back.count() == rows.count() == 600 * 40
    assert sizes[1] < 0.8 * sizes[0]


def test_clusters_have_as_many_parts_as_their_pods_ask_for(spark):
    pods, nodes = small_fleet(spark, 90)
    parts = cluster_parts(pods, 20)
    assert [tuple(r) for r in parts.collect()] == [(0, 5)]
    assert candidates(pods, nodes, parts=parts).select(SPREAD).distinct().count() == 5
    assert candidates(pods, nodes, parts=cluster_parts(pods)).select(SPREAD).distinct().count() == 1
    assert PARTS not in candidates(pods, nodes, parts=parts).columns


def test_how_arrivals_are_dealt_does_not_change_the_rows(spark):
    """Also with clusters that have no pods or no nodes, and pods of no cluster."""
    pods, nodes = small_fleet(spark, 90)
    pods = pods.unionByName(pods.limit(2).withColumn("cluster_id", F.lit(5).cast("long"))).unionByName(
        pods.limit(1).withColumn("cluster_id", F.lit(None).cast("long")))
    nodes = nodes.unionByName(nodes.limit(3).withColumn("cluster_id", F.lit(9).cast("long")))
    a, b = (candidate_row(label_dataset(pods, nodes, parts)) for parts in (None, cluster_parts(pods, 7)))
    assert a.count() == b.count() == 90 * 40 and a.exceptAll(b).count() == 0
    left = [candidates(pods, nodes, how="left", parts=p).count() for p in (None, cluster_parts(pods, 7))]
    assert left[0] == left[1] == 90 * 40 + 3
