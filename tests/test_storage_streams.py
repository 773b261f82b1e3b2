"""Sources, sinks, the student model and streams with several micro-batches."""
import datetime

import pytest
from pyspark.sql import functions as F

from mooring.constants import FEATURES
from mooring.operators import boosting, placement, replay, student
from mooring.sources import datasets, fleet, sinks
from mooring.streaming import jobs, stateful
from builders import make_nodes, make_pods
from test_ranking import fleet as random_fleet


def test_load_order_and_missing(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    parquet = sinks.write_parquet(df, str(tmp_path / "d"))
    csv = sinks.write_csv(df.limit(2), str(tmp_path / "d.csv"))
    absent = str(tmp_path / "none")
    assert datasets.load_dataset(spark, absent, parquet, csv).count() == 5
    assert datasets.load_dataset(spark, csv, parquet).count() == 2
    assert datasets.load_dataset(spark, parquet=absent, csv=csv).count() == 2
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, absent, absent)


def test_column_check(spark):
    with pytest.raises(ValueError, match="teacher_score"):
        datasets.check_columns(spark.range(1).select(*[F.lit(0).alias(c) for c in FEATURES],
                                                     F.lit(1).alias("event_id")))


def test_append_and_split_files(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).coalesce(1)
    sinks.write_parquet(df, path, rows_per_file=40)
    sinks.write_parquet(df, path, rows_per_file=40)
    assert spark.read.parquet(path).count() == 200
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 6


def test_student_learns(spark, sf, tmp_path):
    from mooring.plans.reports import labelled
    rows = student.training_rows(labelled(spark, sf)).cache()
    model = boosting.train(rows, boosting.Params(n_estimators=8, max_depth=5, learning_rate=0.4))
    path = boosting.save(spark, model, str(tmp_path / "model"))
    scored = student.score_with(path, rows)
    assert scored.where("score < 0 OR score > 100").count() == 0
    error = scored.where("is_test").agg(F.avg(F.abs(F.col("score") - F.col("teacher_score"))))
    assert error.first()[0] < 6.0
    found = student.metrics(spark, path, rows).first()
    assert found.r2 > 0.9 and found.winner_accuracy > 0.3 and found.top3_accuracy > 0.6
    rows.unpersist()


def batches(spark, path, frames):
    """Writes frames one after another and returns them as a stream of files."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
    return jobs.folder_stream(spark, path)


def test_snapshot_is_replaced_whole(spark, tmp_path):
    def poll(day, *nodes):
        ts = datetime.datetime(2024, 1, day)
        return spark.createDataFrame(
            [(n, ts, ts, n, float(day), 1.0) for n in nodes],
            "sample_id long, ts timestamp, poll_ts timestamp, node_id long,"
            "cpu_sample double, mem_sample double")

    stream = batches(spark, str(tmp_path / "in"), [poll(1, 1, 2, 3), poll(2, 2, 4), poll(1, 9)])
    rows = jobs.snapshot(stream, str(tmp_path / "out")).collect()
    assert {(r.node_id, r.current_cpu_usage) for r in rows} == {(2, 2.0), (4, 2.0)}


def test_new_pods_are_seen_once(spark, tmp_path):
    def seen(*ids):
        return spark.createDataFrame([(i, datetime.datetime(2024, 1, 1)) for i in ids],
                                     "pod_id long, seen_ts timestamp")

    stream = batches(spark, str(tmp_path / "in"), [seen(1, 2), seen(2, 3, 3), seen(1)])
    rows = jobs.new_pods(stream, str(tmp_path / "out")).collect()
    assert sorted(r.pod_id for r in rows) == [1, 2, 3]


def test_load_windows_lose_no_row(spark, tmp_path):
    def log(*seconds):
        start = datetime.datetime(2024, 1, 1)
        return spark.createDataFrame(
            [(start + datetime.timedelta(seconds=s), s % 2 == 0, float(s)) for s in seconds],
            "ts timestamp, failed boolean, latency_ms double")

    stream = batches(spark, str(tmp_path / "in"), [log(160), log(100, 1, 2, 7), log(40, 3), log(4)])
    rows = jobs.load_windows(stream, str(tmp_path / "out"), "5 seconds").orderBy(
        "window_start").collect()
    start = datetime.datetime(2024, 1, 1)
    assert [((r.window_start - start).seconds, r.sent, r.failed, r.avg_latency_ms) for r in rows] == [
        (0, 4, 2, 2.5), (5, 1, 0, 7.0), (40, 1, 1, 40.0), (100, 1, 1, 100.0), (160, 1, 1, 160.0)]
    assert rows[0].rps == pytest.approx(4 / 5)


def test_pending_keeps_every_pod_over_shuffled_files(spark, sf, tmp_path):
    folder = jobs.split_table(spark, sf, "orders", "o_orderdate", str(tmp_path / "feed"))
    source = jobs.file_stream(spark, folder, "orders", files_per_trigger=1)
    found = jobs.pending(fleet.pods(spark, sf, source), str(tmp_path / "out"))
    expected = placement.pending_pods(fleet.pods(spark, sf)).select(found.columns)
    assert found.count() == expected.count() > 0 and found.exceptAll(expected).count() == 0


def test_stateful_placement_follows_ingest_order(spark, tmp_path):
    """Batches against the order in time: like a replay in the order in which they came."""
    node_rows, pod_rows = random_fleet(12)
    nodes = make_nodes(spark, node_rows)
    pods = make_pods(spark, pod_rows)
    late, early = pods.where("arrival_ts >= '2024-01-05'"), pods.where("arrival_ts < '2024-01-05'")
    stream = batches(spark, str(tmp_path / "in"), [late, early])
    found = stateful.stream_replay(stream, nodes, str(tmp_path / "arrivals"),
                                   str(tmp_path / "placed")).collect()
    ingested = late.withColumn("arrival_ts", F.expr("arrival_ts - INTERVAL 1000 DAYS")).union(early)
    expected = replay.replay(ingested, nodes).collect()
    assert {(r.event_id, r.episode, r.step, r.node_id) for r in found} == {
        (r.event_id, r.episode, r.step, r.node_id) for r in expected}


def test_streamed_placement_equals_batch(spark, sf, tmp_path):
    pods, nodes = fleet.pods(spark, sf), fleet.nodes(spark, sf)
    stream = batches(spark, str(tmp_path / "in"),
                     [pods.where(F.col("event_id") % 2 == k) for k in range(2)])
    found = jobs.place(stream, nodes, str(tmp_path / "out"))
    expected = placement.place(placement.pending_pods(pods), nodes)
    assert found.exceptAll(expected.select(found.columns)).count() == 0
    assert found.count() == expected.count() > 0


def test_stateful_placement_over_batches_equals_replay(spark, tmp_path):
    node_rows, pod_rows = random_fleet(11)
    pods, nodes = make_pods(spark, pod_rows), make_nodes(spark, node_rows)
    # Batches follow arrival time, and episodes straddle their borders.
    early = pods.where("arrival_ts < '2024-01-04'")
    middle = pods.where("arrival_ts >= '2024-01-04' AND arrival_ts < '2024-01-07'")
    late = pods.where("arrival_ts >= '2024-01-07'")
    stream = batches(spark, str(tmp_path / "in"), [early, middle, late])
    stateful.prepare(stream, nodes, str(tmp_path / "arrivals"))
    arrivals = jobs.folder_stream(spark, str(tmp_path / "arrivals"), files_per_trigger=1)
    found = stateful.place_in_order(arrivals, str(tmp_path / "placed")).collect()
    expected = replay.replay(pods, nodes).collect()
    assert {(r.event_id, r.episode, r.step, r.node_id) for r in found} == {
        (r.event_id, r.episode, r.step, r.node_id) for r in expected}


def test_batches_do_not_grow_with_the_files_of_a_table(spark, tmp_path):
    from mooring.plans import streams
    rows = spark.range(400).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.repartition(40).write.parquet(str(tmp_path / "events.parquet"))
    stream = streams.split_stream(spark, str(tmp_path), "events")
    out = jobs.run_batches(stream, str(tmp_path / "out"), lambda batch: batch)
    assert out.count() == 400
    assert out.select("batch").distinct().count() <= streams.BATCHES


def test_stored_dataset_is_smaller_than_with_snappy(spark, tmp_path):
    rows = spark.range(50_000).select(F.bround(F.rand(1), 6).alias("share")).coalesce(1)
    sizes = [sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet")) for name in (
        "a", "b") if sinks.write_parquet(rows, str(tmp_path / name), **(
            {} if name == "a" else {"compression": "snappy"}))]
    assert sizes[0] < 0.9 * sizes[1]


def test_csv_is_stored_compressed_and_read_back_whole(spark, tmp_path):
    """Every file has its header, ends in .gz and comes back with all rows, by schema or inferred."""
    df = spark.range(5000, numPartitions=3).select(
        "id", (F.col("id") / 7).alias("share"), F.lit("no room, \"none\"").alias("why"))
    stored = sinks.write_outputs(df, str(tmp_path / "d.csv"), str(tmp_path / "d"))
    files = [f for f in (tmp_path / "d.csv").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    assert stored.count() == 5000
    for schema in (df.schema, None):
        read = datasets.load_dataset(spark, csv=str(tmp_path / "d.csv"), csv_schema=schema)
        assert read.select(df.columns).exceptAll(df).count() == 0 and read.count() == 5000
    plain = sinks.write_csv(df, str(tmp_path / "plain.csv"), compression="none")
    assert all(f.suffix == ".csv" for f in (tmp_path / "plain.csv").glob("part-*"))
    assert datasets.load_dataset(spark, plain).count() == 5000
