"""Each stream job stopped and started again over the same folder: nothing lost, nothing twice."""
import datetime

import pytest
from pyspark.sql import functions as F

from builders import make_nodes, make_pods
from mooring.operators import decisions, placement, replay
from mooring.sources import fleet
from mooring.streaming import jobs, live, rolling, stateful, validator
from test_ranking import fleet as random_fleet

START = datetime.datetime(2024, 1, 1)


def in_two_runs(spark, tmp_path, frames, run):
    """run(stream) after each half of the frames; the result of the last."""
    folder, result = str(tmp_path / "in"), None
    for half in (frames[:len(frames) // 2], frames[len(frames) // 2:]):
        for frame in half:
            frame.write.mode("append").parquet(folder)
        result = run(jobs.folder_stream(spark, folder))
    # A third run finds nothing new.
    assert run(jobs.folder_stream(spark, folder)).count() == result.count()
    return result


def equal(a, b):
    return a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == b.count() > 0


def thirds(df, key):
    return [df.where(F.pmod(F.xxhash64(key), F.lit(4)) == k) for k in (2, 0, 3, 1)]


@pytest.fixture(scope="module")
def arrivals(spark, sf):
    return fleet.pods(spark, sf), fleet.nodes(spark, sf)


def test_new_pods(spark, tmp_path):
    frames = [spark.createDataFrame([(i,) for i in ids], "pod_id long")
              for ids in ([5, 1, 5], [2, 1], [1, 5, 9], [3])]
    got = in_two_runs(spark, tmp_path, frames, lambda s: jobs.new_pods(s, str(tmp_path / "out")))
    assert sorted(r.pod_id for r in got.collect()) == [1, 2, 3, 5, 9]


def test_no_batch_reads_what_was_written(spark, tmp_path):
    """Keys are kept in Spark's state: the stream's plan has its source alone."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for ids in ([1, 2], [2, 3], [3, 4]):
        spark.createDataFrame([(i,) for i in ids], "pod_id long").coalesce(1).write.mode(
            "append").parquet(folder)
    stream = jobs.folder_stream(spark, folder).dropDuplicates(["pod_id"])
    query = stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", jobs.checkpoint_of(out)).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [len(p["sources"]) for p in progress] == [1] * 3
    assert [p["numInputRows"] for p in progress] == [2, 2, 2]
    assert jobs.new_pods(jobs.folder_stream(spark, folder), str(tmp_path / "again")).count() == 4


def test_pending_and_placement(spark, tmp_path, arrivals):
    pods, nodes = arrivals
    frames = thirds(pods, "pod_id")
    got = in_two_runs(spark, tmp_path, frames, lambda s: jobs.pending(s, str(tmp_path / "a")))
    assert equal(got, placement.pending_pods(pods))
    placed = in_two_runs(spark, tmp_path / "p", frames,
                         lambda s: jobs.place(s, nodes, str(tmp_path / "b")))
    assert equal(placed, placement.place(placement.pending_pods(pods), nodes))


def test_load_windows_and_counters(spark, tmp_path):
    log = spark.range(60).select(
        (F.lit(START) + F.make_dt_interval(secs=F.col("id") * 7 % 50)).alias("ts"),
        (F.col("id") % 3 == 0).alias("failed"), F.col("id").cast("double").alias("latency_ms"),
        F.when(F.col("id") % 3 == 0, "error").otherwise("ok").alias("kind"))
    frames = thirds(log, "latency_ms")
    got = in_two_runs(spark, tmp_path, frames, lambda s: jobs.load_windows(
        s, str(tmp_path / "w"), "5 seconds"))
    assert sum(r.sent for r in got.collect()) == 60
    assert sum(r.failed for r in got.collect()) == 20
    whole = decisions.request_counters(log).first()
    counted = in_two_runs(spark, tmp_path / "c", frames,
                          lambda s: jobs.counters(s, str(tmp_path / "t"))).first()
    assert counted.asDict() == pytest.approx(whole.asDict())


def test_snapshot(spark, tmp_path):
    def poll(day, *nodes):
        ts = START + datetime.timedelta(days=day)
        return spark.createDataFrame(
            [(n, ts, ts, n, float(day), 1.0) for n in nodes], "sample_id long, ts timestamp,"
            "poll_ts timestamp, node_id long, cpu_sample double, mem_sample double").coalesce(1)

    got = in_two_runs(spark, tmp_path, [poll(1, 1, 2), poll(4, 7, 8), poll(2, 5), poll(3, 9)],
                      lambda s: jobs.snapshot(s, str(tmp_path / "out")))
    assert {r.node_id for r in got.collect()} == {7, 8}


def test_stateful_placement(spark, tmp_path):
    node_rows, pod_rows = random_fleet(13)
    nodes, pods = make_nodes(spark, node_rows), make_pods(spark, pod_rows)
    early = pods.where("arrival_ts < '2024-01-05'").coalesce(1)
    late = pods.where("arrival_ts >= '2024-01-05'").coalesce(1)
    got = in_two_runs(spark, tmp_path, [early, late], lambda s: stateful.stream_replay(
        s, nodes, str(tmp_path / "arrivals"), str(tmp_path / "placed")))
    want = replay.replay(pods, nodes)
    assert {(r.event_id, r.episode, r.step, r.node_id) for r in got.collect()} == {
        (r.event_id, r.episode, r.step, r.node_id) for r in want.collect()}


def test_validation(spark, tmp_path, arrivals):
    pods, nodes = arrivals
    got = in_two_runs(spark, tmp_path, thirds(pods, "event_id"),
                      lambda s: validator.validate(s, nodes, str(tmp_path / "v")))
    whole = validator.validate(jobs.folder_stream(spark, str(tmp_path / "in"), 64), nodes,
                               str(tmp_path / "whole"))
    a, b = ({(r.section, r.item): r.value for r in f.collect()} for f in (got, whole))
    assert a == pytest.approx(b) and a["integrity", "gap_zero"] == 1 and len(a) > 100


def test_deviations_of_far_values_do_not_cancel(spark, tmp_path):
    """Chan's rule: a spread of one around a mean of a billion stays."""
    frames = [spark.createDataFrame([("score", 2, 1e9 + m, 0.5, 0.0, 0.0, 0)],
                                    "name string, n long, mean double, squares double,"
                                    "lowest double, highest double, zeros long") for m in (0.0, 3.0)]
    for i, frame in enumerate(frames):
        frame.write.parquet(f"{tmp_path}/moments/batch={i}")
        spark.createDataFrame([("rank", 1.0, 2)], "kind string, value double, n long").write.parquet(
            f"{tmp_path}/buckets/batch={i}")
    moments, buckets = validator.merged(spark, str(tmp_path))
    row = moments.first()
    assert (row.n, row.mean, row.squares) == (4, 1e9 + 1.5, 10.0)
    assert buckets.first().n == 4


def test_live_placement_follows_the_snapshot(spark, tmp_path, arrivals):
    """A poll between the batches: picks and events are those of the batch on the poll of its time."""
    pods, nodes = arrivals
    feed, polls, kept, out = (str(tmp_path / n) for n in ("pods", "polls", "kept", "out"))
    ids = [r.node_id for r in nodes.select("node_id").collect()]
    want_picks, want_events, halves = [], [], thirds(pods, "pod_id")[:3]
    for day, part in enumerate(halves):
        if day:  # the first batch comes before any poll
            ts = START + datetime.timedelta(days=day)
            spark.createDataFrame(
                [(i * 10 + day, ts, ts, i, float(i * 131 % 17) * 300 * day, float(i % 5) * (1 << 30))
                 for i in ids if (i + day) % 3],
                "sample_id long, ts timestamp, poll_ts timestamp, node_id long, cpu_sample double,"
                "mem_sample double").coalesce(1).write.mode("append").parquet(polls)
            jobs.snapshot(jobs.folder_stream(spark, polls), kept)
        part.coalesce(1).write.mode("append").parquet(feed)
        picks, events = live.place_live(jobs.folder_stream(spark, feed), nodes, kept, out)
        states = live.states_on(spark, nodes, kept, day - 1).cache()
        waiting = placement.pending_pods(part)
        placed = placement.place(waiting, states)
        want_picks.append(placed.withColumn("version", F.lit(day - 1)))
        want_events.append(decisions.placement_events(
            waiting, placement.ready_nodes(states), placed))
    for got, parts in ((picks, want_picks), (events, want_events)):
        want = parts[0].unionByName(parts[1]).unionByName(parts[2])
        assert equal(got.drop("batch"), want)
    # A repeated batch keeps the version it began with, whatever has come since.
    jobs.snapshot(jobs.folder_stream(spark, polls), kept)
    assert live._version(spark, out, 0, kept) == -1 and live._version(spark, out, 1, kept) == 0


def test_sliding_means_of_shuffled_samples(spark, tmp_path):
    rows = [(i, START + datetime.timedelta(seconds=i * 37 % 301), i % 3, float(i), None if i % 7 == 0
             else 1.0) for i in range(80)]
    samples = spark.createDataFrame(rows, "sample_id long, ts timestamp, node_id long,"
                                          "cpu_sample double, mem_sample double")
    got = in_two_runs(spark, tmp_path, thirds(samples, "sample_id"),
                      lambda s: jobs.sliding_means(s, str(tmp_path / "m")))
    by = {(r.node_id, (r.window_start - START).total_seconds()): r for r in got.collect()}
    for node in range(3):
        for start in range(-60, 305, 5):
            held = [r for r in rows if r[2] == node and start <= (r[1] - START).total_seconds() < start + 60]
            row = by.pop((node, float(start)), None)
            assert (row is None) == (not held)
            if held:
                assert row.samples == len(held)
                assert row.cpu_mean == pytest.approx(sum(r[3] for r in held) / len(held))
    assert not by


SAMPLES = ("sample_id long, ts timestamp, node_id long, cpu_sample double, mem_sample double")


def last_means(rows, n):
    """By hand: means of the last n samples at every sample."""
    out = {}
    for node in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == node),
                      key=lambda r: (r[1] is not None, r[1] or START, r[0]))
        for i, r in enumerate(mine):
            last = mine[max(0, i - n + 1):i + 1]
            held = [[x[c] for x in last if x[c] is not None] for c in (3, 4)]
            out[r[0]] = (node, *[sum(v) / len(v) if v else None for v in held])
    return out


@pytest.mark.parametrize("span", ["20 seconds", "3 minutes"])
def test_last_samples_in_any_order(spark, tmp_path, span):
    """Spans with fewer and with more samples than a window; one node with most; nulls, equal times."""
    rows = [(i, None if i % 41 == 0 else START + datetime.timedelta(seconds=i * 37 % 301 // 2 * 2),
             None if i % 29 == 0 else 0 if i % 4 else i % 3, float(i), None if i % 5 < 3 else 1.0 + i)
            for i in range(240)]
    frames = thirds(spark.createDataFrame(rows, SAMPLES), "sample_id")
    got = in_two_runs(spark, tmp_path, frames,
                      lambda s: rolling.rolling_means(s, str(tmp_path / "m"), span=span)).collect()
    want = last_means(rows, 12)
    assert len(got) == len(want) == 240
    for r in got:
        assert (r.node_id, r.cpu_mean, r.mem_mean) == pytest.approx(want[r.sample_id])


def test_last_samples_again_and_none(spark, tmp_path):
    early = [(i, START + datetime.timedelta(seconds=i), 1, float(i), 0.0) for i in range(20)]
    mended = [(3, START + datetime.timedelta(seconds=3), 1, 300.0, 0.0)]
    frames = [spark.createDataFrame(part, SAMPLES).coalesce(1) for part in (early, mended, [], mended)]
    got = in_two_runs(spark, tmp_path, frames, lambda s: rolling.rolling_means(
        s, str(tmp_path / "m"), span="5 seconds")).collect()
    rows = [r for r in early if r[0] != 3] + mended
    want = {i: m[1] for i, m in last_means(rows, 12).items()}
    assert {r.sample_id: r.cpu_mean for r in got} == pytest.approx(want)
    empty = spark.createDataFrame([], SAMPLES)
    empty.coalesce(1).write.parquet(str(tmp_path / "none"))
    assert rolling.rolling_means(jobs.folder_stream(spark, str(tmp_path / "none")),
                                 str(tmp_path / "nothing")).count() == 0
