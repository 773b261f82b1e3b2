"""Skew-safe helpers, checked on groups that hold most of the rows."""
import random
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from mooring.operators import candidates as cand
from mooring.operators import evaluation, labelling, replay, validation
from mooring.scale import (
    attach, estimated_bytes, exact_median, is_bounded, nth_value, positions,
)
from mooring.sources.datasets import first_rows
from builders import make_nodes, make_pods


def skewed(spark, rows=6000):
    """Two thirds of the rows in group 0."""
    rng = random.Random(1)
    data = [(0 if i % 3 else i % 30, i, rng.randrange(100)) for i in range(rows)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g long, id long, v long").repartition(7), data


def test_positions_and_running_sums(spark):
    df, data = skewed(spark)
    rows = positions(df, "g", ["v", "id"], sums=("v",)).collect()
    expected = {}
    for g in {d[0] for d in data}:
        total = 0
        members = sorted((v, i) for gg, i, v in data if gg == g)
        for place, (v, i) in enumerate(members, 1):
            total += v
            expected[i] = (place, len(members), total)
    assert {r.id: (r.position, r.group_rows, r.v_through) for r in rows} == expected


def test_hot_group_spreads_over_tasks(spark):
    df, _ = skewed(spark)
    # These few rows would be merged into one task for their size alone.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ordered = df.sort("g", "v", "id").withColumn("task", F.spark_partition_id())
    tasks = {r.task for r in ordered.where("g = 0").select("task").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 2


def test_attach_gives_equal_rows_broadcast_and_salted(spark):
    df, _ = skewed(spark)
    small = spark.createDataFrame([(0, "a"), (3, "b"), (6, "c")], "g long, name string")
    for how in ("inner", "left"):
        one = attach(df, small, "g", how, bounded=True)
        two = attach(df, small, "g", how, bounded=False, salts=5, spread_by=["id"])
        assert "Salt" not in "".join(two.columns)
        assert one.exceptAll(two.select(one.columns)).count() == 0
        assert one.count() == two.count()


def test_broadcast_is_decided_by_file_sizes(spark, tmp_path):
    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    files = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert files / 2 <= estimated_bytes(stored) <= files * 2
    assert is_bounded(stored, files * 40) and not is_bounded(stored, files)
    # A join counts as the product of its sides: never bounded by mistake.
    assert estimated_bytes(stored.join(stored.withColumnRenamed("id", "b"), F.col("id") == F.col(
        "b"))) > files * files / 4


def jobs_while(spark, build):
    """Jobs that Spark starts while build() makes its plan."""
    group = f"plan-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "plan")
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("name", [
    "best_node_topk", "placement_events", "filter_nodes", "preferred_set", "teacher_rank", "overview",
    "score_stats", "penalty_hist", "utilization_stats", "label_integrity", "band_mae", "node_affinity",
    "winner_accuracy", "mean_spearman", "features18", "heuristic_score", "tolerates_taints"])
def test_plans_start_no_job(spark, sf, name):
    """Only the schemas of the given tables are read, a job of its own each."""
    from mooring.plans.catalog import QUERIES
    tables = {"orders", "lineitem", "supplier", "events"}
    reads = jobs_while(spark, lambda: [spark.read.parquet(f"{sf}/{t}.parquet") for t in tables])
    mine = jobs_while(spark, lambda: QUERIES[name](spark, sf))
    schemas = []
    real = type(spark.read).parquet
    try:
        type(spark.read).parquet = lambda self, *p, **k: (schemas.append(p), real(self, *p, **k))[1]
        QUERIES[name](spark, sf)
    finally:
        type(spark.read).parquet = real
    assert reads <= len(tables) and mine <= len(schemas)


def test_median(spark):
    rng = random.Random(3)
    for size in (1, 2, 501, 1000):
        values = [rng.randrange(50) / 4 for _ in range(size)]
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
        assert exact_median(df, "v", "m").first()["m"] == statistics.median(values)


def test_gini_matches_definition(spark):
    rng = random.Random(9)
    values = [rng.choice([0.0, 1.0, 2.5, rng.random() * 40]) for _ in range(2000)]
    df = spark.createDataFrame([(v, 0.0, -v) for v in values], "a double, z double, n double")
    found = {r["name"]: r["gini"] for r in validation.gini(
        df.repartition(6), ["a", "z", "n"]).collect()}
    ordered, running, area = sorted(values), 0.0, 0.0
    for v in ordered:
        running += v
        area += running
    expected = (len(values) + 1 - 2 * area / running) / len(values)
    assert abs(found["a"] - expected) < 1e-9
    assert abs(found["n"] - expected) < 1e-9
    assert found["z"] == 0.0


def test_correlations_with_a_constant_column(spark):
    df = spark.range(1000).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * -2.0).alias("b"),
        F.lit(7.0).alias("c"), (F.col("id") % 7).cast("double").alias("d"),
        (F.col("id") * 3.0 + 1e9).alias("teacher_score"))
    pairs = validation.correlated_pairs(df, ["a", "b", "c", "d"]).collect()
    assert [(r.a, r.b) for r in pairs] == [("a", "b")]
    top = validation.target_correlations(df, ["a", "b", "c", "d"]).collect()
    assert [r["name"] for r in top] == ["b", "a", "d"]
    constant = validation.constant_features(df, ["a", "c"]).collect()
    assert {r["name"]: r["constant"] for r in constant} == {"a": False, "c": True}


def test_labels_do_not_depend_on_the_parts(spark, monkeypatch):
    pods = make_pods(spark, [(i, 0 if i % 3 else 1, i % 5, 100 + i % 7 * 300, 1000 + i)
                             for i in range(90)])
    nodes = make_nodes(spark, [(n, 1900 * (n % 4 + 1), 10_000, 100 * n, 50 * n, n, n % 2)
                               for n in range(12)])
    wanted = ["event_id", "node_id", "teacher_rank", "teacher_score", "best_node_id"]
    many = labelling.label_dataset(pods, nodes).select(wanted)
    monkeypatch.setattr(cand, "SPREADS", 1)
    one = labelling.label_dataset(pods, nodes).select(wanted)
    assert many.count() == 90 // 3 * 6 * 3
    assert many.exceptAll(one).count() == 0 and one.exceptAll(many).count() == 0


def test_ranking_moves_pods_not_pairs(spark, sf):
    """No exchange above the pair join, and the join has no broadcast."""
    from mooring.plans.matching import scored_pairs
    from mooring.plans.reports import labelled
    ranked = labelled(spark, sf).select("event_id", "teacher_rank")
    for frame in (ranked, evaluation.event_spearman(scored_pairs(spark, sf))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        above = plan[:plan.index("ShuffledHashJoin [cluster_id")]
        assert "Window" in above and "Exchange" not in above
        assert "BroadcastHashJoin [cluster_id" not in plan


def test_a_hot_cluster_is_dealt_by_event(spark):
    pods = make_pods(spark, [(i, 0, 0, 100, 100) for i in range(640)])
    nodes = make_nodes(spark, [(n, 1900, 10_000, 0, 0, 0) for n in range(3)])
    pairs = cand.candidates(pods, nodes)
    sizes = pairs.groupBy("_spread").agg(F.count_distinct("event_id").alias("n")).collect()
    assert len(sizes) == cand.SPREADS and max(r.n for r in sizes) < 30 and pairs.count() == 1920


def test_usage_scan_prunes_columns_and_pushes_the_phase(spark, sf):
    from mooring.sources.fleet import active_usage
    plan = active_usage(spark, sf)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "l_comment" not in scan and "l_partkey" not in scan
    assert "Not(EqualTo(l_returnflag,R))" in scan and "GreaterThanOrEqual" in scan


def test_episodes_split_a_hot_cluster(spark):
    pods = make_pods(spark, [(i, 0 if i % 4 else i, i // 10, 100, 100) for i in range(400)])
    rows = replay.episodes(pods).groupBy("cluster_id", "episode").count()
    assert rows.agg(F.max("count")).first()[0] == 20
    assert rows.where("cluster_id = 0").count() == 16


@pytest.mark.parametrize("kind, values", [
    ("long", [5, 5, 5, -(1 << 61), 1 << 61, 0, 7, 7, None, 3, None, 5]),
    ("double", [0.1, 0.1 + 2 ** -55, 1e300, -1e300, 0.0, 2.5, 2.5, None, 1e-300, 0.1]),
    ("long", [4]), ("double", [None, None, 1.5])])
def test_nth_value_by_narrowing(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3)
    ordered = sorted(values, key=lambda v: (v is not None, v or 0))
    for n in range(1, len(values) + 1):
        want = ordered[n - 1]
        assert nth_value(df, "v", n) == (want, ordered.index(want), ordered.count(want))
    with pytest.raises(ValueError):
        nth_value(df, "v", len(values) + 1)


def test_first_rows_without_a_sort(spark):
    rng = random.Random(6)
    data = [(rng.randrange(6), rng.choice([None, 1, 2]), rng.randrange(3), i) for i in range(400)]
    data += [(2, 1, 1, -1)] * 30
    df = spark.createDataFrame(data, "a long, b long, c long, id long").repartition(7)
    order = ["a", "b", "c"]
    for n in (1, 50, 137, 200, 429, 430, 900):
        rows = first_rows(df, n, order)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Sort" not in plan
        want = df.orderBy(*order).limit(n).select(order).collect()
        assert sorted(map(str, rows.select(order).collect())) == sorted(map(str, want))
    # With an order of all columns the rows themselves are fixed.
    whole = [*order, "id"]
    assert sorted(map(str, first_rows(df, 211, whole).collect())) == sorted(map(str, df.orderBy(
        *whole).limit(211).collect()))


def test_gini_and_median_sort_no_table(spark):
    df = spark.range(5000).select((F.col("id") % 97 * 1.5).alias("a"))
    plan = validation.gini(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    empty = exact_median(df.where("a < 0"), "a", "m").first()
    assert empty.m is None


def test_pairs_as_rows_equal_the_self_join(spark, sf):
    from mooring.plans.matching import scored_pairs
    rows = scored_pairs(spark, sf).where("event_id % 50 = 0")
    got = evaluation.event_pairs(rows)
    a = rows.select("event_id", F.col("node_id").alias("node_a"), F.col("teacher_score").alias("p"),
                    F.col("pred").alias("q"))
    b = rows.select("event_id", F.col("node_id").alias("node_b"), F.col("teacher_score").alias("r"),
                    F.col("pred").alias("s"))
    want = a.join(b, "event_id").where("node_a < node_b").select(
        "event_id", "node_a", "node_b", F.signum(F.col("p") - F.col("r")).cast("int").alias("sign_x"),
        F.signum((F.col("q") - F.col("s")).cast("double")).cast("int").alias("sign_y"))
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("ShuffledHashJoin [cluster_id")]
    assert "Join" not in above and "Exchange" not in above


def test_inputs_are_told_apart_by_narrow_keys_and_nulls_count(spark):
    from mooring.operators.validation import is_deterministic
    rows = spark.createDataFrame(
        [(None, 5.0, 1), (5.0, None, 2), (5.0, None, 2), (1.0, 1.0, 3), (1.0, 1.0, 4), (0.0, 1.0, 1),
         (-0.0, 1.0, 1), (float("nan"), 1.0, 1), (float("nan"), 1.0, 1)], "a double, b double, s long")
    found = is_deterministic(rows, ["a", "b"], "s")
    assert found.first()[:] == (5, 1)
    exchanges = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines()
                 if "Exchange hashpartitioning" in line]
    assert exchanges and all("_key0" in line and "a#" not in line for line in exchanges)


def test_tasks_for_pairs_grow_with_the_files_of_the_pods(spark, sf, monkeypatch):
    from mooring.operators import labelling
    from mooring.sources import fleet
    pods, nodes = fleet.pods(spark, sf), fleet.nodes(spark, sf)
    assert cand.pair_tasks(pods) == 8 and cand.pair_tasks(spark.range(5)) == 8
    monkeypatch.setattr(cand, "POD_BYTES", 1 << 10)
    count = cand.pair_tasks(pods)
    assert count > 8
    monkeypatch.setattr(cand, "POD_BYTES", 1 << 9)
    assert 2 * count - 1 <= cand.pair_tasks(pods) <= 2 * count
    plan = labelling.label_dataset(pods, nodes)._jdf.queryExecution().executedPlan().toString()
    assert f", {cand.pair_tasks(pods)}), REPARTITION_BY_NUM" in plan


def test_gini_takes_logarithms_of_distinct_values_only(spark):
    import re
    rows = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (None,)], "a double")
    done = validation.gini(rows, ["a"])
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[name#\d+, value#\d+\]", plan)
    row = done.first()
    # 0, 1, 1, 3: (n + 1 - 2 * sum of running sums / total) / n
    assert row.name == "a" and row.gini == pytest.approx((5 - 2 * (0 + 1 + 2 + 5) / 5) / 4)
