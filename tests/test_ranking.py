"""Ranking, replay and quality measures against brute force."""
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from mooring.constants import CPU_PENALTY_CURVE, DENSITY_PENALTY_CURVE
from mooring.operators import evaluation, labelling, ranking, replay, student, validation
from builders import make_nodes, make_pods


def curve(x, anchors):
    x = max(0.0, min(1.0, x))
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:]):
        if x <= x1:
            return y0 + (x - x0) / (x1 - x0) * (y1 - y0)
    return anchors[-1][1]


def teacher(node, cpu, memory):
    _, ac, am, uc, um, pods = node
    pc, pm = (uc + cpu) / ac, (um + memory) / am
    base = round((0.6 * max(0.0, 1 - pc) + 0.4 * max(0.0, 1 - pm)) * 100)
    return max(0.0, min(100.0, base - curve(pc, CPU_PENALTY_CURVE) - curve(pm, CPU_PENALTY_CURVE)
                        - curve((pods + 1) / 110, DENSITY_PENALTY_CURVE)))


def fits(node, cpu, memory):
    return node[3] + cpu <= node[1] and node[4] + memory <= node[2]


def fleet(seed, nodes=60, pods=130, clusters=3):
    """Clusters larger than an episode, tight enough for refusals and ties."""
    rng = random.Random(seed)
    node_rows = [(n, rng.choice([400, 400, 800]), rng.choice([500, 900]), rng.choice([0, 100]),
                  rng.choice([0, 200]), rng.randrange(4), n % clusters) for n in range(nodes)]
    pod_rows = [(i, 0 if rng.random() < 0.6 else rng.randrange(clusters), rng.randrange(9),
                 rng.choice([50, 100, 300, 700]), rng.choice([50, 100, 400, 950]))
                for i in range(pods)]
    return node_rows, pod_rows


def brute_replay(node_rows, pod_rows, length=20):
    picks = {}
    for cluster in {p[1] for p in pod_rows}:
        arrivals = sorted((p for p in pod_rows if p[1] == cluster), key=lambda p: (p[2], p[0]))
        for k, (event, _, _, cpu, memory) in enumerate(arrivals):
            if k % length == 0:
                state = {n[0]: list(n[:6]) for n in node_rows if n[6] == cluster}
            options = [(-teacher(n, cpu, memory), n[0]) for n in state.values()
                       if fits(n, cpu, memory)]
            if not options:
                picks[event] = (k // length, k % length, None, None)
                continue
            order, node = min(options)
            picks[event] = (k // length, k % length, node, -order)
            state[node][3] += cpu
            state[node][4] += memory
            state[node][5] += 1
    return picks


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_brute_force(spark, seed):
    node_rows, pod_rows = fleet(seed)
    done = replay.replay(make_pods(spark, pod_rows), make_nodes(spark, node_rows)).collect()
    found = {r.event_id: (r.episode, r.step, r.node_id, r.score) for r in done}
    expected = brute_replay(node_rows, pod_rows)
    assert {k: v[:3] for k, v in found.items()} == {k: v[:3] for k, v in expected.items()}
    for event, (_, _, node, score) in expected.items():
        if node is not None:
            assert found[event][3] == pytest.approx(score, abs=1e-9)
    assert any(v[2] is None for v in expected.values())
    assert len({v[2] for v in expected.values()}) > 5


def test_replayed_labels_pick_the_replayed_node(spark):
    node_rows, pod_rows = fleet(4)
    pods, nodes = make_pods(spark, pod_rows), make_nodes(spark, node_rows)
    selected = replay.replayed_labels(pods, nodes).where("selected_by_scheduler = 1").collect()
    picks = {r.event_id: r.node_id for r in replay.replay(pods, nodes).collect()
             if r.node_id is not None}
    assert {r.event_id: r.node_id for r in selected} == picks


def test_labels_equal_brute_force(spark):
    node_rows, pod_rows = fleet(7, nodes=21, pods=40)
    rows = labelling.label_dataset(
        make_pods(spark, pod_rows), make_nodes(spark, node_rows)).collect()
    expected = {}
    for event, cluster, _, cpu, memory in pod_rows:
        members = [n for n in node_rows if n[6] == cluster]
        ranked = sorted((-teacher(n[:6], cpu, memory), n[0]) for n in members
                        if fits(n, cpu, memory))
        if not ranked:
            continue
        for n in members:
            expected[event, n[0]] = None
        for place, (order, node) in enumerate(ranked, 1):
            expected[event, node] = place
    assert {(r.event_id, r.node_id): r.teacher_rank for r in rows} == expected
    assert all(r.selected_by_scheduler == (1 if r.teacher_rank == 1 else 0) for r in rows)
    assert all(r.teacher_score == 0 and r.cpu_penalty == 0 for r in rows if not r.feasible)
    integrity = validation.label_integrity(spark.createDataFrame(rows)).first()
    assert integrity.gap_zero == integrity.winner_rank_one == integrity.no_null_rank == "PASS"
    assert integrity.selected_rows == integrity.events


def random_scores(spark, seed, events=12, largest=25):
    rng = random.Random(seed)
    data = []
    for event in range(events):
        size = 1 if event == 0 else rng.randrange(2, largest)
        for node in range(size):
            y = 5.0 if event == 1 else rng.choice([rng.randrange(6), rng.random() * 6])
            data.append((event, node, float(y), float(rng.randrange(8)), True))
    return spark.createDataFrame(
        data, "event_id long, node_id long, teacher_score double, pred double,"
              " feasible boolean"), data


def test_kendall_and_pair_counts_equal_all_pairs(spark):
    df, data = random_scores(spark, 3)
    found = {r.event_id: r for r in evaluation.pair_counts(df).collect()}
    taus = {r.event_id: r.kendall for r in evaluation.event_kendall(df).collect()}
    for event in {d[0] for d in data}:
        members = [d for d in data if d[0] == event]
        c = d = tx = ty = 0
        for a, b in itertools.combinations(members, 2):
            x, y = a[2] - b[2], a[3] - b[3]
            c, d = c + (x * y > 0), d + (x * y < 0)
            tx, ty = tx + (x == 0), ty + (y == 0)
        row, n = found[event], len(members)
        assert (row.concordant, row.discordant, row.tied_x, row.tied_y, row.n) == (c, d, tx, ty, n)
        pairs = n * (n - 1) / 2
        scale = math.sqrt((pairs - tx) * (pairs - ty))
        if scale == 0:
            assert taus[event] is None
        else:
            assert taus[event] == pytest.approx((c - d) / scale)


def test_spearman_equals_rank_correlation(spark):
    df, data = random_scores(spark, 5)
    found = {r.event_id: r.spearman for r in evaluation.event_spearman(df).collect()}

    def ranks(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2
                for v in values]

    for event in {d[0] for d in data}:
        x = ranks([d[2] for d in data if d[0] == event])
        y = ranks([d[3] for d in data if d[0] == event])
        mx, my = sum(x) / len(x), sum(y) / len(y)
        vx, vy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y)
        if vx == 0 or vy == 0:
            assert found[event] is None
        else:
            cov = sum((a - mx) * (b - my) for a, b in zip(x, y))
            assert found[event] == pytest.approx(cov / math.sqrt(vx * vy))
    summary = evaluation.mean_defined(evaluation.event_spearman(df), "spearman", "m").first()
    assert summary.events_undefined == sum(v is None for v in found.values()) >= 2


def test_best_node_ties_and_threshold(spark):
    df = spark.createDataFrame(
        [(1, 7, 60), (1, 3, 60), (1, 9, 10), (2, 5, 4), (2, 4, 3)],
        "event_id long, node_id long, score long")
    rows = {r.event_id: r for r in ranking.best_node(df).collect()}
    assert (rows[1].best_node_id, rows[1].best_score, rows[1].n_preferred) == (3, 60, 2)
    assert not rows[1].least_bad
    assert (rows[2].best_node_id, rows[2].n_preferred, rows[2].least_bad) == (5, 0, True)


def test_cross_rank_and_verdict(spark):
    df = spark.createDataFrame(
        [(1, 1, 90.0, 50.0, True), (1, 2, 80.0, 70.0, True), (2, 1, 60.0, 60.0, True),
         (3, 1, 10.0, 3.0, True), (3, 2, 9.0, 2.0, True)],
        "event_id long, node_id long, teacher_score double, pred double, feasible boolean")
    rows = {r.event_id: r for r in ranking.cross_rank(df, threshold=5).collect()}
    assert (rows[1].model_node_id, rows[1].model_rank, rows[1].score_gap) == (2, 2, 10.0)
    assert rows[3].model_node_id == 1


def test_report_and_verdict(spark):
    picks = spark.createDataFrame(
        [("a", 0, 2, 1, 2, 10.0, False), ("a", 1, 1, 1, 1, 0.0, False), ("b", 0, 1, 1, 1, 0.0, False),
         ("c", 0, None, None, None, None, None), ("d", 0, 1, 1, 1, 0.0, True)],
        "scenario string, step int, model_node_id long, teacher_node_id long, model_rank int,"
        "score_gap double, capacity_violation boolean")
    found = {r.scenario: r for r in evaluation.verdict(evaluation.scenario_report(picks)).collect()}
    assert found["a"].exact_match_pct == 50.0 and found["a"].verdict == "REVIEW"
    assert found["a"].tests == 1 and found["OVERALL"].tests == 4
    assert found["b"].verdict == "PASS" and found["d"].verdict == "FAIL"
    assert found["c"].verdict == "PASS" and found["c"].exact_match_pct is None
    assert found["OVERALL"].total_pods == 5 and found["OVERALL"].unschedulable == 1
    assert found["OVERALL"].verdict == "FAIL" and found["OVERALL"].capacity_violations == 1


def test_regression_metrics(spark):
    truth, guess = [0.0, 10.0, 20.0, 50.0], [1.0, 12.0, 17.0, 50.0]
    df = spark.createDataFrame(list(zip(truth, guess)), "teacher_score double, pred double")
    m = evaluation.regression_metrics(df).first()
    errors = [t - g for t, g in zip(truth, guess)]
    mean = sum(truth) / 4
    total = sum((t - mean) ** 2 for t in truth)
    assert m.mae == pytest.approx(1.5)
    assert m.rmse == pytest.approx(math.sqrt(sum(e * e for e in errors) / 4))
    assert m.median_absolute_error == pytest.approx(1.5)
    assert m.mape == pytest.approx((0.2 + 0.15 + 0.0) / 3)
    assert m.r2 == pytest.approx(1 - sum(e * e for e in errors) / total)


def test_band_leaves_out_the_top_value(spark):
    df = spark.createDataFrame([(0.0, 1.0), (19.9, 19.9), (20.0, 25.0), (100.0, 0.0)],
                               "teacher_score double, pred double")
    rows = {r.band: (r.n, r.mae) for r in evaluation.band_mae(df).collect()}
    assert rows == {"saturated": (2, 0.5), "stressed": (1, 5.0)}


def test_monotone_steps_and_orders(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.1, 90.0), (1, 2, 0.3, 90.5), (1, 3, 0.5, 92.0), (1, 4, 0.7, 10.0)],
        "event_id long, node_id long, load double, score double")
    assert [r.node_id for r in ranking.rises(df, "event_id", "load", "score").collect()] == [3]
    both = df.withColumn("teacher_score", F.col("score")).withColumn("pred", F.col("score") / 2)
    assert ranking.orders_agree(both).first().same_order
    assert not ranking.orders_agree(both.withColumn("pred", -F.col("score"))).first().same_order


def test_split_keeps_events_whole(spark):
    rows = spark.range(40_000).withColumn("event_id", F.col("id") % 8000)
    split = student.split_by_event(rows)
    assert split.groupBy("event_id").agg(F.count_distinct("is_test").alias("n")).where(
        "n > 1").count() == 0
    share = split.agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert abs(share - 0.15) < 0.01


def test_average_ranks_take_one_window_a_column(spark):
    """Ties, nulls, both zeros and NaN share the mean of their places."""
    nan = float("nan")
    values = [3.0, None, 1.0, 3.0, 0.0, None, -0.0, nan, 3.0, nan, 7.0]
    rows = spark.createDataFrame([(e, i, v, float(i // 2)) for e in (1, 2) for i, v in enumerate(values)],
                                 "event_id long, node_id long, a double, b double").repartition(3)
    ranked = ranking.average_ranks(rows, ["a", "b"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Window [") == 2
    want = [7.0, 1.5, 5.0, 7.0, 3.5, 1.5, 3.5, 10.5, 7.0, 10.5, 9.0]
    found = ranked.orderBy("event_id", "node_id").collect()
    assert [r.rank_a for r in found] == want * 2
    assert [r.rank_b for r in found] == [1.5, 1.5, 3.5, 3.5, 5.5, 5.5, 7.5, 7.5, 9.5, 9.5, 11.0] * 2
