"""Hand-computed values of the scalar expressions."""
import math
import random

import pytest
from pyspark.sql import functions as F

from mooring.constants import CPU_PENALTY_CURVE, DENSITY_PENALTY_CURVE, FEATURES
from mooring.functions import features, scoring, text, units
from builders import make_nodes

GIB = 1024 ** 3


def column(spark, values, kind, expression):
    """expression(col) for every value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").select(
        "r").collect()]


def test_parse_cpu(spark):
    texts = ["450m", "100000n", "2", "0.5", "bad", "", "m", "1e3m", "-2", "12Ki", "NaN", "1_0"]
    assert column(spark, texts, "string", units.parse_cpu) == pytest.approx(
        [450.0, 0.1, 2000.0, 500.0, 0.0, 0.0, 0.0, 1000.0, -2000.0, 0.0, 0.0, 0.0])


def test_parse_memory(spark):
    texts = ["8192Ki", "2Gi", "1.5Mi", "1Ti", "77", "3K", "Gi", "bad"]
    assert column(spark, texts, "string", units.parse_memory) == [
        8192 * 1024.0, 2.0 * GIB, 1.5 * 1024 ** 2, 1024.0 ** 4, 77.0, 0.0, 0.0, 0.0]


def test_allocatable_share(spark):
    assert column(spark, [2000, 500, 1200], "long", units.allocatable_cpu) == [1900, 475, 1140]
    assert column(spark, [64 * GIB], "long", units.allocatable_memory) == [int(64 * GIB * 0.92)]


def test_quantized_requests(spark):
    raw = [1.0, 74.0, 75.0, 125.0, 40_000.0]
    assert column(spark, raw, "double", units.quantize_cpu) == [50, 50, 100, 100, 32_000]
    mib64 = 64 * 1024 ** 2
    memory = [1.0, 1.5 * mib64, 2.5 * mib64, 1e12]
    assert column(spark, memory, "double", units.quantize_memory) == [
        mib64, 2 * mib64, 2 * mib64, 64 * GIB]


def test_round_exact_is_python_round(spark):
    rng = random.Random(5)
    values = [0.0080375, 0.1234565, 0.5, 1.5, 2.675, 1.005, 0.0, 1e-9, 123456.7890125]
    values += [rng.uniform(0, 4) for _ in range(3000)]
    values += [k / 2e6 for k in range(1, 2001)]
    assert column(spark, values, "double", lambda c: units.round_exact(c, 6)) == [
        round(v, 6) for v in values]
    assert column(spark, values, "double", lambda c: units.round_exact(c, 1)) == [
        round(v, 1) for v in values]


def test_penalty_curve_anchors(spark):
    values = [0.0, 0.4, 0.6, 1.0, -3.0, 7.0, 0.5, 0.8]
    assert column(spark, values, "double", lambda c: scoring.curve(c, CPU_PENALTY_CURVE)) == \
        pytest.approx([0.0, 2.0, 8.0, 20.0, 0.0, 20.0, 5.0, 14.0])
    assert column(spark, [0.1, 0.6], "double",
                  lambda c: scoring.curve(c, DENSITY_PENALTY_CURVE)) == pytest.approx([0.5, 3.0])
    assert column(spark, [0.3], "double", lambda c: scoring.curve(c, [])) == [0.0]


def scored(spark, rows, cpu, memory, **options):
    nodes = make_nodes(spark, rows).withColumns(
        {"requested_cpu": F.lit(cpu).cast("long"), "requested_memory": F.lit(memory).cast("long")})
    return scoring.with_teacher_score(features.derive(nodes, **options))


def used(cpu_share, memory_share, pods, node_id=1, cpu=7600, memory=int(14.72 * GIB)):
    return (node_id, cpu, memory, int(cpu * cpu_share), int(memory * memory_share), pods)


def test_idle_node_scores_high_and_full_node_low(spark):
    idle = scored(spark, [(1, 16_000, 32 * GIB, 0, 0, 0)], 1, 1)
    assert idle.first()["teacher_score"] >= 95.0
    full = scored(spark, [used(0.93, 0.91, 30)], 500, GIB)
    assert full.first()["teacher_score"] <= 20.0


def test_scores_fall_with_utilisation(spark):
    ladder = [used(f, f, 5, i) for i, f in enumerate([0.10, 0.30, 0.50, 0.70, 0.85])]
    rows = scored(spark, ladder, 500, GIB).withColumn(
        "heuristic", scoring.heuristic_score()).orderBy("node_id").collect()
    for name in ("teacher_score", "heuristic"):
        values = [r[name] for r in rows]
        assert values == sorted(values, reverse=True)
        assert all(0 <= v <= 100 for v in values)


def test_zero_capacity_guards(spark):
    row = (1, 0, 0, 10, 10, 0)
    assert scored(spark, [row], 5, 5).first()["current_cpu_percent"] == 0.0
    assert scored(spark, [row], 5, 5, guard="one").first()["current_cpu_percent"] == 10.0


def test_balance_variants_differ_beyond_capacity(spark):
    over = [used(1.5, 0.2, 3)]
    by_headroom = scored(spark, over, 0, 0).first()["resource_balance"]
    by_projection = scored(spark, over, 0, 0, balance="projection").first()["resource_balance"]
    assert by_headroom == pytest.approx(0.8, abs=1e-6)
    assert by_projection == pytest.approx(1.3, abs=1e-6)


def test_step_penalties(spark):
    rows = [used(0.95, 0.75, 31, 1), used(0.9, 0.7, 30, 2), used(0.1, 0.1, 5, 3)]
    out = scored(spark, rows, 0, 0).withColumns(scoring.step_penalties()).orderBy("node_id")
    assert [r["step_penalty"] for r in out.collect()][0] == 20 + 10 + 5
    assert [r["step_penalty"] for r in out.collect()][2] == 0


def test_feature_vector_fills_absent_columns(spark):
    df = spark.createDataFrame([(None, 3)], "cpu_headroom double, current_pod_count int")
    row = df.select(*features.feature_vector_columns(df)).first()
    assert list(row.asDict()) == FEATURES
    assert row["cpu_headroom"] == 0.0 and row["current_pod_count"] == 3.0
    assert row["cluster_size"] == 0.0


def test_failed_call_gets_neutral_score_without_penalty(spark):
    df = spark.createDataFrame([(None, 35), (90, 35), (10, 35)], "s long, p long")
    assert [r[0] for r in df.select(scoring.resolve_score(F.col("s"), F.col("p"))).collect()] == [
        50, 55, 0]


def test_text_helpers(spark):
    assert column(spark, [59.4, 59.5, 187.0, 7500.0, 3599.9], "double", text.duration_text) == [
        "59s", "60s", "3m07s", "2h05m", "59m59s"]
    assert column(spark, [999, 1000, 1150, 1250, 1450, 1750, 3_400_000, 999_950, 2 ** 41], "long",
                  text.compact_number) == ["999", "1.0K", "1.1K", "1.3K", "1.4K", "1.8K", "3.4M",
                                           "1000.0K", "2199023.3M"]
    assert column(spark, ["Node_A.1", "worker-2"], "string", text.job_name) == [
        "saturate--ode---1", "saturate-worker-2"]
    assert column(spark, ["a", "a-b", "web-7f-x9"], "string", text.short_name) == [
        "a", "a-b", "7f-x9"]
    assert column(spark, ['<a href="x">&</a>'], "string", text.html_escape) == [
        "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"]


def test_stamp_is_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_seconds(1704067200) AS t, TIMESTAMP_NTZ '2024-01-01' AS w")
        assert tuple(df.select(text.utc_stamp(F.col("t"), zoned=True), text.utc_stamp(
            F.col("w"))).first()) == ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bands_use_whole_percentages(spark):
    df = spark.createDataFrame([(70, 0.503, 0.605, False), (40, 0.505, 0.604, True)],
                               "s long, c double, m double, x boolean")
    bands = scoring.status_bands(F.col("s"), F.col("c"), F.col("m"), F.col("x"))
    assert [tuple(r) for r in df.select(*bands.values()).collect()] == [
        ("high", "green", "yellow", "Healthy"), ("mid", "yellow", "green", "")]


def test_broken_response_falls_back(spark):
    bodies = ['{"score": 7, "reason": "r", "source": "s"}', "oops", None, '{"reason": "x"}',
              '{"score": null}', '{"score": "high"}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string").select(
        text.decode_response(F.col("body")).alias("a"))
    out = df.select(*[c.alias(n) for n, c in scoring.with_fallback(
        F.col("a.score"), F.col("a.source")).items()]).collect()
    assert [tuple(r) for r in out] == [
        (7, "s"), (50, "fallback"), (50, "fallback"), (0, None), (0, None), (50, "fallback")]


def test_weighted_choice_covers_all_names(spark):
    weighted = [("a", 0.2), ("b", 0.3), ("c", 0.5)]
    assert column(spark, [0.0, 0.2, 0.21, 0.5, 0.51, 0.999], "double",
                  lambda c: units.weighted_choice(c, weighted)) == list("aabbcc")
    spread = spark.range(20_000).select(units.unit_interval(F.col("id"), 42).alias("u"))
    low, high, mean = spread.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and math.isclose(mean, 0.5, abs_tol=0.02)


def test_wide_ids_keep_their_digits(spark):
    assert column(spark, [7, 123456789], "long", units.event_label) == ["e00000007", "e123456789"]
