"""Queries over dataset sources and sinks."""
from dataclasses import asdict

from pyspark.sql import functions as F

from mooring.constants import FEATURES, GROUP, TARGET
from mooring.operators import candidates as cand
from mooring.operators import decisions, student, validation
from mooring.operators.labelling import candidate_row
from mooring.plans.matching import count_sql
from mooring.plans.oracle_base import query
from mooring.plans.registry import register
from mooring.plans.reports import COUNTERS_SQL, labelled, rounded
from mooring.plans.scalars import ROW_SQL, comparable_row
from mooring.session import scratch_path, stored_rows
from mooring.sources import datasets, fleet, sinks

#: Per event, what shows that all rows of the candidate dataset came back as they were.
STORED_SQL = f"""
SELECT event_id, count(*) AS nodes, min(node_id) AS first_node, max(node_id) AS last_node,
       CAST(sum(CASE WHEN feasible THEN 1 ELSE 0 END) AS BIGINT) AS feasible_rows,
       CAST(sum(teacher_rank) AS BIGINT) AS ranks,
       CAST(sum(length(reject_reason)) AS BIGINT) AS reject_letters,
       round_even(sum(cpu_headroom), 6) AS headroom, round_even(sum(teacher_score), 6) AS scores
FROM ({ROW_SQL}) GROUP BY event_id"""


def dataset_rows(spark, sf):
    """Labelled rows for storing: those of a cluster lie together as far as a task can hold them."""
    parts = stored_rows(cand.cluster_parts(fleet.pods(spark, sf)), "parts")
    return labelled(spark, sf, parts)


def stored_digest(rows):
    return rows.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.min("node_id").alias("first_node"),
        F.max("node_id").alias("last_node"),
        F.sum(F.when(F.col("feasible"), 1).otherwise(0)).alias("feasible_rows"),
        F.sum("teacher_rank").cast("long").alias("ranks"),
        F.sum(F.length("reject_reason")).cast("long").alias("reject_letters"),
        F.bround(F.sum("cpu_headroom"), 6).alias("headroom"),
        F.bround(F.sum("teacher_score"), 6).alias("scores"))


@register("src_dataset", query(STORED_SQL, "labelled"))
def src_dataset(spark, sf):
    """Missing explicit path, so the stored Parquet copy is read."""
    path = sinks.write_parquet(comparable_row(dataset_rows(spark, sf)),
                               scratch_path(spark, "dataset"), order=sinks.CANDIDATE_ORDER)
    return stored_digest(datasets.load_dataset(spark, path + "-absent", parquet=path))


@register("src_schema_check", query(
    "SELECT 20 AS required, 0 AS missing, 44 AS columns, count(*) AS row_count FROM labelled",
    "labelled"))
def src_schema_check(spark, sf):
    """Columns of the stored dataset, as read back, against the contract."""
    path = sinks.write_parquet(comparable_row(dataset_rows(spark, sf)),
                               scratch_path(spark, "dataset"), order=sinks.CANDIDATE_ORDER)
    rows = datasets.check_columns(datasets.load_dataset(spark, path))
    return rows.agg(
        F.lit(len(FEATURES) + len([TARGET, GROUP])).alias("required"),
        F.lit(len(datasets.missing_columns(rows))).alias("missing"),
        F.lit(len(rows.columns)).alias("columns"), F.count(F.lit(1)).alias("row_count"))


@register("src_nodes", query("""
SELECT node_name, CAST(alloc_cpu AS DOUBLE) AS cpu, CAST(alloc_mem AS DOUBLE) AS memory,
       (SELECT count(*) FROM node) AS cluster_size FROM node""", "node"))
def src_nodes(spark, sf):
    listed = fleet.with_capacity(fleet.bare_nodes(spark, sf))
    return listed.select(
        "node_name", F.col("node_allocatable_cpu").cast("double").alias("cpu"),
        F.col("node_allocatable_memory").cast("double").alias("memory"),
        fleet.bare_nodes(spark, sf).select(F.count(F.lit(1))).scalar().alias("cluster_size"))


@register("src_pods", query("""
SELECT l_suppkey AS node_id, count(*) AS scheduled_pods FROM lineitem GROUP BY 1"""))
def src_pods(spark, sf):
    return cand.bound_pod_count(fleet.running_pods(spark, sf)).select(
        "node_id", F.col("current_pod_count").alias("scheduled_pods"))


@register("src_sample", query("""
SELECT event_id, line, node_id, req_cpu, req_mem FROM request
ORDER BY event_id, line, node_id, req_cpu, req_mem LIMIT 50000""", "request"))
def src_sample(spark, sf):
    order = ["event_id", "line", "node_id", "req_cpu", "req_mem"]
    rows = fleet.score_requests(spark, sf).withColumnsRenamed(
        {"requested_cpu": "req_cpu", "requested_memory": "req_mem"}).select(*order)
    return datasets.first_rows(rows, 50_000, order)


@register("sink_csv", query(STORED_SQL, "labelled"))
def sink_csv(spark, sf):
    rows = comparable_row(dataset_rows(spark, sf))
    path = sinks.write_csv(rows, scratch_path(spark, "dataset") + ".csv", order=sinks.CANDIDATE_ORDER)
    loaded = datasets.load_dataset(spark, csv=path, csv_schema=rows.schema)
    return stored_digest(loaded.withColumn("reject_reason", F.coalesce("reject_reason", F.lit(""))))


@register("sink_parquet", query(STORED_SQL, "labelled"))
def sink_parquet(spark, sf):
    path = sinks.write_parquet(comparable_row(dataset_rows(spark, sf)),
                               scratch_path(spark, "dataset"), order=sinks.CANDIDATE_ORDER)
    return stored_digest(spark.read.parquet(path))


@register("sink_outputs", query(f"""
SELECT s.store, count(*) AS row_count, {count_sql("feasible", "feasible_rows")},
       round_even(sum(t_score), 3) AS score_sum
FROM labelled, (VALUES ('csv'), ('parquet')) s(store) GROUP BY 1""", "labelled"))
def sink_outputs(spark, sf):
    base = scratch_path(spark, "dataset")
    rows = candidate_row(dataset_rows(spark, sf))
    sinks.write_outputs(rows, base + ".csv", base + ".parquet", sinks.CANDIDATE_ORDER)

    def summary(name, df):
        return df.agg(F.lit(name).alias("store"), F.count(F.lit(1)).alias("row_count"),
                      F.sum(F.when(F.col("feasible"), 1).otherwise(0)).alias("feasible_rows"),
                      F.bround(F.sum("teacher_score"), 3).alias("score_sum"))

    csv = datasets.load_dataset(spark, csv=base + ".csv", csv_schema=rows.schema)
    return summary("csv", csv).unionByName(
        summary("parquet", spark.read.parquet(base + ".parquet")))


METRICS = ["mae", "rmse", "r2", "median_absolute_error", "mape", "explained_variance",
           "winner_accuracy", "top3_accuracy", "best_iteration"]


@register("sink_metadata", query(f"""
SELECT 18 AS features, count(*) AS row_count, count(DISTINCT event_id) AS events,
       {count_sql("feasible", "feasible_rows")}, {count_sql("NOT feasible", "infeasible_rows")},
       8 AS max_depth, 256 AS max_bin, 0.2e0 AS gamma, 0.15e0 AS test_size, 9 AS metrics
FROM labelled""", "labelled"))
def sink_metadata(spark, sf):
    """The record of the student's run as read back; `training_run` has the metrics themselves."""
    return training_run(spark, sf).select(
        "features", "row_count", "events", "feasible_rows", "infeasible_rows", "max_depth", "max_bin",
        "gamma", "test_size",
        sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in METRICS), F.lit(0)).alias(
            "metrics"))


@register("training_run")
def training_run(spark, sf):
    """Sizes, parameters and held-out metrics of the student's run, written as JSON and read back."""
    from mooring.plans.ranks import FIT, student_rows, trained
    rows = labelled(spark, sf)
    run = sinks.metadata(
        validation.dataset_size(rows),
        student.metrics(spark, trained(spark, sf), student_rows(spark, sf)), FEATURES,
        {**asdict(FIT), "test_size": student.HELD_OUT}, sf)
    path = sinks.write_metadata(run, scratch_path(spark, "metadata"))
    return sinks.read_json(spark, path).select(
        F.size("feature_columns").alias("features"), "dataset_size.*",
        *[F.col(f"training_parameters.{c}").cast(kind).alias(c) for c, kind in (
            ("max_depth", "int"), ("max_bin", "int"), ("gamma", "double"), ("test_size", "double"))],
        *METRICS)


def _metrics_sql():
    rows = [("score_requests_total", "Scores asked for so far", "counter",
             "CAST(score_requests_total AS VARCHAR)"),
            ("score_fallback_total", "Scores given without the service", "counter",
             "CAST(score_fallback_total AS VARCHAR)"),
            ("score_latency_ms_avg", "Mean time of a score in milliseconds", "gauge",
             "printf('%.4f', score_latency_ms_avg)")]
    parts = []
    for name, text, kind, value in rows:
        full = f"placement_{name}"
        parts += [f"'# HELP {full} {text}'", f"'# TYPE {full} {kind}'", f"'{full} ' || {value}"]
    lines = ", ".join(parts[:3] + ["''"] + parts[3:6] + ["''"] + parts[6:])
    return query(f"SELECT unnest([{lines}]) AS line FROM ({COUNTERS_SQL})")


@register("sink_metrics_text", _metrics_sql())
def sink_metrics_text(spark, sf):
    counters = decisions.request_counters(fleet.request_log(spark, sf))
    path = sinks.write_text(decisions.metrics_lines(
        rounded(counters, "score_latency_ms_avg")), scratch_path(spark, "metrics"))
    return spark.read.text(path).select(F.col("value").alias("line"))
