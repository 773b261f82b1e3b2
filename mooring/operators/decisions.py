"""Decision events, counters and status roll-ups."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.operators.predicates import SCHEDULER_NAME, claim_names, has_claims


def scheduled_events(placed: DataFrame, component=SCHEDULER_NAME) -> DataFrame:
    return placed.select(
        "pod_id",
        F.concat(F.lit("pod-"), "pod_id", F.lit(".scheduled")).alias("event_name"),
        F.lit("Scheduled").alias("reason"), F.lit("Normal").alias("type"),
        F.concat(F.lit(f"{component} chose "), F.col("node_name"),
                 F.lit(" with "), F.col("score").cast("string"), F.lit(" of 100 points"))
        .alias("message"))


def failed_events(unplaced: DataFrame) -> DataFrame:
    """One warning per pod without eligible node, if its cluster has ready nodes."""
    return unplaced.where(F.col("ready_nodes") > 0).select(
        "pod_id",
        F.concat(F.lit("pod-"), "pod_id", F.lit(".failedscheduling")).alias("event_name"),
        F.lit("FailedScheduling").alias("reason"), F.lit("Warning").alias("type"),
        F.concat(F.lit("none of "), F.col("ready_nodes").cast("string"),
                 F.lit(" ready nodes passes taints, affinity and capacity")).alias("message"))


def claim_events(pods: DataFrame, component=SCHEDULER_NAME) -> DataFrame:
    return pods.where(has_claims(F.col("volumes"))).select(
        "pod_id",
        F.concat(F.lit("pod-"), "pod_id", F.lit(".warning")).alias("event_name"),
        F.lit("PVCBindingRisk").alias("reason"), F.lit("Warning").alias("type"),
        F.concat(F.lit("claims "), claim_names(F.col("volumes")),
                 F.lit(f" may never bind: {component} binds the pod itself, and a storage class"
                       " that waits for its first consumer then waits for ever")).alias("message"))


def placement_events(pods: DataFrame, nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """Scheduled, FailedScheduling and claim warnings in one table.

    pods: pending pods; nodes: ready nodes; placed: best node and score per pod.
    """
    names = nodes.select(F.col("node_id").alias("best_node_id"), "node_name")
    outcome = pods.select("event_id", "pod_id", "cluster_id").join(placed, "event_id", "left")
    # One node may win a third of all pods: adaptive execution splits its rows, or broadcasts the names.
    scheduled = outcome.where(F.col("best_node_id").isNotNull()).join(
        names, "best_node_id").withColumn("score", F.col("best_score"))
    ready = nodes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("ready_nodes"))
    unplaced = outcome.where(F.col("best_node_id").isNull()).join(ready, "cluster_id")
    return scheduled_events(scheduled).unionByName(failed_events(unplaced)).unionByName(
        claim_events(pods))


def request_counters(log: DataFrame) -> DataFrame:
    """Requests, those answered by the fallback, mean latency."""
    return log.agg(
        F.count(F.lit(1)).alias("score_requests_total"),
        F.sum(F.when(F.col("failed"), 1).otherwise(0)).alias("score_fallback_total"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("score_latency_ms_avg"))


def load_columns():
    """Aggregates of a load window: sent, success, failed, mean latency."""
    failed = F.sum(F.when(F.col("failed"), 1).otherwise(0))
    return [
        F.count(F.lit(1)).alias("sent"),
        (F.count(F.lit(1)) - failed).alias("success"),
        failed.alias("failed"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
    ]


def load_stats(log: DataFrame, group=()) -> DataFrame:
    """Load counters with the request rate over the observed seconds."""
    micros = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    stats = log.groupBy(*group).agg(*load_columns(), (micros / 1e6).alias("elapsed_sec"))
    return stats.withColumn("rps", F.when(
        F.col("elapsed_sec") > 0, F.col("sent") / F.col("elapsed_sec")).otherwise(0.0))


def pod_map(pods: DataFrame, node="bound_node") -> DataFrame:
    """Pods per node ("pending" where unbound): size of the group and its span.

    The display list of one node is a filter on this key; a group may hold any
    number of pods, so it is summarised here instead of being collected.
    """
    return pods.groupBy(F.coalesce(node, F.lit("pending")).alias("node")).agg(
        F.count(F.lit(1)).alias("pods"), F.min("pod_id").alias("first_pod"),
        F.max("pod_id").alias("last_pod"))


def pod_map_rows(pods: DataFrame, previous: DataFrame, node="bound_node") -> DataFrame:
    """The pod map row by row: node ("pending" where unbound), pod, phase, and whether it is new."""
    known = previous.select("pod_id").distinct().withColumn("_known", F.lit(True))
    return pods.select(F.coalesce(node, F.lit("pending")).alias("node"), "pod_id", "phase").join(
        known, "pod_id", "left").select(
        "node", "pod_id", "phase", F.col("_known").isNull().alias("is_new"))


def new_pods(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Pods of the current snapshot that the previous one did not have."""
    return current.join(previous.select("pod_id"), "pod_id", "left_anti")


def metrics_lines(counters: DataFrame, prefix="placement") -> DataFrame:
    """Counters in text exposition format, one line per row with its place."""
    rows = [
        ("score_requests_total", "Scores asked for so far", "counter",
         F.col("score_requests_total").cast("string")),
        ("score_fallback_total", "Scores given without the service", "counter",
         F.col("score_fallback_total").cast("string")),
        ("score_latency_ms_avg", "Mean time of a score in milliseconds", "gauge",
         F.format_string("%.4f", F.col("score_latency_ms_avg"))),
    ]
    lines = []
    for name, text, kind, value in rows:
        if lines:
            lines.append(F.lit(""))
        full = f"{prefix}_{name}"
        lines += [F.lit(f"# HELP {full} {text}"), F.lit(f"# TYPE {full} {kind}"),
                  F.concat(F.lit(f"{full} "), value)]
    return counters.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))
