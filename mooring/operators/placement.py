"""The online path: eligible ready nodes, service score, penalty, best node."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.functions import features, scoring
from mooring.operators.candidates import PAIR_KEY
from mooring.operators.predicates import (
    fits_total, is_pending, is_ready, matches_constraints,
)
from mooring.operators.ranking import best_node

CONSTRAINTS = ["tolerations", "affinity_terms"]


def ready_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_ready(F.col("unschedulable"), F.col("conditions")))


def pending_pods(pods: DataFrame) -> DataFrame:
    return pods.where(is_pending(F.col("scheduler_name"), F.col("bound_node"), F.col("phase")))


def _sum_of(containers: str, field: str):
    return F.aggregate(containers, F.lit(0).cast("long"), lambda acc, c: acc + c[field])


def pod_requests(pods: DataFrame) -> DataFrame:
    """Requests of all containers with init, of containers, and of the first one."""
    first = F.get("containers", F.lit(0))
    return pods.withColumns({
        "total_requested_cpu": _sum_of("containers", "cpu") + _sum_of("init_containers", "cpu"),
        "total_requested_memory":
            _sum_of("containers", "memory") + _sum_of("init_containers", "memory"),
        "container_cpu": _sum_of("containers", "cpu"),
        "container_memory": _sum_of("containers", "memory"),
        "first_cpu": F.coalesce(first["cpu"], F.lit(0).cast("long")),
        "first_memory": F.coalesce(first["memory"], F.lit(0).cast("long")),
    })


def eligible_pairs(pods: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of pods and ready nodes that pass taints, affinity and capacity.

    Pods of one workload share their constraints, so the nested checks run once per distinct set
    and node: never on more rows than pods times nodes, and on far fewer where sets repeat. Pods
    then meet the nodes that their set allows by the set's hash, and by its arrays in case two
    sets share one. Neither side is measured: nothing above the joins needs their partitions, so
    adaptive execution broadcasts a side that turns out small and splits a hot cluster or set.
    """
    ready = ready_nodes(nodes)
    asked = pod_requests(pods).withColumns({
        c: F.coalesce(c, F.array().cast(pods.schema[c].dataType)) for c in CONSTRAINTS}).withColumn(
        "_set", F.xxhash64(*CONSTRAINTS))
    sets = asked.select(PAIR_KEY, "_set", *CONSTRAINTS).distinct()
    # What only the checks need stays out of the rows that pods are joined with.
    unused = [c for c in ("labels", "taints", "conditions", "unschedulable") if c in ready.columns]
    allowed = sets.join(ready, PAIR_KEY).where(matches_constraints()).drop(*unused)
    renamed = allowed.withColumnsRenamed({c: f"_{c}" for c in CONSTRAINTS})
    same = F.lit(True)
    for c in CONSTRAINTS:
        same &= F.col(c) == F.col(f"_{c}")
    return asked.join(renamed, [PAIR_KEY, "_set"]).where(same).where(fits_total()).drop(
        "_set", *[f"_{c}" for c in CONSTRAINTS])


def online_score(pairs: DataFrame) -> DataFrame:
    """Service score from the first container, minus the step penalty of all.

    Adds service_score, step_penalty and score.
    """
    asked = features.derive(pairs.withColumns({
        "requested_cpu": F.col("first_cpu"), "requested_memory": F.col("first_memory")}),
        guard="one").withColumn("service_score", scoring.heuristic_score())
    step = {
        "projected_cpu_percent": features.share(
            F.col("current_cpu_usage") + F.col("container_cpu"), F.col("node_allocatable_cpu")),
        "projected_memory_percent": features.share(
            F.col("current_memory_usage") + F.col("container_memory"),
            F.col("node_allocatable_memory")),
    }
    return asked.withColumns(step).withColumns(scoring.step_penalties()).withColumn(
        "score", scoring.resolve_score(F.col("service_score"), F.col("step_penalty")))


def place(pods: DataFrame, nodes: DataFrame) -> DataFrame:
    """Best node and score of every pod that has an eligible node."""
    return best_node(online_score(eligible_pairs(pods, nodes)))
