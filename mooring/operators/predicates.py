"""Eligibility predicates over nested node and pod columns.

Plain columns are compared first wherever predicates are combined, so the
nested checks only run on pairs that already fit.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooring.constants import MIN_ACCEPTABLE_SCORE

FINISHED_PHASES = ("Succeeded", "Failed")
SCHEDULER_NAME = "placement-scheduler"


def is_ready(unschedulable: Column, conditions: Column) -> Column:
    """Schedulable, and the first Ready condition is True."""
    first_ready = F.get(F.filter(conditions, lambda c: c["type"] == "Ready"), F.lit(0))
    return ~unschedulable & F.coalesce(first_ready["status"] == "True", F.lit(False))


def is_active(phase: Column) -> Column:
    return ~phase.isin(*FINISHED_PHASES)


def is_pending(scheduler: Column, node_name: Column, phase: Column,
               name=SCHEDULER_NAME) -> Column:
    """Opted in to this scheduler, unbound and still live."""
    unbound = F.coalesce(node_name, F.lit("")) == ""
    return (scheduler == name) & unbound & is_active(phase)


def _text(struct: Column, field: str) -> Column:
    """A text field; what API data leaves out means the empty text."""
    return F.coalesce(struct[field], F.lit(""))


def toleration_matches(toleration: Column, taint: Column) -> Column:
    """Empty or absent effect or key is a wildcard; empty or absent operator means Equal."""
    effect = (_text(toleration, "effect") == "") | (
        _text(toleration, "effect") == _text(taint, "effect"))
    key = (_text(toleration, "key") == "") | (_text(toleration, "key") == _text(taint, "key"))
    operator = _text(toleration, "operator")
    value = (operator == "Exists") | (operator.isin("Equal", "") & (
        _text(toleration, "value") == _text(taint, "value")))
    return effect & key & value


def tolerates_taints(tolerations: Column, taints: Column) -> Column:
    """Every taint but the soft ones meets a matching toleration; absent lists are empty."""
    return F.coalesce(F.forall(taints, lambda taint: (
        _text(taint, "effect") == "PreferNoSchedule") | F.coalesce(F.exists(
            tolerations, lambda toleration: toleration_matches(toleration, taint)),
            F.lit(False))), F.lit(True))


def _integer(text: Column) -> Column:
    """A base-10 integer of 64 bits with nothing around it, else null."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))


def selector_matches(requirement: Column, labels: Column) -> Column:
    """One label requirement; an unknown operator never matches, absent labels are none."""
    actual = F.try_element_at(labels, requirement["key"])
    present = F.coalesce(F.map_contains_key(labels, requirement["key"]), F.lit(False))
    values = requirement["values"]
    listed = F.coalesce(F.array_contains(values, actual), F.lit(False))
    have = _integer(actual)
    want = _integer(F.get(values, F.lit(0)))
    op = requirement["operator"]
    return (
        F.when(op == "In", present & listed)
        .when(op == "NotIn", ~present | ~listed)
        .when(op == "Exists", present)
        .when(op == "DoesNotExist", ~present)
        .when(op == "Gt", F.coalesce(have > want, F.lit(False)))
        .when(op == "Lt", F.coalesce(have < want, F.lit(False)))
        .otherwise(F.lit(False))
    )


def matches_affinity(terms: Column, labels: Column) -> Column:
    """Terms are alternatives, requirements of a term all hold; no terms: true."""
    return terms.isNull() | (F.size(terms) == 0) | F.exists(
        terms, lambda term: F.forall(term, lambda r: selector_matches(r, labels)))


def fits_total() -> Column:
    """Request within total allocatable; unregistered capacity never fits."""
    c = F.col
    return (
        (c("node_allocatable_cpu") > 0) & (c("node_allocatable_memory") > 0)
        & (c("total_requested_cpu") <= c("node_allocatable_cpu"))
        & (c("total_requested_memory") <= c("node_allocatable_memory"))
    )


def fits_free():
    """Request on top of current usage within allocatable, with the reason if not."""
    c = F.col
    cpu = c("current_cpu_usage") + c("requested_cpu") <= c("node_allocatable_cpu")
    memory = c("current_memory_usage") + c("requested_memory") <= c("node_allocatable_memory")
    return {
        "feasible": cpu & memory,
        "reject_reason": F.when(cpu & memory, "").when(~cpu & ~memory, "both")
        .when(~cpu, "cpu").otherwise("memory"),
    }


def first_rejection() -> Column:
    """Name of the first failing check in the order taint, affinity, capacity."""
    return (
        F.when(~tolerates_taints(F.col("tolerations"), F.col("taints")), "taint")
        .when(~matches_affinity(F.col("affinity_terms"), F.col("labels")), "affinity")
        .when(~fits_total(), "capacity")
        .otherwise("")
    )


def matches_constraints() -> Column:
    return (tolerates_taints(F.col("tolerations"), F.col("taints"))
            & matches_affinity(F.col("affinity_terms"), F.col("labels")))


def eligible_nodes(candidates: DataFrame) -> DataFrame:
    """Candidates that pass capacity, taints and affinity."""
    return candidates.where(fits_total()).where(matches_constraints())


def claim_names(volumes: Column) -> Column:
    """Claim (or volume) names of the claim-backed volumes, comma separated."""
    claimed = F.filter(volumes, lambda v: v["claim"].isNotNull())
    return F.concat_ws(", ", F.transform(
        claimed, lambda v: F.when(v["claim"] == "", v["name"]).otherwise(v["claim"])))


def has_claims(volumes: Column) -> Column:
    return F.exists(volumes, lambda v: v["claim"].isNotNull())


def preferred_only(scored: DataFrame, score="score", event="event_id",
                   threshold=MIN_ACCEPTABLE_SCORE) -> DataFrame:
    """Per event the candidates at or above threshold, or all when none is."""
    preferred = F.col(score) >= threshold
    flagged = scored.withColumn(
        "_any", F.max(preferred).over(Window.partitionBy(event)))
    return flagged.where(preferred | ~F.col("_any")).drop("_any")


def feasible_only(labelled: DataFrame, columns) -> DataFrame:
    return labelled.where("feasible").select(*columns)
