"""Projected usage and the derived feature columns.

All expressions take the column names of the candidate row, so one select
computes them next to each other inside one generated stage.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooring.constants import FEATURES, MAX_PODS_PER_NODE, RATIO_COLUMNS
from mooring.functions.units import round_exact
from mooring.session import keep_compiled


def share(part: Column, whole: Column, guard="zero") -> Column:
    """part / whole, with 0 for empty capacity ("zero") or divisor >= 1 ("one")."""
    if guard == "one":
        return part / F.greatest(whole.cast("double"), F.lit(1.0))
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def headroom(projected_percent: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - projected_percent)


def current_percents(guard="zero"):
    c = F.col
    return {
        "current_cpu_percent": share(c("current_cpu_usage"), c("node_allocatable_cpu"), guard),
        "current_memory_percent": share(
            c("current_memory_usage"), c("node_allocatable_memory"), guard),
    }


def projected_usage(guard="zero"):
    c = F.col
    cpu = c("current_cpu_usage") + c("requested_cpu")
    memory = c("current_memory_usage") + c("requested_memory")
    return {
        "projected_cpu_usage": cpu,
        "projected_memory_usage": memory,
        "projected_cpu_percent": share(cpu, c("node_allocatable_cpu"), guard),
        "projected_memory_percent": share(memory, c("node_allocatable_memory"), guard),
        "projected_remaining_cpu": F.greatest(F.lit(0), c("node_allocatable_cpu") - cpu),
        "projected_remaining_memory": F.greatest(
            F.lit(0), c("node_allocatable_memory") - memory),
        "projected_pod_count": c("current_pod_count") + 1,
    }


def headrooms():
    return {
        "cpu_headroom": headroom(F.col("projected_cpu_percent")),
        "memory_headroom": headroom(F.col("projected_memory_percent")),
    }


def resource_balance(variant="headroom") -> Column:
    """|cpu - memory| of headrooms, or of projections where they may exceed 1."""
    if variant == "projection":
        return F.abs(F.col("projected_cpu_percent") - F.col("projected_memory_percent"))
    return F.abs(F.col("cpu_headroom") - F.col("memory_headroom"))


def request_ratios(guard="zero"):
    c = F.col
    return {
        "cpu_request_ratio": share(c("requested_cpu"), c("node_allocatable_cpu"), guard),
        "memory_request_ratio": share(
            c("requested_memory"), c("node_allocatable_memory"), guard),
    }


def packing_density() -> Column:
    return (F.col("current_pod_count") + 1) / F.lit(MAX_PODS_PER_NODE)


def fragmentation():
    c = F.col
    return {
        "cpu_fragmentation": c("current_cpu_percent") * (1.0 - c("cpu_headroom")),
        "memory_fragmentation": c("current_memory_percent") * (1.0 - c("memory_headroom")),
    }


def waste():
    c = F.col
    return {
        "cpu_waste": F.greatest(F.lit(0.0), share(
            c("node_allocatable_cpu") - c("projected_cpu_usage"), c("node_allocatable_cpu"))),
        "memory_waste": F.greatest(F.lit(0.0), share(
            c("node_allocatable_memory") - c("projected_memory_usage"),
            c("node_allocatable_memory"))),
    }


def derive(df: DataFrame, guard="zero", balance="headroom") -> DataFrame:
    """All projected and derived columns of a candidate row, not yet rounded."""
    return (
        keep_compiled(df).withColumns({**current_percents(guard), **projected_usage(guard)})
        .withColumns(headrooms())
        .withColumns({
            **fragmentation(), **waste(), **request_ratios(guard),
            "resource_balance": resource_balance(balance),
            "packing_density": packing_density(),
        })
    )


def feature_vector_columns(df: DataFrame):
    """The 18 features as doubles in contract order; absent or null is 0.0."""
    return [
        (F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns
         else F.lit(0.0)).alias(name)
        for name in FEATURES
    ]


def rounded_ratios(digits=6):
    """Half-even rounding of the ratio columns for storage."""
    return {name: round_exact(F.col(name), digits) for name in RATIO_COLUMNS}
