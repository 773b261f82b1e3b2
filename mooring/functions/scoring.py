"""Penalties, scores and status bands as column expressions."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooring.constants import (
    CPU_HEADROOM_WEIGHT, CPU_PENALTY_CURVE, DENSITY_PENALTY_CURVE, MAX_PODS_PER_NODE,
    MEMORY_HEADROOM_WEIGHT, MEMORY_PENALTY_CURVE, NEUTRAL_SCORE, STEP_DENSITY_PENALTY,
    STEP_DENSITY_PODS, STEP_PENALTIES,
)
from mooring.functions.features import headroom
from mooring.functions.units import clamp, round_exact


def unit_clamp(value: Column) -> Column:
    return clamp(value, 0.0, 1.0)


def curve(value: Column, anchors, clamped=False) -> Column:
    """Piecewise-linear interpolation over anchors, value clamped to [0, 1].

    The value stands in every branch; give a stored column, already clamped,
    where the generated code has to stay small.
    """
    if not anchors:
        return F.lit(0.0)
    x = value if clamped else unit_clamp(value)
    result = F.when(x <= anchors[0][0], F.lit(float(anchors[0][1])))
    for (left, low), (right, high) in zip(anchors, anchors[1:]):
        if right <= left:
            piece = F.lit(float(high))
        else:
            piece = low + (x - left) / (right - left) * (high - low)
        result = result.when(x <= right, piece)
    return result.otherwise(F.lit(float(anchors[-1][1])))


def utilisations(cpu_percent: Column, memory_percent: Column, pod_count: Column):
    """Clamped curve inputs by penalty name."""
    return {
        "cpu_penalty": unit_clamp(cpu_percent),
        "memory_penalty": unit_clamp(memory_percent),
        "density_penalty": unit_clamp((pod_count + 1) / F.lit(MAX_PODS_PER_NODE)),
    }


CURVES = {"cpu_penalty": CPU_PENALTY_CURVE, "memory_penalty": MEMORY_PENALTY_CURVE,
          "density_penalty": DENSITY_PENALTY_CURVE}


def penalties_of(cpu_percent: Column, memory_percent: Column, pod_count: Column):
    """Piecewise cpu, memory and density penalties of one placement."""
    inputs = utilisations(cpu_percent, memory_percent, pod_count)
    return {name: curve(x, CURVES[name], clamped=True) for name, x in inputs.items()}


def _step(utilisation: Column) -> Column:
    result = None
    for above, penalty in STEP_PENALTIES:
        result = (F.when(utilisation > above, penalty) if result is None
                  else result.when(utilisation > above, penalty))
    return result.otherwise(0).cast("long")


def step_penalties():
    """Tiered cpu, memory and density penalties and their total."""
    cpu = _step(F.col("projected_cpu_percent"))
    memory = _step(F.col("projected_memory_percent"))
    density = F.when(F.col("current_pod_count") > STEP_DENSITY_PODS,
                     STEP_DENSITY_PENALTY).otherwise(0).cast("long")
    return {
        "cpu_step_penalty": cpu,
        "memory_step_penalty": memory,
        "density_step_penalty": density,
        "step_penalty": cpu + memory + density,
    }


def teacher_of(cpu_percent: Column, memory_percent: Column, penalties) -> Column:
    """Rounded headroom base minus the piecewise penalties, within [0, 100]."""
    base = F.rint((CPU_HEADROOM_WEIGHT * headroom(cpu_percent)
                   + MEMORY_HEADROOM_WEIGHT * headroom(memory_percent)) * 100)
    return clamp(base - penalties["cpu_penalty"] - penalties["memory_penalty"]
                 - penalties["density_penalty"], 0.0, 100.0)


def teacher_score() -> Column:
    names = ("cpu_penalty", "memory_penalty", "density_penalty")
    return teacher_of(F.col("projected_cpu_percent"), F.col("projected_memory_percent"),
                      {name: F.col(name) for name in names})


def with_teacher_score(df: DataFrame) -> DataFrame:
    """Adds the three penalties and teacher_score to derived candidates."""
    inputs = utilisations(F.col("projected_cpu_percent"), F.col("projected_memory_percent"),
                          F.col("current_pod_count"))
    stored = df.withColumns({f"_{name}_at": x for name, x in inputs.items()})
    curved = stored.withColumns({
        name: curve(F.col(f"_{name}_at"), CURVES[name], clamped=True) for name in CURVES})
    return curved.withColumn("teacher_score", teacher_score()).drop(
        *[f"_{name}_at" for name in CURVES])


def _heuristic(cpu_percent, memory_percent, cpu_headroom, memory_headroom, balance, density):
    cpu, memory = unit_clamp(cpu_headroom), unit_clamp(memory_headroom)
    balance, density = unit_clamp(balance), unit_clamp(density)

    def overload(p):
        return F.when(p > 0.9, (p - 0.9) * 5).otherwise(0.0)

    saturation = F.least(F.lit(1.0), overload(cpu_percent) + overload(memory_percent))
    base = 0.40 * cpu + 0.40 * memory + 0.10 * (1.0 - balance) + 0.10 * (1.0 - density)
    return F.rint(clamp(base * (1.0 - saturation), 0.0, 1.0) * 100).cast("long")


def heuristic_score() -> Column:
    """Headroom, balance and density mix, scaled down near saturation; 0..100."""
    return _heuristic(*map(F.col, (
        "projected_cpu_percent", "projected_memory_percent", "cpu_headroom", "memory_headroom",
        "resource_balance", "packing_density")))


def heuristic_of(cpu_percent: Column, memory_percent: Column, cpu_headroom: Column,
                 memory_headroom: Column, pod_count: Column) -> Column:
    """The heuristic score of one placement, from its projected shares."""
    return _heuristic(cpu_percent, memory_percent, cpu_headroom, memory_headroom,
                      F.abs(cpu_headroom - memory_headroom),
                      (pod_count + 1) / F.lit(MAX_PODS_PER_NODE))


def final_score(service_score: Column, penalty: Column) -> Column:
    return clamp(service_score - penalty, 0, 100).cast("long")


def with_fallback(service_score: Column, source: Column):
    """Neutral score and its source where the scoring call gave nothing."""
    return {
        "score": F.coalesce(service_score, F.lit(NEUTRAL_SCORE)).cast("long"),
        "source": F.when(service_score.isNull(), F.lit("fallback")).otherwise(source),
    }


def resolve_score(service_score: Column, penalty: Column) -> Column:
    """Penalised score, or the unpenalised neutral score after a failed call."""
    return F.when(service_score.isNull(), F.lit(NEUTRAL_SCORE).cast("long")).otherwise(
        final_score(service_score, penalty))


def clamp_prediction(raw: Column, rounded=True) -> Column:
    bounded = clamp(raw, 0.0, 100.0)
    return F.rint(bounded).cast("long") if rounded else bounded


def reason_text() -> Column:
    return F.format_string(
        "req_cpu=%.0fm proj_cpu%%=%.1f%% headroom=%.1f%%",
        F.rint(F.col("requested_cpu").cast("double")),
        round_exact(F.col("projected_cpu_percent") * 100, 1),
        round_exact(F.col("cpu_headroom") * 100, 1),
    )


def node_status():
    return {
        "cpu_util_pct": round_exact(F.col("current_cpu_percent") * 100, 1),
        "mem_util_pct": round_exact(F.col("current_memory_percent") * 100, 1),
        "pods": F.col("current_pod_count"),
    }


def _banded(value: Column, low, high, names) -> Column:
    return F.when(value <= low, names[0]).when(value <= high, names[1]).otherwise(names[2])


def whole_percent(share: Column) -> Column:
    """A share as a whole percentage, halves up."""
    return F.floor(share * 100 + 0.5).cast("long")


def status_bands(score: Column, cpu_share: Column, mem_share: Column, stressed: Column):
    """Score class, usage colours by whole percentages, and the health tag, empty under stress."""
    def by_score(high, middle, low):
        return F.when(score >= 70, high).when(score >= 40, middle).otherwise(low)

    return {
        "score_band": by_score("high", "mid", "low"),
        "cpu_band": _banded(whole_percent(cpu_share), 50, 75, ("green", "yellow", "red")),
        "mem_band": _banded(whole_percent(mem_share), 60, 80, ("green", "yellow", "red")),
        "health_tag": F.when(stressed, "").otherwise(by_score("Healthy", "Moderate", "High Risk")),
    }
