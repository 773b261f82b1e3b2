"""Quantities, identifiers and sizes as column expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from mooring.constants import (
    ALLOCATABLE_CPU_SHARE, ALLOCATABLE_MEMORY_SHARE, GIB, MIB,
)

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def _without(text: Column, suffix_length: int) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - suffix_length)


def parse_cpu(text: Column) -> Column:
    """Millicores of '450m', '100000n' or plain cores; unreadable text is 0."""
    value = (
        F.when(text.endswith("m"), _number(_without(text, 1)))
        .when(text.endswith("n"), _number(_without(text, 1)) / 1e6)
        .otherwise(_number(text) * 1000.0)
    )
    return F.coalesce(value, F.lit(0.0))


def parse_memory(text: Column) -> Column:
    """Bytes of '8192Ki', '2Gi' or plain bytes; other suffixes are 0."""
    value = _number(text)
    for power, suffix in enumerate(["Ki", "Mi", "Gi", "Ti"], start=1):
        value = F.when(text.endswith(suffix),
                       _number(_without(text, 2)) * float(1024 ** power)).otherwise(value)
    return F.coalesce(value, F.lit(0.0))


def allocatable_cpu(capacity: Column) -> Column:
    return F.floor(capacity * ALLOCATABLE_CPU_SHARE).cast("long")


def allocatable_memory(capacity: Column) -> Column:
    return F.floor(capacity * ALLOCATABLE_MEMORY_SHARE).cast("long")


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def quantize_cpu(raw: Column) -> Column:
    """Millicores in steps of 50, half-even, within [50, 32000]."""
    steps = F.rint(clamp(raw.cast("double"), 10.0, 32_000.0) / 50) * 50
    return F.greatest(F.lit(50), steps.cast("long")).cast("long")


def quantize_memory(raw: Column) -> Column:
    """Bytes in blocks of 64 MiB, half-even, within [64 MiB, 64 GiB]."""
    block = 64 * MIB
    return (F.rint(clamp(raw.cast("double"), float(block), float(64 * GIB)) / block)
            * block).cast("long")


def weighted_choice(unit: Column, weighted) -> Column:
    """Name whose cumulative weight first reaches unit * total."""
    total = sum(weight for _, weight in weighted)
    scaled = unit * total
    reached, choice = 0.0, None
    for name, weight in weighted:
        reached += weight
        condition = scaled <= reached
        choice = F.when(condition, name) if choice is None else choice.when(condition, name)
    return choice.otherwise(weighted[-1][0])


def unit_interval(key: Column, salt: int = 0) -> Column:
    """Deterministic spread of an integer key over [0, 1)."""
    # Multiplicative mixing modulo the prime 1000003 stays exact in 64 bits.
    mixed = F.pmod((F.pmod(key, F.lit(1_000_003)) + salt) * 48_271, F.lit(1_000_003))
    mixed = F.pmod(mixed * mixed + mixed * 31, F.lit(1_000_003))
    return mixed / F.lit(1_000_003.0)


def round_exact(value: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value, as Python rounds.

    The value is split in two halves whose products with 10**digits are exact,
    so a value next to a tie falls on its true side. Built-in rounding goes by
    the shortest decimal text and costs a decimal object per value.
    """
    scale = float(10 ** digits)
    value = value.cast("double")
    low = F.floor(value * scale)
    lifted = value * 134_217_729.0
    high_half = lifted - (lifted - value)
    beyond = (high_half * scale - (low + 0.5)) + (value - high_half) * scale
    nearest = F.when(beyond > 0, low + 1).when(beyond < 0, low).otherwise(
        low + F.pmod(low, F.lit(2)))
    return nearest / scale


def padded(number: Column, width: int) -> Column:
    """Zero-padded decimal text; wider numbers keep all their digits."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def cluster_label(number: Column) -> Column:
    return F.concat(F.lit("c"), padded(number, 6))


def event_label(number: Column) -> Column:
    return F.concat(F.lit("e"), padded(number, 8))


def pod_label(number: Column) -> Column:
    return F.concat(F.lit("pod-"), padded(number, 8))


def node_label(cluster: Column, index: Column) -> Column:
    return F.concat(cluster_label(cluster), F.lit("-n"), padded(index, 3))
