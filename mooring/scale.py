"""Skew-safe building blocks shared by the operators."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooring.session import cut_lineage, stored_rows

#: Most bytes of a side that is broadcast: it is held by the driver and by every executor.
BROADCAST_BYTES = 64 << 20
SALTS = 32


#: Bytes in memory for a byte of a stored table, at most: compressed columns become wide rows.
EXPANSION = 16


#: Spark's size of what it knows no size of is beyond this.
UNKNOWN_BYTES = 1 << 60


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of df's size, from the sizes of its files; no job is run for it.

    Filters and aggregates count as if they kept every row, and a join as the product of its sides:
    the estimate errs to the large side.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def source_bytes(df: DataFrame) -> int:
    """Bytes of the largest stored table that df reads; 0 where Spark knows no size, as in streams."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max([s for s in sizes if s < UNKNOWN_BYTES], default=0)


def is_bounded(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when df is certainly small enough to be broadcast, by the sizes of its files."""
    return estimated_bytes(df) * EXPANSION <= max_bytes


def attach(big: DataFrame, small: DataFrame, on, how="inner", max_bytes=BROADCAST_BYTES,
           salts=SALTS, spread_by=None, bounded=None) -> DataFrame:
    """Join a large frame to a dimension without moving a hot key to one task.

    The dimension is broadcast only where the sizes of its files bound it, or
    the caller has seen that those of its rows' source do. Beyond that the large
    side is salted and the dimension repeated once per salt, so that a key
    holding a third of all rows is spread over `salts` tasks.
    """
    on = [on] if isinstance(on, str) else list(on)
    if bounded is None:
        bounded = is_bounded(small, max_bytes)
    if bounded:
        return big.join(F.broadcast(small), on, how)
    salt_source = spread_by or [c for c in big.columns if c not in on] or big.columns
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_source), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, on + ["_salt"], how).drop("_salt")


def positions(df: DataFrame, group, order, sums=()) -> DataFrame:
    """Exact per-group row numbers and running sums without one-task windows.

    Rows are range-partitioned on (group, order), numbered inside each slice of
    (partition, group), then shifted by totals of the earlier slices. A hot
    group spreads over as many partitions as its rows need; only one row per
    (partition, group) reaches the small offset window.

    Adds `position` (1-based), `group_rows`, and `<c>_through` (inclusive running
    sum) and `<c>_total` for each c in sums. `group` plus `order` must identify
    the order completely where the caller needs a reproducible number.
    """
    group = [group] if isinstance(group, str) else list(group)
    order = [order] if isinstance(order, str) else list(order)
    ordered = cut_lineage(
        df.sort(*group, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_id", 33).cast("int"))
    )
    keys = ["_slice"] + group
    slices = ordered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_{c}") for c in sums]
    )
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = slices.select(
        *keys,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("group_rows"),
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}_before") for c in sums],
        *[F.sum(f"_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )
    inside = Window.partitionBy(*keys).orderBy("_id")
    numbered = ordered.withColumn("_in_slice", F.row_number().over(inside)).withColumns(
        {f"_{c}_in": F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for c in sums})
    joined = numbered.join(offsets, keys)
    return joined.withColumns({
        "position": (F.col("_in_slice") + F.col("_before")).cast("long"),
        **{f"{c}_through": F.col(f"_{c}_in") + F.col(f"_{c}_before") for c in sums},
    }).drop("_id", "_slice", "_in_slice", "_before",
            *[f"_{c}_in" for c in sums], *[f"_{c}_before" for c in sums])


#: Buckets of a narrowing round: as many rows come to the driver at most.
BUCKETS = 4096
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def nth_value(df: DataFrame, column: str, n: int, weight: str = None):
    """(value, rows before it, rows equal to it) of the n-th row by a numeric column, nulls first.

    Found without a sort: each round counts the rows per bucket of the range that still holds the
    n-th row and goes on inside one bucket. Buckets are a monotone function of the value, so the
    result is exact; a round narrows the range 4096 times. With a weight, a row counts that often.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    c = F.col(column)
    first = df.agg(F.sum(one).alias("n"), F.sum(F.when(c.isNull(), one)).alias("nulls"),
                   F.min(c).alias("low"), F.max(c).alias("high")).first()
    if not first.n or not 1 <= n <= first.n:
        raise ValueError(f"row {n} of {first.n or 0}")
    before = first.nulls or 0
    if n <= before:
        return None, 0, before
    whole = dict(df.dtypes)[column] in _WHOLE
    low, high, equal = first.low, first.high, first.n - before
    while low < high:
        apart = c - F.lit(low) if whole and high - low < 1 << 62 else (
            c.cast("double") - F.lit(float(low)))
        bucket = F.floor(apart / F.lit(float(high - low)) * (BUCKETS - 1))
        found = df.where((c >= F.lit(low)) & (c <= F.lit(high))).groupBy(bucket.alias("b")).agg(
            F.sum(one).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).collect()
        for row in sorted(found, key=lambda r: r.b):
            if before + row.n >= n:
                low, high, equal = row.low, row.high, row.n
                break
            before += row.n
    return low, before, equal


def exact_median(df: DataFrame, value: str, name: str) -> DataFrame:
    """One-row exact median of the values that are not null; null without any.

    Distinct values are counted once and stored; their middle is found by narrowing, not by a sort.
    """
    counted = stored_rows(df.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.count(F.lit(1)).alias("weight")), "counted")
    total = counted.agg(F.sum("weight")).first()[0] or 0
    median = None
    if total:
        low, before, equal = nth_value(counted, value, (total + 1) // 2, "weight")
        high = low if before + equal >= (total + 2) // 2 else nth_value(
            counted, value, (total + 2) // 2, "weight")[0]
        median = (low + high) / 2
    return df.sparkSession.range(1).select(F.lit(median).cast("double").alias(name))


def with_scalar(frame: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Adds the single value of a one-row frame as a column."""
    return frame.withColumn(name, other.scalar())
