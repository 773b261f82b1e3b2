"""Validation report and redundancy analysis of a labelled dataset.

Every report is a few partial aggregates over the whole dataset; nothing is
sampled and no column is gathered in one place.
"""
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mooring.constants import GIB
from mooring.functions.units import round_exact
from mooring.operators.candidates import event_keys
from mooring.session import ship_package

#: Cuts of the Gini coefficient for each doubling of a value.
CUTS_PER_DOUBLING = 1024
PENALTIES = ["cpu_penalty", "memory_penalty", "density_penalty"]


def _count_if(condition):
    return F.sum(F.when(condition, 1).otherwise(0))


def _unpivot(df: DataFrame, columns, keep=()) -> DataFrame:
    return df.unpivot(list(keep), [F.col(c).cast("double").alias(c) for c in columns],
                      "name", "value")


def overview(labelled: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    feasible = _count_if(F.col("feasible"))
    return labelled.agg(
        total.alias("total_rows"),
        F.count_distinct("event_id").alias("events"),
        F.count_distinct("cluster_id").alias("clusters"),
        F.count_distinct("pod_id").alias("pods"),
        feasible.alias("feasible_rows"),
        (total - feasible).alias("infeasible_rows"),
        F.try_divide(100.0 * feasible, total).alias("feasible_pct"),
        F.try_divide(100.0 * (total - feasible), total).alias("infeasible_pct"),
    )


def average_cluster(labelled: DataFrame) -> DataFrame:
    """Mean cluster size and mean feasible nodes over events."""
    events = labelled.groupBy(*event_keys(labelled)).agg(
        F.min("cluster_size").alias("size"), _count_if(F.col("feasible")).alias("fits"))
    return events.agg(F.avg("size").alias("avg_cluster_size"),
                      F.avg("fits").alias("avg_feasible_nodes"))


def score_stats(labelled: DataFrame) -> DataFrame:
    scores = labelled.where("feasible").select("teacher_score")
    return scores.agg(
        F.min("teacher_score").alias("min_score"), F.avg("teacher_score").alias("mean_score"),
        F.max("teacher_score").alias("max_score"),
        F.stddev_pop("teacher_score").alias("std_population"),
        F.stddev_samp("teacher_score").alias("std_sample"))


def score_histogram(labelled: DataFrame) -> DataFrame:
    """Ten bins of width ten, the last one closed."""
    bin_ = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("teacher_score") / 10)))
    return labelled.where("feasible").groupBy(bin_.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def rank_distribution(labelled: DataFrame, first=10) -> DataFrame:
    """Rows per rank for the first ranks, and how many ranks follow."""
    counts = labelled.where("feasible AND teacher_rank IS NOT NULL").groupBy("teacher_rank").agg(
        F.count(F.lit(1)).alias("n"))
    ranks = counts.agg(F.greatest(F.count(F.lit(1)) - first, F.lit(0)).alias("further_ranks"))
    return counts.orderBy("teacher_rank").limit(first).withColumn(
        "further_ranks", ranks.scalar())


def penalty_stats(labelled: DataFrame) -> DataFrame:
    """Spread, share of zeros and distinct thousandths per penalty.

    Rows first collapse to one per (penalty, thousandth), so the distinct count
    needs no second pass over the dataset.
    """
    long = _unpivot(labelled.where("feasible").select(*PENALTIES), PENALTIES)
    v = F.col("value")
    steps = long.groupBy("name", round_exact(F.col("value"), 3).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(v * v).alias("q"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        _count_if(F.abs(v) < 1e-12).alias("z"))
    n, s = F.sum("n"), F.sum("s")
    variance = F.sum("q") / n - (s / n) * (s / n)
    return steps.groupBy("name").agg(
        F.min("lo").alias("min_penalty"), (s / n).alias("mean_penalty"),
        F.max("hi").alias("max_penalty"),
        F.sqrt(F.greatest(F.lit(0.0), variance)).alias("std_penalty"),
        (100.0 * F.sum("z") / n).alias("zero_pct"),
        F.count(F.lit(1)).alias("unique_values"))


def penalty_histogram(labelled: DataFrame, first=12) -> DataFrame:
    """Rows per tenth of each penalty, the lowest buckets only."""
    long = _unpivot(labelled.where("feasible").select(*PENALTIES), PENALTIES)
    counts = long.groupBy("name", round_exact(F.col("value"), 1).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("bucket"))
    return counts.withColumn("_place", place).where(F.col("_place") <= first).drop("_place")


def request_stats(labelled: DataFrame) -> DataFrame:
    cpu, memory = F.col("requested_cpu"), F.col("requested_memory")
    return labelled.agg(
        F.min(cpu).alias("min_cpu"), F.avg(cpu).alias("mean_cpu"), F.max(cpu).alias("max_cpu"),
        (F.min(memory) / GIB).alias("min_mem_gb"), (F.avg(memory) / GIB).alias("mean_mem_gb"),
        (F.max(memory) / GIB).alias("max_mem_gb"))


UTILISATION = [
    ("current_cpu", "current_cpu_percent", False),
    ("current_memory", "current_memory_percent", False),
    ("projected_cpu", "projected_cpu_percent", True),
    ("projected_memory", "projected_memory_percent", True),
]


def utilisation_stats(labelled: DataFrame) -> DataFrame:
    """Percent statistics: current over all rows, projected over feasible rows."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("name"),
                 F.when(F.col("feasible") | F.lit(not only), F.col(column) * 100)
                 .alias("value"))
        for name, column, only in UTILISATION])
    long = labelled.select(F.inline(cells)).where(F.col("value").isNotNull())
    return long.groupBy("name").agg(
        F.min("value").alias("min_pct"), F.avg("value").alias("mean_pct"),
        F.max("value").alias("max_pct"), F.stddev_pop("value").alias("std_pct"))


def limit_checks(labelled: DataFrame) -> DataFrame:
    """PASS where the largest utilisation is at most 100 percent."""
    return utilisation_stats(labelled).select(
        "name", F.when(F.col("max_pct") <= 100.0, "PASS").otherwise("FAIL").alias("result"))


def label_integrity(labelled: DataFrame) -> DataFrame:
    selected = F.col("selected_by_scheduler") == 1

    def verdict(failures):
        return F.when(F.coalesce(failures, F.lit(0)) == 0, "PASS").otherwise("FAIL")

    return labelled.agg(
        F.sum("selected_by_scheduler").alias("selected_rows"),
        F.count_distinct("event_id").alias("events"),
        verdict(_count_if(selected & (F.col("score_gap_from_best") != 0))).alias("gap_zero"),
        verdict(_count_if(selected & ~F.col("teacher_rank").eqNullSafe(F.lit(1))))
        .alias("winner_rank_one"),
        verdict(_count_if(F.col("feasible") & F.col("teacher_rank").isNull()))
        .alias("no_null_rank"))


def gini(labelled: DataFrame, columns, high=0.8) -> DataFrame:
    """Exact Gini coefficient per column over absolute values.

    Rows collapse to distinct values with counts, in cuts by magnitude that need no look at the data:
    a thousand for each doubling. A cut sorts its own values alone; its count, mass and area are
    merged with those of the cuts below it, of which there are a few thousand per column.
    """
    columns = list(columns)
    # Until the few rows at the end, a column is its number: short keys for the rows of all columns.
    values = F.array(*[F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in columns])
    long = labelled.select(F.posexplode(values).alias("name", "value"))
    finite = long.where(~F.isnan("value") & (F.col("value") < float("inf")))
    # The logarithm never falls as the value rises, so neither do the cuts. It is taken of distinct
    # values, not of rows.
    cut = F.when(F.col("value") > 0, F.floor(F.log2("value") * CUTS_PER_DOUBLING))
    counted = finite.groupBy("name", "value").agg(F.count(F.lit(1)).alias("k")).withColumns(
        {"cut": cut, "mass": F.col("k") * F.col("value")})
    below = Window.partitionBy("name", "cut").orderBy("value").rowsBetween(
        Window.unboundedPreceding, -1)
    # A value repeated k times adds its running sums after 1, 2, .. k copies.
    before = F.coalesce(F.sum("mass").over(below), F.lit(0.0))
    block = F.col("k") * before + F.col("value") * F.col("k") * (F.col("k") + 1) / 2
    cuts = counted.withColumn("block", block).groupBy("name", "cut").agg(
        F.sum("k").alias("k"), F.sum("mass").alias("mass"), F.sum("block").alias("block"))
    lower = Window.partitionBy("name").orderBy(F.col("cut").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    under = F.coalesce(F.sum("mass").over(lower), F.lit(0.0))
    sums = cuts.withColumn("area", F.col("block") + F.col("k") * under).groupBy("name").agg(
        F.sum("area").alias("area"), F.sum("k").alias("n"), F.sum("mass").alias("t"))
    coefficient = F.when(F.col("t") == 0, 0.0).otherwise(
        (F.col("n") + 1 - 2.0 * F.col("area") / F.col("t")) / F.col("n"))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(F.get(names, F.col("name")).alias("name"), coefficient.alias("gini"),
                       (coefficient > high).alias("dominant"))


def constant_features(labelled: DataFrame, columns) -> DataFrame:
    """Columns with at most one distinct value, null counted as a value."""
    cells = []
    for name in columns:
        c = F.col(name)
        nulls = F.sum(F.when(c.isNull(), 1).otherwise(0))
        constant = F.when(nulls > 0, F.count(c) == 0).otherwise(F.min(c).eqNullSafe(F.max(c)))
        cells.append(F.struct(F.lit(name).alias("name"), constant.alias("constant")))
    return labelled.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _partial_products(batches):
    """Row count, column sums and products of columns of one partition."""
    total = None
    for batch in batches:
        matrix = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        ones = np.ones((len(matrix), 1))
        extended = np.hstack([ones, matrix])
        products = extended.T @ extended
        total = products if total is None else total + products
    if total is not None:
        place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place[0].ravel()), pa.array(place[1].ravel()), pa.array(total.ravel())],
            names=["i", "j", "product"])


def _correlations(labelled: DataFrame, columns):
    """Pearson matrix of the columns, nan where one is constant.

    One pass: every partition reduces to one product matrix, Spark adds them
    up, and only the matrix of the named columns comes back. All values are
    taken relative to those of one row, so large means do not cancel and a
    constant column is exactly zero.
    """
    ship_package(labelled.sparkSession)
    vectors = labelled.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    origin = vectors.head()
    if origin is None:
        return np.full((len(columns), len(columns)), math.nan)
    vectors = vectors.select(*[(F.col(c) - F.lit(origin[c])).alias(c) for c in columns])
    sums = vectors.mapInArrow(_partial_products, "i long, j long, product double").groupBy(
        "i", "j").agg(F.sum("product").alias("product"))
    size = len(columns) + 1
    products = np.zeros((size, size))
    for row in sums.collect():
        products[row.i, row.j] = row.product
    count, totals = products[0, 0], products[0, 1:]
    covariance = products[1:, 1:] / count - np.outer(totals, totals) / count ** 2
    variance = np.diag(covariance).copy()
    variance[variance <= 0] = math.nan
    return covariance / np.sqrt(np.outer(variance, variance))


def target_correlations(labelled: DataFrame, columns, target="teacher_score", k=10) -> DataFrame:
    """Pearson correlation with the target, strongest first."""
    last = _correlations(labelled, [*columns, target])[-1]
    rows = [(name, float(r)) for name, r in zip(columns, last) if not math.isnan(r)]
    found = labelled.sparkSession.createDataFrame(rows, "name string, corr double")
    strength = F.round(F.abs("corr"), 9)
    return found.orderBy(strength.desc(), F.col("name").desc()).limit(k)


def correlated_pairs(labelled: DataFrame, columns, at_least=0.95, k=None) -> DataFrame:
    """Column pairs whose absolute correlation reaches at_least, strongest first, at most k."""
    matrix = _correlations(labelled, columns)
    rows = [(columns[i], columns[j], float(abs(matrix[i, j])))
            for i, j in combinations(range(len(columns)), 2) if abs(matrix[i, j]) >= at_least]
    rows = sorted(rows, key=lambda r: (round(r[2], 9), r[0], r[1]), reverse=True)[:k]
    return labelled.sparkSession.createDataFrame(
        [(i + 1, *r) for i, r in enumerate(rows)], "place long, a string, b string, corr double")


def dataset_size(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("event_id").alias("events"),
        _count_if(F.col("feasible")).alias("feasible_rows"),
        _count_if(~F.col("feasible")).alias("infeasible_rows"))


def is_deterministic(scored: DataFrame, inputs, score: str) -> DataFrame:
    """Input combinations, and those that got more than one score.

    Combinations are told apart by 128 bits of hashes over all inputs, with flags for nulls, which
    hashes leave out: 16 bytes go into the shuffle instead of every input of every row. Among 10
    billion combinations, two share their bits with a chance of one in 10**18.
    """
    parts = [*inputs, *[F.col(c).isNull() for c in inputs]]
    keys = [F.xxhash64(F.lit(seed), *parts).alias(f"_key{seed}") for seed in range(2)]
    hashed = scored.select(*keys, score)
    per_input = hashed.groupBy("_key0", "_key1").agg(
        F.min(score).alias("lo"), F.max(score).alias("hi"))
    return per_input.agg(F.count(F.lit(1)).alias("inputs"),
                         _count_if(F.col("lo") != F.col("hi")).alias("ambiguous"))


def bounds_check(scored: DataFrame, scores) -> DataFrame:
    """Whether all values of each score column lie in [0, 100]."""
    return scored.agg(*[
        F.bool_and((F.col(c) >= 0) & (F.col(c) <= 100)).alias(f"{c}_in_bounds") for c in scores])
