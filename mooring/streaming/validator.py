"""Validation of the labelled dataset as its events arrive: every figure of the batch reports.

What a batch leaves is mergeable: count, mean and squared deviations of every measured column, counts
of score bins, ranks and rounded penalties, and the clusters met. Reading merges the batches: counts
add up, distinct values are those with a count, means and deviations follow Chan's rule. A batch that
is repeated replaces its own part, so a restart counts nothing twice; no event time is involved, so
no row is ever late. A batch's part has a bounded number of rows but for the clusters met. The labelled rows
of a batch are looked at once, as they are made, and stored nowhere.
"""
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mooring.constants import GIB
from mooring.functions.units import round_exact
from mooring.operators.candidates import event_keys
from mooring.operators.labelling import label_dataset
from mooring.operators.validation import PENALTIES, UTILISATION
from mooring.session import ship_package
from mooring.streaming.jobs import _drain

#: Measured columns: name, value, whether feasible rows only.
MEASURES = ([("score", F.col, "teacher_score", True)]
            + [(name, F.col, name, True) for name in PENALTIES]
            + [("request_cpu", F.col, "requested_cpu", False),
               ("request_memory", F.col, "requested_memory", False)]
            + [(name, lambda c: F.col(c) * 100, column, only) for name, column, only in UTILISATION])
COUNTS = ("rows", "feasible", "selected", "winner_gap_nonzero", "winner_rank_not_one",
          "feasible_rank_null", "events", "cluster_sizes")


#: What a task leaves: figures of a measured column or a count have no value, those of a bucket only n.
PART = ("kind string, value double, n long, mean double, squares double, lowest double, highest double, "
        "zeros long")
MOMENT = ("n", "mean", "squares", "lowest", "highest", "zeros")


def _seen(rows: DataFrame) -> tuple[DataFrame, list, list, list]:
    """What the report looks at in a row, as columns; their names: measured, bucket kinds, counted."""
    keys, feasible, chosen = event_keys(rows), F.col("feasible"), F.col("selected_by_scheduler") == 1
    # Every event has one chosen row; nothing is sorted for this window.
    size = F.min("cluster_size").over(Window.partitionBy(*keys))
    measured = {name: F.when(feasible | F.lit(not only), use(column).cast("double"))
                for name, use, column, only in MEASURES}
    buckets = {"score_bin": F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("teacher_score") / 10))),
               "rank": F.col("teacher_rank")}
    for name in PENALTIES:
        buckets |= {f"{name}_thousandth": round_exact(F.col(name), 3),
                    f"{name}_tenth": round_exact(F.col(name), 1)}
    buckets = {kind: F.when(feasible, value).cast("double") for kind, value in buckets.items()}
    buckets["cluster"] = F.col("cluster_id").cast("double")
    gap, rank = F.col("score_gap_from_best"), F.col("teacher_rank")
    counted = dict(zip(COUNTS, (
        F.lit(True), feasible, chosen, chosen & (gap != 0), chosen & ~rank.eqNullSafe(F.lit(1)),
        feasible & rank.isNull(), chosen)))
    counted = {name: F.when(when, 1).otherwise(0) for name, when in counted.items()}
    counted["cluster_sizes"] = F.when(chosen, F.col("_size")).otherwise(0)
    columns = [c.alias(f"{group}_{name}") for group, named in (
        ("m", measured), ("b", buckets), ("c", counted)) for name, c in named.items()]
    seen = rows.withColumn("_size", size).select(*columns)
    return seen.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in seen.columns if c[0] == "c"}), [
        *measured], [*buckets], [*counted]


def _add(held, v: np.ndarray):
    """(n, mean, squares, lowest, highest, zeros) with more values, by Chan's rule."""
    n, mean = len(v), v.mean()
    squares, lowest, highest = ((v - mean) ** 2).sum(), np.fmin.reduce(v), v.max()
    zeros = int((np.abs(v) < 1e-12).sum())
    if held is None:
        return n, mean, squares, lowest, highest, zeros
    all_n, apart = held[0] + n, mean - held[1]
    return (all_n, held[1] + apart * n / all_n, held[2] + squares + apart * apart * held[0] * n / all_n,
            np.fmin(held[3], lowest), np.maximum(held[4], highest), held[5] + zeros)


def _tally(measured, kinds, counted):
    """Per task the figures of its rows, by one pass: as many rows as columns and distinct rounded values."""
    def run(batches):
        moments, buckets = dict.fromkeys(measured), {kind: Counter() for kind in kinds}
        counts = dict.fromkeys(counted, 0)
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            for name in measured:
                v = columns[f"m_{name}"].drop_null().to_numpy(zero_copy_only=False)
                if len(v):
                    moments[name] = _add(moments[name], v)
            for kind in kinds:
                v = columns[f"b_{kind}"].drop_null().to_numpy(zero_copy_only=False)
                for value, n in zip(*(part.tolist() for part in np.unique(v, return_counts=True))):
                    buckets[kind][value] += n
            for name in counted:
                counts[name] += int(columns[f"c_{name}"].to_numpy(zero_copy_only=False).sum())
        rows = [(name, None, *held) for name, held in moments.items() if held is not None]
        rows += [(name, None, n, None, None, None, None, 0) for name, n in counts.items()]
        rows += [(kind, value, n, None, None, None, None, 0)
                 for kind, held in buckets.items() for value, n in held.items()]
        names = [c.split()[0] for c in PART.split(", ")]
        types = [pa.string(), pa.float64(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
        for i in range(0, len(rows), 8192):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, kind) for part, kind in zip(zip(*rows[i:i + 8192]), types)], names=names)
    return run


def parts(rows: DataFrame) -> DataFrame:
    """What each task leaves of its labelled rows: they are looked at once and kept nowhere."""
    ship_package(rows.sparkSession)
    seen, *names = _seen(rows)
    return seen.mapInArrow(_tally(*names), PART)


def _moments(left: DataFrame) -> DataFrame:
    """name and figures of every measured column and count, merged over tasks; 0 rows where none had any."""
    none = left.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m[0]) for m in MEASURES], *[
        F.lit(c) for c in COUNTS])).alias("name"), F.lit(0).cast("long").alias("n"), *[
        F.lit(None).cast("double").alias(c) for c in MOMENT[1:5]], F.lit(0).cast("long").alias("zeros"))
    return _merge(left.where("value IS NULL").select(
        F.col("kind").alias("name"), *MOMENT).unionByName(none))


def _buckets(left: DataFrame) -> DataFrame:
    """kind, value, n: counts of score bins, ranks and rounded penalties, and the clusters met."""
    return left.where("value IS NOT NULL").groupBy("kind", "value").agg(F.sum("n").alias("n"))


def validate(pods: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """Validates the labelled rows of a stream of arrivals; the report of all batches so far.

    Each run over the same path goes on where the last one ended.
    """
    spark = pods.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        left_at = f"{path}/parts/batch={batch_id}"
        parts(label_dataset(batch, nodes)).write.mode("overwrite").parquet(left_at)
        left = spark.read.schema(PART).parquet(left_at)
        _moments(left).coalesce(1).write.mode("overwrite").parquet(f"{path}/moments/batch={batch_id}")
        _buckets(left).write.mode("overwrite").parquet(f"{path}/buckets/batch={batch_id}")

    _drain(pods.writeStream.foreachBatch(write), spark, path)
    return report(spark, path)


def _merge(parts: DataFrame) -> DataFrame:
    """The figures of each name over all parts, by Chan's rule."""
    overall = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy("name")) / F.sum(
        F.when(F.col("mean").isNotNull(), F.col("n"))).over(Window.partitionBy("name"))
    apart = F.col("mean") - F.col("_mean")
    return parts.withColumn("_mean", overall).groupBy("name").agg(
        F.sum("n").alias("n"), F.max("_mean").alias("mean"),
        F.sum(F.col("squares") + F.col("n") * apart * apart).alias("squares"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.sum("zeros").alias("zeros"))


def merged(spark: SparkSession, path: str):
    """(moments, buckets) over all batches."""
    moments = _merge(spark.read.parquet(f"{path}/moments/batch=*"))
    buckets = spark.read.parquet(f"{path}/buckets/batch=*").groupBy("kind", "value").agg(
        F.sum("n").alias("n"))
    return moments, buckets


def report(spark: SparkSession, path: str, ranks=10, tenths=12) -> DataFrame:
    """section, item, value: all figures; checks are 1 where they pass, else 0.

    Of ranks and of rounded penalties the lowest few are listed, as in the batch reports.
    """
    moments, buckets = merged(spark, path)
    wide = moments.groupBy().pivot("name", [m[0] for m in MEASURES] + list(COUNTS)).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"),
        F.first("squares").alias("squares"), F.first("lowest").alias("lowest"),
        F.first("highest").alias("highest"), F.first("zeros").alias("zeros"))

    def figure(name, what="n"):
        return F.col(f"{name}_{what}")

    def spread(name):
        return {"min": figure(name, "lowest"), "mean": figure(name, "mean"),
                "max": figure(name, "highest"), "std": F.sqrt(F.greatest(
                    F.lit(0.0), F.try_divide(figure(name, "squares"), figure(name))))}

    rows, feasible, events = figure("rows"), figure("feasible"), figure("events")
    sections = {
        "overview": {
            "total_rows": rows, "events": events, "pods": events, "feasible_rows": feasible,
            "infeasible_rows": rows - feasible,
            "feasible_pct": F.try_divide(100.0 * feasible, rows),
            "infeasible_pct": F.try_divide(100.0 * (rows - feasible), rows),
            "avg_cluster_size": F.try_divide(figure("cluster_sizes"), events),
            "avg_feasible_nodes": F.try_divide(feasible, events)},
        "score": spread("score"),
        "request": {
            **{f"{k}_cpu": v for k, v in spread("request_cpu").items() if k != "std"},
            **{f"{k}_mem_gb": v / GIB for k, v in spread("request_memory").items() if k != "std"}},
        "integrity": {
            "selected_rows": figure("selected"), "gap_zero": figure("winner_gap_nonzero") == 0,
            "winner_rank_one": figure("winner_rank_not_one") == 0,
            "no_null_rank": figure("feasible_rank_null") == 0},
    }
    for name in PENALTIES:
        sections[name] = {**spread(name), "zero_pct": F.try_divide(
            100.0 * figure(name, "zeros"), figure(name))}
    for name, _, _ in UTILISATION:
        sections[name] = {**spread(name), "within_limit": figure(name, "highest") <= 100.0}
    cells = [F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"),
                      value.cast("double").alias("value"))
             for section, items in sections.items() for item, value in items.items()]
    single = wide.select(F.inline(F.array(*cells)))

    def counted(kind, section, item):
        return buckets.where(F.col("kind") == kind).agg(F.count(F.lit(1)).cast("double").alias(
            "value")).select(F.lit(section).alias("section"), F.lit(item).alias("item"), "value")

    place = F.row_number().over(Window.partitionBy("kind").orderBy("value"))
    listed = buckets.where(F.col("kind").rlike("score_bin|rank|_tenth")).withColumn("_place", place)
    kept = listed.where(F.when(F.col("kind") == "rank", F.col("_place") <= ranks).when(
        F.col("kind") == "score_bin", True).otherwise(F.col("_place") <= tenths))
    lists = kept.select(
        F.col("kind").alias("section"),
        F.when(F.col("kind").endswith("_tenth"), F.format_string("%.1f", "value")).otherwise(
            F.col("value").cast("long").cast("string")).alias("item"),
        F.col("n").cast("double").alias("value"))
    further = buckets.where(F.col("kind") == "rank").agg(F.greatest(
        F.count(F.lit(1)) - ranks, F.lit(0)).cast("double").alias("value")).select(
        F.lit("rank").alias("section"), F.lit("further").alias("item"), "value")
    out = single.unionByName(lists).unionByName(further).unionByName(
        counted("cluster", "overview", "clusters"))
    for name in PENALTIES:
        out = out.unionByName(counted(f"{name}_thousandth", name, "unique_values"))
    return out
