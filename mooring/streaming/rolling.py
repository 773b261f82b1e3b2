"""Means of each node's last samples on a stream whose samples come in any order.

A late sample changes its own mean and those of the samples right after it, however long ago. Spark's
state store keeps the samples of one node and one span of time under one key, so a node with a third of
all samples is spread over as many keys as it has spans, and a batch opens only the spans it has samples
of. A span's rows are written again where their figures change, each with the version of the span.
The first samples of a span lack what lies in spans before it: they are completed at reading from the
last rows of those spans alone.
"""
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mooring.operators import candidates
from mooring.session import ship_package
from mooring.streaming.jobs import run_to_table

STATE = "version long, us array<long>, ids array<long>, cpu array<double>, mem array<double>"
#: Stands for a null time, which comes before all others.
NO_TIME = -(1 << 63)
VALUES = ("cpu", "mem")


def _mean(values):
    held = [v for v in values if v is not None]
    return sum(held) / len(held) if held else None


def figures(samples: dict, rows: int) -> dict:
    """(cpu, mem, their means, whole, last) of every sample of a span, keyed by time and id.

    The mean is over the span's own samples; it is whole if there are `rows` of them. The last
    samples are those that a window of a later span may reach.
    """
    order = sorted(samples)
    out = {}
    for i, key in enumerate(order):
        window = [samples[k] for k in order[max(0, i - rows + 1):i + 1]]
        out[key] = (*samples[key], *[_mean([w[v] for w in window]) for v in range(2)],
                    len(window) == rows, i > len(order) - rows)
    return out


def _number(value):
    return None if value is None or value != value else float(value)


def _span_job(rows: int):
    def add_samples(key, frames, state: GroupState):
        """Puts a span's new samples in by time; gives the rows whose figures are new or changed."""
        version, before = 0, {}
        if state.exists:
            version, us, ids, cpu, mem = state.get
            before = {(int(t), int(i)): (_number(c), _number(m))
                      for t, i, c, m in zip(us, ids, cpu, mem)}
        after = dict(before)
        for frame in frames:
            for r in frame.itertuples(index=False):
                after[int(r.us), int(r.sample_id)] = (_number(r.cpu), _number(r.mem))
        order = sorted(after)
        state.update((version + 1, [k[0] for k in order], [k[1] for k in order],
                      *[[after[k][v] for k in order] for v in range(2)]))
        old = figures(before, rows)
        changed = [(*key, version + 1, *k, *row) for k, row in figures(after, rows).items()
                   if old.get(k) != row]
        if changed:
            yield pd.DataFrame(changed, columns=[
                "node_id", "span", "version", "us", "sample_id", "cpu", "mem", "cpu_mean", "mem_mean",
                "whole", "last"])

    return add_samples


def rolling_means(samples: DataFrame, path: str, rows: int = 12, span: str = "1 hour") -> DataFrame:
    """Mean usage over the last `rows` samples of its node at every sample seen so far.

    The result is that of `candidates.rolling_mean` over all samples, whatever the order and the
    batches they came in, and goes on after a restart. Samples are ordered by time, then id. A sample
    that comes again with its time and id is the same sample, and its newest values count. Values that
    are null or NaN count for nothing; a window without a value has a null mean. Samples without a
    time come before all others; without a node they are a node of their own. No samples give no rows.
    """
    ship_package(samples.sparkSession)
    width = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00' + interval {span}) - "
                   "unix_micros(timestamp'1970-01-01 00:00:00')")
    us = F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME))
    keyed = samples.select("node_id", F.floor(us / width).cast("long").alias("span"), us.alias("us"),
                           "sample_id", *[F.col(f"{v}_sample").cast("double").alias(v) for v in VALUES])
    node = samples.schema["node_id"].dataType
    out = T.StructType([T.StructField("node_id", node)] + [
        T.StructField(c, T.LongType()) for c in ("span", "version", "us", "sample_id")] + [
        T.StructField(c, T.DoubleType()) for c in (*VALUES, "cpu_mean", "mem_mean")] + [
        T.StructField(c, T.BooleanType()) for c in ("whole", "last")])
    changes = keyed.groupBy("node_id", "span").applyInPandasWithState(
        _span_job(rows), out, STATE, "append", GroupStateTimeout.NoTimeout)
    return read_means(run_to_table(changes, path, rocksdb=True), rows)


def read_means(changes: DataFrame, rows: int = 12) -> DataFrame:
    """Means of every sample from the rows that the spans have written."""
    rest = ("cpu", "mem", "cpu_mean", "mem_mean", "whole", "last")
    newest = changes.groupBy("node_id", "span", "us", "sample_id").agg(
        F.max_by(F.struct(*rest), "version").alias("row")).select(
        "node_id", "us", "sample_id", "row.*")
    edges = newest.where(~F.col("whole") | F.col("last")).drop("cpu_mean", "mem_mean")
    first = candidates.rolling_mean(
        edges, {f"{v}_mean": F.col(v) for v in VALUES}, rows, order=("us", "sample_id"))
    wanted = ("node_id", "us", "sample_id", "cpu_mean", "mem_mean")
    means = newest.where("whole").select(*wanted).unionByName(
        first.where(~F.col("whole")).select(*wanted))
    return means.select("sample_id", "node_id", F.when(
        F.col("us") != NO_TIME, F.timestamp_micros("us")).alias("ts"), "cpu_mean", "mem_mean")
