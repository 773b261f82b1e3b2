"""Placement of arriving pods on a snapshot of usage that another stream replaces.

One stream keeps the snapshot (`jobs.snapshot`: a folder per batch, the newest poll in each); this one
places every batch of arrivals on the version that is the newest when the batch begins. The version is
written down before anything else, so a batch that is repeated after a failure is placed on the same
one, and its picks and events replace what it had left: each event is there exactly once.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mooring.operators import decisions, placement
from mooring.streaming.jobs import _drain, last_batch

USAGE = ("current_cpu_usage", "current_memory_usage")


def states_on(spark: SparkSession, nodes: DataFrame, snapshot_path: str, version: int) -> DataFrame:
    """nodes with the usage of a snapshot version; no usage where it has none, or before the first."""
    bare = nodes.drop(*USAGE)
    if version < 0:
        return bare.withColumns({c: F.lit(0.0) for c in USAGE})
    samples = spark.read.parquet(f"{snapshot_path}/batch={version}")
    usage = samples.select("node_id", F.col("cpu_sample").alias(USAGE[0]),
                           F.col("mem_sample").alias(USAGE[1]))
    return bare.join(usage, "node_id", "left").withColumns({
        c: F.coalesce(c, F.lit(0.0)) for c in USAGE})


def _version(spark: SparkSession, path: str, batch_id: int, snapshot_path: str) -> int:
    """The snapshot version of a batch: the one it began with, also when it is repeated."""
    if last_batch(spark, f"{path}/versions") < batch_id:
        newest = last_batch(spark, snapshot_path)
        spark.createDataFrame([(newest,)], "version int").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/versions/batch={batch_id}")
    return spark.read.parquet(f"{path}/versions/batch={batch_id}").first().version


def place_live(pods: DataFrame, nodes: DataFrame, snapshot_path: str, path: str):
    """(picks, events) of all batches so far; picks carry the snapshot version they were made on."""
    spark = pods.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        version = _version(spark, path, batch_id, snapshot_path)
        states = states_on(spark, nodes, snapshot_path, version)
        placement.place(batch, states).withColumn("version", F.lit(version)).write.mode(
            "overwrite").parquet(f"{path}/placed/batch={batch_id}")
        picks = spark.read.parquet(f"{path}/placed/batch={batch_id}").drop("version")
        decisions.placement_events(batch, placement.ready_nodes(states), picks).write.mode(
            "overwrite").parquet(f"{path}/events/batch={batch_id}")

    _drain(placement.pending_pods(pods).writeStream.foreachBatch(write), spark, path)
    return tuple(spark.read.option("basePath", f"{path}/{kind}").parquet(
        f"{path}/{kind}/batch=*") for kind in ("placed", "events"))
