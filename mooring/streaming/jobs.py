"""Structured Streaming versions of the snapshot, placement and report jobs.

Every job takes a streaming frame and an output folder, runs what is available
and leaves a table. Its checkpoint is kept beside that folder: the next run over the same
folder goes on where the last one ended. Writers inside foreachBatch use one folder per
batch id, so a batch repeated after a failure replaces its own output.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mooring.operators import decisions, placement


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger=64) -> DataFrame:
    """One given table, a file or a folder of files, as a file stream with its stored schema."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_trigger).parquet(path)


def split_table(spark: SparkSession, sf_dir: str, name: str, order: str, path: str, files=8,
                newest_first=True) -> str:
    """A table as ranges of a column, one written after the other. Returns a folder.

    For trying a job: rows come in many micro-batches, and against their order in time or with it.
    One distributed write deals the rows out to a folder per range; each range is then appended from
    its own folder alone, by as many tasks as it has files.
    """
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    second = F.unix_micros(F.col(order).cast("timestamp"))
    cuts = table.select(second.cast("double").alias("s")).approxQuantile(
        "s", [i / files for i in range(1, files)], 0.01)
    part = sum((F.when(second > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    ranges = f"{path}/{name}-ranges"
    table.withColumn("_range", part).write.partitionBy("_range").parquet(ranges)
    dealt = spark.read.schema(f"{_ddl(table)}, _range INT").parquet(ranges)
    for i in range(files):
        wanted = files - 1 - i if newest_first else i
        dealt.where(F.col("_range") == wanted).drop("_range").write.mode("append").parquet(
            f"{path}/{name}.parquet")
    return path


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def folder_stream(spark: SparkSession, path: str, files_per_trigger=1) -> DataFrame:
    """A Parquet folder as a stream of micro-batches of files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_trigger).parquet(path)


def checkpoint_of(path: str) -> str:
    """Where the progress of the job that writes to path is kept."""
    return f"{path.rstrip('/')}.checkpoint"


def _drain(writer, spark: SparkSession, path: str) -> None:
    query = writer.option("checkpointLocation", checkpoint_of(path)).trigger(
        availableNow=True).start()
    query.awaitTermination()


_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, path: str, mode="append", rocksdb=False) -> DataFrame:
    """The stream as a table of files; with rocksdb its state is kept on disk, not in memory."""
    spark = stream.sparkSession
    before = spark.conf.get(_STORE_KEY)
    if rocksdb:
        spark.conf.set(_STORE_KEY, _ROCKSDB)
    try:
        _drain(stream.writeStream.format("parquet").outputMode(mode).option("path", path), spark, path)
    finally:
        spark.conf.set(_STORE_KEY, before)
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, path: str, transform, mode="append") -> DataFrame:
    """Applies transform to every micro-batch; returns all output with batch."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _drain(stream.writeStream.outputMode(mode).foreachBatch(write), spark, path)
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def snapshot(samples: DataFrame, path: str) -> DataFrame:
    """Nodes of the newest poll, each with its last sample.

    Each batch replaces the stored snapshot by that of the newest poll seen so far: a newer poll
    takes the place of all nodes, an older one, coming late, changes nothing. What is kept is one
    poll, whatever the number of batches.
    """
    spark = samples.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch
        if batch_id:
            kept = kept.unionByName(spark.read.schema(batch.schema).parquet(
                f"{path}/batch={batch_id - 1}"))
        newest = F.max_by(F.struct(*batch.columns), F.struct("ts", "sample_id")).alias("row")
        polls = kept.groupBy("poll_ts", "node_id").agg(newest).select("row.*")
        polls.where(F.col("poll_ts") == kept.select(F.max("poll_ts")).scalar()).write.mode(
            "overwrite").parquet(f"{path}/batch={batch_id}")

    _drain(samples.writeStream.foreachBatch(write), spark, path)
    stored = spark.read.schema(f"{_ddl(samples)}, batch LONG").option("basePath", path).parquet(
        f"{path}/batch=*")
    # Folders are pruned by the newest batch, which no query but the names of the folders tells.
    current = stored.where(F.col("batch") == last_batch(spark, path))
    return current.select("poll_ts", "node_id", F.col("cpu_sample").alias("current_cpu_usage"),
                          F.col("mem_sample").alias("current_memory_usage"))


def last_batch(spark: SparkSession, path: str) -> int:
    """The newest batch that has left a folder below path, by the folders' names; -1 if none has."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(n.split("=")[1]) for n in names if n.startswith("batch=")), default=-1)


def _once_per_key(stream: DataFrame, path: str, key: str) -> DataFrame:
    """Table of one row of every key, over any number of batches in any order.

    Spark keeps one entry per key in its state store on disk, without event time: no row is ever
    late, no batch reads what earlier ones have written, and a restart goes on with the same keys.
    """
    return run_to_table(stream.dropDuplicates([key]), path, rocksdb=True)


def pending(pods: DataFrame, path: str) -> DataFrame:
    """Newly admitted pods: opted in, unbound, live, each once."""
    admitted = placement.pending_pods(pods).select("pod_id", "cluster_id", "scenario")
    return _once_per_key(admitted, path, "pod_id")


def place(pods: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """Best node of every arriving pod against the current node states."""
    return run_batches(placement.pending_pods(pods), path,
                       lambda batch: placement.place(batch, nodes)).drop("batch")


def load_windows(log: DataFrame, path: str, width="5 seconds") -> DataFrame:
    """Counters per tumbling window, over all requests.

    Each batch leaves its own partial sums per window, and reading adds them up: a request may come
    in any batch, and a window is never closed.
    """
    failed = F.sum(F.when(F.col("failed"), 1).otherwise(0))
    parts = run_batches(log, path, lambda batch: batch.groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("sent"), failed.alias("failed"),
        F.sum("latency_ms").alias("latency"), F.count("latency_ms").alias("measured")))
    whole = parts.groupBy("w").agg(*[F.sum(c).alias(c) for c in (
        "sent", "failed", "latency", "measured")])
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return whole.select(
        F.col("w.start").alias("window_start"), "sent",
        (F.col("sent") - F.col("failed")).alias("success"), "failed",
        F.when(F.col("measured") > 0, F.col("latency") / F.col("measured")).otherwise(0.0)
        .alias("avg_latency_ms"), (F.col("sent") / seconds).alias("rps"))


def sliding_means(samples: DataFrame, path: str, width="60 seconds", slide="5 seconds") -> DataFrame:
    """Mean usage per node and sliding window, over all samples.

    As with `load_windows`, each batch leaves its own sums, so a sample may come in any batch and
    changes every window that holds it.
    """
    values = ("cpu_sample", "mem_sample")
    parts = run_batches(samples, path, lambda batch: batch.groupBy(
        "node_id", F.window("ts", width, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("samples"), *[F.sum(c).alias(c) for c in values],
        *[F.count(c).alias(f"{c}_n") for c in values]))
    whole = parts.groupBy("node_id", "w").agg(F.sum("samples").alias("samples"), *[
        F.sum(c).alias(c) for v in values for c in (v, f"{v}_n")])
    return whole.select(
        "node_id", F.col("w.start").alias("window_start"), "samples",
        *[F.try_divide(c, f"{c}_n").alias(c.replace("sample", "mean")) for c in values])


def counters(log: DataFrame, path: str) -> DataFrame:
    """Cumulative request counters after the newest batch."""
    totals = decisions.request_counters(log)
    stored = run_batches(totals, path, lambda batch: batch, mode="complete")
    return stored.where(F.col("batch") == stored.select(F.max("batch")).scalar()).drop("batch")


def new_pods(pods: DataFrame, path: str) -> DataFrame:
    """First sighting of every pod id."""
    return _once_per_key(pods.select("pod_id"), path, "pod_id")
