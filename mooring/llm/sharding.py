"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets by a seeded hash, uniformly, so that a bucket fits a
task's memory whatever the sources or copies in the data: the hash is over a row and its place in the
input, so that equal rows spread. Pass two puts each bucket in the order of the input, shuffles it as
an array (Spark's `shuffle` is a Fisher-Yates shuffle) and writes it: a seed gives one result, in a
repeated task too. The buckets one after the
other are one global random order; shard s of n takes its rows from s/n to (s+1)/n, so counts of
shards differ by one at most, and a shard's slots have no gaps.
"""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mooring.llm.catalog import register
from mooring.llm.common import stored, table
from mooring.session import scratch_path

SHARDS = 40
SEED = 20_240
#: Bytes of records in a bucket, on average; the array of a bucket is held by one task.
BUCKET_BYTES = 16 << 20


def record_size(text: str = "text"):
    """UTF-8 bytes of the text, none for null, plus 16."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long")


def _scattered(df: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(_row, _id, _bucket). The hash is over all columns and the row's place in its partition, so
    that neither a hot id or text nor equal rows matter."""
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                     F.monotonically_increasing_id().alias("_id"))
    key = F.xxhash64(F.lit(seed), "_id", *[F.col("_row")[c] for c in plain])
    return rows.withColumn("_bucket", F.pmod(key, F.lit(buckets)).cast("int"))


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text",
          bucket_bytes: int = BUCKET_BYTES) -> str:
    """Writes df into shard=0 .. shard=n-1 below a new folder and returns its path.

    Each written row is (row, slot) in the folder of its shard; row has all columns of df as they
    are, nulls and clashing names included. Repeated rows stay as many rows. An empty df gives
    an empty folder. The number of buckets follows the bytes of df, so memory per task doesn't.
    """
    spark = df.sparkSession
    total = df.select(F.sum(record_size(text))).first()[0] or 0
    buckets = max(shards, -(-total // bucket_bytes))
    scattered = _scattered(df, buckets, seed)
    # One row per bucket: a few bytes for each 16 MB of records.
    counts = stored(scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")), "buckets")
    in_order = Window.orderBy("_bucket")
    offsets = stored(counts.select(
        "_bucket", (F.sum("_rows").over(in_order) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias("_total")), "offsets")

    parts = min(buckets, 20_000)
    arrays = scattered.repartition(parts, "_bucket").groupBy("_bucket").agg(
        F.array_sort(F.collect_list(F.struct("_id", "_row")), lambda a, b: F.when(
            a["_id"] < b["_id"], -1).otherwise(1)).alias("_rows"))
    # In the order of buckets, as a task's random numbers go on from one bucket to the next.
    ordered = arrays.join(offsets, "_bucket").sortWithinPartitions("_bucket")
    shuffled = ordered.select(
        "_before", "_total", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_at", "_own"))
    place = F.col("_before") + F.col("_at")
    # The shard of place p is the last s with floor(s * total / n) <= p.
    number = F.expr(f"((_before + _at + 1) * {shards} - 1) div _total")
    start = F.expr(f"(shard * _total) div {shards}")
    path = scratch_path(spark, "shards")
    shuffled.withColumn("_place", place).withColumn("shard", number.cast("int")).select(
        F.col("_own._row").alias("row"), (F.col("_place") - start).alias("slot"), "shard").write.partitionBy(
        "shard").parquet(path)
    return path


def read_shards(spark, path: str, row_type) -> DataFrame:
    """The written rows with their shard and slot."""
    from pyspark.sql.types import IntegerType, LongType, StructType
    schema = StructType().add("row", row_type).add("slot", LongType()).add("shard", IntegerType())
    return spark.read.schema(schema).parquet(path)


@register("op8_sharding")
def op8_sharding(spark, sf_dir):
    """Shard and slot of every document, read back from the written shards."""
    docs = table(spark, sf_dir, "documents")
    written = read_shards(spark, shard(docs), docs.schema)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return written.select(
        "row.doc_id", record_size("row.text").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard"))
