"""Candidate pairs, snapshots and the joins around them."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooring.constants import DEFAULT_SNAPSHOT
from mooring.functions.features import current_percents
from mooring.operators.predicates import is_active
from mooring.scale import attach, positions, source_bytes

EVENT = "event_id"
PAIR_KEY = "cluster_id"
SPREAD = "_spread"
#: Parts that the events of a cluster are dealt into; nodes are repeated as often.
SPREADS = 64
#: Pods of a part where a cluster has as many parts as its pods ask for.
PART_PODS = 8192
PARTS = "_parts"
#: Bytes of the pods' stored table for a task, some 15,000 pods: their pairs are sorted in its memory.
POD_BYTES = 256 << 10
MOST_TASKS = 1 << 14
#: Marks the row of a cluster that stands for no node.
NO_NODE = "_no_node"


def candidates(pods: DataFrame, nodes: DataFrame, dealt_by=(EVENT,), how="inner",
               parts: DataFrame = None) -> DataFrame:
    """Every (pod, node) pair of one cluster, one way at every size.

    Pods are dealt by cluster and a part of the events, nodes repeated for each part, and the two
    meet in a hash join. A cluster with a third of all pods is in as many tasks as there are parts,
    and nothing is broadcast or measured. All pairs of an event lie in one partition, which
    `event_keys` tells Spark: windows and groups over an event need no exchange of pairs. With
    dealt_by, columns that an event has one value of, so do all events with the same values. With parts,
    the stored rows of `cluster_parts`, a small cluster is not torn apart, and a large one has all it needs.
    """
    count, number = pair_tasks(pods), F.lit(SPREADS)
    if parts is not None:
        pods, nodes = (attach(side, parts, PAIR_KEY, "left") for side in (pods, nodes))
        number = F.coalesce(PARTS, F.lit(1))
    repeated = nodes.withColumn(SPREAD, F.explode(F.sequence(F.lit(0), number - 1)))
    dealt, met = (side.drop(PARTS).repartition(count, PAIR_KEY, SPREAD)
                  for side in (with_spread(pods, dealt_by, number), repeated))
    return dealt.join(met.hint("shuffle_hash"), [PAIR_KEY, SPREAD], how)


def pair_tasks(pods: DataFrame) -> int:
    """Tasks for the pairs: the session's number, and more where the pods' files ask for it.

    By the size of the narrow pods, Spark would leave few for their pairs; with a fixed number, what a
    task sorts grows with the tables until it spills.
    """
    session = int(pods.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, min(MOST_TASKS, -(-source_bytes(pods) // POD_BYTES)))


def with_spread(rows: DataFrame, dealt_by=(EVENT,), parts: Column = None) -> DataFrame:
    """Adds the part that a row's event is dealt to."""
    number = F.lit(SPREADS) if parts is None else parts
    return rows.withColumn(SPREAD, F.pmod(F.xxhash64(*dealt_by), number).cast("int"))


def cluster_parts(pods: DataFrame, part_pods=PART_PODS) -> DataFrame:
    """Per cluster how many parts its pods ask for, at least one."""
    return pods.groupBy(PAIR_KEY).agg(F.ceil(F.count(F.lit(1)) / part_pods).cast("int").alias(PARTS))


def with_no_node(nodes: DataFrame) -> DataFrame:
    """nodes and, per cluster, a row that stands for none: with it, no pod is lost by a filter of nodes."""
    none = nodes.select(PAIR_KEY).distinct().withColumn(NO_NODE, F.lit(True))
    return nodes.withColumn(NO_NODE, F.lit(False)).unionByName(none, allowMissingColumns=True)


def event_keys(pairs: DataFrame) -> list:
    """Columns by which the pairs of an event lie together: the event, and how its pods were dealt.

    The event comes first: sorts then tell rows apart by their first column.
    """
    dealt = [PAIR_KEY, SPREAD] if {PAIR_KEY, SPREAD} <= set(pairs.columns) else []
    return [EVENT, *dealt]


def usage_of(pods: DataFrame) -> DataFrame:
    """Per node sums of container requests and the count of live pods.

    Containers are summed inside the row, so the shuffle carries one partial
    row per node and task, also for a node that holds a third of the pods.
    """
    live = pods.where(is_active(F.col("phase")))

    def total(field):
        return F.aggregate("containers", F.lit(0).cast("long"), lambda acc, c: acc + c[field])

    return live.groupBy("node_id").agg(
        F.sum(total("cpu")).alias("current_cpu_usage"),
        F.sum(total("memory")).alias("current_memory_usage"),
        F.count(F.lit(1)).alias("current_pod_count"),
    )


def bound_pod_count(pods: DataFrame) -> DataFrame:
    """Pods per node whatever their phase."""
    return pods.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(
        F.count(F.lit(1)).alias("current_pod_count"))


def snapshot(nodes: DataFrame, usage: DataFrame | None, pod_counts: DataFrame) -> DataFrame:
    """Capacity with latest usage and pod count; missing parts, or no usage source, are zero."""
    joined = nodes.join(pod_counts, "node_id", "left")
    joined = joined.join(usage, "node_id", "left") if usage is not None else joined.withColumns(
        {c: F.lit(None).cast("double") for c in ("current_cpu_usage", "current_memory_usage")})
    filled = joined.withColumns({
        "current_cpu_usage": F.coalesce("current_cpu_usage", F.lit(0.0)),
        "current_memory_usage": F.coalesce("current_memory_usage", F.lit(0.0)),
        "current_pod_count": F.coalesce("current_pod_count", F.lit(0).cast("long")),
    })
    return filled.withColumns(current_percents("one"))


def latest_usage(samples: DataFrame) -> DataFrame:
    """Last sample of the newest poll per node."""
    newest = samples.select(F.max("poll_ts")).scalar()
    order = F.struct("ts", "sample_id")
    return samples.where(F.col("poll_ts") == newest).groupBy("node_id").agg(
        F.max_by("cpu_sample", order).alias("current_cpu_usage"),
        F.max_by("mem_sample", order).alias("current_memory_usage"),
    )


def rolling_mean(samples: DataFrame, columns: dict, rows: int = 12, node="node_id",
                 order=("ts", "sample_id"), block: int = 4096) -> DataFrame:
    """Adds the mean of each node's last `rows` samples; columns maps new names to values.

    Samples are numbered per node by a distributed sort and cut into blocks; the last rows of a block
    are repeated in the next one. A window holds one block, so a node with a third of all samples is
    spread over as many tasks as it has blocks. Samples without a node are a node of their own.
    """
    nodes = {"_node": F.coalesce(node, F.lit(0).cast(samples.schema[node].dataType)),
             "_no_node": F.col(node).isNull()}
    placed = positions(samples.withColumns(nodes), list(nodes), list(order))
    at = F.col("position") - 1
    own = F.floor(at / block).cast("long")
    carried = (at % block >= block - (rows - 1)) & (F.col("position") < F.col("group_rows"))
    blocks = F.when(carried, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    last = Window.partitionBy(*nodes, "_block").orderBy("position").rowsBetween(1 - rows, 0)
    means = spread.withColumns({name: F.avg(c).over(last) for name, c in columns.items()})
    return means.where(F.col("_own") == F.col("_block")).drop(
        "_own", "_block", "position", "group_rows", *nodes)


def with_default_snapshot(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Left-joins the node snapshot; an unknown node gets the default one."""
    joined = attach(rows, snapshots.withColumn("_known", F.lit(True)), "node_id", "left")
    return joined.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) for name, value in DEFAULT_SNAPSHOT.items()
    }).withColumn("known_node", F.coalesce("_known", F.lit(False))).drop("_known")


def schedulable(pods: DataFrame, feasible_pairs: DataFrame) -> DataFrame:
    """Pods with at least one feasible node."""
    return pods.join(feasible_pairs.select("event_id").distinct(), "event_id", "left_semi")


def unschedulable(pods: DataFrame, feasible_pairs: DataFrame) -> DataFrame:
    """Pods with no feasible node, also where the cluster has none at all."""
    return pods.join(feasible_pairs.select("event_id").distinct(), "event_id", "left_anti")


def stressed_nodes(status: DataFrame, jobs: DataFrame) -> DataFrame:
    """Flags nodes that an unfinished job targets."""
    targets = jobs.where(F.col("completed_ts").isNull()).select("node_id").distinct()
    return status.join(targets.withColumn("_hit", F.lit(True)), "node_id", "left").withColumn(
        "stressed", F.col("_hit").isNotNull()).drop("_hit")
