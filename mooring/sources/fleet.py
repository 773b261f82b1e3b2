"""Nodes, pods, requests and telemetry as views of the given star-schema tables.

supplier -> node, a block of 40 suppliers -> cluster; lineitem -> running pod
and scoring request; orders -> arriving pod; events -> telemetry and request
log. Clusters keep a bounded size while their number grows with the tables, so
candidate pairs grow linearly with the orders.
"""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mooring.constants import BASE_PROFILES, EXTENDED_PROFILES, GIB
from mooring.functions.units import allocatable_cpu, allocatable_memory, quantize_cpu
from mooring.operators.predicates import SCHEDULER_NAME
from mooring.scale import attach, is_bounded

NODES_PER_CLUSTER = 40
CUSTOMERS_PER_CLUSTER = 600
FIRST_RUNNING_DAY = "2001-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _source(spark, sf_dir, name, source):
    """The given frame (a stream of the same table), else the stored table."""
    return table(spark, sf_dir, name) if source is None else source


def _profile_rows(spark, rows, first_id):
    values = ", ".join(
        f"({first_id + i}L, '{name}', {cpu}L, {gib * GIB}L)"
        for i, (name, cpu, gib) in enumerate(rows))
    return spark.sql(
        "SELECT * FROM VALUES " + values
        + " AS t(profile_id, profile_name, node_cpu_capacity, node_memory_capacity)")


def profiles(spark: SparkSession) -> DataFrame:
    """Base and extended hardware profiles in one list."""
    return _profile_rows(spark, BASE_PROFILES, 0).unionByName(
        _profile_rows(spark, EXTENDED_PROFILES, len(BASE_PROFILES)))


def block(key, size) -> Column:
    return F.floor(F.col(key) / size).cast("long")


def running_pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per running or finished pod, two containers each."""
    cpu = F.floor(F.col("l_quantity") * 4).cast("long")
    memory = F.floor(F.col("l_extendedprice") * 2048).cast("long")
    main_cpu = F.floor(cpu * 0.8).cast("long")
    main_memory = F.floor(memory * 0.8).cast("long")
    phase = (F.when(F.col("l_returnflag") == "R", "Failed")
             .when(F.col("l_shipdate") < F.lit(FIRST_RUNNING_DAY).cast("timestamp_ntz"),
                   "Succeeded").otherwise("Running"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pod_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("node_id"),
        phase.alias("phase"),
        cpu.alias("requested_cpu"),
        memory.alias("requested_memory"),
        F.array(
            F.struct(main_cpu.alias("cpu"), main_memory.alias("memory")),
            F.struct((cpu - main_cpu).alias("cpu"), (memory - main_memory).alias("memory")),
        ).alias("containers"),
    )


def active_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested cpu, memory and pod count of the live pods per node.

    The phase is tested on the raw columns, which the Parquet scan can skip by.
    """
    live = table(spark, sf_dir, "lineitem").where(
        (F.col("l_returnflag") != "R")
        & (F.col("l_shipdate") >= F.lit(FIRST_RUNNING_DAY).cast("timestamp_ntz")))
    return live.groupBy(F.col("l_suppkey").alias("node_id")).agg(
        F.sum(F.floor(F.col("l_quantity") * 4)).cast("long").alias("current_cpu_usage"),
        F.sum(F.floor(F.col("l_extendedprice") * 2048)).cast("long")
        .alias("current_memory_usage"),
        F.count(F.lit(1)).alias("current_pod_count"),
    )


def bare_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with capacity, labels, taints and conditions but no usage yet."""
    key = F.col("s_suppkey")
    label = [F.lit("hostname"), F.col("s_name"), F.lit("zone"),
             F.concat(F.lit("z"), (key % 3).cast("string")),
             F.lit("gen"), (key % 7).cast("string")]

    def taint(name, value, effect):
        return F.struct(F.lit(name).alias("key"), F.lit(value).alias("value"),
                        F.lit(effect).alias("effect"))

    dedicated = taint("dedicated", "batch", "NoSchedule")
    maintenance = taint("maintenance", "", "NoExecute")
    spot = taint("spot", "true", "PreferNoSchedule")
    none = F.array(dedicated)
    ready = F.when((F.col("s_acctbal") >= 0) & (F.col("s_acctbal") < 4000), "False").otherwise(
        "True")

    def condition(kind, status):
        return F.struct(F.lit(kind).alias("type"), status.alias("status"))

    return table(spark, sf_dir, "supplier").select(
        key.alias("node_id"),
        block("s_suppkey", NODES_PER_CLUSTER).alias("cluster_id"),
        F.col("s_name").alias("node_name"),
        (key % (len(BASE_PROFILES) + len(EXTENDED_PROFILES))).alias("profile_id"),
        (F.col("s_acctbal") < 0).alias("unschedulable"),
        F.when(key % 2 == 0, F.create_map(*label, F.lit("ssd"), F.lit("true")))
        .otherwise(F.create_map(*label)).alias("labels"),
        F.when(key % 10 == 0, F.array(dedicated, maintenance))
        .when(key % 5 == 0, F.array(dedicated))
        .when(key % 5 == 1, F.array(spot))
        # What has no taints may have an empty list or none at all.
        .when(key % 5 == 2, F.filter(none, lambda t: F.lit(False))).alias("taints"),
        F.array(condition("MemoryPressure", F.lit("False")),
                condition("Ready", ready)).alias("conditions"),
    )


def with_capacity(nodes: DataFrame) -> DataFrame:
    """Joins the hardware profile and derives the allocatable share."""
    return nodes.join(F.broadcast(profiles(nodes.sparkSession)), "profile_id").withColumns({
        "node_allocatable_cpu": allocatable_cpu(F.col("node_cpu_capacity")),
        "node_allocatable_memory": allocatable_memory(F.col("node_memory_capacity")),
    })


def with_usage(nodes: DataFrame, usage: DataFrame) -> DataFrame:
    """Left-joins usage per node; a node without pods uses nothing."""
    joined = nodes.join(usage, "node_id", "left")
    return joined.withColumns({
        c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        for c in ("current_cpu_usage", "current_memory_usage", "current_pod_count")})


def with_cluster_size(nodes: DataFrame) -> DataFrame:
    """Nodes per cluster by partial aggregation, joined back on the cluster.

    A left join on unique keys, so Spark drops it where the size is not read.
    """
    sizes = nodes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return nodes.join(sizes, "cluster_id", "left")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node states: capacity, usage of live pods, cluster size, constraints."""
    full = with_capacity(with_cluster_size(bare_nodes(spark, sf_dir)))
    return with_usage(full, active_usage(spark, sf_dir))


def _main_share(total: Column) -> Column:
    return F.floor(total * 0.8).cast("long")


def pods(spark: SparkSession, sf_dir: str, source: DataFrame = None) -> DataFrame:
    """Arriving pods, one scheduling event each."""
    key = F.col("o_orderkey")
    priority = F.col("o_orderpriority")
    cpu = quantize_cpu(F.col("o_totalprice") / 40)
    memory = ((key * 17) % 32 + 1) * 67_108_864

    def toleration(name, operator, value, effect):
        """Empty fields are left out by every other pod, as API data has it."""
        def field(text):
            return F.lit(text) if text else F.when(key % 2 == 0, "")

        return F.struct(field(name).alias("key"), F.lit(operator).alias("operator"),
                        field(value).alias("value"), field(effect).alias("effect"))

    def requirement(name, operator, *values):
        listed = F.array(*[F.lit(v) for v in values]) if values else F.filter(
            F.array(F.lit("")), lambda v: F.lit(False))
        return F.struct(F.lit(name).alias("key"), F.lit(operator).alias("operator"),
                        listed.alias("values"))

    wildcard = F.array(toleration("", "Exists", "", ""))
    kind = key % 6
    no_terms = F.array(F.array(requirement("zone", "In", "z0")))
    container = F.struct(cpu.alias("cpu"), memory.alias("memory"))
    init = F.struct(F.lit(100).cast("long").alias("cpu"),
                    F.lit(67_108_864).cast("long").alias("memory"))

    def volume(name, claim):
        return F.struct(name.alias("name"), claim.alias("claim"))

    plain = volume(F.lit("scratch"), F.lit(None).cast("string"))
    own = volume(F.concat(F.lit("v"), key.cast("string")),
                 F.concat(F.lit("c"), key.cast("string")))
    unnamed = volume(F.concat(F.lit("u"), key.cast("string")), F.lit(""))
    return _source(spark, sf_dir, "orders", source).select(
        key.alias("event_id"),
        key.alias("pod_id"),
        block("o_custkey", CUSTOMERS_PER_CLUSTER).alias("cluster_id"),
        F.col("o_orderdate").alias("arrival_ts"),
        priority.alias("scenario"),
        cpu.alias("requested_cpu"),
        memory.alias("requested_memory"),
        F.when(priority == "5-LOW", "default-scheduler").otherwise(SCHEDULER_NAME)
        .alias("scheduler_name"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("node-"), (key % 97).cast("string")))
        .alias("bound_node"),
        F.when(F.col("o_orderstatus") == "F", "Succeeded").otherwise("Pending").alias("phase"),
        F.when(priority == "1-URGENT", wildcard)
        .when(priority == "2-HIGH",
              F.array(toleration("dedicated", "Equal", "batch", "NoSchedule")))
        .when(priority == "3-MEDIUM", F.array(toleration("dedicated", "Exists", "", "")))
        .when(key % 2 == 0, F.filter(wildcard, lambda t: F.lit(False))).alias("tolerations"),
        F.when(kind == 1, F.array(F.array(requirement("zone", "In", "z0", "z1"))))
        .when(kind == 2, F.array(F.array(requirement("zone", "NotIn", "z2"))))
        .when(kind == 3, F.array(F.array(requirement("ssd", "Exists"))))
        .when(kind == 4, F.array(F.array(requirement("ssd", "DoesNotExist"))))
        .when(kind == 5, F.array(F.array(requirement("gen", "Gt", "3")),
                                 F.array(requirement("gen", "Lt", "1"))))
        .otherwise(F.filter(no_terms, lambda t: F.lit(False))).alias("affinity_terms"),
        F.array(
            F.struct(_main_share(cpu).alias("cpu"), _main_share(memory).alias("memory")),
            F.struct((cpu - _main_share(cpu)).alias("cpu"),
                     (memory - _main_share(memory)).alias("memory")),
        ).alias("containers"),
        F.when(key % 4 == 0, F.array(init))
        .otherwise(F.filter(F.array(container), lambda c: F.lit(False)))
        .alias("init_containers"),
        F.when(F.col("o_totalprice") >= 480_000, F.array(plain, own, unnamed))
        .when(F.col("o_totalprice") >= 450_000, F.array(own))
        .otherwise(F.array(plain)).alias("volumes"),
    )


def score_requests(spark: SparkSession, sf_dir: str, node_states: DataFrame = None,
                   how="inner") -> DataFrame:
    """One scoring request per line item, joined to the state of its node."""
    asked = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"),
        F.col("l_orderkey").alias("pod_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_suppkey").alias("node_id"),
        F.floor(F.col("l_quantity") * 40).cast("long").alias("requested_cpu"),
        F.floor(F.col("l_extendedprice") * 20480).cast("long").alias("requested_memory"),
    )
    states = nodes(spark, sf_dir) if node_states is None else node_states
    # States have a row per supplier, so the file of suppliers bounds them.
    return attach(asked, states, "node_id", how, spread_by=["pod_id", "line"],
                  bounded=is_bounded(table(spark, sf_dir, "supplier")))


def telemetry(spark: SparkSession, sf_dir: str, source: DataFrame = None) -> DataFrame:
    """Usage samples of nodes, one poll per day."""
    return _source(spark, sf_dir, "events", source).select(
        F.col("event_id").alias("sample_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("poll_ts"),
        F.col("user_id").alias("node_id"),
        F.col("value").alias("cpu_sample"),
        ((F.col("event_id") * 13) % 100).cast("double").alias("mem_sample"),
    )


def request_log(spark: SparkSession, sf_dir: str, source: DataFrame = None) -> DataFrame:
    """Answered requests with latency; an error event is a failed request."""
    return _source(spark, sf_dir, "events", source).select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("node_id"),
        F.col("event_type").alias("kind"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("value").alias("latency_ms"),
    )


def quantity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity strings in all spellings, unreadable ones included."""
    n = F.col("o_orderkey").cast("string")

    def pick(*texts):
        out = F.when(F.lit(False), "")
        for i, text in enumerate(texts):
            out = out.when(F.col("o_orderkey") % len(texts) == i, text)
        return out

    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pod_id"),
        pick(F.concat(n, F.lit("m")), F.concat(n, F.lit("n")), n, F.lit("bad"),
             F.concat(n, F.lit(".5")), F.concat(n, F.lit("Ki")), F.lit("")).alias("cpu_text"),
        pick(F.concat(n, F.lit("Ki")), F.concat(n, F.lit("Mi")), F.concat(n, F.lit("Gi")),
             F.concat(n, F.lit("Ti")), n, F.concat(n, F.lit("K")), F.lit("bad"))
        .alias("memory_text"))


def stress_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load jobs aimed at nodes; errors are those still running."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("node_id"),
        F.when(kind != "error", F.col("ts")).alias("completed_ts"),
        F.when(F.col("value") >= 10, kind).alias("profile"))


def score_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of scoring answers; an error left a broken one, some have no score or a null one."""
    rest = F.lit('"reason": "ok", "source": "trees"}')
    which = F.col("event_id") % 13
    body = F.concat(
        F.when(which == 0, "{").when(which == 1, '{"score": null, ').otherwise(
            F.format_string('{"score": %d, ', F.col("event_id") % 101)), rest)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "upstream timed out").otherwise(body)
        .alias("body"))
