"""Queries over eligibility predicates, joins and set operations."""
from pyspark.sql import functions as F

from mooring.functions import scoring
from mooring.operators import candidates as cand
from mooring.operators import decisions, evaluation, placement, predicates
from mooring.operators.labelling import label_dataset
from mooring.operators.predicates import claim_names, has_claims
from mooring.plans.oracle_base import query
from mooring.plans.registry import register
from mooring.plans.scalars import status
from mooring.sources import fleet


def pairs(spark, sf):
    """All pod and node pairs, the requests of the pod summed three ways."""
    return cand.candidates(placement.pod_requests(fleet.pods(spark, sf)), fleet.nodes(spark, sf))


def waiting_pods(spark, sf):
    return placement.pending_pods(fleet.pods(spark, sf))


def count_if(condition, name):
    return F.sum(F.when(condition, 1).otherwise(0)).alias(name)


def count_sql(condition, name):
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


def sum_sql(value, name):
    return f"CAST(sum({value}) AS BIGINT) AS {name}"


@register("ready_nodes", query("SELECT node_id, node_name FROM ready", "ready"))
def ready_nodes(spark, sf):
    return placement.ready_nodes(fleet.nodes(spark, sf)).select("node_id", "node_name")


@register("pending_pods", query("SELECT event_id AS pod_id, cluster_id, scenario FROM pending",
                                "pending"))
def pending_pods(spark, sf):
    return waiting_pods(spark, sf).select("pod_id", "cluster_id", "scenario")


@register("active_pods", query("""
SELECT l_orderkey AS pod_id, CAST(l_linenumber AS BIGINT) AS line, l_suppkey AS node_id
FROM lineitem WHERE l_returnflag <> 'R' AND l_shipdate >= TIMESTAMP '2001-06-01'"""))
def active_pods(spark, sf):
    return fleet.running_pods(spark, sf).where(predicates.is_active(F.col("phase"))).select(
        "pod_id", F.col("line").cast("long").alias("line"), "node_id")


@register("toleration_match", query(f"""
SELECT node_id, taint_key, count(*) AS checked, {count_sql("ok", "matched")} FROM (
  SELECT p.event_id, n.node_id, t.taint_key,
         scenario = '1-URGENT' OR (taint_key = 'dedicated') AS ok
  FROM pod p JOIN node n USING (cluster_id)
  JOIN (VALUES ('dedicated'), ('maintenance'), ('spot')) t(taint_key)
    ON (taint_key = 'dedicated' AND node_id % 5 = 0) OR (taint_key = 'maintenance'
        AND node_id % 10 = 0) OR (taint_key = 'spot' AND node_id % 5 = 1)
  WHERE scenario IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) GROUP BY ALL""", "pod", "node"))
def toleration_match(spark, sf):
    each = pairs(spark, sf).select("node_id", "tolerations", F.explode("taints").alias("taint"))
    checked = each.select("node_id", "taint", F.explode("tolerations").alias("toleration"))
    ok = predicates.toleration_matches(F.col("toleration"), F.col("taint"))
    return checked.select("node_id", F.col("taint.key").alias("taint_key"), ok.alias("ok")
                          ).groupBy("node_id", "taint_key").agg(
        F.count(F.lit(1)).alias("checked"), count_if(F.col("ok"), "matched"))


@register("tolerates_taints", query(f"""
SELECT event_id, count(*) AS nodes, {count_sql("tolerated", "tolerated")},
       {sum_sql("CASE WHEN tolerated THEN node_id ELSE 0 END", "id_sum")}
FROM tolerance GROUP BY 1""", "tolerance"))
def tolerates_taints(spark, sf):
    ok = predicates.tolerates_taints(F.col("tolerations"), F.col("taints"))
    return pairs(spark, sf).select("event_id", "node_id", ok.alias("ok")).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("nodes"), count_if(F.col("ok"), "tolerated"),
        F.sum(F.when(F.col("ok"), F.col("node_id")).otherwise(0)).alias("id_sum"))


@register("selector_requirement", query(f"""
SELECT node_id, label, operator, count(*) AS checked, {count_sql("ok", "matched")} FROM (
  SELECT n.node_id, r.label, r.operator, CASE r.id
         WHEN 1 THEN node_id % 3 IN (0, 1) WHEN 2 THEN node_id % 3 <> 2
         WHEN 3 THEN node_id % 2 = 0 WHEN 4 THEN node_id % 2 = 1
         WHEN 5 THEN node_id % 7 > 3 ELSE node_id % 7 < 1 END AS ok
  FROM pod p JOIN node n USING (cluster_id)
  JOIN (VALUES (1, 1, 'zone', 'In'), (2, 2, 'zone', 'NotIn'), (3, 3, 'ssd', 'Exists'),
               (4, 4, 'ssd', 'DoesNotExist'), (5, 5, 'gen', 'Gt'), (6, 5, 'gen', 'Lt'))
       r(id, kind, label, operator) ON event_id % 6 = r.kind) GROUP BY ALL""", "pod", "node"))
def selector_requirement(spark, sf):
    terms = pairs(spark, sf).select("node_id", "labels", F.explode("affinity_terms").alias("term"))
    each = terms.select("node_id", "labels", F.explode("term").alias("r"))
    return each.select(
        "node_id", F.col("r.key").alias("label"), F.col("r.operator").alias("operator"),
        predicates.selector_matches(F.col("r"), F.col("labels")).alias("ok")
    ).groupBy("node_id", "label", "operator").agg(
        F.count(F.lit(1)).alias("checked"), count_if(F.col("ok"), "matched"))


@register("node_affinity", query(f"""
SELECT event_id, {count_sql("affine", "affine")},
       {sum_sql("CASE WHEN affine THEN node_id ELSE 0 END", "id_sum")}
FROM tolerance GROUP BY 1""", "tolerance"))
def node_affinity(spark, sf):
    ok = predicates.matches_affinity(F.col("affinity_terms"), F.col("labels"))
    return pairs(spark, sf).select("event_id", "node_id", ok.alias("ok")).groupBy("event_id").agg(
        count_if(F.col("ok"), "affine"),
        F.sum(F.when(F.col("ok"), F.col("node_id")).otherwise(0)).alias("id_sum"))


@register("capacity_total", query(f"""
SELECT event_id, {count_sql("fits", "fitting")},
       {sum_sql("CASE WHEN fits THEN node_id ELSE 0 END", "id_sum")}
FROM tolerance GROUP BY 1""", "tolerance"))
def capacity_total(spark, sf):
    return pairs(spark, sf).groupBy("event_id").agg(
        count_if(predicates.fits_total(), "fitting"),
        F.sum(F.when(predicates.fits_total(), F.col("node_id")).otherwise(0)).alias("id_sum"))


@register("capacity_free", query("""
SELECT event_id, CASE WHEN feasible THEN '' WHEN used_cpu + req_cpu > alloc_cpu
       AND used_mem + req_mem > alloc_mem THEN 'both'
       WHEN used_cpu + req_cpu > alloc_cpu THEN 'cpu' ELSE 'memory' END AS reject_reason,
       count(*) AS nodes FROM pair_d GROUP BY ALL""", "pair_d"))
def capacity_free(spark, sf):
    return pairs(spark, sf).withColumns(predicates.fits_free()).groupBy(
        "event_id", "reject_reason").agg(F.count(F.lit(1)).alias("nodes"))


@register("filter_nodes", query("SELECT event_id, node_id FROM eligible", "eligible"))
def filter_nodes(spark, sf):
    return placement.eligible_pairs(waiting_pods(spark, sf), fleet.nodes(spark, sf)).select(
        "event_id", "node_id")


@register("reject_breakdown", query("""
SELECT p.cluster_id, CASE WHEN NOT tolerated THEN 'taint' WHEN NOT affine THEN 'affinity'
       WHEN NOT fits THEN 'capacity' ELSE '' END AS reason, count(*) AS pairs
FROM pending p JOIN ready n USING (cluster_id)
JOIN tolerance t ON t.event_id = p.event_id AND t.node_id = n.node_id GROUP BY ALL""",
                                    "pending", "ready", "tolerance"))
def reject_breakdown(spark, sf):
    every = cand.candidates(placement.pod_requests(waiting_pods(spark, sf)),
                            placement.ready_nodes(fleet.nodes(spark, sf)))
    return every.select("cluster_id", predicates.first_rejection().alias("reason")).groupBy(
        "cluster_id", "reason").agg(F.count(F.lit(1)).alias("pairs"))


@register("pvc_pods", query("""
SELECT event_id AS pod_id, 'c' || event_id || CASE WHEN price >= 480000 THEN ', u' || event_id
       ELSE '' END AS claims FROM pod WHERE price >= 450000""", "pod"))
def pvc_pods(spark, sf):
    return fleet.pods(spark, sf).where(has_claims(F.col("volumes"))).select(
        "pod_id", claim_names(F.col("volumes")).alias("claims"))


@register("active_jobs", query("""
SELECT event_id AS job_id, user_id AS node_id,
       CASE WHEN value >= 10 THEN event_type ELSE 'unknown' END AS profile
FROM events WHERE event_type = 'error'"""))
def active_jobs(spark, sf):
    return fleet.stress_jobs(spark, sf).where(F.col("completed_ts").isNull()).select(
        "job_id", "node_id", F.coalesce("profile", F.lit("unknown")).alias("profile"))


@register("label_select", query("""
SELECT o_orderkey AS pod_id, CASE WHEN o_orderstatus = 'P' THEN 'node-' || o_orderkey % 97
       ELSE 'pending' END AS node, o_orderstatus = 'P' AND o_totalprice >= 100000 AS ready
FROM orders WHERE o_orderpriority = '1-URGENT'"""))
def label_select(spark, sf):
    bound = F.col("o_orderstatus") == "P"
    orders = fleet.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pod_id"),
        F.create_map(F.lit("app"), F.col("o_orderpriority")).alias("labels"),
        F.when(bound, F.concat(F.lit("node-"), (F.col("o_orderkey") % 97).cast("string")))
        .alias("node"),
        F.array(F.struct(F.lit("init").alias("name"), F.lit(False).alias("ready")),
                F.struct(F.lit("main").alias("name"),
                         (bound & (F.col("o_totalprice") >= 100_000)).alias("ready")))
        .alias("containers"))
    return orders.where(F.col("labels")["app"] == "1-URGENT").select(
        "pod_id", F.coalesce("node", F.lit("pending")).alias("node"),
        F.exists("containers", lambda c: c["ready"]).alias("ready"))


def online_pairs(spark, sf):
    return placement.online_score(placement.eligible_pairs(
        waiting_pods(spark, sf), fleet.nodes(spark, sf)))


@register("preferred_set", query("""
SELECT event_id, node_id, CAST(final AS BIGINT) AS score FROM (
  SELECT *, bool_or(final >= 90) OVER (PARTITION BY event_id) AS any_pref FROM online)
WHERE final >= 90 OR NOT any_pref""", "online"))
def preferred_set(spark, sf):
    return predicates.preferred_only(online_pairs(spark, sf), threshold=90).select(
        "event_id", "node_id", "score")


@register("feasible_only", query("""
SELECT event_id, node_id, req_cpu AS requested_cpu, round_even(proj_cpu, 6) AS
       projected_cpu_percent, round_even(t_score, 6) AS teacher_score
FROM fit""", "fit"))
def feasible_only(spark, sf):
    kept = predicates.feasible_only(label_dataset(fleet.pods(spark, sf), fleet.nodes(spark, sf)), [
        "event_id", "node_id", "requested_cpu", "projected_cpu_percent", "teacher_score"])
    return kept.withColumns({c: F.bround(c, 6) for c in (
        "projected_cpu_percent", "teacher_score")})


# Joins.

@register("candidates", query(f"""
SELECT event_id, count(*) AS nodes, min(node_id) AS first_node, max(node_id) AS last_node,
       {sum_sql("node_id", "id_sum")}, {sum_sql("node_id * node_id", "square_sum")}
FROM pair GROUP BY 1""", "pair"))
def candidates(spark, sf):
    n = F.col("node_id")
    return cand.candidates(fleet.pods(spark, sf), fleet.nodes(spark, sf)).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.min(n).alias("first_node"),
        F.max(n).alias("last_node"), F.sum(n).alias("id_sum"), F.sum(n * n).alias("square_sum"))


LATEST_SQL = """
SELECT user_id AS node_id, arg_max(value, (ts, event_id)) AS cpu,
       CAST(arg_max(event_id * 13 % 100, (ts, event_id)) AS DOUBLE) AS mem
FROM events WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events)
GROUP BY 1"""


@register("src_usage", query(LATEST_SQL))
def src_usage(spark, sf):
    return cand.latest_usage(fleet.telemetry(spark, sf)).select(
        "node_id", F.col("current_cpu_usage").alias("cpu"),
        F.col("current_memory_usage").alias("mem"))


ROLLING_SQL = """
SELECT event_id AS sample_id, user_id AS node_id, round_even(avg(value) OVER w, 6) AS cpu_mean,
       round_even(avg(CAST(event_id * 13 % 100 AS DOUBLE)) OVER w, 6) AS mem_mean
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                         ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""


@register("rolling_mean", query(ROLLING_SQL))
def rolling_mean(spark, sf):
    means = cand.rolling_mean(fleet.telemetry(spark, sf), {
        "cpu_mean": F.col("cpu_sample"), "mem_mean": F.col("mem_sample")})
    return means.select("sample_id", "node_id", F.bround("cpu_mean", 6).alias("cpu_mean"),
                        F.bround("mem_mean", 6).alias("mem_mean"))


@register("usage_absent", query("""
SELECT n.node_id, 0e0 AS cpu, 0e0 AS mem, coalesce(p.n, 0) AS pods
FROM node n LEFT JOIN (SELECT l_suppkey AS node_id, count(*) AS n FROM lineitem GROUP BY 1) p
  USING (node_id)""", "node"))
def usage_absent(spark, sf):
    """The snapshot where no usage source answers: capacity and pods, usage zero."""
    capacity = fleet.with_capacity(fleet.with_cluster_size(fleet.bare_nodes(spark, sf)))
    taken = cand.snapshot(capacity, None, cand.bound_pod_count(fleet.running_pods(spark, sf)))
    return taken.select("node_id", F.col("current_cpu_usage").alias("cpu"),
                        F.col("current_memory_usage").alias("mem"),
                        F.col("current_pod_count").alias("pods"))


@register("snapshot_join", query(f"""
SELECT n.node_id, n.cluster_size, n.alloc_cpu, n.alloc_mem, coalesce(u.cpu, 0e0) AS cpu,
       coalesce(u.mem, 0e0) AS mem,
       round_even(coalesce(u.cpu, 0e0) / greatest(n.alloc_cpu, 1), 6) AS cpu_percent,
       round_even(coalesce(u.mem, 0e0) / greatest(n.alloc_mem, 1), 6) AS mem_percent,
       coalesce(p.n, 0) AS pods
FROM node n LEFT JOIN ({LATEST_SQL}) u USING (node_id)
LEFT JOIN (SELECT l_suppkey AS node_id, count(*) AS n FROM lineitem GROUP BY 1) p
  USING (node_id)""", "node"))
def snapshot_join(spark, sf):
    capacity = fleet.with_capacity(fleet.with_cluster_size(fleet.bare_nodes(spark, sf)))
    taken = cand.snapshot(capacity, cand.latest_usage(fleet.telemetry(spark, sf)),
                          cand.bound_pod_count(fleet.running_pods(spark, sf)))
    return taken.select(
        "node_id", "cluster_size", F.col("node_allocatable_cpu").alias("alloc_cpu"),
        F.col("node_allocatable_memory").alias("alloc_mem"),
        F.col("current_cpu_usage").alias("cpu"), F.col("current_memory_usage").alias("mem"),
        F.bround("current_cpu_percent", 6).alias("cpu_percent"),
        F.bround("current_memory_percent", 6).alias("mem_percent"),
        F.col("current_pod_count").alias("pods"))


@register("running_usage_join", query(
    "SELECT node_id, alloc_cpu, used_cpu, used_mem, pods FROM node", "node"))
def running_usage_join(spark, sf):
    states = fleet.with_usage(
        fleet.with_capacity(fleet.bare_nodes(spark, sf)),
        cand.usage_of(fleet.running_pods(spark, sf)))
    return states.select(
        "node_id", F.col("node_allocatable_cpu").alias("alloc_cpu"),
        F.col("current_cpu_usage").alias("used_cpu"),
        F.col("current_memory_usage").alias("used_mem"), F.col("current_pod_count").alias("pods"))


@register("schedulable_semi", query(
    "SELECT event_id AS pod_id FROM pending WHERE event_id IN (SELECT event_id FROM eligible)",
    "pending", "eligible"))
def schedulable_semi(spark, sf):
    waiting = waiting_pods(spark, sf)
    return cand.schedulable(
        waiting, placement.eligible_pairs(waiting, fleet.nodes(spark, sf))).select("pod_id")


@register("unschedulable_anti", query(
    "SELECT event_id AS pod_id FROM pending WHERE event_id NOT IN (SELECT event_id FROM eligible)",
    "pending", "eligible"))
def unschedulable_anti(spark, sf):
    waiting = waiting_pods(spark, sf)
    return cand.unschedulable(
        waiting, placement.eligible_pairs(waiting, fleet.nodes(spark, sf))).select("pod_id")


@register("stressed_flag", query("""
SELECT s.*, EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error'
                    AND e.user_id = s.node_id AND e.value >= 0) AS stressed
FROM node_status s""", "node_status"))
def stressed_flag(spark, sf):
    return cand.stressed_nodes(status(spark, sf), fleet.stress_jobs(spark, sf))


@register("pred_join", query("""
SELECT event_id, node_id, round_even(t_score, 6) AS teacher_score, heur AS pred
FROM fit""", "fit"))
def pred_join(spark, sf):
    labelled = label_dataset(fleet.pods(spark, sf), fleet.nodes(spark, sf)).where("feasible")
    predictions = labelled.select("event_id", "node_id", scoring.heuristic_score().alias("pred"))
    return labelled.select("event_id", "node_id", "teacher_score").join(
        predictions, ["event_id", "node_id"]).select(
        "event_id", "node_id", F.bround("teacher_score", 6).alias("teacher_score"), "pred")


@register("rank_pairs", query(f"""
SELECT a.event_id, {count_sql("(a.t_score - b.t_score) * (a.heur - b.heur) > 0", "concordant")},
       {count_sql("(a.t_score - b.t_score) * (a.heur - b.heur) < 0", "discordant")}
FROM fit a JOIN fit b ON a.event_id = b.event_id AND a.node_id < b.node_id GROUP BY 1""", "fit"))
def rank_pairs(spark, sf):
    counts = evaluation.pair_counts(scored_pairs(spark, sf))
    return counts.where("n > 1").select("event_id", "concordant", "discordant")


@register("rank_pair_rows", query("""
SELECT a.event_id, count(*) AS pairs, CAST(sum(a.node_id * 1000003 + b.node_id) AS BIGINT) AS nodes,
       CAST(sum(CASE WHEN sign(a.t_score - b.t_score) * sign(a.heur - b.heur) > 0 THEN 1 ELSE 0 END)
            AS BIGINT) AS concordant,
       CAST(sum(CASE WHEN sign(a.t_score - b.t_score) * sign(a.heur - b.heur) < 0 THEN 1 ELSE 0 END)
            AS BIGINT) AS discordant
FROM fit a JOIN fit b ON a.event_id = b.event_id AND a.node_id < b.node_id GROUP BY 1""", "fit"))
def rank_pair_rows(spark, sf):
    """The pairs themselves, told per event by sums over their rows."""
    rows = evaluation.event_pairs(scored_pairs(spark, sf))
    agree = F.col("sign_x") * F.col("sign_y")
    return rows.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.col("node_a") * 1000003 + F.col("node_b")).alias("nodes"),
        count_if(agree > 0, "concordant").cast("long").alias("concordant"),
        count_if(agree < 0, "discordant").cast("long").alias("discordant"))


def scored_pairs(spark, sf):
    """Feasible candidates with teacher labels and the heuristic as prediction."""
    labelled = label_dataset(fleet.pods(spark, sf), fleet.nodes(spark, sf))
    return labelled.where("feasible").withColumn("pred", scoring.heuristic_score())


@register("profile_join", query(
    "SELECT node_id, profile_name, CAST(cap_cpu AS BIGINT) AS cap_cpu, CAST(cap_mem AS BIGINT)"
    " AS cap_mem FROM node", "node"))
def profile_join(spark, sf):
    return fleet.with_capacity(fleet.bare_nodes(spark, sf)).select(
        "node_id", "profile_name", F.col("node_cpu_capacity").alias("cap_cpu"),
        F.col("node_memory_capacity").alias("cap_mem"))


# Set operations.

EVENTS_SQL = """
SELECT event_id AS pod_id, 'pod-' || event_id || '.scheduled' AS event_name,
       'Scheduled' AS reason, 'Normal' AS type, 'placement-scheduler chose '
       || n.node_name || ' with ' || best_score || ' of 100 points' AS message
FROM placed JOIN node n ON n.node_id = best_id
UNION ALL
SELECT event_id, 'pod-' || event_id || '.failedscheduling', 'FailedScheduling', 'Warning',
       'none of ' || r.n || ' ready nodes passes taints, affinity and capacity'
FROM pending JOIN (SELECT cluster_id, count(*) AS n FROM ready GROUP BY 1) r USING (cluster_id)
WHERE event_id NOT IN (SELECT event_id FROM placed)
UNION ALL
SELECT event_id, 'pod-' || event_id || '.warning', 'PVCBindingRisk', 'Warning',
       'claims c' || event_id || CASE WHEN price >= 480000
       THEN ', u' || event_id ELSE '' END || ' may never bind: placement-scheduler binds the pod '
       || 'itself, and a storage class that waits for its first consumer then waits for ever'
FROM pending WHERE price >= 450000"""


@register("placement_events", query(EVENTS_SQL, "pending", "ready", "placed"))
def placement_events(spark, sf):
    waiting, nodes = waiting_pods(spark, sf), fleet.nodes(spark, sf)
    return decisions.placement_events(
        waiting, placement.ready_nodes(nodes), placement.place(waiting, nodes))


@register("new_pods", query("""
SELECT DISTINCT l_orderkey AS pod_id FROM lineitem
WHERE l_returnflag <> 'R' AND l_shipdate >= TIMESTAMP '2001-08-01' AND l_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R'
  AND l_shipdate >= TIMESTAMP '2001-06-01' AND l_shipdate < TIMESTAMP '2001-08-01')"""))
def new_pods(spark, sf):
    seen = fleet.table(spark, sf, "lineitem").where(
        (F.col("l_returnflag") != "R")
        & (F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")))
    late = F.col("l_shipdate") >= F.lit("2001-08-01").cast("timestamp_ntz")
    key = F.col("l_orderkey").alias("pod_id")
    return decisions.new_pods(seen.where(late).select(key).distinct(),
                              seen.where(~late).select(key))


@register("concat_profiles", query("""
SELECT CAST(p.profile_id AS BIGINT) AS profile_id, p.profile_name, count(n.node_id) AS nodes
FROM profile p LEFT JOIN node0 n USING (profile_id) GROUP BY ALL""", "profile", "node0"))
def concat_profiles(spark, sf):
    used = fleet.bare_nodes(spark, sf).groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("nodes"))
    return fleet.profiles(spark).join(used, "profile_id", "left").select(
        "profile_id", "profile_name", F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"))


@register("distinct_keys", query("""
SELECT count(DISTINCT event_id) AS events, count(DISTINCT cluster_id) AS clusters,
       count(DISTINCT node_id) AS nodes FROM labelled""", "labelled"))
def distinct_keys(spark, sf):
    return label_dataset(fleet.pods(spark, sf), fleet.nodes(spark, sf)).agg(
        F.count_distinct("event_id").alias("events"),
        F.count_distinct("cluster_id").alias("clusters"),
        F.count_distinct("node_id").alias("nodes"))
