"""Queries over scalar expressions: quantities, features, scores, text."""
from pyspark.sql import functions as F

from mooring.constants import CANDIDATE_ROW, CLUSTER_SIZE_TIERS, FEATURES, SCENARIO_WEIGHTS
from mooring.functions import features, scoring, text, units
from mooring.operators import placement
from mooring.operators.candidates import with_default_snapshot
from mooring.operators.labelling import candidate_row
from mooring.plans.oracle_base import FEATURE_SQL, query
from mooring.plans.registry import register
from mooring.sources import fleet

KEY = ["event_id", "line", "node_id"]
KEY_SQL = "event_id, line, node_id"


def r6(name, alias=None):
    return F.bround(name, 6).alias(alias or name)


def requests(spark, sf):
    return features.derive(fleet.score_requests(spark, sf))


@register("parse_cpu", query("""
SELECT pod_id, round_even(coalesce(CASE
    WHEN t LIKE '%m' THEN try_cast(left(t, length(t) - 1) AS DOUBLE)
    WHEN t LIKE '%n' THEN try_cast(left(t, length(t) - 1) AS DOUBLE) / 1e6
    ELSE try_cast(t AS DOUBLE) * 1000 END, 0), 6) AS millicores
FROM (SELECT o_orderkey AS pod_id, CASE o_orderkey % 7 WHEN 0 THEN o_orderkey || 'm'
        WHEN 1 THEN o_orderkey || 'n' WHEN 2 THEN o_orderkey || '' WHEN 3 THEN 'bad'
        WHEN 4 THEN o_orderkey || '.5' WHEN 5 THEN o_orderkey || 'Ki' ELSE '' END AS t
      FROM orders)"""))
def parse_cpu(spark, sf):
    texts = fleet.quantity_texts(spark, sf)
    return texts.select("pod_id", F.bround(units.parse_cpu(F.col("cpu_text")), 6)
                        .alias("millicores"))


@register("parse_memory", query("""
SELECT o_orderkey AS pod_id, CASE o_orderkey % 7 WHEN 0 THEN o_orderkey * 1024e0
    WHEN 1 THEN o_orderkey * 1048576e0 WHEN 2 THEN o_orderkey * 1073741824e0
    WHEN 3 THEN o_orderkey * 1099511627776e0 WHEN 4 THEN o_orderkey * 1e0 ELSE 0e0 END AS bytes
FROM orders"""))
def parse_memory(spark, sf):
    texts = fleet.quantity_texts(spark, sf)
    return texts.select("pod_id", units.parse_memory(F.col("memory_text")).alias("bytes"))


@register("pod_requests", query("""
SELECT event_id AS pod_id,
       CAST(req_cpu + CASE WHEN event_id % 4 = 0 THEN 100 ELSE 0 END AS BIGINT) AS total_cpu,
       CAST(req_mem + CASE WHEN event_id % 4 = 0 THEN 67108864 ELSE 0 END AS BIGINT) AS total_memory,
       req_cpu AS container_cpu, req_mem AS container_memory,
       CAST(floor(req_cpu * 0.8e0) AS BIGINT) AS first_cpu,
       CAST(floor(req_mem * 0.8e0) AS BIGINT) AS first_memory
FROM pod""", "pod"))
def pod_requests(spark, sf):
    return placement.pod_requests(fleet.pods(spark, sf)).select(
        "pod_id", F.col("total_requested_cpu").alias("total_cpu"),
        F.col("total_requested_memory").alias("total_memory"),
        "container_cpu", "container_memory", "first_cpu", "first_memory")


@register("alloc_capacity", query("SELECT node_id, alloc_cpu, alloc_mem FROM node", "node"))
def alloc_capacity(spark, sf):
    return fleet.nodes(spark, sf).select(
        "node_id", F.col("node_allocatable_cpu").alias("alloc_cpu"),
        F.col("node_allocatable_memory").alias("alloc_mem"))


@register("current_percent", query("""
SELECT node_id, round_even(CAST(used_cpu AS DOUBLE) / greatest(alloc_cpu, 1), 6) AS cpu_guard_one,
       round_even(CAST(used_mem AS DOUBLE) / greatest(alloc_mem, 1), 6) AS mem_guard_one,
       round_even(CASE WHEN alloc_cpu > 0 THEN CAST(used_cpu AS DOUBLE) / alloc_cpu ELSE 0 END, 6)
       AS cpu_guard_zero,
       round_even(CASE WHEN alloc_mem > 0 THEN CAST(used_mem AS DOUBLE) / alloc_mem ELSE 0 END, 6)
       AS mem_guard_zero
FROM node""", "node"))
def current_percent(spark, sf):
    states = fleet.nodes(spark, sf)
    one, zero = features.current_percents("one"), features.current_percents("zero")
    return states.select(
        "node_id",
        F.bround(one["current_cpu_percent"], 6).alias("cpu_guard_one"),
        F.bround(one["current_memory_percent"], 6).alias("mem_guard_one"),
        F.bround(zero["current_cpu_percent"], 6).alias("cpu_guard_zero"),
        F.bround(zero["current_memory_percent"], 6).alias("mem_guard_zero"))


@register("projected_usage", query(f"""
SELECT {KEY_SQL}, used_cpu + req_cpu AS projected_cpu_usage, used_mem + req_mem AS
       projected_memory_usage, round_even(proj_cpu, 6) AS projected_cpu_percent,
       round_even(proj_mem, 6) AS projected_memory_percent,
       greatest(0, alloc_cpu - used_cpu - req_cpu) AS projected_remaining_cpu,
       greatest(0, alloc_mem - used_mem - req_mem) AS projected_remaining_memory,
       pods + 1 AS projected_pod_count FROM request_d""", "request_d"))
def projected_usage(spark, sf):
    return requests(spark, sf).select(
        *KEY, "projected_cpu_usage", "projected_memory_usage", r6("projected_cpu_percent"),
        r6("projected_memory_percent"), "projected_remaining_cpu", "projected_remaining_memory",
        "projected_pod_count")


@register("headroom", query(f"""
SELECT {KEY_SQL}, round_even(head_cpu, 6) AS cpu_headroom, round_even(head_mem, 6) AS
       memory_headroom FROM request_d""", "request_d"))
def headroom(spark, sf):
    return requests(spark, sf).select(*KEY, r6("cpu_headroom"), r6("memory_headroom"))


@register("resource_balance", query(f"""
SELECT {KEY_SQL}, round_even(balance, 6) AS by_headroom,
       round_even(abs(proj_cpu - proj_mem), 6) AS by_projection FROM request_d""", "request_d"))
def resource_balance(spark, sf):
    return requests(spark, sf).select(
        *KEY, F.bround(features.resource_balance("headroom"), 6).alias("by_headroom"),
        F.bround(features.resource_balance("projection"), 6).alias("by_projection"))


@register("request_ratio", query(f"""
SELECT {KEY_SQL}, round_even(ratio_cpu, 6) AS cpu_request_ratio, round_even(ratio_mem, 6) AS
       memory_request_ratio FROM request_d""", "request_d"))
def request_ratio(spark, sf):
    return requests(spark, sf).select(
        *KEY, r6("cpu_request_ratio"), r6("memory_request_ratio"))


@register("packing_density", query(f"""
SELECT {KEY_SQL}, round_even(density, 6) AS packing_density FROM request_d""", "request_d"))
def packing_density(spark, sf):
    return requests(spark, sf).select(*KEY, r6("packing_density"))


@register("fragmentation", query(f"""
SELECT {KEY_SQL}, round_even(cur_cpu * (1e0 - head_cpu), 6) AS cpu_fragmentation,
       round_even(cur_mem * (1e0 - head_mem), 6) AS memory_fragmentation
FROM request_d""", "request_d"))
def fragmentation(spark, sf):
    return requests(spark, sf).select(
        *KEY, r6("cpu_fragmentation"), r6("memory_fragmentation"))


@register("waste", query(f"""
SELECT {KEY_SQL}, round_even(greatest(0e0, CAST(alloc_cpu - used_cpu - req_cpu AS DOUBLE)
       / alloc_cpu), 6) AS cpu_waste,
       round_even(greatest(0e0, CAST(alloc_mem - used_mem - req_mem AS DOUBLE) / alloc_mem), 6)
       AS memory_waste FROM request_d""", "request_d"))
def waste(spark, sf):
    return requests(spark, sf).select(*KEY, r6("cpu_waste"), r6("memory_waste"))


@register("features18", query(
    f"SELECT {KEY_SQL}, " + ", ".join(
        f"round_even({sql}, 6) AS {name}" for name, sql in FEATURE_SQL.items())
    + " FROM request_d", "request_d"))
def features18(spark, sf):
    rows = features.derive(fleet.score_requests(spark, sf), guard="one")
    return rows.select(*KEY, *[F.bround(c, 6).alias(name) for name, c in zip(
        FEATURES, features.feature_vector_columns(rows))])


ROW_SQL = """
SELECT printf('e%08d', event_id) AS event_id, printf('c%06d', cluster_id) AS cluster_id,
       printf('pod-%08d', event_id) AS pod_id,
       printf('c%06d-n%03d', cluster_id, node_id) AS node_id,
       printf('c%06d-n%03d', best_id // 40, best_id) AS best_node_id, cluster_size,
       CAST(cap_cpu AS BIGINT) AS node_cpu_capacity, CAST(cap_mem AS BIGINT) AS node_memory_capacity,
       alloc_cpu AS node_allocatable_cpu, alloc_mem AS node_allocatable_memory,
       used_cpu AS current_cpu_usage, used_mem AS current_memory_usage,
       CAST(printf('%.6f', cur_cpu) AS DOUBLE) AS current_cpu_percent,
       CAST(printf('%.6f', cur_mem) AS DOUBLE) AS current_memory_percent, pods AS current_pod_count,
       req_cpu AS requested_cpu, req_mem AS requested_memory,
       used_cpu + req_cpu AS projected_cpu_usage, used_mem + req_mem AS projected_memory_usage,
       CAST(printf('%.6f', proj_cpu) AS DOUBLE) AS projected_cpu_percent,
       CAST(printf('%.6f', proj_mem) AS DOUBLE) AS projected_memory_percent,
       greatest(0, alloc_cpu - used_cpu - req_cpu) AS projected_remaining_cpu,
       greatest(0, alloc_mem - used_mem - req_mem) AS projected_remaining_memory,
       pods + 1 AS projected_pod_count, CAST(printf('%.6f', head_cpu) AS DOUBLE) AS cpu_headroom,
       CAST(printf('%.6f', head_mem) AS DOUBLE) AS memory_headroom,
       CAST(printf('%.6f', cur_cpu * (1e0 - head_cpu)) AS DOUBLE) AS cpu_fragmentation,
       CAST(printf('%.6f', cur_mem * (1e0 - head_mem)) AS DOUBLE) AS memory_fragmentation,
       CAST(printf('%.6f', balance) AS DOUBLE) AS resource_balance,
       CAST(printf('%.6f', greatest(0e0, CAST(alloc_cpu - used_cpu - req_cpu AS DOUBLE) / alloc_cpu)) AS DOUBLE)
       AS cpu_waste,
       CAST(printf('%.6f', greatest(0e0, CAST(alloc_mem - used_mem - req_mem AS DOUBLE) / alloc_mem)) AS DOUBLE)
       AS memory_waste, CAST(printf('%.6f', ratio_cpu) AS DOUBLE) AS cpu_request_ratio,
       CAST(printf('%.6f', ratio_mem) AS DOUBLE) AS memory_request_ratio,
       CAST(printf('%.6f', density) AS DOUBLE) AS packing_density, feasible,
       CASE WHEN feasible THEN '' WHEN used_cpu + req_cpu > alloc_cpu
            AND used_mem + req_mem > alloc_mem THEN 'both'
            WHEN used_cpu + req_cpu > alloc_cpu THEN 'cpu' ELSE 'memory' END AS reject_reason,
       CAST(printf('%.6f', p_cpu) AS DOUBLE) AS cpu_penalty, CAST(printf('%.6f', p_mem) AS DOUBLE) AS memory_penalty,
       CAST(printf('%.6f', p_den) AS DOUBLE) AS density_penalty, CAST(printf('%.6f', win) AS DOUBLE) AS winner_score,
       CAST(printf('%.6f', t_score) AS DOUBLE) AS teacher_score,
       CASE WHEN rank_ = 1 THEN 1 ELSE 0 END AS selected_by_scheduler,
       CAST(rank_ AS INTEGER) AS teacher_rank,
       CAST(printf('%.6f', win - t_score) AS DOUBLE) AS score_gap_from_best
FROM labelled"""


SCORES = ["cpu_penalty", "memory_penalty", "density_penalty", "winner_score", "teacher_score",
          "score_gap_from_best"]


def comparable_row(labelled):
    """The stored row with scores rounded, so that engines can be compared."""
    return candidate_row(labelled).withColumns(
        {c: units.round_exact(F.col(c), 6) for c in SCORES})


#: Columns of the stored row that are fractions: six digits, compared as millionths.
FRACTIONS = [c for c in CANDIDATE_ROW if c.endswith((
    "_percent", "_headroom", "_fragmentation", "_waste", "_ratio", "_balance", "_density", "_penalty",
    "_score", "_from_best"))]


def _row_digest_sql():
    cells = ", ".join(
        f"CAST(CAST(round_even({c} * 1e6, 0) AS BIGINT) AS VARCHAR)" if c in FRACTIONS
        else f"coalesce(CAST({c} AS VARCHAR), '')" for c in CANDIDATE_ROW)
    return f"""
SELECT event_id, count(*) AS nodes, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {cells})), 1, 12)
       AS BIGINT)) AS BIGINT) AS digest FROM ({ROW_SQL}) GROUP BY 1"""


@register("candidate_row", query(_row_digest_sql(), "labelled"))
def candidate_rows(spark, sf):
    """Every labelled pair with all stored columns: an event's rows, by a digest of each whole row."""
    # The millionths of a rounded fraction are its own digits.
    from mooring.plans.reports import labelled
    rows = comparable_row(labelled(spark, sf))
    cells = [F.rint(F.col(c) * 1e6).cast("long").cast("string") if c in FRACTIONS
             else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CANDIDATE_ROW]
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *cells).cast("binary")), 1, 12), 16, 10)
    return rows.select("event_id", digest.cast("long").alias("d")).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("d").alias("digest"))


def scored_requests(spark, sf):
    return scoring.with_teacher_score(requests(spark, sf))


STEP_SQL = """
SELECT {key}, CAST(cpu AS BIGINT) AS cpu, CAST(mem AS BIGINT) AS mem, CAST(den AS BIGINT) AS den,
       CAST(cpu + mem + den AS BIGINT) AS total FROM (
  SELECT *, CASE WHEN proj_cpu > 0.9e0 THEN 20 WHEN proj_cpu > 0.7e0 THEN 10 ELSE 0 END AS cpu,
         CASE WHEN proj_mem > 0.9e0 THEN 20 WHEN proj_mem > 0.7e0 THEN 10 ELSE 0 END AS mem,
         CASE WHEN pods > 30 THEN 5 ELSE 0 END AS den FROM request_t)"""


@register("step_penalty", query(STEP_SQL.format(key=KEY_SQL), "request_t"))
def step_penalty(spark, sf):
    return requests(spark, sf).withColumns(scoring.step_penalties()).select(
        *KEY, F.col("cpu_step_penalty").alias("cpu"), F.col("memory_step_penalty").alias("mem"),
        F.col("density_step_penalty").alias("den"), F.col("step_penalty").alias("total"))


@register("piecewise_penalty", query(f"""
SELECT {KEY_SQL}, round_even(pen_cpu, 6) AS cpu_penalty FROM request_t""", "request_t"))
def piecewise_penalty(spark, sf):
    return scored_requests(spark, sf).select(*KEY, r6("cpu_penalty"))


@register("piecewise_penalties", query(f"""
SELECT {KEY_SQL}, round_even(pen_cpu, 6) AS cpu_penalty, round_even(pen_mem, 6) AS memory_penalty,
       round_even(pen_den, 6) AS density_penalty,
       round_even(pen_cpu + pen_mem + pen_den, 6) AS total FROM request_t""", "request_t"))
def piecewise_penalties(spark, sf):
    total = F.col("cpu_penalty") + F.col("memory_penalty") + F.col("density_penalty")
    return scored_requests(spark, sf).select(
        *KEY, r6("cpu_penalty"), r6("memory_penalty"), r6("density_penalty"),
        F.bround(total, 6).alias("total"))


@register("teacher_score", query(f"""
SELECT {KEY_SQL}, round_even(score, 6) AS teacher_score FROM request_t""", "request_t"))
def teacher_score(spark, sf):
    return scored_requests(spark, sf).select(*KEY, r6("teacher_score"))


@register("heuristic_score", query(f"""
SELECT {KEY_SQL}, heur AS score FROM request_t""", "request_t"))
def heuristic_score(spark, sf):
    return requests(spark, sf).select(*KEY, scoring.heuristic_score().alias("score"))


@register("final_score", query(f"""
SELECT {KEY_SQL}, greatest(0, least(100, heur
         - CASE WHEN proj_cpu > 0.9e0 THEN 20 WHEN proj_cpu > 0.7e0 THEN 10 ELSE 0 END
         - CASE WHEN proj_mem > 0.9e0 THEN 20 WHEN proj_mem > 0.7e0 THEN 10 ELSE 0 END
         - CASE WHEN pods > 30 THEN 5 ELSE 0 END)) AS score FROM request_t""", "request_t"))
def final_score(spark, sf):
    rows = requests(spark, sf).withColumns(scoring.step_penalties())
    return rows.select(*KEY, scoring.final_score(
        scoring.heuristic_score(), F.col("step_penalty")).alias("score"))


@register("fallback_score", query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 50 WHEN event_id % 13 IN (0, 1) THEN 0
       ELSE event_id % 101 END AS score,
       CASE WHEN event_type = 'error' THEN 'fallback' ELSE 'trees' END AS source FROM events"""))
def fallback_score(spark, sf):
    answer = text.decode_response(F.col("body"))
    return fleet.score_responses(spark, sf).select("event_id", answer.alias("a")).select(
        "event_id", *[c.alias(n) for n, c in scoring.with_fallback(
            F.col("a.score"), F.col("a.source")).items()])


@register("clamp_round_pred", query("""
SELECT event_id, round_even(greatest(0e0, least(100e0, value)), 6) AS clipped,
       CAST(round_even(greatest(0e0, least(100e0, value)), 0) AS BIGINT) AS score FROM events"""))
def clamp_round_pred(spark, sf):
    raw = F.col("value")
    return fleet.table(spark, sf, "events").select(
        "event_id", F.bround(scoring.clamp_prediction(raw, rounded=False), 6).alias("clipped"),
        scoring.clamp_prediction(raw).alias("score"))


@register("reason_text", query(f"""
SELECT {KEY_SQL}, printf('req_cpu=%.0fm proj_cpu%%=%.1f%% headroom=%.1f%%',
       CAST(req_cpu AS DOUBLE), proj_cpu * 100, head_cpu * 100) AS reason
FROM request_d""", "request_d"))
def reason_text(spark, sf):
    return requests(spark, sf).select(*KEY, scoring.reason_text().alias("reason"))


NODE_STATUS_SQL = """
SELECT node_id, CAST(printf('%.1f', CAST(used_cpu AS DOUBLE) / alloc_cpu * 100) AS DOUBLE) AS cpu_util_pct,
       CAST(printf('%.1f', CAST(used_mem AS DOUBLE) / alloc_mem * 100) AS DOUBLE) AS mem_util_pct, pods,
       heur AS score
FROM idle_t"""


def _register_idle():
    from mooring.plans import oracle_base as base
    base.cte("idle", "SELECT node_id AS event_id, 0 AS req_cpu, 0 AS req_mem, * FROM node", "node")
    base.cte("idle_d", base.derived("idle"), "idle")
    base.cte("idle_t", base.teacher("idle_d"), "idle_d")
    base.cte("node_status", NODE_STATUS_SQL, "idle_t")


_register_idle()


def idle_nodes(spark, sf):
    """Features of every node for a request of nothing."""
    nothing = F.lit(0).cast("long")
    return features.derive(fleet.nodes(spark, sf).withColumns(
        {"requested_cpu": nothing, "requested_memory": nothing}), guard="one")


def status(spark, sf):
    """Utilisation, pods and zero-request score of every node."""
    return idle_nodes(spark, sf).select("node_id", *[c.alias(n) for n, c in scoring.node_status().items()],
                       scoring.heuristic_score().alias("score"))


@register("node_status", query("SELECT * FROM node_status", "node_status"))
def node_status(spark, sf):
    return status(spark, sf)


@register("status_band", query("""
SELECT node_id, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'mid' ELSE 'low' END
       AS score_band,
       CASE WHEN cpu <= 50 THEN 'green' WHEN cpu <= 75 THEN 'yellow' ELSE 'red' END AS cpu_band,
       CASE WHEN mem <= 60 THEN 'green' WHEN mem <= 80 THEN 'yellow' ELSE 'red' END AS mem_band,
       CASE WHEN stressed THEN '' WHEN score >= 70 THEN 'Healthy' WHEN score >= 40 THEN 'Moderate'
            ELSE 'High Risk' END AS health_tag
FROM (SELECT node_id, heur AS score, floor(CAST(used_cpu AS DOUBLE) / alloc_cpu * 100 + 0.5) AS cpu,
             floor(CAST(used_mem AS DOUBLE) / alloc_mem * 100 + 0.5) AS mem,
             EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error'
                     AND e.user_id = i.node_id) AS stressed FROM idle_t i)""", "idle_t"))
def status_band(spark, sf):
    from mooring.operators.candidates import stressed_nodes
    shares = idle_nodes(spark, sf).select(
        "node_id", "current_cpu_percent", "current_memory_percent",
        scoring.heuristic_score().alias("score"))
    bands = scoring.status_bands(F.col("score"), F.col("current_cpu_percent"),
                                 F.col("current_memory_percent"), F.col("stressed"))
    return stressed_nodes(shares, fleet.stress_jobs(spark, sf)).select(
        "node_id", *[c.alias(n) for n, c in bands.items()])


@register("quantize_request", query("""
SELECT o_orderkey AS pod_id,
       CAST(greatest(50, round_even(greatest(10e0, least(32000e0, o_totalprice / 12)) / 50, 0) * 50)
            AS BIGINT) AS cpu_milli,
       CAST(round_even(greatest(67108864e0, least(68719476736e0, o_totalprice * 150000))
            / 67108864, 0) * 67108864 AS BIGINT) AS mem_bytes FROM orders"""))
def quantize_request(spark, sf):
    price = F.col("o_totalprice")
    return fleet.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pod_id"),
        units.quantize_cpu(price / 12).alias("cpu_milli"),
        units.quantize_memory(price * 150_000).alias("mem_bytes"))


def _weighted_sql(weighted, unit):
    total, reached, cases = sum(w for _, w in weighted), 0.0, []
    for name, weight in weighted:
        reached += weight
        cases.append(f"WHEN {unit} * {total!r}e0 <= {reached!r}e0 THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{weighted[-1][0]}' END"


UNIT_SQL = """(SELECT o_orderkey AS pod_id, (m * m + m * 31) % 1000003 / 1000003e0 AS u
FROM (SELECT o_orderkey, (o_orderkey % 1000003 + 7) * 48271 % 1000003 AS m FROM orders))"""
TIERS = [(f"{low}-{high}", weight) for low, high, weight in CLUSTER_SIZE_TIERS]


@register("weighted_assign", query(f"""
SELECT pod_id, {_weighted_sql(TIERS, 'u')} AS size_tier,
       {_weighted_sql(SCENARIO_WEIGHTS, 'u')} AS load_scenario FROM {UNIT_SQL}"""))
def weighted_assign(spark, sf):
    unit = units.unit_interval(F.col("o_orderkey"), 7)
    return fleet.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pod_id"),
        units.weighted_choice(unit, TIERS).alias("size_tier"),
        units.weighted_choice(unit, SCENARIO_WEIGHTS).alias("load_scenario"))


@register("row_ids", query("""
SELECT l_linenumber AS line, printf('e%08d', l_orderkey) AS event_label,
       printf('pod-%08d', l_orderkey) AS pod_label,
       printf('c%06d', l_suppkey // 40) AS cluster_label,
       printf('c%06d-n%03d', l_suppkey // 40, l_suppkey) AS node_label FROM lineitem"""))
def row_ids(spark, sf):
    cluster = fleet.block("l_suppkey", fleet.NODES_PER_CLUSTER)
    return fleet.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("line"),
        units.event_label(F.col("l_orderkey")).alias("event_label"),
        units.pod_label(F.col("l_orderkey")).alias("pod_label"),
        units.cluster_label(cluster).alias("cluster_label"),
        units.node_label(cluster, F.col("l_suppkey")).alias("node_label"))


# Text, time, map and JSON expressions.

@register("job_name", query("""
SELECT s_suppkey AS node_id,
       'saturate-' || lower(regexp_replace(s_name, '[^a-z0-9-]', '-', 'g')) AS job
FROM supplier"""))
def job_name(spark, sf):
    return fleet.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("node_id"), text.job_name(F.col("s_name")).alias("job"))


@register("short_name", query("""
SELECT pod_id, CASE WHEN len(string_split(n, '-')) <= 2 THEN n
       ELSE array_to_string(list_slice(string_split(n, '-'), -2, -1), '-') END AS short
FROM (SELECT o_orderkey AS pod_id, CASE WHEN o_orderstatus = 'F' THEN 'p' || o_orderkey
             ELSE 'app-' || o_orderpriority || '-' || o_orderkey END AS n FROM orders)"""))
def short_name(spark, sf):
    key = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("p"), key)).otherwise(
        F.concat(F.lit("app-"), "o_orderpriority", F.lit("-"), key))
    return fleet.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pod_id"), text.short_name(name).alias("short"))


@register("fmt_num", query("""
SELECT pod_id, CASE WHEN n >= 1000000 AND n % 1000000 = 250000 THEN printf('%d.3M', n // 1000000)
       WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000e0)
       WHEN n >= 1000 AND n % 1000 = 250 THEN printf('%d.3K', n // 1000)
       WHEN n >= 1000 THEN printf('%.1fK', n / 1000e0) ELSE CAST(n AS VARCHAR) END AS short
FROM (SELECT o_orderkey AS pod_id, o_orderkey * o_orderkey * 50 + o_orderkey % 3 AS n FROM orders)"""))
def fmt_num(spark, sf):
    key = F.col("o_orderkey")
    return fleet.table(spark, sf, "orders").select(
        key.alias("pod_id"), text.compact_number(key * key * 50 + key % 3).alias("short"))


@register("html_escape", query("""
SELECT page_id, md5(e) AS digest, length(e) AS n_chars FROM (
  SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
         '"', '&quot;') AS e FROM pages)"""))
def html_escape(spark, sf):
    escaped = text.html_escape(F.col("html"))
    return fleet.table(spark, sf, "pages").select("page_id", escaped.alias("e")).select(
        "page_id", F.md5("e").alias("digest"), F.length("e").cast("long").alias("n_chars"))


@register("fmt_seconds", query("""
SELECT event_id, CASE WHEN s < 60 THEN CAST(round_even(s, 0) AS BIGINT) || 's'
       WHEN floor(s / 60) < 60 THEN printf('%dm%02ds', CAST(floor(s / 60) AS BIGINT),
            CAST(floor(s - floor(s / 60) * 60) AS BIGINT))
       ELSE printf('%dh%02dm', CAST(floor(s / 3600) AS BIGINT),
            CAST(floor(s / 60) AS BIGINT) % 60) END AS duration
FROM (SELECT event_id, value * 50 AS s FROM events)"""))
def fmt_seconds(spark, sf):
    return fleet.table(spark, sf, "events").select(
        "event_id", text.duration_text(F.col("value") * 50).alias("duration"))


@register("utc_stamp", query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events"""))
def utc_stamp(spark, sf):
    return fleet.table(spark, sf, "events").select(
        "event_id", text.utc_stamp(F.col("ts")).alias("stamp"))


@register("label_lookup", query("""
SELECT s_suppkey AS node_id, s_suppkey % 2 = 0 AS has_ssd,
       CASE WHEN s_suppkey % 2 = 0 THEN 'true' END AS ssd,
       TRUE AS has_gen, CAST(s_suppkey % 7 AS VARCHAR) AS gen FROM supplier"""))
def label_lookup(spark, sf):
    has_ssd, ssd = text.label_lookup(F.col("labels"), F.lit("ssd"))
    has_gen, gen = text.label_lookup(F.col("labels"), F.lit("gen"))
    return fleet.bare_nodes(spark, sf).select(
        "node_id", has_ssd.alias("has_ssd"), ssd.alias("ssd"), has_gen.alias("has_gen"),
        gen.alias("gen"))


@register("condition_json", query("""
SELECT event_id AS pod_id, '{"status":{"conditions":[{"type":"PodScheduled","status":"False",'
       || '"reason":"Unschedulable","message":"no node for ' || req_cpu
       || 'm","lastTransitionTime":"' || strftime(arrival_ts, '%Y-%m-%dT%H:%M:%SZ') || '"}]}}'
       AS patch FROM pending WHERE event_id NOT IN (SELECT event_id FROM placed)""",
                                   "pending", "placed"))
def condition_json(spark, sf):
    from mooring.operators.candidates import unschedulable
    waiting = placement.pending_pods(fleet.pods(spark, sf))
    unplaced = unschedulable(waiting, placement.eligible_pairs(waiting, fleet.nodes(spark, sf)))
    message = F.concat(F.lit("no node for "), F.col("requested_cpu").cast("string"), F.lit("m"))
    return unplaced.select("pod_id", text.condition_json(message, F.col("arrival_ts"))
                           .alias("patch"))


@register("decode_scores", query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 50 WHEN event_id % 13 IN (0, 1) THEN 0
       ELSE event_id % 101 END AS score,
       CASE WHEN event_type <> 'error' THEN 'ok' END AS reason FROM events"""))
def decode_scores(spark, sf):
    answer = text.decode_response(F.col("body"))
    return fleet.score_responses(spark, sf).select("event_id", answer.alias("a")).select(
        "event_id", scoring.with_fallback(F.col("a.score"), F.col("a.source"))["score"]
        .alias("score"), F.col("a.reason").alias("reason"))


@register("snapshot_default", query("""
SELECT event_id, u.node_id IS NOT NULL AS known_node,
       CAST(coalesce(u.cluster_size, 1) AS BIGINT) AS cluster_size,
       coalesce(CAST(u.alloc_cpu AS DOUBLE), 1000e0) AS alloc_cpu,
       coalesce(CAST(u.alloc_mem AS DOUBLE), 1073741824e0) AS alloc_mem,
       coalesce(CAST(u.used_cpu AS DOUBLE), 0e0) AS used_cpu, coalesce(u.pods, 0) AS pods
FROM events e LEFT JOIN node u ON u.node_id = e.user_id + CAST(e.value AS BIGINT)""", "node"))
def snapshot_default(spark, sf):
    states = fleet.nodes(spark, sf).withColumns({
        c: F.col(c).cast("double") for c in (
            "node_allocatable_cpu", "node_allocatable_memory", "current_cpu_usage",
            "current_memory_usage")}).withColumns(features.current_percents("one")).select(
        "node_id", *[f for f in FEATURES[:8]])
    asked = fleet.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") + F.rint("value").cast("long")).alias("node_id"))
    return with_default_snapshot(asked, states).select(
        "event_id", "known_node", F.col("cluster_size").cast("long").alias("cluster_size"),
        F.col("node_allocatable_cpu").alias("alloc_cpu"),
        F.col("node_allocatable_memory").alias("alloc_mem"),
        F.col("current_cpu_usage").alias("used_cpu"),
        F.col("current_pod_count").cast("long").alias("pods"))
