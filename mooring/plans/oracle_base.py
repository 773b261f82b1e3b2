"""Shared pieces of the comparison SQL, written from the flat rules of the views.

`query(body, *names)` puts the needed common table expressions, and what they
need themselves, in front of a statement.
"""
from mooring.constants import FEATURES


def curve_sql(x, anchors):
    clamped = f"greatest(0e0, least(1e0, {x}))"
    cases = [f"WHEN {clamped} <= {anchors[0][0]}e0 THEN {anchors[0][1]}e0"]
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:]):
        cases.append(f"WHEN {clamped} <= {x1}e0 THEN {y0}e0 + ({clamped} - {x0}e0)"
                     f" / ({x1}e0 - {x0}e0) * ({y1}e0 - {y0}e0)")
    return f"CASE {' '.join(cases)} ELSE {anchors[-1][1]}e0 END"


CPU = [(0.0, 0.0), (0.4, 2.0), (0.6, 8.0), (1.0, 20.0)]
DENSITY = [(0.0, 0.0), (0.2, 1.0), (0.6, 3.0), (1.0, 5.0)]

#: Hardware profiles, restated: name, milli-cores, GiB.
_PROFILES = ", ".join(f"({i}, '{name}', {cpu}, {gib * 1024 ** 3})" for i, (name, cpu, gib) in enumerate([
    ("small", 2000, 4), ("medium", 4000, 8), ("large", 8000, 16), ("xlarge", 16000, 32),
    ("cpu_heavy", 32000, 16), ("mem_heavy", 8000, 128), ("gpu", 64000, 64), ("arm_small", 1200, 2),
    ("storage_opt", 4000, 64), ("burstable", 6000, 8), ("edge", 500, 1)]))

CTES = {}


def cte(name, sql, *needs):
    CTES[name] = (needs, sql.strip())


cte("profile", f"SELECT * FROM (VALUES {_PROFILES}) t(profile_id, profile_name, cap_cpu, cap_mem)")
cte("active", """
SELECT l_suppkey AS node_id, CAST(sum(floor(l_quantity * 4)) AS BIGINT) AS used_cpu,
       CAST(sum(floor(l_extendedprice * 2048)) AS BIGINT) AS used_mem, count(*) AS pods
FROM lineitem WHERE l_returnflag <> 'R' AND l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY 1""")
cte("node0", """
SELECT s_suppkey AS node_id, s_suppkey // 40 AS cluster_id, s_name AS node_name,
       s_suppkey % 11 AS profile_id, s_acctbal < 0 AS unschedulable,
       NOT (s_acctbal >= 0 AND s_acctbal < 4000) AS ready_flag,
       count(*) OVER (PARTITION BY s_suppkey // 40) AS cluster_size
FROM supplier""")
cte("node", """
SELECT n.*, p.profile_name, p.cap_cpu, p.cap_mem,
       CAST(floor(p.cap_cpu * 0.95e0) AS BIGINT) AS alloc_cpu,
       CAST(floor(p.cap_mem * 0.92e0) AS BIGINT) AS alloc_mem,
       CAST(coalesce(a.used_cpu, 0) AS BIGINT) AS used_cpu,
       CAST(coalesce(a.used_mem, 0) AS BIGINT) AS used_mem,
       CAST(coalesce(a.pods, 0) AS BIGINT) AS pods
FROM node0 n JOIN profile p USING (profile_id) LEFT JOIN active a USING (node_id)""",
    "node0", "profile", "active")
cte("pod", """
SELECT o_orderkey AS event_id, o_custkey // 600 AS cluster_id, o_orderdate AS arrival_ts,
       o_orderpriority AS scenario, o_orderstatus AS status, o_totalprice AS price,
       CAST(greatest(50, round_even(greatest(10e0, least(32000e0, o_totalprice / 40)) / 50, 0) * 50)
            AS BIGINT) AS req_cpu,
       CAST((o_orderkey * 17 % 32 + 1) * 67108864 AS BIGINT) AS req_mem
FROM orders""")
cte("request", """
SELECT l_orderkey AS event_id, CAST(l_linenumber AS BIGINT) AS line,
       CAST(floor(l_quantity * 40) AS BIGINT) AS req_cpu,
       CAST(floor(l_extendedprice * 20480) AS BIGINT) AS req_mem, n.*
FROM lineitem JOIN node n ON n.node_id = l_suppkey""", "node")
cte("pair", """
SELECT p.event_id, p.scenario, p.arrival_ts, p.req_cpu, p.req_mem, n.*
FROM pod p JOIN node n USING (cluster_id)""", "pod", "node")


def derived(source, extra=""):
    """Projected and derived values of rows that carry node and request columns."""
    return f"""
SELECT *, greatest(0e0, 1e0 - proj_cpu) AS head_cpu, greatest(0e0, 1e0 - proj_mem) AS head_mem,
       abs(greatest(0e0, 1e0 - proj_cpu) - greatest(0e0, 1e0 - proj_mem)) AS balance
       {extra}
FROM (SELECT *, CAST(used_cpu AS DOUBLE) / alloc_cpu AS cur_cpu,
             CAST(used_mem AS DOUBLE) / alloc_mem AS cur_mem,
             CAST(used_cpu + req_cpu AS DOUBLE) / alloc_cpu AS proj_cpu,
             CAST(used_mem + req_mem AS DOUBLE) / alloc_mem AS proj_mem,
             CAST(req_cpu AS DOUBLE) / alloc_cpu AS ratio_cpu,
             CAST(req_mem AS DOUBLE) / alloc_mem AS ratio_mem,
             (pods + 1) / 110e0 AS density,
             used_cpu + req_cpu <= alloc_cpu AND used_mem + req_mem <= alloc_mem AS feasible
      FROM {source})"""


def teacher(source):
    """Penalties, teacher score and heuristic score on top of derived columns."""
    return f"""
SELECT *, greatest(0e0, least(100e0, round_even((0.6e0 * head_cpu + 0.4e0 * head_mem) * 100, 0)
              - pen_cpu - pen_mem - pen_den)) AS score,
       CAST(round_even(greatest(0e0, least(1e0,
            (0.4e0 * least(1e0, head_cpu) + 0.4e0 * least(1e0, head_mem)
             + 0.1e0 * (1e0 - least(1e0, balance)) + 0.1e0 * (1e0 - least(1e0, density)))
            * (1e0 - least(1e0, CASE WHEN proj_cpu > 0.9e0 THEN (proj_cpu - 0.9e0) * 5 ELSE 0e0 END
                             + CASE WHEN proj_mem > 0.9e0 THEN (proj_mem - 0.9e0) * 5 ELSE 0e0 END))
            )) * 100, 0) AS BIGINT) AS heur
FROM (SELECT *, {curve_sql('proj_cpu', CPU)} AS pen_cpu, {curve_sql('proj_mem', CPU)} AS pen_mem,
             {curve_sql('least(1e0, density)', DENSITY)} AS pen_den FROM {source})"""


def labels(source):
    """Teacher labels over events that have a feasible row."""
    return f"""
SELECT * FROM (
  SELECT *, CASE WHEN feasible THEN row_number() OVER w END AS rank_,
         first_value(node_id) OVER w AS best_id, first_value(t_score) OVER w AS win,
         bool_or(feasible) OVER (PARTITION BY event_id) AS any_fit
  FROM (SELECT *, CASE WHEN feasible THEN score ELSE 0e0 END AS t_score,
               CASE WHEN feasible THEN pen_cpu ELSE 0e0 END AS p_cpu,
               CASE WHEN feasible THEN pen_mem ELSE 0e0 END AS p_mem,
               CASE WHEN feasible THEN pen_den ELSE 0e0 END AS p_den FROM {source})
  WINDOW w AS (PARTITION BY event_id ORDER BY feasible DESC, t_score DESC, node_id)
) WHERE any_fit"""


cte("request_d", derived("request"), "request")
cte("request_t", teacher("request_d"), "request_d")
cte("pair_d", derived("pair"), "pair")
cte("pair_t", teacher("pair_d"), "pair_d")
cte("labelled", labels("pair_t"), "pair_t")
cte("fit", "SELECT * FROM labelled WHERE feasible", "labelled")
# Constraint rules in flat form, from the keys the nested columns are built from.
cte("tolerance", """
SELECT event_id, node_id,
       CASE WHEN node_id % 10 = 0 THEN scenario = '1-URGENT'
            WHEN node_id % 5 = 0 THEN scenario IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
            ELSE TRUE END AS tolerated,
       CASE event_id % 6 WHEN 0 THEN TRUE WHEN 1 THEN node_id % 3 IN (0, 1)
            WHEN 2 THEN node_id % 3 <> 2 WHEN 3 THEN node_id % 2 = 0
            WHEN 4 THEN node_id % 2 = 1 ELSE node_id % 7 > 3 OR node_id % 7 < 1 END AS affine,
       req_cpu + CASE WHEN event_id % 4 = 0 THEN 100 ELSE 0 END <= alloc_cpu
       AND req_mem + CASE WHEN event_id % 4 = 0 THEN 67108864 ELSE 0 END <= alloc_mem AS fits
FROM pair""", "pair")
cte("pending", "SELECT * FROM pod WHERE scenario <> '5-LOW' AND status = 'O'", "pod")
cte("ready", "SELECT * FROM node WHERE NOT unschedulable AND ready_flag", "node")
cte("eligible", """
SELECT p.event_id, p.scenario, p.req_cpu AS all_cpu, p.req_mem AS all_mem,
       CAST(floor(p.req_cpu * 0.8e0) AS BIGINT) AS req_cpu,
       CAST(floor(p.req_mem * 0.8e0) AS BIGINT) AS req_mem, n.*
FROM pending p JOIN ready n USING (cluster_id)
JOIN tolerance t ON t.event_id = p.event_id AND t.node_id = n.node_id
WHERE tolerated AND affine AND fits""", "pending", "ready", "tolerance")
cte("eligible_d", derived("eligible"), "eligible")
cte("eligible_t", teacher("eligible_d"), "eligible_d")
cte("online", """
SELECT *, greatest(0, least(100, heur - step)) AS final FROM (
  SELECT *, CASE WHEN pc > 0.9e0 THEN 20 WHEN pc > 0.7e0 THEN 10 ELSE 0 END
         + CASE WHEN pm > 0.9e0 THEN 20 WHEN pm > 0.7e0 THEN 10 ELSE 0 END
         + CASE WHEN pods > 30 THEN 5 ELSE 0 END AS step
  FROM (SELECT *, CAST(used_cpu + all_cpu AS DOUBLE) / alloc_cpu AS pc,
               CAST(used_mem + all_mem AS DOUBLE) / alloc_mem AS pm FROM eligible_t))""",
    "eligible_t")
cte("placed", """
SELECT event_id, arg_min(node_id, rn) AS best_id, arg_min(final, rn) AS best_score,
       count(*) AS n_candidates, CAST(sum(CASE WHEN final >= 20 THEN 1 ELSE 0 END) AS BIGINT)
       AS n_preferred
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY final DESC, node_id) AS rn
      FROM online) GROUP BY event_id""", "online")


def query(body, *names):
    order, seen = [], set()

    def visit(name):
        if name not in seen:
            seen.add(name)
            for need in CTES[name][0]:
                visit(need)
            order.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return (f"WITH {head}\n" if head else "") + body.strip()


FEATURE_SQL = dict(zip(FEATURES, [
    "CAST(cluster_size AS DOUBLE)", "CAST(alloc_cpu AS DOUBLE)", "CAST(alloc_mem AS DOUBLE)",
    "CAST(used_cpu AS DOUBLE)", "CAST(used_mem AS DOUBLE)", "cur_cpu", "cur_mem",
    "CAST(pods AS DOUBLE)", "CAST(req_cpu AS DOUBLE)", "CAST(req_mem AS DOUBLE)",
    "proj_cpu", "proj_mem", "head_cpu", "head_mem", "balance", "ratio_cpu", "ratio_mem",
    "density"]))
