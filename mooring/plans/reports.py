"""Queries over the validation report, quality metrics, counters and roll-ups."""
from pyspark.sql import functions as F

from mooring.constants import (
    ANALYSIS_FEATURES, DOMINANCE_FEATURES, FEATURES, SCORE_BANDS,
)
from mooring.functions import scoring
from mooring.operators import candidates as cand
from mooring.operators import decisions, evaluation, validation
from mooring.operators.labelling import label_dataset
from mooring.plans.matching import count_if, count_sql, scored_pairs, sum_sql
from mooring.plans.oracle_base import FEATURE_SQL, query
from mooring.plans.registry import register
from mooring.sources import fleet

# Column expressions of the labelled rows in the comparison SQL.
SQL_OF = {
    **FEATURE_SQL,
    "node_cpu_capacity": "CAST(cap_cpu AS DOUBLE)", "node_memory_capacity": "CAST(cap_mem AS DOUBLE)",
    "projected_cpu_usage": "CAST(used_cpu + req_cpu AS DOUBLE)",
    "projected_memory_usage": "CAST(used_mem + req_mem AS DOUBLE)",
    "projected_remaining_cpu": "CAST(greatest(0, alloc_cpu - used_cpu - req_cpu) AS DOUBLE)",
    "projected_remaining_memory": "CAST(greatest(0, alloc_mem - used_mem - req_mem) AS DOUBLE)",
    "projected_pod_count": "CAST(pods + 1 AS DOUBLE)",
    "cpu_fragmentation": "cur_cpu * (1e0 - head_cpu)",
    "memory_fragmentation": "cur_mem * (1e0 - head_mem)",
    "cpu_waste": "greatest(0e0, CAST(alloc_cpu - used_cpu - req_cpu AS DOUBLE) / alloc_cpu)",
    "memory_waste": "greatest(0e0, CAST(alloc_mem - used_mem - req_mem AS DOUBLE) / alloc_mem)",
}
PENALTY_SQL = [("cpu_penalty", "p_cpu"), ("memory_penalty", "p_mem"), ("density_penalty", "p_den")]


def labelled(spark, sf, parts=None):
    return label_dataset(fleet.pods(spark, sf), fleet.nodes(spark, sf), parts)


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.bround(c, digits) for c in columns})


@register("node_usage", query("""
SELECT l_suppkey AS node_id, CAST(sum(floor(l_quantity * 4)) AS BIGINT) AS cpu,
       CAST(sum(floor(l_extendedprice * 2048)) AS BIGINT) AS memory, count(*) AS pods
FROM lineitem WHERE l_returnflag <> 'R' AND l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY 1"""))
def node_usage(spark, sf):
    return cand.usage_of(fleet.running_pods(spark, sf)).select(
        "node_id", F.col("current_cpu_usage").alias("cpu"),
        F.col("current_memory_usage").alias("memory"), F.col("current_pod_count").alias("pods"))


@register("pod_count", query(
    "SELECT l_suppkey AS node_id, count(*) AS pods FROM lineitem GROUP BY 1"))
def pod_count(spark, sf):
    return cand.bound_pod_count(fleet.running_pods(spark, sf)).select(
        "node_id", F.col("current_pod_count").alias("pods"))


@register("overview", query(f"""
SELECT count(*) AS total_rows, count(DISTINCT event_id) AS events,
       count(DISTINCT cluster_id) AS clusters, count(DISTINCT event_id) AS pods,
       {count_sql("feasible", "feasible_rows")}, {count_sql("NOT feasible", "infeasible_rows")},
       round_even(100e0 * sum(CAST(feasible AS INT)) / count(*), 6) AS feasible_pct,
       round_even(100e0 * sum(CAST(NOT feasible AS INT)) / count(*), 6) AS infeasible_pct
FROM labelled""", "labelled"))
def overview(spark, sf):
    return rounded(validation.overview(labelled(spark, sf)), "feasible_pct", "infeasible_pct")


@register("avg_cluster", query("""
SELECT round_even(avg(size), 6) AS avg_cluster_size, round_even(avg(fits), 6) AS
       avg_feasible_nodes FROM (
  SELECT event_id, min(cluster_size) AS size, sum(CAST(feasible AS INT)) AS fits
  FROM labelled GROUP BY 1)""", "labelled"))
def avg_cluster(spark, sf):
    return rounded(validation.average_cluster(labelled(spark, sf)),
                   "avg_cluster_size", "avg_feasible_nodes")


@register("score_stats", query("""
SELECT round_even(min(t_score), 6) AS min_score, round_even(avg(t_score), 6) AS mean_score,
       round_even(max(t_score), 6) AS max_score, round_even(stddev_pop(t_score), 6) AS
       std_population, round_even(stddev_samp(t_score), 6) AS std_sample FROM fit""", "fit"))
def score_stats(spark, sf):
    stats = validation.score_stats(labelled(spark, sf))
    return rounded(stats, *stats.columns)


@register("score_hist", query("""
SELECT CAST(least(9, floor(t_score / 10)) AS INTEGER) AS bin, count(*) AS n
FROM fit GROUP BY 1""", "fit"))
def score_hist(spark, sf):
    return validation.score_histogram(labelled(spark, sf))


@register("rank_dist", query("""
SELECT CAST(rank_ AS INTEGER) AS teacher_rank, count(*) AS n,
       (SELECT greatest(count(DISTINCT rank_) - 10, 0) FROM fit) AS further_ranks
FROM fit GROUP BY 1 ORDER BY 1 LIMIT 10""", "fit"))
def rank_dist(spark, sf):
    return validation.rank_distribution(labelled(spark, sf))


@register("penalty_stats", query(" UNION ALL ".join(f"""
SELECT '{name}' AS name, round_even(min({c}), 6) AS min_penalty, round_even(avg({c}), 6) AS
       mean_penalty, round_even(max({c}), 6) AS max_penalty, round_even(stddev_pop({c}), 6) AS
       std_penalty, round_even(100e0 * sum(CAST(abs({c}) < 1e-12 AS INT)) / count(*), 6) AS
       zero_pct, count(DISTINCT printf('%.3f', {c})) AS unique_values FROM fit"""
                                              for name, c in PENALTY_SQL), "fit"))
def penalty_stats(spark, sf):
    return rounded(validation.penalty_stats(labelled(spark, sf)), "min_penalty", "mean_penalty",
                   "max_penalty", "std_penalty", "zero_pct")


@register("penalty_hist", query(" UNION ALL ".join(f"""
SELECT * FROM (SELECT '{name}' AS name, CAST(printf('%.1f', {c}) AS DOUBLE) AS bucket,
  count(*) AS n FROM fit GROUP BY 2 ORDER BY 2 LIMIT 12)""" for name, c in PENALTY_SQL), "fit"))
def penalty_hist(spark, sf):
    return validation.penalty_histogram(labelled(spark, sf))


@register("request_stats", query("""
SELECT min(req_cpu) AS min_cpu, round_even(avg(req_cpu), 6) AS mean_cpu, max(req_cpu) AS max_cpu,
       round_even(min(req_mem) / 1073741824e0, 6) AS min_mem_gb,
       round_even(avg(req_mem) / 1073741824e0, 6) AS mean_mem_gb,
       round_even(max(req_mem) / 1073741824e0, 6) AS max_mem_gb FROM labelled""", "labelled"))
def request_stats(spark, sf):
    return rounded(validation.request_stats(labelled(spark, sf)),
                   "mean_cpu", "min_mem_gb", "mean_mem_gb", "max_mem_gb")


def _spread_sql(name, value, source):
    return f"""
SELECT '{name}' AS name, round_even(min({value}), 6) AS min_pct, round_even(avg({value}), 6) AS
       mean_pct, round_even(max({value}), 6) AS max_pct, round_even(stddev_pop({value}), 6) AS
       std_pct FROM {source}"""


UTILISATION_SQL = " UNION ALL ".join([
    _spread_sql("current_cpu", "cur_cpu * 100", "labelled"),
    _spread_sql("current_memory", "cur_mem * 100", "labelled"),
    _spread_sql("projected_cpu", "proj_cpu * 100", "fit"),
    _spread_sql("projected_memory", "proj_mem * 100", "fit")])


@register("utilization_stats", query(UTILISATION_SQL, "labelled", "fit"))
def utilization_stats(spark, sf):
    return rounded(validation.utilisation_stats(labelled(spark, sf)),
                   "min_pct", "mean_pct", "max_pct", "std_pct")


@register("limit_checks", query(
    "SELECT name, CASE WHEN max_pct <= 100 THEN 'PASS' ELSE 'FAIL' END AS result FROM ("
    + UTILISATION_SQL + ")", "labelled", "fit"))
def limit_checks(spark, sf):
    return validation.limit_checks(labelled(spark, sf))


@register("label_integrity", query(f"""
SELECT {count_sql("rank_ = 1", "selected_rows")}, count(DISTINCT event_id) AS events,
       CASE WHEN bool_and(rank_ IS DISTINCT FROM 1 OR win = t_score) THEN 'PASS' ELSE 'FAIL' END
       AS gap_zero,
       CASE WHEN bool_and(node_id <> best_id OR rank_ = 1) THEN 'PASS' ELSE 'FAIL' END
       AS winner_rank_one,
       CASE WHEN bool_and(NOT feasible OR rank_ IS NOT NULL) THEN 'PASS' ELSE 'FAIL' END
       AS no_null_rank FROM labelled""", "labelled"))
def label_integrity(spark, sf):
    return validation.label_integrity(labelled(spark, sf))


@register("gini", query(" UNION ALL ".join(f"""
SELECT '{name}' AS name, round_even(g, 6) AS gini, g > 0.8e0 AS dominant FROM (
  SELECT (count(*) + 1 - 2e0 * sum(v * (n_all + 1 - i)) / sum(v)) / count(*) AS g FROM (
    SELECT abs({SQL_OF[name]}) AS v, row_number() OVER (ORDER BY abs({SQL_OF[name]})) AS i,
           count(*) OVER () AS n_all FROM labelled))""" for name in DOMINANCE_FEATURES),
                        "labelled"))
def gini(spark, sf):
    return rounded(validation.gini(labelled(spark, sf), DOMINANCE_FEATURES), "gini")


@register("constant_features", query(" UNION ALL ".join(
    f"SELECT '{name}' AS name, count(DISTINCT {SQL_OF[name]}) <= 1 AS constant FROM labelled"
    for name in ANALYSIS_FEATURES), "labelled"))
def constant_features(spark, sf):
    return validation.constant_features(labelled(spark, sf), ANALYSIS_FEATURES)


@register("feature_corr", query("SELECT name, round_even(corr, 6) AS corr FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS name, corr({SQL_OF[name]}, t_score) AS corr FROM labelled"
        for name in ANALYSIS_FEATURES)
    + ") WHERE corr IS NOT NULL AND NOT isnan(corr)"
      " ORDER BY round_even(abs(corr), 9) DESC, name DESC LIMIT 10", "labelled"))
def feature_corr(spark, sf):
    return rounded(validation.target_correlations(labelled(spark, sf), ANALYSIS_FEATURES), "corr")


def _pairs_sql():
    cells = []
    for i, a in enumerate(ANALYSIS_FEATURES):
        for b in ANALYSIS_FEATURES[i + 1:]:
            cells.append(f"{{'a': '{a}', 'b': '{b}', 'corr': abs(corr({a}, {b}))}}")
    columns = ", ".join(f"{SQL_OF[c]} AS {c}" for c in ANALYSIS_FEATURES)
    return query(f"""
SELECT r.a AS a, r.b AS b, round_even(r.corr, 5) AS corr
FROM (SELECT unnest([{', '.join(cells)}]) AS r FROM (SELECT {columns} FROM labelled))
WHERE r.corr >= 0.95e0 AND NOT isnan(r.corr)""", "labelled")


@register("corr_pairs", _pairs_sql())
def corr_pairs(spark, sf):
    return rounded(validation.correlated_pairs(labelled(spark, sf), ANALYSIS_FEATURES), "corr",
                   digits=5).drop("place")


@register("corr_pairs_top", f"""
SELECT place, a, b, corr FROM (
  SELECT row_number() OVER (ORDER BY strength DESC, a DESC, b DESC) AS place, * FROM (
    {_pairs_sql().replace("round_even(r.corr, 5) AS corr",
                          "round_even(r.corr, 5) AS corr, round(r.corr, 9) AS strength")}))
WHERE place <= 10""")
def corr_pairs_top(spark, sf):
    """The ten strongest pairs with their place."""
    return rounded(validation.correlated_pairs(labelled(spark, sf), ANALYSIS_FEATURES, k=10),
                   "corr", digits=5)


@register("dataset_size", query(f"""
SELECT count(*) AS row_count, count(DISTINCT event_id) AS events,
       {count_sql("feasible", "feasible_rows")}, {count_sql("NOT feasible", "infeasible_rows")}
FROM labelled""", "labelled"))
def dataset_size(spark, sf):
    return validation.dataset_size(labelled(spark, sf))


# Quality of the heuristic as a prediction of the teacher score.

@register("regression_metrics", query("""
SELECT round_even(avg(abs(e)), 6) AS mae, round_even(sqrt(avg(e * e)), 6) AS rmse,
       round_even(median(abs(e)), 6) AS median_absolute_error,
       round_even(avg(abs(e) / abs(y)) FILTER (y <> 0), 6) AS mape,
       round_even(1 - avg(e * e) / var_pop(y), 6) AS r2,
       round_even(1 - var_pop(e) / var_pop(y), 6) AS explained_variance
FROM (SELECT t_score AS y, t_score - heur AS e FROM fit)""", "fit"))
def regression_metrics(spark, sf):
    metrics = evaluation.regression_metrics(scored_pairs(spark, sf))
    return rounded(metrics, *metrics.columns)


BAND_SQL = "CASE " + " ".join(
    f"WHEN t_score >= {low} AND t_score < {high} THEN '{name}'"
    for name, low, high in SCORE_BANDS) + " END"


@register("band_mae", query(f"""
SELECT {BAND_SQL} AS band, count(*) AS n, round_even(avg(abs(t_score - heur)), 6) AS mae
FROM fit WHERE {BAND_SQL} IS NOT NULL GROUP BY 1""", "fit"))
def band_mae(spark, sf):
    return rounded(evaluation.band_mae(scored_pairs(spark, sf)), "mae")


@register("winner_accuracy", query("""
SELECT count(*) AS events, round_even(avg(CAST(place = 1 AS DOUBLE)), 6) AS winner_accuracy,
       round_even(avg(CAST(place <= 3 AS DOUBLE)), 6) AS top3_accuracy
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY heur DESC, node_id) AS place
      FROM fit) WHERE rank_ = 1""", "fit"))
def winner_accuracy(spark, sf):
    return rounded(evaluation.winner_accuracy(scored_pairs(spark, sf)),
                   "winner_accuracy", "top3_accuracy")


RANKED_SQL = """
SELECT event_id, node_id,
       rank() OVER (PARTITION BY event_id ORDER BY t_score)
       + (count(*) OVER (PARTITION BY event_id, t_score) - 1) / 2e0 AS rank_teacher_score,
       rank() OVER (PARTITION BY event_id ORDER BY heur)
       + (count(*) OVER (PARTITION BY event_id, heur) - 1) / 2e0 AS rank_pred FROM {source}"""


@register("mean_spearman", query(f"""
SELECT round_even(avg(r), 6) AS mean_spearman, count(r) AS events_defined,
       CAST(sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS events_undefined
FROM (SELECT event_id, CASE WHEN var_pop(rank_teacher_score) > 0 AND var_pop(rank_pred) > 0
      THEN corr(rank_teacher_score, rank_pred) END AS r
      FROM ({RANKED_SQL.format(source='fit')}) GROUP BY 1)""", "fit"))
def mean_spearman(spark, sf):
    per_event = evaluation.event_spearman(scored_pairs(spark, sf))
    return rounded(evaluation.mean_defined(per_event, "spearman", "mean_spearman"),
                   "mean_spearman")


@register("mean_kendall", query("""
SELECT round_even(avg(tau), 6) AS mean_kendall, count(tau) AS events_defined,
       CAST(count(*) - count(tau) AS BIGINT) AS events_undefined FROM (
  SELECT event_id, CASE WHEN sum(sx * sx) > 0 AND sum(sy * sy) > 0
         THEN sum(sx * sy) / sqrt(CAST(sum(sx * sx) AS DOUBLE) * sum(sy * sy)) END AS tau
  FROM (SELECT a.event_id, sign(a.t_score - b.t_score) AS sx, sign(a.heur - b.heur) AS sy
        FROM fit a JOIN fit b ON a.event_id = b.event_id AND a.node_id <= b.node_id)
  GROUP BY 1)""", "fit"))
def mean_kendall(spark, sf):
    per_event = evaluation.event_kendall(scored_pairs(spark, sf))
    return rounded(evaluation.mean_defined(per_event, "kendall", "mean_kendall"), "mean_kendall")


COUNTERS_SQL = f"""
SELECT count(*) AS score_requests_total,
       {count_sql("event_type = 'error'", "score_fallback_total")},
       round_even(avg(value), 6) AS score_latency_ms_avg FROM events"""


@register("request_counters", query(COUNTERS_SQL))
def request_counters(spark, sf):
    return rounded(decisions.request_counters(fleet.request_log(spark, sf)),
                   "score_latency_ms_avg")


LOAD_SQL = """
SELECT {group}count(*) AS sent,
       CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS success,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
       round_even(avg(value), 6) AS avg_latency_ms"""


@register("load_stats", query(f"""
SELECT *, round_even(sent / elapsed_sec, 9) AS rps FROM (
  {LOAD_SQL.format(group="user_id AS node_id, ")},
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_sec FROM events GROUP BY 1)"""))
def load_stats(spark, sf):
    stats = decisions.load_stats(fleet.request_log(spark, sf), ["node_id"])
    return rounded(rounded(stats, "avg_latency_ms"), "rps", digits=9)


@register("pod_map", query("""
SELECT CASE WHEN o_orderstatus = 'P' THEN 'node-' || o_orderkey % 97 ELSE 'pending' END AS node,
       count(*) AS pods, min(o_orderkey) AS first_pod, max(o_orderkey) AS last_pod
FROM orders GROUP BY 1"""))
def pod_map(spark, sf):
    return decisions.pod_map(fleet.pods(spark, sf))


@register("pod_map_rows", query("""
SELECT CASE WHEN o_orderstatus = 'P' THEN 'node-' || o_orderkey % 97 ELSE 'pending' END AS node,
       o_orderkey AS pod_id, CASE WHEN o_orderstatus = 'F' THEN 'Succeeded' ELSE 'Pending' END AS phase,
       o_orderdate >= (SELECT max(o_orderdate) - INTERVAL '30 days' FROM orders) AS is_new
FROM orders"""))
def pod_map_rows(spark, sf):
    """Against a snapshot of thirty days before the newest arrival."""
    pods = fleet.pods(spark, sf)
    border = pods.select((F.max("arrival_ts") - F.expr("INTERVAL '30' DAY")).alias("t")).scalar()
    return decisions.pod_map_rows(pods, pods.where(F.col("arrival_ts") < border))


@register("determinism_check", query("""
SELECT count(*) AS inputs, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous
FROM (SELECT cluster_size, alloc_cpu, alloc_mem, used_cpu, used_mem, pods, req_cpu, req_mem,
             count(DISTINCT heur) AS n FROM pair_t GROUP BY ALL)""", "pair_t"))
def determinism_check(spark, sf):
    from mooring.functions.features import derive
    from mooring.operators.candidates import candidates
    pairs = derive(candidates(fleet.pods(spark, sf), fleet.nodes(spark, sf)))
    scored = pairs.withColumn("score", scoring.heuristic_score())
    return validation.is_deterministic(scored, FEATURES, "score")


@register("bounds_check", query("""
SELECT bool_and(t_score BETWEEN 0 AND 100) AS teacher_score_in_bounds,
       bool_and(heur BETWEEN 0 AND 100) AS pred_in_bounds FROM labelled""", "labelled"))
def bounds_check(spark, sf):
    scored = labelled(spark, sf).withColumn("pred", scoring.heuristic_score())
    return validation.bounds_check(scored, ["teacher_score", "pred"])
