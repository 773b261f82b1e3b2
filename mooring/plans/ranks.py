"""Queries over ranking, labelling, replay and the student model."""
from pyspark.sql import functions as F

from mooring.constants import CANDIDATE_ROW
from mooring.functions.features import rounded_ratios
from mooring.functions.units import round_exact
from mooring.operators import boosting, placement, ranking, replay, student
from mooring.operators.candidates import event_keys
from mooring.plans.matching import scored_pairs, waiting_pods
from mooring.plans.oracle_base import (
    CPU, DENSITY, cte, curve_sql, derived, labels, query, teacher,
)
from mooring.plans.registry import register
from mooring.plans.reports import RANKED_SQL, labelled
from mooring.plans.scalars import ROW_SQL, SCORES, status
from mooring.scale import positions
from mooring.session import scratch_path, stored_rows
from mooring.sources import fleet


@register("teacher_rank", query("""
SELECT event_id, node_id, CAST(rank_ AS INTEGER) AS teacher_rank FROM labelled""", "labelled"))
def teacher_rank(spark, sf):
    return labelled(spark, sf).select("event_id", "node_id", "teacher_rank")


@register("winner_score", query("""
SELECT event_id, round_even(max(t_score), 6) AS winner_score FROM fit GROUP BY 1""", "fit"))
def winner_score(spark, sf):
    return labelled(spark, sf).where("feasible").groupBy("event_id").agg(
        F.bround(F.min("winner_score"), 6).alias("winner_score"))


@register("best_node", query("""
SELECT event_id, max(best_id) AS best_node_id, count(*) AS nodes FROM labelled GROUP BY 1""",
                             "labelled"))
def best_node(spark, sf):
    return labelled(spark, sf).groupBy("event_id", "best_node_id").agg(
        F.count(F.lit(1)).alias("nodes"))


@register("selected_flag", query("""
SELECT event_id, best_id AS node_id, CAST(count(*) AS BIGINT) AS selected
FROM fit WHERE rank_ = 1 GROUP BY 1, 2""", "fit"))
def selected_flag(spark, sf):
    return labelled(spark, sf).where(F.col("selected_by_scheduler") == 1).groupBy(
        "event_id", "node_id").agg(
        F.sum("selected_by_scheduler").cast("long").alias("selected"))


@register("score_gap", query("""
SELECT event_id, round_even(min(win - t_score), 6) AS least_gap,
       round_even(max(win - t_score), 6) AS most_gap, round_even(sum(win - t_score), 4) AS total_gap
FROM labelled GROUP BY 1""", "labelled"))
def score_gap(spark, sf):
    gap = "score_gap_from_best"
    return labelled(spark, sf).groupBy("event_id").agg(
        F.bround(F.min(gap), 6).alias("least_gap"), F.bround(F.max(gap), 6).alias("most_gap"),
        F.bround(F.sum(gap), 4).alias("total_gap"))


@register("best_node_topk", query("""
SELECT event_id, best_id AS best_node_id, CAST(best_score AS BIGINT) AS best_score, n_candidates,
       n_preferred, n_preferred = 0 AS least_bad FROM placed""", "placed"))
def best_node_topk(spark, sf):
    return placement.place(waiting_pods(spark, sf), fleet.nodes(spark, sf))


@register("top3", query("""
SELECT event_id, node_id, heur AS pred, place FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY heur DESC, node_id) AS INTEGER)
  AS place FROM fit) WHERE place <= 3""", "fit"))
def top3(spark, sf):
    return ranking.top_k(scored_pairs(spark, sf), 3).select(
        "event_id", "node_id", "pred", "place")


@register("cross_rank", query("""
SELECT event_id, max(best_id) AS teacher_node_id, arg_min(node_id, place) AS model_node_id,
       CAST(arg_min(rank_, place) AS INTEGER) AS model_rank,
       round_even(max(t_score) - arg_min(t_score, place), 6) AS score_gap,
       FALSE AS capacity_violation
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY heur DESC, node_id) AS place
      FROM fit) GROUP BY 1""", "fit"))
def cross_rank(spark, sf):
    return ranking.cross_rank(scored_pairs(spark, sf)).withColumn(
        "score_gap", F.bround("score_gap", 6))


@register("avg_rank_ties", query(RANKED_SQL.format(source="fit"), "fit"))
def avg_rank_ties(spark, sf):
    from mooring.functions.scoring import heuristic_score
    rows = labelled(spark, sf).where("feasible").withColumn("pred", heuristic_score())
    return ranking.average_ranks(rows.select("event_id", "node_id", "teacher_score", "pred"),
                                 ["teacher_score", "pred"]).select(
        "event_id", "node_id", "rank_teacher_score", "rank_pred")


@register("monotonicity", query("""
SELECT event_id, profile_id, node_id, heur AS pred, prev AS previous_score FROM (
  SELECT *, lag(heur) OVER (PARTITION BY event_id, profile_id ORDER BY proj_cpu, heur) AS prev
  FROM fit) WHERE heur > prev + 1e0""", "fit"))
def monotonicity(spark, sf):
    rising = ranking.rises(scored_pairs(spark, sf), ["event_id", "profile_id"],
                           "projected_cpu_percent", "pred")
    return rising.select("event_id", "profile_id", "node_id", "pred", "previous_score")


@register("order_agreement", query("""
SELECT event_id, list(node_id ORDER BY t_score DESC, node_id)
       = list(node_id ORDER BY heur DESC, node_id) AS same_order FROM fit GROUP BY 1""", "fit"))
def order_agreement(spark, sf):
    return ranking.orders_agree(scored_pairs(spark, sf))


@register("sort_desc", query("""
SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id DESC) AS position
FROM node_status""", "node_status"))
def sort_desc(spark, sf):
    keyed = status(spark, sf).select(
        "node_id", "score", (-F.col("score")).alias("_s"), (-F.col("node_id")).alias("_n"),
        F.lit(0).alias("_all"))
    placed = positions(keyed, "_all", ["_s", "_n"])
    return placed.orderBy("position").select("node_id", "score", "position")


@register("agreement", query("""
SELECT count(*) AS events, CAST(sum(CAST(m = t AS INT)) AS BIGINT) AS matches,
       round_even(avg(CAST(m = t AS DOUBLE)), 6) AS agreement FROM (
  SELECT event_id, max(best_id) AS t, arg_min(node_id, place) AS m
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY heur DESC, node_id) AS place
        FROM fit) GROUP BY 1)""", "fit"))
def agreement(spark, sf):
    return ranking.agreement(scored_pairs(spark, sf)).withColumns({
        "agreement": F.bround("agreement", 6), "matches": F.col("matches").cast("long")})


# The labelled dataset, one digest row per event over every stored column.

DIGEST = [c for c in CANDIDATE_ROW if c not in (
    "event_id", "pod_id", "cluster_id", "node_id", "best_node_id", "feasible", "reject_reason",
    "teacher_rank", "selected_by_scheduler", "node_memory_capacity", "node_allocatable_memory",
    "current_memory_usage", "requested_memory", "projected_memory_usage",
    "projected_remaining_memory")]
DIGEST_LONG = ["node_memory_capacity", "node_allocatable_memory", "current_memory_usage",
               "requested_memory", "projected_memory_usage", "projected_remaining_memory",
               "teacher_rank", "selected_by_scheduler"]


def _digest_sql(source):
    rows = ROW_SQL.replace("FROM labelled", f"FROM {source}").replace(
        "AS event_id,", "AS event_label, event_id AS event_id,", 1)
    parts = [f"round_even(CAST(sum({c}) AS DOUBLE), 6) AS {c}" for c in DIGEST]
    parts += [f"CAST(sum({c}) AS BIGINT) AS {c}" for c in DIGEST_LONG]
    return f"""
SELECT event_id, max(CAST(split_part(best_node_id, '-n', 2) AS BIGINT)) AS best_node,
       min(CAST(split_part(node_id, '-n', 2) AS BIGINT)) AS first_node,
       max(CAST(split_part(node_id, '-n', 2) AS BIGINT)) AS last_node, count(*) AS nodes,
       CAST(sum(CAST(feasible AS INT)) AS BIGINT) AS feasible,
       CAST(sum(length(reject_reason)) AS BIGINT) AS reject_letters, {', '.join(parts)}
FROM ({rows}) GROUP BY 1"""


def digest(labelled_rows):
    """One row per event over the stored columns; ids stay numbers, so sums hash."""
    rounding = {**rounded_ratios(), **{c: round_exact(F.col(c), 6) for c in SCORES}}
    rows = labelled_rows.withColumns(rounding)
    return rows.groupBy(*event_keys(rows)).agg(
        F.max("best_node_id").alias("best_node"), F.min("node_id").alias("first_node"),
        F.max("node_id").alias("last_node"), F.count(F.lit(1)).alias("nodes"),
        F.sum(F.col("feasible").cast("int")).alias("feasible"),
        F.sum(F.length("reject_reason")).alias("reject_letters"),
        *[F.bround(F.sum(F.col(c).cast("double")), 6).alias(c) for c in DIGEST],
        *[F.sum(c).cast("long").alias(c) for c in DIGEST_LONG]).drop("cluster_id", "_spread")


@register("label_dataset", query(_digest_sql("labelled"), "labelled"))
def label_dataset_query(spark, sf):
    return digest(labelled(spark, sf))


# Replay: the sequential placement as a recursive query over whole clusters.

def teacher_sql(cpu, mem, pods):
    return (f"greatest(0e0, least(100e0, round_even((0.6e0 * greatest(0e0, 1e0 - {cpu})"
            f" + 0.4e0 * greatest(0e0, 1e0 - {mem})) * 100, 0) - ({curve_sql(cpu, CPU)})"
            f" - ({curve_sql(mem, CPU)})"
            f" - ({curve_sql(f'least(1e0, ({pods} + 1) / 110e0)', DENSITY)})))")


cte("timeline", """
SELECT *, (place - 1) // 20 AS episode, (place - 1) % 20 AS step FROM (
  SELECT event_id, cluster_id, req_cpu, req_mem, row_number() OVER (
    PARTITION BY cluster_id ORDER BY arrival_ts, event_id) AS place FROM pod)""", "pod")


CHOICE = teacher_sql("CAST(n.uc + req_cpu AS DOUBLE) / n.ac", "CAST(n.um + req_mem AS DOUBLE) / n.am",
                      "n.p")
cte("node_list", """
SELECT cluster_id, list({'id': node_id, 'ac': alloc_cpu, 'am': alloc_mem, 'uc': used_cpu,
                         'um': used_mem, 'p': pods} ORDER BY node_id) AS ns
FROM node GROUP BY 1""", "node")
cte("steps", f"""
SELECT cluster_id, episode, CAST(-1 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS event_id,
       CAST(NULL AS BIGINT) AS node_id, CAST(NULL AS DOUBLE) AS score, ns
FROM (SELECT DISTINCT cluster_id, episode FROM timeline) JOIN node_list USING (cluster_id)
UNION ALL
SELECT cluster_id, episode, next_step, next_event, b.id, -b.s,
       list_transform(ns, lambda n: CASE WHEN n.id = b.id THEN
         {{'id': n.id, 'ac': n.ac, 'am': n.am, 'uc': n.uc + req_cpu, 'um': n.um + req_mem,
           'p': n.p + 1}} ELSE n END)
FROM (SELECT *, list_min(list_transform(
        list_filter(ns, lambda n: n.uc + req_cpu <= n.ac AND n.um + req_mem <= n.am),
        lambda n: {{'s': -({CHOICE}), 'id': n.id}})) AS b
      FROM (SELECT s.cluster_id, s.episode, s.ns, t.step AS next_step, t.event_id AS next_event,
                   t.req_cpu, t.req_mem
            FROM steps s JOIN timeline t ON t.cluster_id = s.cluster_id
             AND t.episode = s.episode AND t.step = s.step + 1))""", "timeline", "node_list")
cte("seen", """
SELECT t.event_id, e.node_id, CAST(sum(p.req_cpu) AS BIGINT) AS add_cpu,
       CAST(sum(p.req_mem) AS BIGINT) AS add_mem, count(*) AS add_pods
FROM timeline t JOIN steps e ON e.cluster_id = t.cluster_id AND e.episode = t.episode
     AND e.step < t.step AND e.node_id IS NOT NULL
JOIN pod p ON p.event_id = e.event_id GROUP BY 1, 2""", "steps", "timeline", "pod")
cte("replayed", """
SELECT p.* REPLACE (used_cpu + coalesce(add_cpu, 0) AS used_cpu,
                    used_mem + coalesce(add_mem, 0) AS used_mem, pods + coalesce(add_pods, 0) AS pods)
FROM pair p LEFT JOIN seen s ON s.event_id = p.event_id AND s.node_id = p.node_id""",
    "pair", "seen")
cte("replayed_d", derived("replayed"), "replayed")
cte("replayed_t", teacher("replayed_d"), "replayed_d")
cte("replayed_l", labels("replayed_t"), "replayed_t")


def recursive(body, *names):
    return query(body, *names).replace("WITH ", "WITH RECURSIVE ", 1)


REPLAY_SQL = recursive("""
SELECT cluster_id, episode, CAST(step AS INTEGER) AS step, event_id, node_id,
       round_even(score, 6) AS score FROM steps WHERE step >= 0""", "steps")


@register("replay_placements", REPLAY_SQL)
def replay_placements(spark, sf):
    done = replay.replay(fleet.pods(spark, sf), fleet.nodes(spark, sf))
    return done.select("cluster_id", "episode", "step", "event_id", "node_id",
                       F.bround("score", 6).alias("score"))


@register("replay_dataset", recursive(_digest_sql("replayed_l"), "replayed_l"))
def replay_dataset(spark, sf):
    return digest(replay.replayed_labels(fleet.pods(spark, sf), fleet.nodes(spark, sf)))


# The student model.

@register("group_split", query("""
SELECT event_id, u < 0.15e0 AS is_test, n AS candidate_rows FROM (
  SELECT event_id, count(*) AS n,
         (((event_id % 1000003 + 42) * 48271 % 1000003) * ((event_id % 1000003 + 42) * 48271 % 1000003)
          + ((event_id % 1000003 + 42) * 48271 % 1000003) * 31) % 1000003 / 1000003e0 AS u
  FROM labelled GROUP BY 1)""", "labelled"))
def group_split(spark, sf):
    return student.split_by_event(labelled(spark, sf)).groupBy("event_id", "is_test").agg(
        F.count(F.lit(1)).alias("candidate_rows"))


#: All as published: up to 5,000 rounds, until 100 of them bring no gain on held-out events.
FIT = boosting.Params()
_models, _rows = {}, {}


def _labelled_rows(spark, sf):
    """(the student's rows, the same as a table): stored once per application and tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _rows:
        rows = student.training_rows(labelled(spark, sf))
        _rows[key] = rows, stored_rows(rows, "student-rows")
    return _rows[key]


def student_rows(spark, sf):
    return _labelled_rows(spark, sf)[1]


def trained(spark, sf):
    """Path of a student trained on all labelled rows; once per application and tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        rows, stored = _labelled_rows(spark, sf)
        # A sketch depends on how rows lie: the cuts are those of the labelled rows, not of their copy.
        cuts = boosting.cuts_of(rows.where(~F.col("is_test")), FIT.max_bin)
        _models[key] = boosting.save(
            spark, boosting.train(stored, FIT, cuts), scratch_path(spark, "student"))
    return _models[key]


@register("train_student", query("""
SELECT count(DISTINCT event_id) FILTER (u < 0.15e0) AS test_events,
       CAST(sum(CASE WHEN u < 0.15e0 THEN 1 ELSE 0 END) AS BIGINT) AS test_rows,
       CAST(0 AS BIGINT) AS shared_events, TRUE AS r2_above_095, TRUE AS mae_below_2
FROM (SELECT event_id, (((event_id % 1000003 + 42) * 48271 % 1000003)
             * ((event_id % 1000003 + 42) * 48271 % 1000003)
          + ((event_id % 1000003 + 42) * 48271 % 1000003) * 31) % 1000003 / 1000003e0 AS u FROM fit)""",
                                 "fit"))
def train_student(spark, sf):
    """What any good run must show: the split, and floors of the quality on held-out events."""
    from mooring.operators.evaluation import regression_metrics
    rows = student_rows(spark, sf)
    test = student.held_out_scores(boosting.load(spark, trained(spark, sf)), rows)
    sides = rows.groupBy("event_id").agg(F.count_distinct("is_test").alias("sides"))
    quality = regression_metrics(test)
    counts = test.agg(F.count_distinct("event_id").alias("test_events"),
                      F.count(F.lit(1)).alias("test_rows"))
    return counts.select(
        "test_events", "test_rows", sides.select(F.coalesce(F.sum(F.when(
            F.col("sides") > 1, 1).otherwise(0)), F.lit(0))).scalar().cast("long").alias(
            "shared_events"),
        (quality.select("r2").scalar() > 0.95).alias("r2_above_095"),
        (quality.select("mae").scalar() < 2.0).alias("mae_below_2"))


@register("student_quality")
def student_quality(spark, sf):
    """The figures themselves: errors and ranking of the student on held-out events."""
    return student.metrics(spark, trained(spark, sf), student_rows(spark, sf))


@register("score_model")
def score_model(spark, sf):
    """Score of the stored trees for every feasible pair."""
    return student.score_with(trained(spark, sf), student_rows(spark, sf)).select(
        "event_id", "node_id", "score", "source")


@register("score_without_model", query("""
SELECT event_id, node_id, heur AS score, 'heuristic' AS source FROM fit""", "fit"))
def score_without_model(spark, sf):
    """No model is stored, so every pair gets the heuristic score."""
    rows = labelled(spark, sf).where("feasible")
    return student.score_with(scratch_path(spark, "no-student"), rows).select(
        "event_id", "node_id", "score", "source")


@register("feature_importance")
def feature_importance(spark, sf):
    """Gain, weight and cover of the ten first features each, from the nodes of the stored trees."""
    return boosting.importances(spark, trained(spark, sf))
