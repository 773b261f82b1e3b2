"""Best nodes, teacher ranks and comparisons of two scorers."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mooring.constants import MIN_ACCEPTABLE_SCORE
from mooring.operators.candidates import EVENT, event_keys


def best_node(scored: DataFrame, score="score", threshold=MIN_ACCEPTABLE_SCORE) -> DataFrame:
    """Argmax per event with the size of the preferred set.

    Candidates at or above the threshold always contain the argmax, so the
    threshold only shows in n_preferred and least_bad. Partial aggregation
    shrinks each event to one row per task before any exchange.
    """
    key = F.min(F.struct((-F.col(score)).alias("order"), F.col("node_id")))
    picked = scored.groupBy(EVENT).agg(
        key.alias("best"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.sum(F.when(F.col(score) >= threshold, 1).otherwise(0)).alias("n_preferred"),
    )
    return picked.select(
        EVENT,
        F.col("best.node_id").alias("best_node_id"),
        (-F.col("best.order")).alias("best_score"),
        "n_candidates", "n_preferred",
        (F.col("n_preferred") == 0).alias("least_bad"),
    )


def rank_labels(scored: DataFrame) -> DataFrame:
    """Rank, winner, selection and gap of every candidate; one window, one sort.

    Input: feasible, teacher_score. Events without a feasible node give no
    signal and are dropped.
    """
    by_score = Window.partitionBy(*event_keys(scored)).orderBy(
        F.col("feasible").desc(), F.col("teacher_score").desc(), F.col("node_id"))
    ranked = scored.withColumns({
        "_place": F.row_number().over(by_score),
        "_any": F.first("feasible").over(by_score),
        "best_node_id": F.first("node_id").over(by_score),
        "winner_score": F.first("teacher_score").over(by_score),
        **({"best_node_label": F.first("node_label").over(by_score)}
           if "node_label" in scored.columns else {}),
    })
    return ranked.where("_any").withColumns({
        "teacher_rank": F.when(F.col("feasible"), F.col("_place")),
        "selected_by_scheduler": F.when(F.col("_place") == 1, 1).otherwise(0),
        "score_gap_from_best": F.col("winner_score") - F.col("teacher_score"),
    }).drop("_place", "_any")


def top_k(scored: DataFrame, k: int, score="pred") -> DataFrame:
    """Best k candidates per event with their place."""
    order = Window.partitionBy(*event_keys(scored)).orderBy(F.col(score).desc(), F.col("node_id"))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def cross_rank(scored: DataFrame, threshold=None) -> DataFrame:
    """Place and gap, in teacher order, of the node the model picks.

    One row per event: both picks, model_rank, score_gap, and whether the
    picked node lacks free capacity.
    """
    event = Window.partitionBy(*event_keys(scored))
    teacher = event.orderBy(F.col("teacher_score").desc(), F.col("node_id"))
    ranked = scored.withColumn("_rank", F.row_number().over(teacher))
    order = [(-F.col("pred")).alias("p"), F.col("node_id")]
    if threshold is not None:
        order = [F.when(F.col("pred") >= threshold, 0).otherwise(1).alias("t")] + order
    pick = F.min(F.struct(*order, F.col("_rank").alias("rank"), F.col("teacher_score").alias("s"),
                          F.col("feasible").alias("fits")))
    return ranked.groupBy(*event_keys(scored)).agg(
        pick.alias("model"),
        F.min(F.struct("_rank", "node_id")).alias("teacher"),
        F.max("teacher_score").alias("best"),
    ).select(
        EVENT,
        F.col("teacher.node_id").alias("teacher_node_id"),
        F.col("model.node_id").alias("model_node_id"),
        F.col("model.rank").alias("model_rank"),
        (F.col("best") - F.col("model.s")).alias("score_gap"),
        (~F.col("model.fits")).alias("capacity_violation"),
    )


def average_ranks(scored: DataFrame, columns) -> DataFrame:
    """Average ranks with ties, per event, as rank_<column>; one window a column.

    Equal values hold the places from their rank to the rows counted up to them, which a window over
    the same order gives in the same pass.
    """
    out = scored
    for name in columns:
        order = Window.partitionBy(*event_keys(scored)).orderBy(name)
        through = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(
            f"rank_{name}", (F.rank().over(order) + F.count(F.lit(1)).over(through)) / F.lit(2.0))
    return out


def rises(scored: DataFrame, group, by: str, score: str, tolerance=1.0) -> DataFrame:
    """Steps where the score rises by more than tolerance while `by` grows."""
    group = [group] if isinstance(group, str) else list(group)
    order = Window.partitionBy(*group).orderBy(by, score)
    return scored.withColumn("previous_score", F.lag(score).over(order)).where(
        F.col(score) > F.col("previous_score") + tolerance)


def orders_agree(scored: DataFrame) -> DataFrame:
    """Per event: both scorers list the nodes in the same order.

    The lists are equal exactly when every node holds the same place in both,
    so no list is ever collected.
    """
    event = Window.partitionBy(*event_keys(scored))
    teacher = event.orderBy(F.col("teacher_score").desc(), F.col("node_id"))
    model = event.orderBy(F.col("pred").desc(), F.col("node_id"))
    placed = scored.withColumn("_t", F.row_number().over(teacher)).withColumn(
        "_m", F.row_number().over(model))
    return placed.groupBy(*event_keys(scored)).agg(
        F.bool_and(F.col("_t") == F.col("_m")).alias("same_order")).select(EVENT, "same_order")


def agreement(scored: DataFrame) -> DataFrame:
    """Share of events in which both scorers pick the same node."""
    picks = scored.groupBy(EVENT).agg(
        F.min(F.struct((-F.col("teacher_score")).alias("s"), F.col("node_id"))).alias("t"),
        F.min(F.struct((-F.col("pred")).alias("s"), F.col("node_id"))).alias("m"),
    )
    same = F.when(F.col("t.node_id") == F.col("m.node_id"), 1).otherwise(0)
    return picks.agg(F.count(F.lit(1)).alias("events"), F.sum(same).alias("matches"),
                     F.avg(same.cast("double")).alias("agreement"))
