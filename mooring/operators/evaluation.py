"""Regression and ranking quality of predictions against teacher labels."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mooring.constants import (
    SCORE_BANDS, VERDICT_AVG_GAP, VERDICT_AVG_RANK, VERDICT_EXACT_MATCH_PCT,
)
from mooring.operators.candidates import EVENT, event_keys
from mooring.operators.ranking import average_ranks
from mooring.scale import exact_median, with_scalar


def regression_metrics(rows: DataFrame, label="teacher_score", pred="pred") -> DataFrame:
    """MAE, RMSE, median error, MAPE over non-zero labels, R2, explained variance."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    error = y - p
    pairs = rows.select(y.alias("y"), error.alias("e"), F.abs(error).alias("a"))
    sums = pairs.agg(
        F.avg("a").alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.coalesce(F.avg(F.when(F.col("y") != 0, F.col("a") / F.abs("y"))),
                   F.lit(0.0)).alias("mape"),
        (1 - F.try_divide(F.avg(F.col("e") * F.col("e")), F.var_pop("y"))).alias("r2"),
        (1 - F.try_divide(F.var_pop("e"), F.var_pop("y"))).alias("explained_variance"),
    )
    return with_scalar(sums, exact_median(pairs, "a", "median"), "median_absolute_error")


def band_mae(rows: DataFrame, label="teacher_score", pred="pred") -> DataFrame:
    """Rows and MAE per label band [low, high); the top value is in none."""
    y = F.col(label)
    band = None
    for name, low, high in SCORE_BANDS:
        inside = (y >= low) & (y < high)
        band = F.when(inside, name) if band is None else band.when(inside, name)
    return rows.select(band.alias("band"), F.abs(y - F.col(pred)).alias("a")).where(
        F.col("band").isNotNull()).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("mae"))


def winner_accuracy(rows: DataFrame, pred="pred", k=3) -> DataFrame:
    """Top-1 and top-k hit rates over events that have a selected row."""
    keys = event_keys(rows)
    order = Window.partitionBy(*keys).orderBy(F.col(pred).desc(), F.col("node_id"))
    placed = rows.select(*keys, "node_id", pred, "selected_by_scheduler").withColumn(
        "place", F.row_number().over(order))
    hits = placed.where(F.col("selected_by_scheduler") == 1).select(
        F.when(F.col("place") == 1, 1.0).otherwise(0.0).alias("first"),
        F.when(F.col("place") <= k, 1.0).otherwise(0.0).alias("near"))
    return hits.agg(F.count(F.lit(1)).alias("events"),
                    F.coalesce(F.avg("first"), F.lit(0.0)).alias("winner_accuracy"),
                    F.coalesce(F.avg("near"), F.lit(0.0)).alias("top3_accuracy"))


def event_spearman(rows: DataFrame, x="teacher_score", y="pred") -> DataFrame:
    """Spearman correlation per event; null where a side is constant."""
    keys = event_keys(rows)
    ranked = average_ranks(rows.select(*keys, x, y), [x, y])
    a, b = F.col(f"rank_{x}"), F.col(f"rank_{y}")
    n = F.count(F.lit(1))
    # Ranks are multiples of one half, so these sums are exact.
    cov = n * F.sum(a * b) - F.sum(a) * F.sum(b)
    var_a = n * F.sum(a * a) - F.sum(a) * F.sum(a)
    var_b = n * F.sum(b * b) - F.sum(b) * F.sum(b)
    return ranked.groupBy(*keys).agg(F.when(
        (var_a > 0) & (var_b > 0), cov / F.sqrt(var_a * var_b)).alias("spearman")).select(
        EVENT, "spearman")


def event_pairs(rows: DataFrame, x="teacher_score", y="pred") -> DataFrame:
    """Every pair of an event's rows once: event_id, node_a < node_b, and the signs of both differences.

    An event's rows become one sorted array where they lie, and each of them meets those behind it:
    no join, no exchange of pairs. An array is as long as the event has candidates.
    """
    keys = event_keys(rows)
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "node_id", F.col(x).alias("x"), F.col(y).alias("y")))).alias("_rows"))
    first = listed.select(EVENT, "_rows", F.posexplode("_rows").alias("_at", "a"))
    rest = F.slice("_rows", F.col("_at") + 2, F.size("_rows"))
    pairs = first.select(EVENT, "a", F.explode(rest).alias("b"))
    return pairs.select(
        EVENT, F.col("a.node_id").alias("node_a"), F.col("b.node_id").alias("node_b"),
        F.signum(F.col("a.x") - F.col("b.x")).cast("int").alias("sign_x"),
        F.signum(F.col("a.y") - F.col("b.y")).cast("int").alias("sign_y"))


def pair_counts(rows: DataFrame, x="teacher_score", y="pred") -> DataFrame:
    """Concordant, discordant and tied pairs per event without forming pairs.

    y is replaced by its dense rank in the event. Two different ranks first
    differ in exactly one binary digit, so every pair is met once among rows
    sharing the digits above it. There, running counts in x order give the
    concordant and discordant pairs. Work is rows x digits, not rows squared;
    an event uses the digits of its largest rank.
    """
    keys = event_keys(rows)
    event = Window.partitionBy(*keys)
    by_x, by_y = event.orderBy("x"), event.orderBy("y")
    # Row number minus rank counts the earlier rows with the same value.
    ranked = rows.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).withColumns({
        "r": F.dense_rank().over(by_y) - 1,
        "same_y": F.row_number().over(by_y) - F.rank().over(by_y),
        "same_x": F.row_number().over(by_x) - F.rank().over(by_x),
    }).withColumn("digits", F.length(F.bin(F.max("r").over(event).cast("long"))))
    split = ranked.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("digits") - 1)))
    digit = F.expr("shiftright(r, level) & 1")
    once = F.col("level") == 0
    counted = split.groupBy(*keys, "level", F.expr("shiftright(r, level + 1)").alias("prefix"),
                            "x").agg(
        F.sum(1 - digit).alias("zeros"), F.sum(digit).alias("ones"),
        F.sum(F.when(once, F.col("same_x")).otherwise(0)).alias("same_x"),
        F.sum(F.when(once, F.col("same_y")).otherwise(0)).alias("same_y"),
        F.sum(F.when(once, 1).otherwise(0)).alias("n"))
    before = Window.partitionBy(*keys, "level", "prefix").orderBy("x").rowsBetween(
        Window.unboundedPreceding, -1)
    return counted.select(
        *keys, "n", "same_x", "same_y",
        (F.col("ones") * F.coalesce(F.sum("zeros").over(before), F.lit(0))).alias("agree"),
        (F.col("zeros") * F.coalesce(F.sum("ones").over(before), F.lit(0))).alias("differ"),
    ).groupBy(*keys).agg(
        F.sum("agree").alias("concordant"), F.sum("differ").alias("discordant"),
        F.sum("same_x").alias("tied_x"), F.sum("same_y").alias("tied_y"), F.sum("n").alias("n"))


def event_kendall(rows: DataFrame, x="teacher_score", y="pred") -> DataFrame:
    """Kendall tau-b per event; null where a side is constant."""
    counts = pair_counts(rows, x, y)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    scale = F.sqrt((pairs - F.col("tied_x")) * (pairs - F.col("tied_y")))
    return counts.select(EVENT, F.when(
        scale > 0, (F.col("concordant") - F.col("discordant")) / scale).alias("kendall"))


def mean_defined(per_event: DataFrame, value: str, name: str) -> DataFrame:
    """Mean over events where the value is defined, and how many are not."""
    return per_event.agg(
        F.coalesce(F.avg(value), F.lit(0.0)).alias(name),
        F.count(value).alias("events_defined"),
        F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).alias("events_undefined"),
    )


def scenario_report(picks: DataFrame, by: str = None) -> DataFrame:
    """Agreement per scenario and in total ("OVERALL"), for each value of by, if given, which is never null.

    picks: one row per pod, of `stress.duel`: scenario, step, model_node_id (null: unschedulable),
    teacher_node_id, model_rank, score_gap, capacity_violation. A test begins with step 0.
    """
    placed = F.col("model_node_id").isNotNull()
    exact = F.col("model_node_id") == F.col("teacher_node_id")

    def count_if(condition):
        return F.sum(F.when(condition, 1).otherwise(0))

    placements = count_if(placed)
    report = picks.rollup(*([by] if by else []), "scenario").agg(
        count_if(F.col("step") == 0).alias("tests"),
        F.count(F.lit(1)).alias("total_pods"),
        placements.alias("successful_placements"),
        count_if(~placed).alias("unschedulable"),
        count_if(F.col("capacity_violation")).alias("capacity_violations"),
        (100.0 * placements / F.count(F.lit(1))).alias("success_pct"),
        F.try_divide(100.0 * count_if(exact), placements).alias("exact_match_pct"),
        F.avg("model_rank").alias("avg_rank"),
        F.avg("score_gap").alias("avg_gap"),
        F.max("score_gap").alias("max_gap"),
        count_if(~exact).alias("non_optimal_picks"),
        count_if(F.col("model_rank") > 1).alias("rank_above_one"),
    ).withColumn("scenario", F.coalesce("scenario", F.lit("OVERALL")))
    return report.where(F.col(by).isNotNull()) if by else report


def verdict(report: DataFrame) -> DataFrame:
    """FAIL on violations, PASS within all floors or with nothing placed, else REVIEW."""
    c = F.col
    good = ((c("exact_match_pct") >= VERDICT_EXACT_MATCH_PCT)
            & (c("avg_rank") <= VERDICT_AVG_RANK) & (c("avg_gap") <= VERDICT_AVG_GAP))
    return report.withColumn(
        "verdict",
        F.when(c("capacity_violations") > 0, "FAIL")
        .when(c("successful_placements") == 0, "PASS")
        .when(good, "PASS").otherwise("REVIEW"))
