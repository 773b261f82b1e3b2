"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query is
computed in full and thrown away, after a warm-up of each on the smallest
tables, which compiles its code.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "label_dataset_full", "best_node_topk", "teacher_rank", "overview",
    "score_stats", "rank_dist", "penalty_stats", "penalty_hist", "utilization_stats",
    "label_integrity", "gini", "feature_corr", "corr_pairs", "regression_metrics", "band_mae",
    "winner_accuracy", "mean_spearman", "mean_kendall", "scenario_report", "replay_placements",
    "replay_dataset", "placement_events", "node_usage", "features18", "heuristic_score",
    "tolerates_taints", "node_affinity", "stream_place",
]


def main():
    from mooring.operators.labelling import candidate_row
    from mooring.plans.catalog import QUERIES
    from mooring.plans.reports import labelled
    from mooring.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8),
                          app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = dict(QUERIES)
    queries["label_dataset_full"] = lambda s, d: candidate_row(labelled(s, d))

    def run(name, path):
        start = time.perf_counter()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    names = sys.argv[1:] or HEADLINE
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in names if os.path.isdir(warm) else []:
        run(name, warm)
    seconds = {name: run(name, sf_dir) for name in names}
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count() * 40
    print(json.dumps({
        "metric": "headline_queries_total_sec", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).replace("sf", "") or 0),
        "candidate_rows_per_sec": round(rows / seconds.get("label_dataset_full", float("inf"))),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
