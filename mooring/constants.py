"""Fixed values of the placement data model.

Everything in this module is a fixed value: results only agree with the
published formulas when these lists, anchors and weights are exactly these.
"""

# The 18-column feature contract, in contract order.
FEATURES = [
    "cluster_size",
    "node_allocatable_cpu",
    "node_allocatable_memory",
    "current_cpu_usage",
    "current_memory_usage",
    "current_cpu_percent",
    "current_memory_percent",
    "current_pod_count",
    "requested_cpu",
    "requested_memory",
    "projected_cpu_percent",
    "projected_memory_percent",
    "cpu_headroom",
    "memory_headroom",
    "resource_balance",
    "cpu_request_ratio",
    "memory_request_ratio",
    "packing_density",
]
TARGET = "teacher_score"
GROUP = "event_id"

# The 44 columns of a labelled candidate row, in order.
CANDIDATE_ROW = [
    "event_id", "cluster_id", "pod_id", "node_id", "best_node_id",
    "cluster_size",
    "node_cpu_capacity", "node_memory_capacity",
    "node_allocatable_cpu", "node_allocatable_memory",
    "current_cpu_usage", "current_memory_usage",
    "current_cpu_percent", "current_memory_percent", "current_pod_count",
    "requested_cpu", "requested_memory",
    "projected_cpu_usage", "projected_memory_usage",
    "projected_cpu_percent", "projected_memory_percent",
    "projected_remaining_cpu", "projected_remaining_memory",
    "projected_pod_count",
    "cpu_headroom", "memory_headroom",
    "cpu_fragmentation", "memory_fragmentation",
    "resource_balance", "cpu_waste", "memory_waste",
    "cpu_request_ratio", "memory_request_ratio", "packing_density",
    "feasible", "reject_reason",
    "cpu_penalty", "memory_penalty", "density_penalty",
    "winner_score", "teacher_score", "selected_by_scheduler",
    "teacher_rank", "score_gap_from_best",
]
RATIO_COLUMNS = [
    "current_cpu_percent", "current_memory_percent",
    "projected_cpu_percent", "projected_memory_percent",
    "cpu_headroom", "memory_headroom",
    "cpu_fragmentation", "memory_fragmentation",
    "resource_balance", "cpu_waste", "memory_waste",
    "cpu_request_ratio", "memory_request_ratio", "packing_density",
]

# The 29 columns looked at by the redundancy analysis, in order.
ANALYSIS_FEATURES = [
    "cluster_size",
    "node_cpu_capacity", "node_memory_capacity",
    "node_allocatable_cpu", "node_allocatable_memory",
    "current_cpu_usage", "current_memory_usage",
    "current_cpu_percent", "current_memory_percent", "current_pod_count",
    "requested_cpu", "requested_memory",
    "projected_cpu_usage", "projected_memory_usage",
    "projected_cpu_percent", "projected_memory_percent",
    "projected_remaining_cpu", "projected_remaining_memory",
    "projected_pod_count",
    "cpu_headroom", "memory_headroom",
    "cpu_fragmentation", "memory_fragmentation",
    "resource_balance", "cpu_waste", "memory_waste",
    "cpu_request_ratio", "memory_request_ratio", "packing_density",
]

# The 12 columns of the dominance (Gini) check.
DOMINANCE_FEATURES = [
    "current_cpu_percent", "current_memory_percent",
    "projected_cpu_percent", "projected_memory_percent",
    "cpu_headroom", "memory_headroom",
    "cpu_fragmentation", "memory_fragmentation",
    "resource_balance", "packing_density",
    "cpu_request_ratio", "memory_request_ratio",
]

# Fixed values: (utilisation, penalty) anchors of the piecewise-linear curves.
CPU_PENALTY_CURVE = [(0.0, 0.0), (0.4, 2.0), (0.6, 8.0), (1.0, 20.0)]
MEMORY_PENALTY_CURVE = [(0.0, 0.0), (0.4, 2.0), (0.6, 8.0), (1.0, 20.0)]
DENSITY_PENALTY_CURVE = [(0.0, 0.0), (0.2, 1.0), (0.6, 3.0), (1.0, 5.0)]

# Step penalties, (utilisation above, penalty), highest first.
STEP_PENALTIES = [(0.90, 20), (0.70, 10)]
STEP_DENSITY_PODS = 30
STEP_DENSITY_PENALTY = 5

# Score weights and limits.
CPU_HEADROOM_WEIGHT = 0.60
MEMORY_HEADROOM_WEIGHT = 0.40
MAX_PODS_PER_NODE = 110.0
NEUTRAL_SCORE = 50
MIN_ACCEPTABLE_SCORE = 20
MIN_ACCEPTABLE_SCORE_STRESS = 5
EPISODE_LENGTH = 20

# Share of capacity left for workloads.
ALLOCATABLE_CPU_SHARE = 0.95
ALLOCATABLE_MEMORY_SHARE = 0.92

# Hardware profiles (name, millicores, GiB), base then extended.
BASE_PROFILES = [
    ("small", 2000, 4),
    ("medium", 4000, 8),
    ("large", 8000, 16),
    ("xlarge", 16000, 32),
    ("cpu_heavy", 32000, 16),
    ("mem_heavy", 8000, 128),
]
EXTENDED_PROFILES = [
    ("gpu", 64000, 64),
    ("arm_small", 1200, 2),
    ("storage_opt", 4000, 64),
    ("burstable", 6000, 8),
    ("edge", 500, 1),
]

# Cluster-size tiers (smallest, largest, weight).
CLUSTER_SIZE_TIERS = [
    (5, 10, 0.20), (10, 25, 0.30), (25, 50, 0.25), (50, 100, 0.15), (100, 250, 0.10),
]
# Load scenarios and their weights.
SCENARIO_WEIGHTS = [
    ("very_light", 0.18), ("healthy_idle", 0.17), ("sparse", 0.12),
    ("balanced", 0.12), ("mixed", 0.11), ("fragmented", 0.10),
    ("dense_packing", 0.08), ("cpu_bottleneck", 0.06), ("memory_bottleneck", 0.06),
]

# Unknown-node snapshot.
DEFAULT_SNAPSHOT = {
    "cluster_size": 1,
    "node_allocatable_cpu": 1000.0,
    "node_allocatable_memory": 1024.0 * 1024 * 1024,
    "current_cpu_usage": 0.0,
    "current_memory_usage": 0.0,
    "current_cpu_percent": 0.0,
    "current_memory_percent": 0.0,
    "current_pod_count": 0,
}

# Teacher-score bands [low, high) of the error report.
SCORE_BANDS = [
    ("saturated", 0, 20), ("stressed", 20, 40), ("moderate", 40, 60),
    ("healthy", 60, 80), ("idle", 80, 100),
]

# Verdict floors of the scenario report.
VERDICT_EXACT_MATCH_PCT = 85.0
VERDICT_AVG_RANK = 1.25
VERDICT_AVG_GAP = 5.0

MIB = 1024 * 1024
GIB = 1024 * 1024 * 1024
