"""Small fleets for tests."""


def make_nodes(spark, rows, cluster=0):
    """Node states from (id, alloc_cpu, alloc_mem, used_cpu, used_mem, pods[, cluster])."""
    full = [(*r, cluster) if len(r) == 6 else r for r in rows]
    sizes = {}
    for r in full:
        sizes[r[6]] = sizes.get(r[6], 0) + 1
    data = [(r[0], r[6], f"node-{r[0]}", sizes[r[6]], int(r[1] / 0.95), int(r[2] / 0.92),
             *r[1:6]) for r in full]
    return spark.createDataFrame(data, (
        "node_id long, cluster_id long, node_name string, cluster_size long,"
        "node_cpu_capacity long, node_memory_capacity long, node_allocatable_cpu long,"
        "node_allocatable_memory long, current_cpu_usage long, current_memory_usage long,"
        "current_pod_count long"))


def make_pods(spark, rows):
    """Arrivals from (event_id, cluster_id, arrival, cpu, mem); arrival in days."""
    import datetime
    start = datetime.datetime(2024, 1, 1)
    data = [(e, e, c, start + datetime.timedelta(days=a), cpu, mem)
            for e, c, a, cpu, mem in rows]
    return spark.createDataFrame(data, (
        "event_id long, pod_id long, cluster_id long, arrival_ts timestamp,"
        "requested_cpu long, requested_memory long"))
