"""Embedding near-duplicates through a robust-pruned flat graph.

Vectors of a label are dealt to overlapping cluster shards of bounded size, around centroids fitted
on a bounded sample. Each shard builds a graph: nearest candidates, pruned so that the kept
neighbours cover directions, with reverse edges. The adjacency lists of a vector are united over its
shards. Each shard is then searched over the united graph: a greedy walk of a small beam from the
medoid, widened to everything in range by following the edges of what is in range. Pairs are
verified by their cosine in double precision. Recall is audited against all rows, and the shards
overlap more if it is low; if it stays low at the largest overlap, all pairs are compared in blocks.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mooring.llm.catalog import register
from mooring.llm.common import stored, table
from mooring.llm.components import components
from mooring.session import ship_package

THRESHOLD = 0.98
#: Rows of a shard, on average, before overlap.
SHARD_ROWS = 500
#: Vectors that centroids are fitted on at most, over all labels: the bound of the sample.
SAMPLE_ROWS = 50_000
#: Shards that a vector belongs to; doubled while the audit finds less than RECALL.
OVERLAP = 3
MAX_OVERLAP = 24
#: Vectors of a block where all pairs are compared, on average.
BLOCK_ROWS = 2_000
RECALL = 0.97
AUDIT_QUERIES = 300
DEGREE = 24
CANDIDATES = 48
ALPHA = 1.2
BEAM = 12
STEPS = 16


# ---- vectors --------------------------------------------------------------------------------

def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
            label: str = "label"):
    """(members, nodes): rows by vector, and one node for each distinct vector of a label.

    Null, zero and non-finite vectors, and rows with a null label, have no node.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"),
                          F.col(f"`{embedding}`").alias("v"))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "v", lambda x: x != 0)
    flagged = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    distinct = stored(flagged.where("usable").groupBy("label", "v").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")), "vectors")
    nodes = stored(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn(
        "part", F.concat_ws("|", F.size("v").cast("string"), F.col("label").cast("string"))),
        "nodes")
    members = flagged.where("usable").select("vec_id", "label", "v").join(
        nodes.select("label", "v", "node"), ["label", "v"]).select("vec_id", "node")
    return flagged.where("not usable").select("vec_id"), members, nodes


def _matrix(column) -> np.ndarray:
    """The rows of a list column, which all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


# ---- shards ---------------------------------------------------------------------------------

def _kmeans(x: np.ndarray, k: int, turns: int = 6) -> np.ndarray:
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(turns):
        own = np.concatenate([np.argmax(x[i:i + 4096] @ centres.T, axis=1)
                              for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def centroids(nodes: DataFrame, shard_rows: int = SHARD_ROWS,
              sample_rows: int = SAMPLE_ROWS) -> dict:
    """part -> unit centroids, for parts of more than one shard, from a bounded sample."""
    sizes = {r.part: r["count"] for r in nodes.groupBy("part").count().where(
        F.col("count") > shard_rows).collect()}
    if not sizes:
        return {}
    share = min(1.0, sample_rows / sum(sizes.values()))
    drawn = nodes.where(F.col("part").isin(*sizes)).where(
        F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000)).select(
        "part", "v").limit(2 * sample_rows).toPandas()
    out = {}
    for part, rows in drawn.groupby("part"):
        x = _unit(np.stack(rows["v"].to_list()).astype(np.float64))
        k = min(-(-sizes[part] // shard_rows), max(1, len(x) // 8))
        out[part] = _kmeans(x, k).astype(np.float32)
    return out


def _dealer(centres: dict, overlap: int):
    def run(batches):
        for batch in batches:
            parts = np.array(batch.column(1).to_pylist(), object)
            at, shard = [], []
            for part in set(parts):
                rows = np.flatnonzero(parts == part)
                own = centres.get(part)
                if own is None or len(own) == 1:
                    at.append(rows)
                    shard.append(np.zeros(len(rows), np.int32))
                    continue
                x = _matrix(batch.column(2).take(pa.array(rows)))
                near = np.argsort(-(x @ own.T), axis=1, kind="stable")[:, :overlap]
                at.append(np.repeat(rows, near.shape[1]))
                shard.append(near.ravel().astype(np.int32))
            if not at:
                continue
            rows = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows),
                 pa.array(np.concatenate(shard), pa.int32())],
                names=["node", "part", "v", "shard"])
    return run


# ---- graph ----------------------------------------------------------------------------------

def _prune(x: np.ndarray, me: int, candidates: np.ndarray, degree: int, alpha: float) -> list:
    """Nearest first; a candidate goes once a kept neighbour is nearer to it, by alpha, than `me`."""
    far = 1.0 - x[candidates] @ x[me]
    order = np.argsort(far, kind="stable")
    candidates, far = candidates[order], far[order]
    between = 1.0 - x[candidates] @ x[candidates].T
    alive = np.ones(len(candidates), bool)
    kept = []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(int(candidates[i]))
            if len(kept) == degree:
                break
            # Squared distances on the sphere are twice one minus the cosine.
            alive &= alpha * alpha * between[i] > far
    return kept


def build(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES,
          alpha: float = ALPHA) -> list:
    """Adjacency lists of a robust-pruned graph over unit rows."""
    n = len(x)
    out = []
    for i in range(0, n, 1024):
        close = x[i:i + 1024] @ x.T
        close[np.arange(len(close)), np.arange(i, i + len(close))] = -np.inf
        k = min(candidates, n - 1)
        near = (np.argpartition(-close, k - 1, axis=1)[:, :k] if k < n - 1
                else np.argsort(-close, axis=1)[:, :k])
        for j, row in enumerate(near):
            out.append(_prune(x, i + j, row, degree, alpha) if k else [])
    back = [[] for _ in range(n)]
    for i, row in enumerate(out):
        for j in row:
            back[j].append(i)
    joined = []
    for i in range(n):
        both = np.array(sorted({*out[i], *back[i]}), np.int64)
        joined.append(both.tolist() if len(both) <= 2 * degree
                      else _prune(x, i, both, 2 * degree, alpha))
    return joined


def _builder(table_: pa.Table) -> pa.Table:
    nodes = table_.column("node").to_numpy()
    lists = build(_unit(_matrix(table_.column("v"))).astype(np.float32))
    return pa.table({"node": pa.array(nodes), "near": pa.array(
        [nodes[row] for row in lists], pa.list_(pa.int64()))})


def search(x: np.ndarray, graph: np.ndarray, threshold: float, beam: int = BEAM,
           steps: int = STEPS):
    """For each row of x, the rows in range that the graph leads to. graph: rows padded with -1."""
    n = len(x)
    single = x.astype(np.float32)
    medoid = int(np.argmax(single @ single.mean(axis=0)))
    slack = threshold - 1e-4
    for lo in range(0, n, 512):
        me = np.arange(lo, min(n, lo + 512))
        ids = np.full((len(me), beam), -1, np.int64)
        ids[:, 0] = medoid
        sims = np.full((len(me), beam), -2.0, np.float32)
        sims[:, 0] = single[me] @ single[medoid]
        done = np.zeros((len(me), beam), bool)
        rows = np.arange(len(me))
        for _ in range(steps):
            open_ = np.where(done | (ids < 0), -3.0, sims)
            best = np.argmax(open_, axis=1)
            if (open_[rows, best] <= -3).all():
                break
            here = ids[rows, best]
            done[rows, best] = True
            near = np.where((open_[rows, best] > -3)[:, None], graph[here], -1)
            known = (near[:, :, None] == ids[:, None, :]).any(axis=2) | (near < 0)
            score = np.einsum("qrd,qd->qr", single[near], single[me])
            score[known] = -2.0
            all_ids = np.concatenate([ids, np.where(known, -1, near)], axis=1)
            all_sims = np.concatenate([sims, score], axis=1)
            all_done = np.concatenate([done, known], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids, sims, done = (np.take_along_axis(a, top, axis=1)
                               for a in (all_ids, all_sims, all_done))
        for k, i in enumerate(me):
            # The walk's finds in range, and the query's own place, are widened along edges.
            frontier = np.unique(np.append(ids[k][(ids[k] >= 0) & (sims[k] >= slack)], i))
            seen = np.zeros(n, bool)
            seen[frontier] = True
            found = [frontier]
            while len(frontier):
                near = graph[frontier].ravel()
                near = near[near >= 0]
                near = np.unique(near[~seen[near]])
                seen[near] = True
                frontier = near[single[near] @ single[i] >= slack]
                found.append(frontier)
            found = np.concatenate(found)
            found = found[found != i]
            yield i, found[(x[found] @ x[i]) >= threshold] if len(found) else found


def _searcher(threshold: float):
    def run(table_: pa.Table) -> pa.Table:
        nodes = table_.column("node").to_numpy()
        x = _unit(_matrix(table_.column("v")))
        place = {node: i for i, node in enumerate(nodes.tolist())}
        lists = [[place[j] for j in row if j in place]
                 for row in table_.column("near").to_pylist()]
        width = max(1, max(map(len, lists), default=1))
        graph = np.full((len(nodes), width), -1, np.int64)
        for i, row in enumerate(lists):
            graph[i, :len(row)] = row
        me, found = [], []
        for i, rows in search(x, graph, threshold):
            if len(rows):
                me.append(nodes[i])
                found.append(nodes[rows])
        return pa.table({"a": pa.array(me, pa.int64()),
                         "found": pa.array(found, pa.list_(pa.int64()))})
    return run


def find_pairs(nodes: DataFrame, centres: dict, overlap: int,
               threshold: float = THRESHOLD) -> DataFrame:
    """Distinct verified pairs (a, b) of nodes, a < b."""
    narrow = nodes.select("node", "part", "v")
    dealt = stored(narrow.mapInArrow(_dealer(centres, overlap), T.StructType(
        [*narrow.schema.fields, T.StructField("shard", T.IntegerType())])), "shards")
    lists = dealt.groupBy("part", "shard").applyInArrow(
        _builder, "node bigint, near array<bigint>")
    united = stored(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list(
        "near"))).alias("near")), "adjacency")
    found = dealt.join(united, "node").groupBy("part", "shard").applyInArrow(
        _searcher(threshold), "a bigint, found array<bigint>")
    return stored(found.select("a", F.explode("found").alias("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def audit(nodes: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD,
          queries: int = AUDIT_QUERIES) -> float:
    """Share of the true pairs of some hash-drawn vectors, found by comparing with all rows."""
    total = nodes.count()
    rate = max(1, total // queries)
    drawn = nodes.where(F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(rate)) == 0).select(
        "node", "part", "v").limit(4 * queries).collect()
    asked = {}
    for row in drawn:
        asked.setdefault(row.part, []).append((row.node, row.v))
    asked = {part: (np.array([r[0] for r in rows]), _unit(np.array([r[1] for r in rows], float)))
             for part, rows in asked.items()}

    def truth(batches):
        for batch in batches:
            parts = np.array(batch.column(1).to_pylist(), object)
            a, b = [], []
            for part in set(parts) & set(asked):
                rows = np.flatnonzero(parts == part)
                ids = batch.column(0).to_numpy()[rows]
                x = _unit(_matrix(batch.column(2).take(pa.array(rows))))
                names, q = asked[part]
                i, j = np.nonzero(q @ x.T >= threshold)
                other = names[i] != ids[j]
                a.append(names[i][other])
                b.append(ids[j][other])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    true = nodes.select("node", "part", "v").mapInArrow(truth, "a bigint, b bigint").distinct()
    row = true.join(pairs.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).first()
    return row.hits / row.n if row.n else 1.0


def exact_pairs(nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_ROWS) -> DataFrame:
    """All pairs (a, b) of nodes of a part, a < b: each two blocks of a part meet in one task."""
    sizes = nodes.groupBy("part").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
    met = nodes.join(F.broadcast(sizes), "part").select(
        "node", "part", "v", mine.alias("mine"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "node", "part", "v", "mine", F.least("mine", "other").alias("low"),
        F.greatest("mine", "other").alias("high"))

    def compare(table_: pa.Table) -> pa.Table:
        ids, own = table_.column("node").to_numpy(), table_.column("mine").to_numpy()
        x = _unit(_matrix(table_.column("v")))
        left = np.flatnonzero(own == table_.column("low")[0].as_py())
        right = np.flatnonzero(own == table_.column("high")[0].as_py())
        same = table_.column("low")[0].as_py() == table_.column("high")[0].as_py()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(left), 512):
            rows = left[k:k + 512]
            i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
            one, two = ids[rows[i]], ids[right[j]]
            kept = one < two if same else np.ones(len(one), bool)
            a.append(np.minimum(one, two)[kept])
            b.append(np.maximum(one, two)[kept])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()),
                         "b": pa.array(np.concatenate(b), pa.int64())})

    return stored(met.groupBy("part", "low", "high").applyInArrow(
        compare, "a bigint, b bigint"), "exact-pairs")


# ---- operator -------------------------------------------------------------------------------

def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id",
                    embedding: str = "embedding", label: str = "label",
                    shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS,
                    overlap: int = OVERLAP, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row.

    Vectors link within a label and dimension. Equal vectors are one node of the graph; each of
    their rows links with all others. Unusable vectors (see `classes`) link with nothing. A null id
    is no component's id where there is another, and is not kept. Repeated rows stay as rows.
    """
    ship_package(vectors.sparkSession)
    alone, members, nodes = classes(vectors, vec_id, embedding, label)
    centres = centroids(nodes, shard_rows, sample_rows)
    while True:
        pairs = find_pairs(nodes, centres, overlap, threshold)
        if audit(nodes, pairs, threshold) >= recall:
            break
        if overlap >= MAX_OVERLAP:
            # The graph still misses pairs: all are compared.
            pairs = exact_pairs(nodes, threshold)
            break
        overlap *= 2
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        pairs.select("b", "a"))
    copies = stored(nodes.select(F.col("node").alias("other"), "copies"), "copies")
    linked = stored(both.join(copies, "other").groupBy("node").agg(
        F.sum("copies").alias("far")), "linked")
    roots = components(pairs)
    own = nodes.select("node", "first", "copies").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    smallest = stored(own.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    figures = stored(own.join(smallest, "root").join(linked, "node", "left").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias(
            "n_links")), "figures")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return members.join(figures, "node").select("vec_id", "n_links", "component_id").union(
        alone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))).select(
        "vec_id", "n_links", "component_id", kept)


_SQL = """
WITH RECURSIVE p AS (
  SELECT a.vec_id AS x, b.vec_id AS y
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.98),
reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT reach.x, p.y FROM reach JOIN p ON p.x = reach.y),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT c.x AS vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id,
       c.x = component_id AS kept
FROM c LEFT JOIN n ON n.x = c.x
"""


@register("op10_embedding_dedup", _SQL)
def op10_embedding_dedup(spark, sf_dir):
    """Links and component of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
