"""Connected components of a graph of any size, by rounds of contraction."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.common import stored


def _order(node, turn: int):
    """A new random order in each round; the node itself breaks ties."""
    return F.struct(F.xxhash64(F.lit(turn), F.col(node)).alias("h"), F.col(node).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b): equal roots, same component.

    In a round every node points to the first of itself and its neighbours in a random order, and
    edges move to the nodes pointed at. A constant share of the nodes goes in each round, chains
    included, so the number of rounds is logarithmic. The driver sees only whether edges are left.
    A hub is one row of an aggregate, and its edges meet their pointer in a join that Spark may
    split, as both sides are read from stored tables.
    """
    edges = stored(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    mapping = stored(nodes.select("node", F.col("node").alias("root")), "roots")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.select("a", "b").union(edges.select("b", "a"))
        pointers = stored(both.groupBy("a").agg(F.min(_order("b", turn)).alias("m")).select(
            F.col("a").alias("at"), F.least("m", _order("a", turn))["n"].alias("to")), "pointers")
        left = pointers.select(F.col("at").alias("a"), F.col("to").alias("x"))
        right = pointers.select(F.col("at").alias("b"), F.col("to").alias("y"))
        mapping = stored(mapping.join(pointers.withColumnRenamed("at", "root"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")), "roots")
        edges = stored(edges.join(left, "a").join(right, "b").where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return mapping
