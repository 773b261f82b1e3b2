"""The labelled candidate dataset and its storage row."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mooring.constants import CANDIDATE_ROW
from mooring.functions import features, scoring, units
from mooring.operators.candidates import candidates
from mooring.operators.predicates import fits_free
from mooring.operators.ranking import rank_labels

ZERO_WHEN_INFEASIBLE = ["teacher_score", "cpu_penalty", "memory_penalty", "density_penalty"]


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Feasibility, derived columns, penalties and teacher score of candidates.

    Infeasible candidates keep their projections; scores and penalties are 0.
    """
    derived = features.derive(pairs.withColumns(fits_free()))
    scored = scoring.with_teacher_score(derived)
    return scored.withColumns({
        c: F.when(F.col("feasible"), F.col(c)).otherwise(F.lit(0.0))
        for c in ZERO_WHEN_INFEASIBLE})


def label_pairs(pairs: DataFrame) -> DataFrame:
    return rank_labels(score_pairs(pairs))


def with_pod_labels(pods: DataFrame) -> DataFrame:
    """Text ids of arrivals, made once per pod instead of once per candidate."""
    return pods.withColumns({"event_label": units.event_label(F.col("event_id")),
                             "pod_label": units.pod_label(F.col("pod_id"))})


def with_node_labels(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({
        "cluster_label": units.cluster_label(F.col("cluster_id")),
        "node_label": units.node_label(F.col("cluster_id"), F.col("node_id"))})


def _flat(df: DataFrame) -> DataFrame:
    """df without its nested constraint columns, which labels never read."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, nested)])


def described_candidates(pods: DataFrame, nodes: DataFrame, known: DataFrame = None,
                         parts: DataFrame = None) -> DataFrame:
    """Candidate pairs with text ids and without nested columns, but for those of known by event."""
    described = with_pod_labels(_flat(pods))
    if known is not None:
        described = described.join(known, "event_id", "left")
    return candidates(described, with_node_labels(_flat(nodes)), parts=parts)


def label_dataset(pods: DataFrame, nodes: DataFrame, parts: DataFrame = None) -> DataFrame:
    """All candidates of all arrivals with teacher labels; parts are those of `candidates`."""
    return label_pairs(described_candidates(pods, nodes, parts=parts))


def candidate_row(labelled: DataFrame) -> DataFrame:
    """The 44 stored columns in order: text ids, ratios rounded to six digits."""
    names = {"event_id": "event_label", "cluster_id": "cluster_label", "pod_id": "pod_label",
             "node_id": "node_label", "best_node_id": "best_node_label"}
    rounded = features.rounded_ratios()
    return labelled.select(*[
        F.col(names[c]).alias(c) if c in names else rounded.get(c, F.col(c)).alias(c)
        for c in CANDIDATE_ROW])
