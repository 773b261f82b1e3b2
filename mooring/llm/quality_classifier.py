"""Quality by regularised quadratic discriminant analysis of document statistics.

A document becomes a short vector: logarithms of sizes, and shares of symbols, capitals, breaks and
repeats under a square-root transform, which evens out their spread. Each class is a normal density.
Its covariance is shrunk towards that of both classes and then towards a multiple of the identity, so
that a share which never varies within a class doesn't make it singular. The score is the logistic
of the difference of the log densities, from squared Mahalanobis distances over Cholesky factors that
are computed once and sent to the workers.

Means and covariances are sums over all labelled rows, made by Spark: the driver gets a few hundred
numbers, whatever the corpus.
"""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mooring.llm.byte_words import utf8
from mooring.llm.catalog import register
from mooring.llm.common import crc_remainder, stored, table, text_workers

#: Weight of the covariance of both classes, and then of the identity, in that of a class.
TO_POOLED = 0.4
TO_IDENTITY = 0.1
FOLDS, HELD_OUT = 4, 2
AT_LEAST = 0.7

STATISTICS = ("words", "word_length", "longest_word", "distinct_words", "commonest_word", "capitals",
              "digits", "sentence_marks", "calls", "bars", "symbols", "beyond_ascii", "lines",
              "repeated_lines", "short_lines", "entropy")

_CAPITALS = np.arange(ord("A"), ord("Z") + 1)
_DIGITS = np.arange(ord("0"), ord("9") + 1)
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8)


def statistics(data: bytes | None) -> np.ndarray:
    """The transformed statistics of one whole text in UTF-8; those of an empty text for a null."""
    data = data or b""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(len(data), 1)
    tokens = data.split()
    n = len(tokens)
    often = {}
    for w in tokens:
        often[w] = often.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = counts[counts > 0] / size
    return np.array([
        np.log1p(n),
        np.log1p(sum(map(len, tokens)) / max(n, 1)),
        np.log1p(max(map(len, tokens), default=0)),
        np.log1p(len(often)) - np.log1p(n),
        np.sqrt(max(often.values(), default=0) / max(n, 1)),
        np.sqrt(counts[_CAPITALS].sum() / size),
        np.sqrt(counts[_DIGITS].sum() / size),
        np.sqrt((counts[ord(".")] + counts[ord(",")]) / size),
        np.sqrt(counts[ord("!")] / size),
        np.sqrt(counts[ord("|")] / size),
        np.sqrt(counts[_SYMBOLS].sum() / size),
        np.sqrt(counts[128:].sum() / size),
        np.log1p(len(lines)) - np.log1p(n),
        np.sqrt((len(lines) - len(set(lines))) / max(len(lines), 1)),
        np.sqrt(sum(len(x) < 20 for x in lines) / max(len(lines), 1)),
        float(-(shares * np.log2(shares)).sum()),
    ])


def _stated(batches):
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(1)]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        ends = np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "x"])


def with_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, x): the statistics of every document; repeated rows stay repeated."""
    text_workers(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType),
                           T.StructField("x", T.ArrayType(T.DoubleType()))])
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), utf8(text)).mapInArrow(_stated, schema)


# ---- the two densities -----------------------------------------------------------------------

@dataclass(frozen=True)
class Density:
    """A class: its mean, the Cholesky factor of its covariance, and what doesn't depend on a row."""
    mean: np.ndarray
    factor: np.ndarray
    constant: float

    def log(self, x: np.ndarray) -> np.ndarray:
        """Log density of each row, but for a term that all classes share."""
        apart = np.linalg.solve(self.factor, (x - self.mean).T)
        return self.constant - 0.5 * (apart * apart).sum(axis=0)


def density(mean, covariance, pooled, share, to_pooled=TO_POOLED, to_identity=TO_IDENTITY) -> Density:
    size = len(mean)
    shrunk = (1 - to_pooled) * covariance + to_pooled * pooled
    # Without any spread, the identity itself stands in.
    spread = np.trace(shrunk) / size or 1.0
    shrunk = (1 - to_identity) * shrunk + to_identity * spread * np.eye(size)
    factor = np.linalg.cholesky(shrunk)
    return Density(mean, factor, float(np.log(share) - np.log(np.diag(factor)).sum()))


@dataclass(frozen=True)
class Model:
    """Scale of the statistics, and the densities of label 0 and 1; None for one never seen."""
    origin: np.ndarray
    scale: np.ndarray
    classes: tuple

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row: 0.5 without any label, 0 or 1 where only one was seen."""
        low, high = self.classes
        if low is None or high is None:
            return np.full(len(x), 0.5 if low is high else float(low is None))
        z = (x - self.origin) / self.scale
        return 1 / (1 + np.exp(-np.clip(high.log(z) - low.log(z), -700, 700)))


def _products(origins):
    """Per class, the products of the statistics about the class mean, summed over a task's rows."""
    def run(batches):
        sums = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            label, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(label):
                mine = label == k
                apart = x[mine] - origins[int(k)]
                sums[k] = sums.get(k, 0) + (apart * n[mine, None]).T @ apart
        i, j = np.indices((len(STATISTICS),) * 2)
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, k, np.int32)), pa.array(i.ravel().astype(np.int32)),
                 pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())],
                names=["label", "i", "j", "s"])
    return run


def learn(stated: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
          to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    """The model of all rows of stated (doc_id, x) that have a label of 0 or 1.

    Other labels, null labels and null ids teach nothing. A label given several times counts as
    often; a document with both labels counts for both.
    """
    named = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias(
        "label")).where("label IN (0, 1)").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(stated.join(named, "doc_id").select("x", "label", "n"), "labelled")
    size = len(STATISTICS)
    n = F.col("n")
    sums = rows.groupBy("label").agg(F.sum(n).alias("n"), *[
        F.sum(F.col("x")[i] * n).alias(f"s{i}") for i in range(size)]).collect()
    counts = {r.label: r.n for r in sums}
    means = {r.label: np.array([r[f"s{i}"] for i in range(size)]) / r.n for r in sums}
    total = sum(counts.values())
    if not total:
        return Model(np.zeros(size), np.ones(size), (None, None))
    products = {k: np.zeros((size, size)) for k in counts}
    for r in rows.mapInArrow(_products(means), "label int, i int, j int, s double").groupBy(
            "label", "i", "j").agg(F.sum("s").alias("s")).collect():
        products[r.label][r.i, r.j] = r.s
    origin = sum(counts[k] * means[k] for k in counts) / total
    within = sum(products.values()) / total
    between = sum(counts[k] * np.outer(means[k] - origin, means[k] - origin) for k in counts) / total
    scale = np.sqrt(np.diag(within + between))
    scale[scale < 1e-9] = 1.0
    unit = np.outer(scale, scale)
    return Model(origin, scale, tuple(density(
        (means[k] - origin) / scale, products[k] / counts[k] / unit, within / unit,
        counts[k] / total, to_pooled, to_identity) if k in counts else None for k in (0, 1)))


def _scored(model):
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])
    return run


def classify(stated: DataFrame, model: Model, at_least: float = AT_LEAST) -> DataFrame:
    """(doc_id, score, predicted) for each row of stated (doc_id, x)."""
    schema = T.StructType([stated.schema["doc_id"], T.StructField("score", T.DoubleType())])
    scored = stated.select("doc_id", "x").mapInArrow(_scored(model), schema)
    return scored.withColumn("predicted", F.when(F.col("score") >= at_least, 1).otherwise(0))


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text",
          doc_id: str = "doc_id", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per document, whole texts.

    Learned is from labelled documents outside the held-out fold, which is by the crc32 of the id as
    text. A null text counts as empty, and an empty one has a score like any other. Null ids have no
    label and are not held out. Repeated rows are scored, and taught by, one by one. No documents
    give no rows. With labels of one kind only all scores are that label, with none 0.5. Other
    columns, whatever their names, are ignored.
    """
    stated = stored(with_statistics(docs, text, doc_id), "statistics")
    apart = F.coalesce(crc_remainder("doc_id", folds) == held_out, F.lit(False))
    model = learn(stated.where(~apart), labels, label, doc_id)
    return classify(stated, model).withColumn("held_out", apart).select(
        "doc_id", "held_out", "score", "predicted")


@register("op12_quality")
def op12_quality(spark, sf_dir):
    """Score and verdict of every document, learned from the labels outside the held-out fold."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
