"""Importance resampling: documents whose hashed n-grams look like those of a target.

Every feature, a run of consecutive words, is counted in a bucket of its crc32. A bucket's gain is
the log ratio of its shares in the target and in all documents; a document's weight is the sum of
its features' gains. With a Gumbel number of its id added, the highest scores are a sample drawn
without replacement in proportion to the importance.

Words come from the bytes of a text (`byte_words`). The crc32 of a run is that of its first words,
carried on as the seed over a space and the next word, so no run is ever put together. Each task adds
to one Counter of at most `buckets` entries, and Spark adds the tasks up: the driver sees one number
per bucket and table, whatever the corpus.
"""
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mooring.llm.byte_words import utf8, words
from mooring.llm.catalog import register
from mooring.llm.common import stored, table, text_workers
from mooring.scale import positions

LONGEST = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10


def buckets_of(tokens: list, longest: int = LONGEST, buckets: int = BUCKETS) -> list:
    """The bucket of every run of 1 to `longest` words, repeats included."""
    codes = list(map(crc32, tokens))
    found = [c % buckets for c in codes]
    for n in range(2, longest + 1):
        codes = [crc32(w, crc32(b" ", c)) for c, w in zip(codes, tokens[n - 1:])]
        found += [c % buckets for c in codes]
    return found


def _counted(longest, buckets):
    def run(batches):
        tally = Counter()
        for batch in batches:
            for text in batch.column(0):
                tally.update(buckets_of(words(text.as_py()), longest, buckets))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(tally), pa.int32()), pa.array(list(tally.values()), pa.int64())],
            names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST,
                  buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket; at most `buckets` rows come to the driver."""
    text_workers(texts.sparkSession)
    parts = texts.select(utf8(text)).mapInArrow(_counted(longest, buckets), "bucket int, n bigint")
    counts = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares per bucket, rounded down."""
    size, in_source, in_target = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(
        (t + 1.0) * (in_source + size) / ((s + 1.0) * (in_target + size))))
        for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weighed(gain, longest):
    def run(batches):
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column(1):
                tokens = words(text.as_py())
                found = buckets_of(tokens, longest, len(gain))
                n_words.append(len(tokens))
                n_features.append(len(found))
                weight.append(int(gain[found].sum()) if found else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in (n_words, n_features, weight)]],
                names=["doc_id", "n_words", "n_features", "weight"])
    return run


def gumbel(doc_id: str, seed: int):
    """Thousandths of a standard Gumbel number that the id and the seed fix, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id",
             target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row per document; rank is null where not drawn.

    Drawn are the highest scores, `percent` of a hundred of the documents with at least `min_words`
    words, rounded down; equal scores go by the smaller id, null ids last. A null or empty text has
    no features and weight 0. Repeated rows are documents of their own, with the same score and
    neighbouring ranks. Null ids share the number of the empty id. No documents give no rows; an
    empty target leaves gains that favour rare buckets. Other columns are ignored, whatever their
    names.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets),
                 bucket_counts(target, target_text, longest, buckets))
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [
        T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    weighed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), utf8(text)).mapInArrow(
        _weighed(gain, longest), schema)
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "weights")
    able = F.col("n_words") >= min_words
    # Sorted over the whole cluster, numbered by slices: no task holds all that are able.
    placed = positions(scored.where(able).withColumns({
        "_all": F.lit(0), "_best": -F.col("score"), "_none": F.col("doc_id").isNull()}),
        "_all", ["_best", "_none", "doc_id"])
    drawn = F.floor(F.col("group_rows") * percent / F.lit(100))
    columns = ("doc_id", "n_features", "weight", "score")
    return placed.select(*columns, F.when(F.col("position") <= drawn, F.col("position")).alias(
        "rank")).unionByName(scored.where(~able).select(
            *columns, F.lit(None).cast("long").alias("rank")))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: crc32 in SQL, by the table of its polynomial, for each distinct word.
_SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT b, 0 AS step, CAST(b AS BIGINT) AS c FROM range(256) t(b)
  UNION ALL
  SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
  FROM bits WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY b) AS crcs FROM bits WHERE step = 8),
d AS (
  SELECT row_number() OVER () AS row_, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_LETTERS.upper()}', '{_LETTERS}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (SELECT row_, w, count(*) AS k FROM (SELECT row_, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS k FROM (SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), '{_LETTERS.upper()}', '{_LETTERS}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY 1),
coded AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
      range(1, CAST(length(h) AS BIGINT), 2),
      lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda c, b: xor(crcs[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)), crc_table),
s AS (SELECT bucket, CAST(sum(k) AS BIGINT) AS s FROM dw JOIN coded USING (w) GROUP BY 1),
t AS (SELECT bucket, CAST(sum(k) AS BIGINT) AS t FROM bw JOIN coded USING (w) GROUP BY 1),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1e0)
           * ((SELECT coalesce(sum(s), 0) FROM s) + 10000e0)
           / ((coalesce(s, 0) + 1e0) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000e0)))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (bucket)),
weight AS (
  SELECT row_, CAST(sum(k * g) AS BIGINT) AS weight
  FROM dw JOIN coded USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(
           sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM d LEFT JOIN weight USING (row_)),
able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN able USING (doc_id)
"""


@register("op13_resampling", _SQL)
def op13_resampling(spark, sf_dir):
    """Weight, score and rank of every document against the benchmark texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
