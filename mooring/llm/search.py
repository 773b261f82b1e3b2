"""Ranked lexical search, a term at a time, with a limited number of accumulators.

Documents are read in chunks of bounded size, and each chunk gets an inverted index of the queries'
terms. A query takes its terms from the rarest to the commonest. A document met for the first time
gets an accumulator, until the best that the remaining terms could give a new document is less than
the k-th best partial score; from then on only documents that have one are updated, exactly. What is
left out can't reach the k best: its whole score is within that bound, and the k-th score only grows.
A task carries its k best of a query from chunk to chunk, and their least is a bar from the start.

Frequencies of the whole corpus come first, by one aggregation over the queries' terms. Queries are
taken in blocks whose terms are bounded, so that what goes to the workers is bounded too; each block
reads the documents twice. Texts and postings are never shuffled: only k rows of a query and task.
"""
import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mooring.llm.byte_words import utf8, words
from mooring.llm.catalog import register
from mooring.llm.common import stored, table, text_workers
from mooring.scale import positions

TOP = 50
#: Terms, with repeats over queries, of a block; a single query with more is a block of its own.
BLOCK_TERMS = 200_000
#: A chunk of documents ends after so many documents or postings.
CHUNK_DOCS = 16_384
CHUNK_POSTINGS = 1_000_000
#: First rounds of the final choice take the k best of as many parts of a query's rows.
PARTS = 64
_DOCUMENTS, _WORDS = -1, -2


# ---- frequencies ----------------------------------------------------------------------------

def _counted(vocabulary):
    def run(batches):
        held = np.zeros(len(vocabulary), np.int64)
        documents = total = 0
        for batch in batches:
            for text in batch.column(0):
                tokens = words(text.as_py())
                documents += bool(tokens)
                total += len(tokens)
                held[[vocabulary[t] for t in vocabulary.keys() & set(tokens)]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[some, _DOCUMENTS, _WORDS], pa.int32()),
             pa.array(np.r_[held[some], documents, total], pa.int64())], names=["term", "n"])
    return run


def frequencies(docs: DataFrame, vocabulary: dict, text: str = "text"):
    """(documents with a term, all terms with repeats, documents holding each term of vocabulary)."""
    parts = docs.select(utf8(text)).mapInArrow(_counted(vocabulary), "term int, n bigint")
    held = np.zeros(len(vocabulary) + 2, np.int64)
    for row in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():
        held[row.term] = row.n  # the two totals are the last entries
    return int(held[_DOCUMENTS]), int(held[_WORDS]), held[:len(vocabulary)]


def weight(documents: int, held: int) -> int:
    """Thousandths of the logarithm of a term's rarity, rounded down."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


# ---- a chunk and its index -------------------------------------------------------------------

class Chunk:
    """Inverted index of some documents: per term its documents and what it adds to their scores."""

    def __init__(self, term, doc, length, weights, documents, total):
        size = len(length)
        key, tf = np.unique(term.astype(np.int64) * size + doc, return_counts=True)
        self.docs = size
        self.at = key % size
        owner = key // size
        measure = np.array([50 + 50 * n * documents // total for n in length], np.int64)
        self.gain = weights[owner] * (1_000_000_000 * tf // (1000 * tf + 20 * measure[self.at]))
        self.terms, starts = np.unique(owner, return_index=True)
        self.starts = np.r_[starts, len(key)]
        self.most = np.maximum.reduceat(self.gain, starts) if len(key) else self.gain
        self.place = dict(zip(self.terms.tolist(), range(len(self.terms))))

    def search(self, terms, k: int, bar: int = 0):
        """Documents and scores with a chance for the k best; `terms` come from rare to common.

        Scores below `bar` have none. Among the result are all documents whose score is at least the
        k-th best, and every score is whole.
        """
        lists = [self.place[t] for t in terms if t in self.place]
        left = np.r_[np.cumsum(self.most[lists][::-1])[::-1], 0] if lists else [0]
        score = np.zeros(self.docs, np.int64)
        created = np.zeros(self.docs, bool)
        creating = True
        for i, entry in enumerate(lists):
            part = slice(self.starts[entry], self.starts[entry + 1])
            at, gain = self.at[part], self.gain[part]
            if creating:
                # At this point a new document can get left[i] at most.
                held = score[created]
                kth = np.partition(held, -k)[-k] if len(held) >= k else 0
                creating = left[i] >= max(kth, bar)
            if creating:
                created[at] = True
            else:
                known = created[at]
                at, gain = at[known], gain[known]
            score[at] += gain
        found = np.flatnonzero(created & (score > 0) & (score >= bar))
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        return found, score[found]


def _order(entry):
    score, doc_id = entry
    return -score, doc_id is None, 0 if doc_id is None else doc_id


def _searched(queries, vocabulary, weights, documents, total, k, kind, limits):
    """queries: for each its terms from the rarest to the commonest; limits: documents and postings."""
    names = ["query", "doc_id", "score"]

    def run(batches):
        best = [[] for _ in queries]
        term, doc, length, ids, postings = [], [], [], [], 0

        def close():
            chunk = Chunk(np.concatenate(term), np.concatenate(doc), length, weights, documents,
                          max(total, 1))
            for q, terms in enumerate(queries):
                bar = best[q][-1][0] if len(best[q]) >= k else 0
                at, scores = chunk.search(terms, k, bar)
                if len(at):
                    joined = best[q] + [(s, ids[d]) for s, d in zip(scores.tolist(), at.tolist())]
                    best[q] = sorted(joined, key=_order)[:k]

        for batch in batches:
            names_of, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                tokens = words(texts[i].as_py())
                if not tokens:
                    continue
                found = np.fromiter(map(vocabulary.get, tokens, repeat(-1)), np.int32, len(tokens))
                found = found[found >= 0]
                term.append(found)
                doc.append(np.full(len(found), len(length), np.int64))
                length.append(len(tokens))
                ids.append(names_of[i].as_py())
                postings += len(found)
                if len(length) >= limits[0] or postings >= limits[1]:
                    close()
                    term, doc, length, ids, postings = [], [], [], [], 0
        if length:
            close()
        flat = [(q, d, s) for q, entries in enumerate(best) for s, d in entries]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], kind),
             pa.array([f[2] for f in flat], pa.int64())], names=names)
    return run


# ---- search ----------------------------------------------------------------------------------

def _words_of(batches):
    for batch in batches:
        terms = [sorted(set(words(t.as_py()))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(terms, pa.list_(pa.binary())),
             pa.array(map(len, terms), pa.int64())], names=["item_id", "terms", "size"])


def _blocks(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """(item_id, terms, block) for items with a term; the terms of a block are bounded."""
    kind = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item_id", kind),
                           T.StructField("terms", T.ArrayType(T.BinaryType())),
                           T.StructField("size", T.LongType())])
    found = stored(items.select(F.col(f"`{item_id}`").alias("item_id"), utf8(text)).mapInArrow(
        _words_of, schema).where("size > 0").withColumn("_all", F.lit(0)), "query-terms")
    placed = positions(found, "_all", ["item_id"], sums=("size",))
    before = F.col("size_through") - F.col("size")
    return stored(placed.select("item_id", "terms", F.floor(before / BLOCK_TERMS).alias("block")),
                  "query-blocks")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank, in two rounds: a part of a query, then all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    first = Window.partitionBy("query", "_part").orderBy(*order)
    last = Window.partitionBy("query").orderBy(*order)
    some = rows.withColumn("_part", part).withColumn("_r", F.row_number().over(first)).where(
        F.col("_r") <= k).drop("_part", "_r")
    return some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text",
           doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, scores above 0 only.

    Terms are words of ASCII letters, digits and whatever is beyond ASCII, A-Z lower-cased; an item's
    terms count once each. Equal scores go by the smaller id, null ids last. Null and empty texts, of
    documents or items, have no terms: such items give no rows. Each repeated row of docs is a
    document of its own, each repeated row of items a query of its own, with rows of its own. No
    documents or no items give no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text_workers(spark)
    kind = docs.schema[doc_id].dataType
    queries = _blocks(items, item_text, item_id)
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", kind),
                           T.StructField("score", T.LongType())])
    found = None
    last = queries.agg(F.max("block")).first()[0]
    for block in range(0 if last is None else last + 1):
        # At most BLOCK_TERMS terms and one more item.
        mine = queries.where(F.col("block") == block).select("item_id", "terms").collect()
        vocabulary = {}
        terms = [[vocabulary.setdefault(bytes(t), len(vocabulary)) for t in row.terms]
                 for row in mine]
        documents, total, held = frequencies(docs, vocabulary, text)
        weights = np.array([weight(documents, h) for h in held.tolist()], np.int64)
        ordered = [sorted(t, key=lambda x: (held[x], x)) for t in terms]
        hits = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), utf8(text)).mapInArrow(
            _searched(ordered, vocabulary, weights, documents, total, k, to_arrow_type(kind),
                      (CHUNK_DOCS, CHUNK_POSTINGS)), schema)
        names = spark.createDataFrame(
            [(q, row.item_id) for q, row in enumerate(mine)],
            T.StructType([T.StructField("query", T.IntegerType()),
                          T.StructField("item_id", items.schema[item_id].dataType)]))
        best = _best(hits, k).join(names, "query").select("item_id", "rank", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], T.StructType([
            T.StructField("item_id", items.schema[item_id].dataType),
            T.StructField("rank", T.IntegerType()), *schema.fields[1:]]))
    return found


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, '{_LETTERS.upper()}', '{_LETTERS}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, '{_LETTERS.upper()}', '{_LETTERS}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
size AS (SELECT count(*) AS n_all, CAST(sum(len(ws)) AS BIGINT) AS l_all FROM d WHERE len(ws) > 0),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2e0 * (SELECT n_all FROM size) + 2e0)
                                    / (2e0 * count(*) + 1e0))) AS BIGINT) AS w
  FROM tf GROUP BY 1),
part AS (
  SELECT term, doc_id, w * ((1000000000 * tf)
         // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_all) // l_all)))) AS p
  FROM tf JOIN w USING (term), size),
score AS (
  SELECT item_id, doc_id, CAST(sum(p) AS BIGINT) AS score
  FROM part JOIN q USING (term) GROUP BY ALL HAVING sum(p) > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM score)
WHERE r <= 50
"""


@register("op11_search", _SQL)
def op11_search(spark, sf_dir):
    """The 50 best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
