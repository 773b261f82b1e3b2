"""Best-fit packing planned on the histogram of lengths.

Only the histogram, one count per possible length, reaches the driver. Best-fit-decreasing runs over
counts: all pieces of a length that go into equally filled sequences are placed by one step, so the
plan has a few thousand rows whatever the corpus. Pieces then take the planned slots by their rank
within their length.
"""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.catalog import register
from mooring.llm.common import row_schema, stored, table, text_workers
from mooring.scale import positions

CAPACITY = 1024
END_ID = 2


# ---- pieces ---------------------------------------------------------------------------------

_ENCODERS = {}


def _encoder(rank_path: str, pattern: str, special: tuple):
    """tiktoken over the rank file: the same ids as the vocabulary's own tokenizer, but faster."""
    if rank_path not in _ENCODERS:
        import base64

        import tiktoken
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        _ENCODERS[rank_path] = tiktoken.Encoding(
            "packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    return _ENCODERS[rank_path]


def _splitter(rank_path, pattern, special, capacity, end_id, with_ids):
    names = [s for s, _ in special]

    def run(batches):
        own = _encoder(rank_path, pattern, special)
        for batch in batches:
            index, piece, start, length, crc, kept = [], [], [], [], [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                ids = (own.encode(text, allowed_special="all") if any(s in text for s in names)
                       else own.encode_ordinary(text))
                ids.append(end_id)
                flat = np.array(ids, "<u4")
                # Only the first piece may be shorter.
                first = len(flat) % capacity or capacity
                cuts = [0, *range(first, len(flat) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    index.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(flat[a:b].tobytes()))
                    if with_ids:
                        kept.append(flat[a:b])
            columns = [batch.column(0).take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                       pa.array(crc, pa.int64())]
            names_ = ["row", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([k.astype(np.int32) for k in kept], pa.list_(pa.int32())))
                names_.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names_)
    return run


def pieces(docs: DataFrame, rank_path: str, pattern: str, special: dict, columns=("doc_id",),
           text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """The given columns with piece, start, length and ids_crc32 (and ids, if wanted).

    A document is its ids and the end id. Longer ones are cut so that only the first piece may be
    shorter than the capacity. A null text counts as empty: one piece, the end id.
    """
    text_workers(docs.sparkSession)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                        F.col(f"`{text}`").alias("text"))
    return inner.mapInArrow(
        _splitter(rank_path, pattern, tuple(special.items()), capacity, end_id, with_ids),
        row_schema(inner, "piece int, start bigint, length bigint, ids_crc32 bigint"
                   + (", ids array<int>" if with_ids else "")))


# ---- plan -----------------------------------------------------------------------------------

def plan(histogram: dict, capacity: int = CAPACITY) -> list:
    """Slots (length, first rank, ranks, first sequence, per sequence, offset), ranks from 0.

    Lengths go from long to short. All sequences with equal room are one or more runs of numbers;
    a step fills the runs with the least room that still fits, else opens new sequences. A slot
    with `per` > 1 holds that many pieces side by side in each of its sequences.
    """
    rooms = {}  # room -> runs (first sequence, sequences)
    slots, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                room = capacity
                first, count = opened, max(1, left // (capacity // length))
                opened += count
            else:
                first, count = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            # Best fit puts further pieces of this length where it has just put one.
            per = min(room // length, left)
            used = min(count, left // per)
            slots.append((length, rank, used * per, first, per, capacity - room))
            rank += used * per
            left -= used * per
            if used < count:
                rooms.setdefault(room, []).append((first + used, count - used))
            if room > per * length:
                rooms.setdefault(room - per * length, []).append((first, used))
    return slots


SLOTS = "length long, rank long, ranks long, first long, per long, at long"


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces with sequence_id and offset.

    A length may be that of a third of all pieces: ranks within lengths come from a distributed sort
    whose slices are counted, not from one task. No pieces give no rows.
    """
    spark = parts.sparkSession
    # At most `capacity` rows.
    histogram = dict(parts.groupBy("length").count().collect())
    # A few thousand rows: the plan depends on the number of lengths, not of pieces.
    slots = spark.createDataFrame(plan(histogram, capacity), SLOTS)
    placed = positions(parts.withColumn("_tie", F.xxhash64("row", F.monotonically_increasing_id())),
                       "length", ["piece", "ids_crc32", "_tie"])
    at = F.col("position") - 1
    slots = slots.withColumnRenamed("length", "_length")
    joined = placed.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (
        at >= F.col("rank")) & (at < F.col("rank") + F.col("ranks")))
    k = at - F.col("rank")
    return joined.select(
        *parts.columns, (F.col("first") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + k % F.col("per") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, columns=("doc_id",), text: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False):
    """Pieces of docs in the public 50k vocabulary, packed; the given columns come first.

    With ids, narrow keys are ranked, and each stored piece meets its place once, at the end. A null
    text counts as empty: one piece, the end id. Repeated rows have pieces of their own, pieces of
    equal length any order. No documents give no rows.
    """
    import public_tokenizers
    found = pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                   public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, columns, text,
                   capacity, end_id, with_ids)
    if not with_ids:
        packed = pack(stored(found, "pieces"), capacity)
        return packed.select("row.*", *packed.columns[1:])
    parts = stored(found.withColumn("_key", F.monotonically_increasing_id()), "pieces")
    keys = parts.select(F.col("_key").alias("row"), "piece", "length", "ids_crc32")
    placed = pack(keys, capacity).select(F.col("row").alias("_key"), "sequence_id", "offset")
    # The narrow side is hashed, so that ids are not sorted.
    whole = parts.join(placed.hint("shuffle_hash"), "_key")
    return whole.select("row.*", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                        "ids")


@register("op5_packing")
def op5_packing(spark, sf_dir):
    """Sequence and offset of every piece of every document."""
    return pack_documents(table(spark, sf_dir, "documents"))
