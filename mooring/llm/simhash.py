"""SimHash near-duplicates through an inverted index over byte positions.

Fingerprints of 64 bits that differ in three bits or fewer share at least five of their eight
bytes, place for place. The index has a list for each of some choices of four byte places and
their values; any five places hold one of the choices (14 suffice), so every such pair meets. In
a list the shared positional bytes of pairs are tallied; pairs with five or more are verified by
their differing bits.

Lists hold distinct fingerprints, so exact copies never meet. Each list gives a spanning forest of
its links, which keeps connectivity and never more rows than its members. Lists beyond a cap are
indexed again with a fifth place, which such pairs must share too; those hold at most 2**24.
"""
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.catalog import register
from mooring.llm.common import fresh, stored, table, text_workers
from mooring.llm.components import components

WORDS = 3
SEED = 42
MAX_BITS = 3
BYTES = 8
#: Bytes that a linked pair shares at least: each differing bit spoils one byte at most.
MIN_SHARED = BYTES - MAX_BITS
KEY_BYTES = 4
#: Lists with more members are split by a further byte.
LIST_CAP = 20_000


def fingerprint(text, words: int = WORDS, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the hashes of all word shingles; 0 for no word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(
        starts, ends[words - 1:].tolist())], np.uint64)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8)
        bits += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1)
        found = [fingerprint(texts[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))],
            names=["row", "fp"])


def with_fingerprint(docs: DataFrame, columns, text: str = "text") -> DataFrame:
    """(row struct of columns, fp) for each document."""
    text_workers(docs.sparkSession)
    inner = docs.select(F.struct(*columns).alias("row"), F.col(f"`{text}`").alias("t"))
    return inner.mapInArrow(
        _fingerprints, f"row {inner.schema['row'].dataType.simpleString()}, fp bigint")


def _masks(size: int) -> dict:
    """Place set (as bits) -> mask of those bytes, as a signed long."""
    masks = {}
    for places in combinations(range(BYTES), size):
        value = sum(0xFF << (8 * p) for p in places)
        masks[sum(1 << p for p in places)] = value - (1 << 64) if value >> 63 else value
    return masks


def cover(subset: int = KEY_BYTES, shared: int = MIN_SHARED) -> list:
    """Place sets of `subset` bytes so that any `shared` places hold one of them, greedily few."""
    wanted = {frozenset(c) for c in combinations(range(BYTES), shared)}
    choices = [frozenset(c) for c in combinations(range(BYTES), subset)]
    picked = []
    while wanted:
        best = max(choices, key=lambda c: (sum(c <= w for w in wanted), sorted(c)))
        picked.append(sum(1 << p for p in best))
        wanted = {w for w in wanted if not best <= w}
    return picked


def index(fps: DataFrame, places: list) -> DataFrame:
    """(places, shared, fp): the inverted index, a row per place set of each fingerprint."""
    masks = _masks(bin(places[0]).count("1"))
    entry = F.explode(F.array(*[F.struct(
        F.lit(s).cast("short").alias("places"),
        F.col("fp").bitwiseAND(F.lit(masks[s])).alias("shared")) for s in places]))
    return fps.select("fp", entry.alias("e")).select("e.places", "e.shared", "fp")


def _refine(entries: DataFrame) -> DataFrame:
    """Entries of long lists again, with one more place each."""
    masks = _masks(1)
    options = [F.when(F.col("places").bitwiseAND(F.lit(s)) == 0, F.struct(
        F.col("places").bitwiseOR(F.lit(s)).cast("short").alias("places"),
        F.col("shared").bitwiseOR(F.col("fp").bitwiseAND(F.lit(m))).alias("shared")))
        for s, m in masks.items()]
    return entries.select("fp", F.explode(F.array_compact(F.array(*options))).alias("e")).select(
        "e.places", "e.shared", "fp").distinct()


def forest(members: np.ndarray, max_bits: int = MAX_BITS) -> list:
    """Links (i, j) of a spanning forest of the pairs that share enough bytes and differ little."""
    left = np.arange(len(members))
    links = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            differ = members[left] ^ members[i]
            tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            close = tally >= MIN_SHARED
            close[close] = np.bitwise_count(differ[close]) <= max_bits
            if close.any():
                found = left[close]
                links += [(i, j) for j in found]
                queue += found.tolist()
                left = left[~close]
    return links


def _links_of_lists(batches):
    """Rows come sorted by list; a list may go on in the next batch."""
    kept = None

    def links(places, shared, fp):
        breaks = np.flatnonzero((places[1:] != places[:-1]) | (shared[1:] != shared[:-1])) + 1
        starts, ends = np.r_[0, breaks], np.r_[breaks, len(fp)]
        a, b = [], []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            members = np.ascontiguousarray(fp[s:e]).view(np.uint64)
            for i, j in forest(members):
                a.append(fp[s + i])
                b.append(fp[s + j])
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(3)]
        if not len(now[0]):
            continue
        if kept is not None:
            now = [np.concatenate(pair) for pair in zip(kept, now)]
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        cut = int(np.argmax(same))
        if cut:
            yield links(*[x[:cut] for x in now])
        kept = [x[cut:] for x in now]
    if kept is not None:
        yield links(*kept)


def _links(entries: DataFrame) -> DataFrame:
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartition(parts, "places", "shared").sortWithinPartitions(
        "places", "shared").mapInArrow(_links_of_lists, "a bigint, b bigint")


def links(fps: DataFrame, list_cap: int = LIST_CAP) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fp that join the same components as all."""
    text_workers(fps.sparkSession)
    entries = index(fps, cover())
    long_lists = stored(entries.groupBy("places", "shared").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") > list_cap).drop("n"), "long-lists")
    if long_lists.isEmpty():
        return _links(entries)
    short = entries.join(long_lists, ["places", "shared"], "left_anti")
    split = _refine(entries.join(long_lists, ["places", "shared"], "left_semi"))
    return _links(short).union(_links(split))


def near_groups(marked: DataFrame, first: str, list_cap: int = LIST_CAP) -> DataFrame:
    """(fp, group): group is the smallest value of column `first` reachable by links."""
    own = stored(marked.groupBy("fp").agg(F.min(first).alias("first")), "fingerprints")
    roots = components(links(own.select("fp"), list_cap))
    placed = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    smallest = stored(placed.groupBy("root").agg(F.min("first").alias("group")), "groups")
    return stored(placed.select("fp", "root"), "placed").join(smallest, "root").select("fp", "group")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    list_cap: int = LIST_CAP) -> DataFrame:
    """(doc_id, fp, component_id), one row per document.

    A null text counts as empty: its fingerprint is zero, and it links with others like it. Null
    ids get a row too but are never a component's id, unless it has no other (then it is null).
    Repeated rows stay repeated. No rows give no rows. Other columns are ignored.
    """
    marked = stored(with_fingerprint(docs, [F.col(f"`{doc_id}`").alias("doc_id")], text).select(
        "row.doc_id", "fp"), "marked")
    groups = stored(near_groups(marked, "doc_id", list_cap), "near-groups")
    return marked.join(groups, "fp").select("doc_id", "fp", F.col("group").alias("component_id"))


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
         list_cap: int = LIST_CAP) -> DataFrame:
    """One document of each group: the one with the smallest id, then text hash.

    Null ids come after all others. Of rows equal in id and text one stays.
    """
    mark = F.struct(F.col(f"`{doc_id}`").isNull().alias("absent"), F.col(f"`{doc_id}`").alias("id"),
                    F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h"))
    marked = stored(with_fingerprint(docs, [mark.alias("mark")], text).select(
        "row.mark", "fp"), "marked")
    groups = near_groups(marked, "mark", list_cap)
    stay = stored(groups.select("group").distinct(), "survivors")
    name = fresh(docs.columns, "_mark")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.to_json(mark).alias(name))
    chosen = stay.select(F.to_json("group").alias(name))
    return rows.join(chosen, name, "left_semi").dropDuplicates([name]).select("row.*")


@register("op2_simhash")
def op2_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")
