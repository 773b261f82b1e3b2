"""Interpolated modified Kneser-Ney language model over words, of order two.

Counting runs in Spark. Tasks turn texts into arrays of token hashes and count in numpy, and send
sorted arrays, cut into ranges of the key, instead of a row for each n-gram. A range is merged by
one task and written to the shared folder as two plain arrays: sorted keys, and counts. Ranges get
more as the corpus grows, so no task holds more than a bounded share of the model. Workers map the
arrays into memory and look up sorted batches of keys; nothing is loaded whole.

Word ids are ranks in the sorted array of word hashes, so that a bigram is one exact long.
"""
import itertools
import os

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.catalog import register
from mooring.llm.common import crc_remainder, row_schema, stored, table, text_workers
from mooring.session import scratch_path

#: Distinct n-grams that one task merges, on average.
RANGE_KEYS = 4_000_000
#: Texts are tokenised in groups of about this many bytes.
GROUP_BYTES = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---- tokens ---------------------------------------------------------------------------------

def _mix(x):
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = {}


def _powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1), kept for the next group of texts."""
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        have = np.ones(max(count, GROUP_BYTES + 1), np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if count <= GROUP_BYTES + 1:
            _POWERS[base] = have
    return have[:count]


_BYTE_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]  # A-Z count as a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: The hash that stands for the end of a text; word hashes are never 0 or 1.
END = np.uint64(1)


def tokens(data: bytes, limits: np.ndarray):
    """(hash of each token, tokens per text) for texts data[limits[i]:limits[i+1]] in UTF-8.

    A token's hash is a polynomial in its bytes, taken from running sums. Each text ends in END.
    """
    raw = np.frombuffer(data, np.uint8)
    count = len(limits) - 1
    padded = np.ones(len(raw) + 1, bool)
    padded[:-1] = _IS_SPACE[raw]
    # A text's end ends a word too: a word starts where a byte is no space and a space is before.
    starts_text = np.zeros(len(raw) + 1, bool)
    starts_text[limits] = True
    inside = ~padded
    begins = inside.copy()
    begins[1:] &= padded[:-1] | starts_text[1:]
    ends = np.zeros(len(raw) + 1, bool)
    ends[1:] = inside[:-1] & (padded[1:] | starts_text[1:])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    back = _powers(_INVERSE, len(raw) + 1)
    words = _mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64) * _ODD)
    words = np.maximum(words, np.uint64(2))
    owner = np.searchsorted(limits, first, side="right") - 1
    per_text = np.bincount(owner, minlength=count)[:count] + 1
    stops = np.cumsum(per_text) - 1
    out = np.full(int(per_text.sum()), END, np.uint64)
    free = np.ones(len(out), bool)
    free[stops] = False
    out[free] = words
    return out, per_text


def _groups(column):
    """(data, limits) of slices of a text column, each of bounded size but for single long texts."""
    column = column.cast(pa.large_string()).fill_null("")
    begin = 0
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    while begin < len(column):
        end = int(np.searchsorted(offsets, offsets[begin] + GROUP_BYTES, side="right")) - 1
        end = max(begin + 1, min(end, len(column)))
        lo, hi = int(offsets[begin]), int(offsets[end])
        piece = memoryview(data)[lo:hi] if data is not None and hi > lo else b""
        yield piece, offsets[begin:end + 1] - lo
        begin = end


# ---- sorted arrays --------------------------------------------------------------------------

def _count(keys: np.ndarray, counts=None):
    """Distinct keys in order, with the sum of their counts."""
    if counts is None:
        found, n = np.unique(keys, return_counts=True)
        return found, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each key by its hash: even, whatever words are frequent."""
    return (_mix(keys) % np.uint64(ranges)).astype(np.int64)


def _small(counts: np.ndarray) -> np.ndarray:
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(counts) or counts.max() <= np.iinfo(kind).max:
            return counts.astype(kind)
    return counts.astype(np.uint64)


def _packed(keys, counts, ranges: int):
    """A record batch with one row per range that has keys."""
    of = _range_of(keys, ranges)
    order = np.argsort(of, kind="stable")
    of, keys, counts = of[order], keys[order], counts[order]
    cuts = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)] if len(of) else np.zeros(1, int)
    # Sorted keys share their high bytes, so bytes of one place compress well side by side.
    rows = [(int(of[a]), keys[a:b].view(np.uint8).reshape(-1, 8).T.tobytes(), _small(counts[a:b]))
            for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
         pa.array([r[2].tobytes() for r in rows], pa.binary()),
         pa.array([r[2].dtype.itemsize for r in rows], pa.int32())],
        names=["range", "keys", "counts", "width"])


PACKED = "range int, keys binary, counts binary, width int"
_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def _open(path: str):
    where, inner = fs.FileSystem.from_uri(path)
    return where, inner


def _mapped(path: str, kind) -> np.ndarray:
    """The array in the file, mapped. A file that no local path reaches is read into memory."""
    where, inner = _open(path)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(inner, kind, "r") if os.path.getsize(inner) else np.zeros(0, kind)
    with where.open_input_stream(inner) as stream:
        return np.frombuffer(stream.read(), kind)


def _write(path: str, array: np.ndarray) -> None:
    """Whole or not at all, and the same bytes from any attempt."""
    where, inner = _open(path)
    part = f"{inner}.{os.getpid()}-{os.urandom(4).hex()}"
    where.create_dir(os.path.dirname(inner), recursive=True)
    with where.open_output_stream(part) as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")
    where.move(part, inner)


def _merger(folder: str):
    """Merges the rows of each range, writes the arrays, gives statistics of each file."""
    def merge(batches):
        rows = ((batch.column(0)[i].as_py(), batch, i) for batch in batches
                for i in range(batch.num_rows))
        for number, group in itertools.groupby(rows, key=lambda r: r[0]):
            keys, counts, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
            waiting = 0
            for _, batch, i in group:
                k = np.ascontiguousarray(np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                                         .reshape(8, -1).T).view(np.uint64).ravel()
                c = np.frombuffer(batch.column(2)[i].as_buffer(),
                                  _WIDTHS[batch.column(3)[i].as_py()]).astype(np.int64)
                held.append((k, c))
                waiting += len(k)
                if waiting > max(RANGE_KEYS // 2, len(keys)):
                    keys, counts = _count(np.concatenate([keys, *[h[0] for h in held]]),
                                          np.concatenate([counts, *[h[1] for h in held]]))
                    held, waiting = [], 0
            keys, counts = _count(np.concatenate([keys, *[h[0] for h in held]]),
                                  np.concatenate([counts, *[h[1] for h in held]]))
            _write(f"{folder}/{number}.keys", keys)
            _write(f"{folder}/{number}.counts", _small(counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([len(keys)], pa.int64()),
                 pa.array([int(counts.sum())], pa.int64()),
                 pa.array([_small(counts).dtype.itemsize], pa.int32()),
                 *[pa.array([int((counts == n).sum())], pa.int64()) for n in (1, 2, 3, 4)]],
                names=["range", "size", "total", "width", "n1", "n2", "n3", "n4"])
    return merge


FILES = "range int, size bigint, total bigint, width int, n1 bigint, n2 bigint, n3 bigint, n4 bigint"


def _merged(rows: DataFrame, label: str, ranges: int) -> dict:
    """Merges packed rows into files of sorted arrays; returns where they are and their sums."""
    folder = scratch_path(rows.sparkSession, label)
    files = stored(rows.repartition(min(ranges, 10_000), "range").sortWithinPartitions(
        "range").mapInArrow(_merger(folder), FILES), label + "-files").collect()
    out = {"folder": folder, "ranges": ranges,
           # One entry per file of millions of keys.
           "width": {f["range"]: f["width"] for f in files},
           "sizes": {f["range"]: f["size"] for f in files}}
    out |= {k: sum(f[k] for f in files) for k in ("size", "total", "n1", "n2", "n3", "n4")}
    return out


class Sorted:
    """Look-up in the files of one merged table."""

    def __init__(self, files: dict):
        self.files, self.open = files, {}
        sizes = [files["sizes"].get(n, 0) for n in range(files["ranges"])]
        self.before = np.cumsum([0, *sizes])

    def _arrays(self, number: int):
        if number not in self.open:
            base = f"{self.files['folder']}/{number}"
            self.open[number] = (_mapped(base + ".keys", np.uint64), _mapped(
                base + ".counts", _WIDTHS[self.files["width"][number]]))
        return self.open[number]

    def find(self, keys: np.ndarray):
        """Count and rank of sorted distinct keys: count 0, and no meaning to the rank, if absent."""
        of = _range_of(keys, self.files["ranges"])
        counts, ranks = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        order = np.argsort(of, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(of[order])) + 1, len(of)] if len(of) else [0]
        for a, b in zip(cuts, cuts[1:]):
            number = int(of[order[a]])
            if number not in self.files["width"]:
                continue
            mine = order[a:b]
            have, n = self._arrays(number)
            at = np.minimum(np.searchsorted(have, keys[mine]), len(have) - 1)
            hit = have[at] == keys[mine]
            counts[mine] = np.where(hit, n[at], 0)
            ranks[mine] = at + self.before[number]
        return counts, ranks


# ---- counting -------------------------------------------------------------------------------

def _tally(pieces, ranges: int):
    """Packed rows of the keys that `pieces` yields with their counts, in bounded memory."""
    keys, counts, held, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    for piece in pieces:
        held.append(piece)
        waiting += len(piece[0])
        if waiting > max(RANGE_KEYS // 2, len(keys)):
            keys, counts = _count(np.concatenate([keys, *[h[0] for h in held]]),
                                  np.concatenate([counts, *[h[1] for h in held]]))
            held, waiting = [], 0
            if len(keys) > RANGE_KEYS:
                yield _packed(keys, counts, ranges)
                keys, counts = keys[:0], counts[:0]
    keys, counts = _count(np.concatenate([keys, *[h[0] for h in held]]),
                          np.concatenate([counts, *[h[1] for h in held]]))
    if len(keys):
        yield _packed(keys, counts, ranges)


def _word_counter(ranges: int):
    def run(batches):
        return _tally((_count(tokens(*group)[0]) for batch in batches
                       for group in _groups(batch.column(0))), ranges)
    return run


def _previous(ids: np.ndarray, per_text: np.ndarray, start: int) -> np.ndarray:
    """The id before each token; `start` for the first of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(per_text) - per_text] = start
    return before


def _bigram_counter(words: dict, ranges: int):
    def run(batches):
        table_ = Sorted(words)

        def pieces():
            for batch in batches:
                for group in _groups(batch.column(0)):
                    found, per_text = tokens(*group)
                    distinct, back = np.unique(found, return_inverse=True)
                    ids = table_.find(distinct)[1].astype(np.uint64)[back]
                    before = _previous(ids, per_text, words["size"])
                    yield _count((before << np.uint64(32)) | ids)
        return _tally(pieces(), ranges)
    return run


def _marginal_counter(bigrams: dict, ranges: int, followers: bool):
    """Of each bigram file: followers of a word that occur once, twice, more often after it (keys
    id * 4 + 1, 2, 3), or distinct words before a word (key id)."""
    def run(batches):
        def pieces():
            for batch in batches:
                for number in batch.column(0).to_pylist():
                    table_ = Sorted(bigrams)
                    keys, counts = table_._arrays(number)
                    for i in range(0, len(keys), RANGE_KEYS // 2):
                        k, c = keys[i:i + RANGE_KEYS // 2], counts[i:i + RANGE_KEYS // 2]
                        if followers:
                            yield _count((k >> np.uint64(32)) * np.uint64(4)
                                         + np.minimum(c, 3).astype(np.uint64))
                        else:
                            yield _count(k & np.uint64(0xFFFFFFFF))
        return _tally(pieces(), ranges)
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple:
    """Modified Kneser-Ney discounts of counts one, two, and three or more, from counts of counts.

    Where a count of counts is zero, as in tiny corpora, half the count is discounted.
    """
    n = (n1, n2, n3, n4)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2
        out.append(min(max(d, 0.05 * k), float(k)))
    return tuple(out)


def train(docs: DataFrame, text: str = "text") -> dict:
    """Counts the corpus and writes its model; returns the paths and sums that scoring needs.

    Null and empty texts count as texts of one token, the end. No rows give a model in which
    every token has the same probability.
    """
    spark = docs.sparkSession
    text_workers(spark)
    only = docs.select(F.col(f"`{text}`").alias("text"))
    size = only.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    ranges = 1 + (size[0] or 0) // (8 * RANGE_KEYS)
    words = _merged(only.mapInArrow(_word_counter(ranges), PACKED), "words", ranges)
    if words["size"] >= 1 << 32:
        raise ValueError("ids of more than 2**32 distinct words don't fit a bigram key")
    pairs = _merged(only.mapInArrow(_bigram_counter(words, ranges), PACKED), "bigrams", ranges)
    files = spark.createDataFrame([(n,) for n in pairs["width"]], "range int").repartition(
        max(1, len(pairs["width"])), "range")

    def marginal(followers, label):
        return _merged(files.mapInArrow(_marginal_counter(pairs, ranges, followers), PACKED), label,
                       ranges)

    return {"words": words, "pairs": pairs, "texts": size[1],
            "followers": marginal(True, "followers"), "contexts": marginal(False, "contexts")}


# ---- scoring --------------------------------------------------------------------------------

def _scorer(model: dict):
    total, vocabulary = model["words"]["total"], model["words"]["size"]
    start = vocabulary
    kinds = model["pairs"]["size"]
    upper = np.array([0.0, *discounts(*[model["pairs"][f"n{k}"] for k in (1, 2, 3, 4)])])
    lower = np.array([0.0, *discounts(*[model["contexts"][f"n{k}"] for k in (1, 2, 3, 4)])])

    def run(batches):
        words, pairs = Sorted(model["words"]), Sorted(model["pairs"])
        followers, contexts = Sorted(model["followers"]), Sorted(model["contexts"])
        c = model["contexts"]
        spare = (lower[1] * c["n1"] + lower[2] * c["n2"] + lower[3] * (
            c["size"] - c["n1"] - c["n2"])) / kinds if kinds else 1.0
        uniform = 1.0 / (vocabulary + 1)

        def score(group):
            found, per_text = tokens(*group)
            distinct, back = np.unique(found, return_inverse=True)
            count, ids = words.find(distinct)
            known = count > 0
            ids[~known] = -1
            # Lower order: in how many distinct contexts a word was seen.
            order = np.argsort(ids)
            cont = np.zeros(len(ids), np.int64)
            real = order[ids[order] >= 0]
            cont[real] = contexts.find(ids[real].astype(np.uint64))[0]
            base = spare * uniform + np.maximum(
                cont - lower[np.minimum(cont, 3)], 0) / max(kinds, 1)
            # What a context leaves to the lower order.
            left = np.ones(len(ids) + 1)
            seen = np.append(count, model["texts"])
            heads = np.append(ids[real], start).astype(np.uint64)
            at = np.append(real, len(ids))
            mass = np.zeros(len(heads))
            for k in (1, 2, 3):
                mass += upper[k] * followers.find(heads * np.uint64(4) + np.uint64(k))[0]
            left[at] = np.where(seen[at] > 0, mass / np.maximum(seen[at], 1), 1.0)
            token_ids = ids[back]
            before = _previous(token_ids, per_text, start)
            where = _previous(back.astype(np.int64), per_text, len(ids))
            both = (token_ids >= 0) & (before >= 0)
            keys, again = np.unique((before[both].astype(np.uint64) << np.uint64(32))
                                    | token_ids[both].astype(np.uint64), return_inverse=True)
            n = pairs.find(keys)[0][again]
            p = left[where] * base[back]
            p[both] += np.maximum(n - upper[np.minimum(n, 3)], 0) / np.maximum(
                seen[where[both]], 1)
            first = np.cumsum(per_text) - per_text
            plain = np.log10((count + 1) / (total + vocabulary + 1))

            def per(values):
                return np.add.reduceat(values, first)

            return (per_text, per(known[back].astype(np.int64)), per(plain[back]),
                    per(np.log10(p)))

        for batch in batches:
            parts = [score(group) for group in _groups(batch.column(1))]
            columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0)
                       for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0].astype(np.int64)),
                 pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(float)),
                 pa.array(columns[3].astype(float))],
                names=["row", "n_tokens", "n_known", "base_score", "score"])
    return run


def score(docs: DataFrame, model: dict, columns=("doc_id",), text: str = "text") -> DataFrame:
    """The given columns of docs with n_tokens, n_known, base_score and score of each whole text.

    A null text counts as empty. Repeated rows are scored alike. `perplexity` gives the usual
    figure from score and n_tokens.
    """
    text_workers(docs.sparkSession)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                        F.col(f"`{text}`").alias("text"))
    return inner.mapInArrow(_scorer(model), row_schema(
        inner, "n_tokens bigint, n_known bigint, base_score double, score double")).select(
        "row.*", "n_tokens", "n_known", "base_score", "score")


def perplexity(score_column: str = "score", tokens_column: str = "n_tokens"):
    return F.pow(F.lit(10.0), -F.col(score_column) / F.col(tokens_column))


@register("op3_ngram_lm")
def op3_ngram_lm(spark, sf_dir):
    """Base and model log-probability of every document; fold 2 of 7 isn't learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model["words"]["total"]).cast("long").alias("train_tokens"), "base_score", "score",
        perplexity().alias("perplexity"))
