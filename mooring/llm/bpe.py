"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by the public pattern; each piece is encoded by itself. The tree's leaf i holds the
rank of the pair that starts at live position i (and i itself, so that the minimum is the leftmost
of the lowest rank); the root names the next merge. A merge joins two live neighbours and updates
the three leaves that it changes, in logarithmic time. Short pieces are merged side by side in
numpy, one merge per piece and round; long ones one at a time.
"""
import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.catalog import register
from mooring.llm.common import row_schema, table, text_workers

#: Pieces of up to so many bytes are merged side by side.
SHORT = 64
#: Distinct pieces that a worker remembers; a matter of speed only.
REMEMBERED = 400_000
#: Characters of text whose pieces are held at once.
GROUP_CHARS = 1 << 20
_NONE = np.iinfo(np.int64).max


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        joined = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    joined[(a, b)] = rank
        self.joined = joined
        keys = np.array([(a << 32) | b for a, b in joined], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], _NONE)
        self.pair_ranks = np.append(np.fromiter(joined.values(), np.int64, len(joined))[order], -1)
        self.known = {}

    # -- merging

    def _ranks_of(self, left, right):
        """Rank of each pair of ids, or -1 if it never merges."""
        keys = (left << 32) | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge_short(self, pieces: list) -> list:
        """Ids of pieces of at most SHORT bytes."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = [None] * len(pieces)
        size = 2
        while size <= SHORT:
            chosen = np.flatnonzero((lengths <= size) & (lengths > (size // 2 if size > 2 else 0)))
            for i in range(0, len(chosen), 20_000):
                part = chosen[i:i + 20_000]
                for k, ids in zip(part, self._side_by_side([pieces[k] for k in part], size)):
                    out[k] = ids
            size *= 2
        return out

    def _side_by_side(self, pieces: list, size: int):
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8)
        length = np.fromiter(map(len, pieces), np.int64, n)
        place = np.arange(size)
        ids = np.where(place < length[:, None], self.byte[raw.reshape(n, size)], -1)
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * size), _NONE, np.int64)
        pair = (place[:-1] + 1 < length[:, None])
        rank = self._ranks_of(np.where(pair, ids[:, :-1], 0), np.where(pair, ids[:, 1:], 0))
        tree[:, size:2 * size - 1] = np.where(pair & (rank >= 0), rank * size + place[:-1], _NONE)
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.arange(n)

        def set_leaf(row, at, right):
            """The leaf of the pair (at, right), where right may be past the piece's end."""
            real = right < length[row]
            found = self._ranks_of(ids[row, at], np.where(real, ids[row, np.minimum(
                right, size - 1)], 0))
            tree[row, size + at] = np.where(real & (found >= 0), found * size + at, _NONE)

        while True:
            rows = rows[tree[rows, 1] != _NONE]
            if not len(rows):
                break
            least = tree[rows, 1]
            at = least % size
            gone = after[rows, at]
            right = after[rows, gone]
            ids[rows, at] = least // size
            ids[rows, gone] = -1
            after[rows, at] = right
            inner = right < size
            before[rows[inner], right[inner]] = at[inner]
            tree[rows, size + gone] = _NONE
            set_leaf(rows, at, right)
            left = before[rows, at]
            some = left >= 0
            set_leaf(rows[some], left[some], at[some])
            left = np.where(some, left, at)
            nodes = [at + size, gone + size, left + size]
            for _ in range(size.bit_length() - 1):
                nodes = [node >> 1 for node in nodes]
                for node in nodes:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        live = ids >= 0
        flat, ends = ids[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        start = 0
        for end in ends:
            yield tuple(flat[start:end])
            start = end

    def merge_long(self, piece: bytes) -> tuple:
        """Ids of one piece of any length."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joined = self.joined
        none = int(_NONE)
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = joined.get((ids[i], ids[i + 1]))
            if rank is not None:
                tree[size + i] = rank * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(at, value):
            node = size + at
            if tree[node] == value:
                return
            tree[node] = value
            node >>= 1
            while node:
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value
                node >>= 1

        def pair(at):
            right = after[at]
            rank = joined.get((ids[at], ids[right])) if right < n else None
            return none if rank is None else rank * size + at

        while tree[1] != none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            ids[at], ids[gone] = rank, -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            update(gone, none)
            update(at, pair(at))
            if before[at] >= 0:
                update(before[at], pair(before[at]))
        return tuple(i for i in ids if i >= 0)

    # -- texts

    def learn(self, pieces) -> None:
        """Makes the ids of all the given pieces known."""
        missing = [p for p in set(pieces) if p not in self.known]
        short, kept = [], []
        for piece in missing:
            data = piece.encode("utf-8")
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[piece] = (whole,)
            elif len(data) <= SHORT:
                short.append(data)
                kept.append(piece)
            else:
                self.known[piece] = self.merge_long(data)
        for piece, ids in zip(kept, self.merge_short(short)):
            self.known[piece] = ids

    def encode_all(self, texts):
        """The list of ids of each text, in groups of bounded size."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts):
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = [self.find(text) for text in texts]
        self.learn(chain.from_iterable(split))
        for pieces in split:
            yield list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_CODECS = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _rows(docs: DataFrame, columns, value: str) -> DataFrame:
    text_workers(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                       F.col(f"`{value}`").alias("value"))


def encode(docs: DataFrame, path: str, pattern: str, columns=("doc_id",),
           text: str = "text") -> DataFrame:
    """The given columns and `ids` (array of int) of each whole text; a null text has none."""
    inner = _rows(docs, columns, text)

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids = list(own.encode_all(v.as_py() for v in batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["row", "ids"])

    return inner.mapInArrow(
        run, row_schema(inner, "ids array<int>")).select(
        "row.*", "ids")


def decode(coded: DataFrame, path: str, pattern: str, columns=("doc_id",),
           ids: str = "ids") -> DataFrame:
    """The given columns and `data`, the bytes that the ids stand for; null ids give no bytes."""
    inner = _rows(coded, columns, ids)

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            data = [own.decode(v.as_py() or ()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(data, pa.binary())], names=["row", "data"])

    return inner.mapInArrow(
        run, row_schema(inner, "data binary")).select(
        "row.*", "data")


def round_trip(docs: DataFrame, path: str, pattern: str, columns=("doc_id",),
               text: str = "text") -> DataFrame:
    """Digests of the ids and of what they decode to, computed where the text is read.

    A null text counts as empty. Repeated rows stay; no rows give no rows.
    """
    inner = _rows(docs, columns, text)

    def run(batches):
        own = codec(path, pattern)
        decimal = {i: str(i) for i in own.token}
        for batch in batches:
            counts, coded, decoded = [], [], []
            for ids in own.encode_all(v.as_py() for v in batch.column(1)):
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(
                    decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
                 pa.array(decoded, pa.string())],
                names=["row", "n_tokens", "ids_sha256", "decoded_sha256"])

    return inner.mapInArrow(run, row_schema(
        inner, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")).select(
        "row.*", "n_tokens", "ids_sha256", "decoded_sha256")


@register("op9_bpe")
def op9_bpe(spark, sf_dir):
    """Token count and digests of every document."""
    import public_tokenizers
    return round_trip(table(spark, sf_dir, "documents"),
                      public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)
