"""Language identification by cross-parsing.

For each language a bounded reference text is taken from labelled documents and its suffix
automaton built. A text is then parsed against every reference: each phrase is the longest run
of letters that occurs in it. A reference in the text's own language gives long phrases, so the
language that needs the fewest, normalised by its text's size, wins.

The automata are dense tables (state x letter), and many stretches of text walk through them side
by side in numpy, one letter per step.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mooring.llm.catalog import register
from mooring.llm.common import crc_remainder, row_schema, table, text_workers

#: Letters of reference text per language: the bound of the sample that is fitted.
REFERENCE_CHARS = 60_000
#: Whole texts are parsed in stretches of this many letters; a phrase ends with its stretch.
STRETCH = 2_048
#: Texts of MIN_LETTERS or more with fewer letters per phrase than this, in the best language,
#: resemble none; in shorter ones phrases are too few to tell.
MIN_PHRASE = 2.0
MIN_LETTERS = 200
UNDETERMINED = "und"


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
           chars: int = REFERENCE_CHARS) -> dict:
    """At most `chars` characters of reference text per language, from hash-ordered documents.

    Counts decide the share of documents drawn, so only about as many texts as needed move.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        F.xxhash64(F.lit("reference"), F.col(doc_id).cast("string"), F.col(text)).alias("h"))
    # One row per language value.
    sizes = known.groupBy("lang").agg(F.sum(F.length("text")).alias("size")).collect()
    sizes = docs.sparkSession.createDataFrame(sizes, "lang string, size long")
    share = F.lit(2.0 * chars) / F.greatest(F.col("size"), F.lit(1))
    drawn = known.join(F.broadcast(sizes), "lang").where(
        (F.col("h").cast("double") / 2.0 ** 64 + 0.5 <= share) | (F.col("size") <= 8 * chars))
    # The fewest texts that reach `chars`: those at whose start the sum is still below.
    before = Window.partitionBy("lang").orderBy("h", "text").rowsBetween(
        Window.unboundedPreceding, -1)
    taken = drawn.withColumn("before", F.coalesce(
        F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") < chars)
    texts = {}
    # Bounded: the parameter's characters for each language value.
    for row in taken.select("lang", "before", F.substring("text", 1, chars).alias("text")).orderBy(
            "lang", "before").toLocalIterator():
        texts[row.lang] = (texts.get(row.lang, "") + " " + row.text)[:chars]
    return texts


def letters_only(text: str) -> str:
    """Lower case; each run of other characters becomes one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(text: str, alphabet: dict) -> np.ndarray:
    """Suffix automaton of text as a table [state, letter] -> next state, -1 where there is none.

    Every state is final for our purpose: a walk from state 0 spells a substring of text.
    """
    edges, link, longest = [{}], [-1], [0]
    last = 0
    for c in (alphabet[x] for x in text):
        here = len(edges)
        edges.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = here
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if longest[q] == longest[p] + 1:
                link[here] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    table_ = np.full((len(edges), len(alphabet) + 1), -1, np.int32)
    for state, out in enumerate(edges):
        for c, to in out.items():
            table_[state, c] = to
    return table_


def fit(texts: dict) -> dict:
    """Alphabet, languages, and per language the walk table and the reference's size.

    The walk table has the restart built in: where a state has no edge, it holds the state after
    restarting with that letter, plus the number of states as a mark that a phrase ended.
    """
    texts = {lang: letters_only(t) for lang, t in sorted(texts.items())}
    texts = {lang: t for lang, t in texts.items() if t}
    alphabet = {c: i for i, c in enumerate(sorted(set("".join(texts.values()) + " ")))}
    walks = []
    for t in texts.values():
        plain = automaton(t, alphabet)
        # A letter that the reference lacks is a phrase of its own, after which any letter restarts.
        alone = len(plain)
        first = np.where(plain[0] < 0, alone, plain[0])
        walk = np.where(plain < 0, first + alone + 1, plain)
        walk[0] = first
        walks.append(np.vstack([walk, first + alone + 1]).astype(np.int32))
    return {"langs": list(texts), "alphabet": alphabet, "walks": walks,
            "sizes": [len(t) for t in texts.values()]}


def _codes_table(alphabet: dict) -> np.ndarray:
    """Code point -> letter number + 1; 0 for what is no letter, the last for unknown letters."""
    codes = np.zeros(0x110000, np.uint8 if len(alphabet) < 250 else np.uint16)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    codes[letter] = len(alphabet) + 1
    for c, i in alphabet.items():
        if c != " ":
            codes[ord(c)] = i + 1
    return codes


def phrases(lengths: np.ndarray, letters: np.ndarray, walks: list, stretch: int = STRETCH):
    """Phrases per text and language, for texts that lie one after the other in `letters`."""
    pieces = np.maximum(-(-lengths // stretch), 0)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(lengths) - lengths, pieces) + within * stretch
    size = np.minimum(lengths[owner] - within * stretch, stretch)
    order = np.argsort(-size, kind="stable")
    owner, start, size = owner[order], start[order], size[order]
    # Lanes that still have a letter at step t: a prefix, as lanes are sorted by size.
    active = len(size) - np.searchsorted(size[::-1], np.arange(1, stretch + 1), side="left")
    counts = np.zeros((len(lengths), len(walks)), np.int64)
    for k, walk in enumerate(walks):
        states, width = walk.shape
        flat = walk.ravel()
        at = np.zeros(len(size), np.int64)
        ended = np.zeros(len(size), np.int32)
        for t in range(int(size[0]) if len(size) else 0):
            n = active[t]
            to = flat[at[:n] * width + letters[start[:n] + t]]
            over = to >= states
            ended[:n] += over
            at[:n] = to - over * states
        # The last phrase of a stretch ends with it.
        np.add.at(counts[:, k], owner, ended + 1)
    return counts


def _judge(texts: list, model: dict, codes: np.ndarray):
    """(language, score, letters per phrase, letters) of each text."""
    space = model["alphabet"][" "]
    unknown = len(model["alphabet"])
    lengths, parts = [], []
    for text in texts:
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        code = codes[points]
        real = code > 0
        # One space after each run of letters stands for whatever follows it.
        keep = real.copy()
        keep[1:] |= real[:-1]
        code = code[keep]
        parts.append(np.where(code > 0, np.minimum(code - 1, unknown), space).astype(np.int64)
                     if code.any() else code[:0].astype(np.int64))
        lengths.append(len(parts[-1]))
    lengths = np.array(lengths, np.int64)
    counts = phrases(lengths, np.concatenate(parts) if parts else np.zeros(0, np.int64),
                     model["walks"])
    # A phrase costs the bits that name a place in the reference.
    cost = counts * np.log2(np.maximum(np.array(model["sizes"], float), 2))[None, :]
    best = np.argmin(cost, axis=1) if cost.shape[1] else np.zeros(len(texts), int)
    out = []
    for i, n in enumerate(lengths):
        if n == 0 or cost.shape[1] == 0:
            out.append((UNDETERMINED, 0.0, 0.0, int(n)))
            continue
        others = np.delete(cost[i], best[i])
        gap = (others.min() - cost[i, best[i]]) / max(n, 1) if len(others) else math.inf
        # Bits per letter by which the runner-up is dearer, as odds.
        out.append((model["langs"][best[i]], 1.0 / (1.0 + 2.0 ** -min(8.0 * gap, 60.0)),
                    float(n / counts[i, best[i]]), int(n)))
    return out


_FITTED = {}


def _fitted(texts: tuple) -> tuple:
    """Model and letter codes, built once per worker from the reference texts, which are small."""
    if texts not in _FITTED:
        _FITTED.clear()
        model = fit(dict(texts))
        _FITTED[texts] = model, _codes_table(model["alphabet"])
    return _FITTED[texts]


def _predictor(texts: tuple, text_at: int):
    def run(batches):
        model, codes = _fitted(texts)
        for batch in batches:
            found, step = [], 512
            column = batch.column(0).field(text_at)
            for i in range(0, batch.num_rows, step):
                found += _judge(column.slice(i, step).to_pylist(), model, codes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.float64()),
                 pa.array([f[3] for f in found], pa.int64())],
                names=["row", "pred", "score", "phrase_letters", "letters"])
    return run


def _predicted(docs: DataFrame, texts: dict, text: str) -> DataFrame:
    """(row struct, pred, score, phrase_letters, letters)."""
    text_workers(docs.sparkSession)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return inner.mapInArrow(
        _predictor(tuple(sorted(texts.items())), docs.columns.index(text)),
        row_schema(inner, "pred string, score double, phrase_letters double, letters bigint"))


def identify(docs: DataFrame, texts: dict, text: str = "text") -> DataFrame:
    """docs with a struct `language` (pred, score, phrase_letters, letters), one row per row.

    texts: reference text per language, as `sample` gives it. The prediction is `und`, with score 0,
    for a null text, one without a letter, or where no language was learned. Ties go to the language
    that sorts first. All columns pass through; one named `language` is replaced. Rows stay where
    they are: no shuffle.
    """
    names = [c for c in docs.columns if c.lower() != "language"]
    return _predicted(docs.select(*[f"`{c}`" for c in names]), texts, text).select(
        "row.*", F.struct("pred", "score", "phrase_letters", "letters").alias("language"))


def learn(docs: DataFrame) -> dict:
    """Reference texts from documents outside fold 1 of 3."""
    return sample(docs.where(crc_remainder("doc_id", 3) != 1))


def keep(docs: DataFrame, texts: dict, text: str = "text") -> DataFrame:
    """Documents in some learned language: others are `und` or fall apart into tiny phrases.

    Null and empty texts and texts without a letter go; texts of few letters stay, as their phrases
    tell little. Repeated rows are judged one by one. All columns pass through, whatever their
    names. No documents give no rows.
    """
    return _predicted(docs, texts, text).where(
        (F.col("pred") != UNDETERMINED) & (
            (F.col("letters") < MIN_LETTERS) | (F.col("phrase_letters") >= MIN_PHRASE))).select("row.*")


@register("op1_language")
def op1_language(spark, sf_dir):
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select(
        "doc_id", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("language.pred").alias("lang_pred"), F.col("language.score").alias("score"),
        F.col("language.phrase_letters").alias("phrase_letters"))
