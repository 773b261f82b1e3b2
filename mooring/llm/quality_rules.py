"""Quality rules: one threshold table, compiled into a single Spark projection.

Every figure is a built-in expression over the text, so a document is judged where it is
read: no user function, no shuffle, no state. Counts are exact for texts of any length.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooring.llm.catalog import register
from mooring.llm.common import table

SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Function words of the corpus languages; a text of sentences has many of them.
STOP_WORDS = tuple(
    "the of and to in a is that for it as was on with by this are be "
    "de la le et les des en un une du que est pour qui dans "
    "el los las del por con una su para no lo "
    "der die das und den von mit sich dem ein eine ist im".split())

#: Bits of a packed window key that hold the window's place in the text.
PLACE_BITS = 20


@dataclass(frozen=True)
class Rule:
    """A ratio and the closed range that it must lie in; None leaves a side open."""
    name: str
    over: str
    under: str
    least: float | None
    most: float | None


#: Ratios of two figures of `figures`. A zero denominator counts as one.
THRESHOLDS = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeat_word_ratio", "n_repeat_words", "n_words", None, 0.5),
    Rule("size", "n_words", "one", 50.0, None),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _once(value: Column, use) -> Column:
    """use(value), where value is computed once even if use() has it inside other lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def _covered(places: Column) -> Column:
    """Words inside the three-word windows that start at the given sorted places."""
    steps = _once(places, lambda at: F.transform(at, lambda p, k: F.least(
        F.lit(3), F.coalesce(F.get(at, k + 1), p + 3) - p)))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _same_window(words: Column, i: Column, j: Column) -> Column:
    same = F.get(words, i) == F.get(words, j)
    for k in (1, 2):
        same &= F.get(words, i + k) == F.get(words, j + k)
    return same


def _repeated_words(df: DataFrame, words: str) -> DataFrame:
    """Adds n_repeat_words: words in three-word windows that the text holds twice or more.

    Windows are sorted as longs: 44 bits of hash, 20 of place. Neighbours with equal hash bits
    are compared by their words. Where two different windows share those bits, or the text has
    too many words for the place, the windows themselves are sorted instead.
    """
    w = F.col(words)
    count = F.greatest(F.size(w) - 2, F.lit(0))
    mask = F.lit((1 << PLACE_BITS) - 1).cast("long")
    keyed = df.withColumn("_keys", F.sort_array(F.transform(
        F.slice(w, F.lit(1), count), lambda first, i: F.shiftleft(F.shiftright(F.xxhash64(
            first, F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS), PLACE_BITS)
        + i.cast("long"))))
    keys = F.col("_keys")

    def place(key):
        return key.bitwiseAND(mask).cast("int")

    def touching(k, key):
        """The key before, where it has the same hash bits."""
        before = F.get(keys, k - 1)
        return F.when((k > 0) & (F.shiftright(before, PLACE_BITS) == F.shiftright(
            key, PLACE_BITS)), before)

    # One entry for each neighbour pair of equal hash bits: (earlier place, later place).
    paired = keyed.withColumn("_pairs", F.filter(
        F.transform(keys, lambda key, k: F.struct(
            place(touching(k, key)).alias("a"), place(key).alias("b"))),
        lambda pair: pair["a"].isNotNull()))
    pairs = F.col("_pairs")
    clash = (F.size(w) >= (1 << PLACE_BITS)) | F.exists(
        pairs, lambda p: ~_same_window(w, p["a"], p["b"]))
    fast = _covered(F.array_sort(F.array_distinct(F.concat(
        F.transform(pairs, lambda p: p["a"]), F.transform(pairs, lambda p: p["b"])))))

    spelled = F.array_sort(F.transform(F.slice(w, F.lit(1), count), lambda first, i: F.struct(
        first.alias("x"), F.get(w, i + 1).alias("y"), F.get(w, i + 2).alias("z"), i.alias("i"))))

    def equal(s, t):
        return (s["x"] == t["x"]) & (s["y"] == t["y"]) & (s["z"] == t["z"])

    def twice(windows):
        return F.transform(F.filter(windows, lambda s, k: F.coalesce(
            (k > 0) & equal(F.get(windows, k - 1), s), F.lit(False)) | F.coalesce(
            equal(F.get(windows, k + 1), s), F.lit(False))), lambda s: s["i"])

    plain = _covered(F.array_sort(_once(spelled, twice)))
    return paired.withColumn(
        "n_repeat_words", F.when(F.size(pairs) == 0, 0).when(~clash, fast).otherwise(plain)
    ).drop("_keys", "_pairs")


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts that rules are made of, as long columns in the struct `figures` beside docs.

    Words are maximal runs without space, tab or line-end characters. A null text has none.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("_words", _words(body))
    split = _repeated_words(split, "_words").withColumn("_lines", F.filter(
        F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    words = F.col("_words")
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(body) - F.length(F.translate(body, SYMBOLS, "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.col("n_repeat_words"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))),
        "one": F.lit(1),
    }
    return split.withColumn("figures", F.struct(
        *[c.cast("long").alias(name) for name, c in counts.items()])).drop(
        "_words", "_lines", "n_repeat_words")


def verdict(figure, rules=THRESHOLDS) -> Column:
    """True where every ratio lies in its range; figure(name) gives a column."""
    passed = F.lit(True)
    for rule in rules:
        ratio = figure(rule.over).cast("double") / F.greatest(figure(rule.under), F.lit(1))
        if rule.least is not None:
            passed &= ratio >= rule.least
        if rule.most is not None:
            passed &= ratio <= rule.most
    return passed


def judge(docs: DataFrame, text: str = "text", rules=THRESHOLDS) -> DataFrame:
    """docs with a struct column `quality`: the figures, base_failed and kept.

    Null and empty texts have zero words: they fail the base rule and are not kept. Repeated
    rows are judged one by one; other columns pass through, but one named `quality` is replaced.
    """
    kept_columns = [c for c in docs.columns if c.lower() != "quality"]
    prepared = figures(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("_row"),
        F.col(f"`{text}`").alias("_text")), "_text")

    def figure(name):
        return F.col(f"figures.{name}")

    base_failed = (figure("n_words") < 50) | (
        100 * figure("n_repeat_words") > 50 * figure("n_words"))
    quality = F.struct("figures.*", base_failed.alias("base_failed"),
                       (~base_failed & verdict(figure, rules)).alias("kept"))
    # Always true, but tied to the row: a filter on the verdict stays above this projection. Pushed
    # down, it would spell out the whole word array wherever a rule mentions a word.
    here = F.monotonically_increasing_id() >= 0
    return prepared.withColumn("quality", F.when(here, quality)).select("_row.*", "quality")


def keep(docs: DataFrame, text: str = "text", rules=THRESHOLDS) -> DataFrame:
    """The documents that pass, with their own columns, whatever their names.

    Null and empty texts go. Repeated rows are judged one by one; no documents give no rows.
    """
    judged = judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                               F.col(f"`{text}`").alias("_own")), "_own", rules)
    return judged.where("quality.kept").select("row.*")


_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                     lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win)
  WHERE n >= 2),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) AS steps(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)),
                             lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda x: list_contains(string_split(
      'the of and to in a is that for it as was on with by this are be '
      || 'de la le et les des en un une du que est pour qui dans '
      || 'el los las del por con una su para no lo '
      || 'der die das und den von mit sich dem ein eine ist im', ' '), x))) AS BIGINT)
      AS n_stop_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
    AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words
    AND n_symbols / n_words <= 0.1 AND n_stop_words / n_words >= 0.02
    AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM b
"""


@register("op7_quality_rules", _SQL)
def op7_quality_rules(spark, sf_dir):
    """Figures and verdict of every document."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept")])
