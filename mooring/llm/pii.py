"""Personal data: rules, and a character BiLSTM with CRF transitions that adds what they miss.

Rules mark e-mail addresses, IP addresses, card and phone numbers; their spans always stay. The
tagger learns from rule spans in a bounded sample of windows, as they stand and written in other ways
that the rules don't read ("name [at] host [dot] com"). It reads overlapping windows around every mark
that such a span must hold (a digit, @ or +, a bracketed "at", the word "dot"), so no text is cut short.
Spans that a window's edge may have cut are left to its neighbour, and one set of spans that don't
overlap is chosen for the whole text by its total score. A tagged span is added only if, written the
plain way, it passes the same check as a rule's (Luhn, parts up to 255, digit counts), and if it touches
no rule span.
"""
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.catalog import register
from mooring.llm.common import row_schema, table, text_workers

KINDS = ("email", "ip", "card", "phone")

# ---- rules ----------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number's first digit can only be where no digit is before: a later start fails alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def valid(kind: str, found: str) -> bool:
    """Whether text of a kind passes the kind's check."""
    if kind == "ip":
        parts = found.split(".")
        return len(parts) == 4 and all(
            p and all("0" <= c <= "9" for c in p) and (len(p.lstrip("0")) <= 3) and int(
                p.lstrip("0") or "0") <= 255 for p in parts)
    if kind == "card":
        digits = _digits(found)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(_digits(found)) <= 15
    at = found.find("@")
    return at > 0 and set(found[:at]) <= _LOCAL and bool(_DOMAIN.fullmatch(found, at + 1))


def _emails(text: str):
    """Leftmost matches, one look at each @: the local part is the run before it, as far as free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def rule_spans(text) -> list:
    """(kind, start, end) by kind as listed, then start."""
    text = text or ""
    spans = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text)
                  if valid(kind, m.group())]
    return spans


# ---- other ways of writing --------------------------------------------------------------------

#: What stands for @ and for a dot in an address.
EMAIL_WAYS = ((" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "),
              (" (at) ", " (dot) "), ("{at}", "{dot}"), (" @ ", "."), ("@", "[.]"))
IP_WAYS = ("[.]", "(.)", " . ", " dot ", "[dot]")
CARD_WAYS = (".", "/", "_", "  ", " - ")
#: What stands for the plus sign, and between the digits (None: as it was).
PHONE_WAYS = (("+ ", None), ("00", None), ("00", "/"), ("+", "/"), ("+", "_"), ("00", "."))

_AT = re.compile(r" ?[\[({<] ?(?:at|@) ?[\])}>] ?| @ ?|@ | at ", re.IGNORECASE)
_DOT = re.compile(r" ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot | \. ", re.IGNORECASE)
_CARD_GROUPS = re.compile(r"[0-9]{3,6}([ ./_-]{1,3})[0-9]{3,6}(?:\1[0-9]{1,6})+")
_PHONE_GROUPS = re.compile(r"(?:\+ ?|00 ?)[1-9][0-9]*[ ()./_-][ ()./_0-9-]*[0-9]")


def rewritten(kind: str, found: str, rng: random.Random) -> str:
    """A rule span in one of the other ways of writing it."""
    if kind == "email":
        at, dot = rng.choice(EMAIL_WAYS)
        local, host = found.split("@")
        return f"{local}{at}{host.replace('.', dot)}"
    if kind == "ip":
        return found.replace(".", rng.choice(IP_WAYS))
    if kind == "card":
        digits = _digits(found)
        return rng.choice(CARD_WAYS).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    plus, between = rng.choice(PHONE_WAYS)
    body = found[1:] if between is None else re.sub(r"[^0-9]+", between, found[1:])
    return plus + body


def plainly(kind: str, found: str) -> str:
    """A span in the way that the rules read, or the empty text if it is no known way of writing."""
    if kind == "card":
        return _digits(found) if _CARD_GROUPS.fullmatch(found) else ""
    if kind == "phone":
        digits = _digits(found)
        return f"+{digits.removeprefix('00')}" if _PHONE_GROUPS.fullmatch(found) else ""
    plain, dots = _DOT.subn(".", found)
    if kind == "ip":
        return plain
    # A bare "at" is a word like others unless the dots are spelled out, too.
    return _AT.sub("@", plain) if dots or " at " not in found.lower() else ""


def accepted(kind: str, text: str, a: int, b: int) -> bool:
    """Whether a tagged span of the text passes its kind's check, as it stands or written plainly."""
    found = text[a:b]
    stands = {"card": _CARD, "phone": _PHONE}.get(kind)
    if valid(kind, found) and (stands is None or stands.fullmatch(found)):
        return True
    alone = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    return alone and valid(kind, plainly(kind, found))


def apart(spans: list) -> list:
    """The spans in order of place, without those that overlap one before."""
    kept, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= end:
            kept.append((kind, a, b))
            end = b
    return kept


def altered(text: str, spans: list, seed: int = 0):
    """The text with its spans rewritten, and where they are then; one seed and text give one result."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) + (seed << 32))
    out, marks, at, size = [], [], 0, 0
    for kind, a, b in apart(spans):
        new = rewritten(kind, text[a:b], rng)
        out += [text[at:a], new]
        size += a - at
        marks.append((kind, size, size + len(new)))
        size, at = size + len(new), b
    return "".join([*out, text[at:]]), marks


# ---- tagger ---------------------------------------------------------------------------------

#: A span of up to WINDOW - STRIDE characters lies whole in a window, wherever it is.
WINDOW = 96
STRIDE = 32
MARGIN = 32
HIDDEN = 16
EMBED = 8
#: Windows that are learned from at most: the bound of the sample.
SAMPLE_WINDOWS = 3_000
#: Updates of the parameters, and windows in each.
UPDATES = 600
BATCH = 32
#: Log odds against no span, emissions and transitions together, from which a span may be added.
LEAST_SCORE = 2.0
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
_TRIGGER = re.compile(r"[0-9@+]|(?i:\bdot\b)|[\[({<] ?(?i:at) ?[\])}>]")
_MARKS = "@.+-_%(): /=\"',;#*\n[]{}<>"
_LETTERS = "adot"


def _class_table() -> np.ndarray:
    """Class of each code point below 128, then of all others; 0 is padding."""
    codes = np.full(129, 1, np.int64)
    codes[48:58], codes[97:123], codes[65:91], codes[128] = 2, 3, 4, 5
    for i, mark in enumerate(_MARKS):
        codes[ord(mark)] = 6 + i
    for i, letter in enumerate(_LETTERS):
        codes[[ord(letter), ord(letter.upper())]] = 6 + len(_MARKS) + i
    return codes


_CLASSES = _class_table()
N_CLASSES = 6 + len(_MARKS) + len(_LETTERS)


def windows(text: str) -> list:
    """Starts of windows over the stretches around triggers; each stretch is covered whole.

    A stretch begins and ends a margin beyond the run of address characters around its trigger.
    """
    starts, low, high, end = [], None, None, 0

    def close():
        at = low
        while True:
            starts.append(at)
            if at + WINDOW >= high:
                break
            at += STRIDE

    for match in _TRIGGER.finditer(text):
        # No character is walked over twice: runs are followed from where the last one ended.
        a, before = match.start(), end
        end = max(end, match.end())
        while a > before and text[a - 1] in _LOCAL:
            a -= 1
        while end < len(text) and text[end] in _LOCAL:
            end += 1
        a = max(0, a - MARGIN)
        if high is None or a > high:
            if high is not None:
                close()
            low = a
        high = end + MARGIN
    if high is not None:
        close()
    return starts


def encode(text: str, starts: list) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.zeros(len(points) + WINDOW, np.int64)
    codes[:len(points)] = _CLASSES[np.minimum(points, 128)]
    return codes[np.array(starts, np.int64)[:, None] + np.arange(WINDOW)]


def allowed() -> np.ndarray:
    """Score 0 for tag pairs that may follow each other, else a large negative one."""
    out = np.zeros((TAGS + 1, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0.0
    return out


_ALLOWED = allowed()  # the last row is the start


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _lstm(codes, p, side):
    """Hidden states of one direction, and what its gradient needs."""
    n, length = codes.shape
    inputs = p["embed"] @ p["in" + side] + p["bias" + side]
    h = c = np.zeros((n, HIDDEN), inputs.dtype)
    states, cache = np.zeros((n, length, HIDDEN), inputs.dtype), []
    steps = range(length) if side == "f" else range(length - 1, -1, -1)
    for t in steps:
        z = inputs[codes[:, t]] + h @ p["rec" + side]
        gates = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = np.split(gates, 3, axis=1)
        g = np.tanh(z[:, 3 * HIDDEN:])
        new = f * c + i * g
        tc = np.tanh(new)
        cache.append((t, h, c, i, f, o, g, tc))
        h, c = o * tc, new
        states[:, t] = h
    return states, cache


def emissions(codes: np.ndarray, p: dict):
    forward, fc = _lstm(codes, p, "f")
    backward, bc = _lstm(codes, p, "b")
    both = np.concatenate([forward, backward], axis=2)
    return both @ p["out"] + p["out_bias"], both, fc, bc


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _crf_gradient(e, tags, move):
    """Negative log-likelihood, and its gradients in emissions and transitions."""
    n, length, _ = e.shape
    full = move + _ALLOWED
    a = np.zeros_like(e)
    a[:, 0] = e[:, 0] + full[-1]
    for t in range(1, length):
        a[:, t] = e[:, t] + _log_sum(a[:, t - 1][:, :, None] + full[None, :-1], 1)
    b = np.zeros_like(e)
    for t in range(length - 2, -1, -1):
        b[:, t] = _log_sum(full[None, :-1] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    z = _log_sum(a[:, -1], 1)
    grad = np.exp(a + b - z[:, None, None])
    moves = np.zeros_like(move)
    moves[-1] = grad[:, 0].sum(axis=0)
    for t in range(1, length):
        moves[:-1] += np.exp(a[:, t - 1][:, :, None] + full[None, :-1] + (
            e[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
    rows = np.arange(n)
    gold = full[-1, tags[:, 0]] + e[rows, 0, tags[:, 0]]
    np.add.at(moves, (np.full(n, TAGS), tags[:, 0]), -1.0)
    grad[rows, 0, tags[:, 0]] -= 1
    for t in range(1, length):
        gold = gold + full[tags[:, t - 1], tags[:, t]] + e[rows, t, tags[:, t]]
        np.add.at(moves, (tags[:, t - 1], tags[:, t]), -1.0)
        grad[rows, t, tags[:, t]] -= 1
    return float((z - gold).sum()), grad, moves


def _lstm_gradient(codes, d_states, cache, p, side, grads):
    n = len(codes)
    d_inputs = np.zeros((N_CLASSES, 4 * HIDDEN))
    dh = dc = np.zeros((n, HIDDEN))
    for t, h, c, i, f, o, g, tc in reversed(cache):
        dh = dh + d_states[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o),
                             dc * i * (1 - g * g)], axis=1)
        grads["rec" + side] += h.T @ dz
        np.add.at(d_inputs, codes[:, t], dz)
        dh, dc = dz @ p["rec" + side].T, dc * f
    grads["bias" + side] += d_inputs.sum(axis=0)
    grads["in" + side] += p["embed"].T @ d_inputs
    grads["embed"] += d_inputs @ p["in" + side].T


def initial(seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (N_CLASSES, EMBED)),
         "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "out_bias": np.zeros(TAGS),
         "move": np.zeros((TAGS + 1, TAGS))}
    for side in "fb":
        p["in" + side] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN))
        p["rec" + side] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        p["bias" + side] = np.zeros(4 * HIDDEN)
        p["bias" + side][HIDDEN:2 * HIDDEN] = 1.0
    return p


def loss_and_gradient(codes, tags, p):
    e, both, fc, bc = emissions(codes, p)
    loss, de, dmove = _crf_gradient(e, tags, p["move"])
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["move"] = dmove
    grads["out"] = np.einsum("nth,ntk->hk", both, de)
    grads["out_bias"] = de.sum(axis=(0, 1))
    d_both = de @ p["out"].T
    _lstm_gradient(codes, d_both[:, :, :HIDDEN], fc, p, "f", grads)
    _lstm_gradient(codes, d_both[:, :, HIDDEN:], bc, p, "b", grads)
    return loss, grads


def fit(codes: np.ndarray, tags: np.ndarray, updates: int = UPDATES, batch: int = BATCH) -> dict:
    """Parameters by Adam over the windows; without windows, those that tag nothing."""
    p = initial()
    if not len(codes):
        p["out_bias"][0] = 50.0
        return p
    rng = np.random.default_rng(5)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    order = np.zeros(0, np.int64)
    for turn in range(1, updates + 1):
        while len(order) < batch:
            order = np.append(order, rng.permutation(len(codes)))
        rows, order = order[:batch], order[batch:]
        _, grads = loss_and_gradient(codes[rows], tags[rows], p)
        rate = 0.02 * min(1.0, 2.0 * (1 - turn / (updates + 1)))
        for k, g in grads.items():
            g = np.clip(g / len(rows), -5, 5)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9 ** turn)) / (
                np.sqrt(second[k] / (1 - 0.999 ** turn)) + 1e-8)
    return p


def viterbi(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of each window."""
    n, length, _ = e.shape
    full = move + _ALLOWED
    score, back = e[:, 0] + full[-1], np.zeros((n, length, TAGS), np.int8)
    for t in range(1, length):
        ways = score[:, :, None] + full[None, :-1]
        back[:, t] = ways.argmax(axis=1)
        score = ways.max(axis=1) + e[:, t]
    tags = np.zeros((n, length), np.int64)
    tags[:, -1] = score.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
    return tags


def window_spans(tags: np.ndarray, e: np.ndarray, move: np.ndarray, start: int, size: int) -> list:
    """(kind, start, end, score) in the text of the spans that no window edge may have cut.

    The score is the log odds per character of the best path against that path without the span.
    """
    spans, t = [], 0
    full = move + _ALLOWED

    def path(a, b, chosen):
        """Score of the given tags from a to b, with the steps into the first and out of the last."""
        steps = np.concatenate([[tags[a - 1] if a else TAGS], chosen, tags[b:b + 1]])
        return e[np.arange(a, b), chosen].sum() + full[steps[:-1], steps[1:]].sum()

    end_of_text = size - start
    while t < len(tags):
        tag = tags[t]
        if tag == 0:
            t += 1
            continue
        kind, begin = (tag - 1) // 2, t
        t += 1
        while t < len(tags) and tags[t] == 2 + 2 * kind:
            t += 1
        whole = (begin > 0 or start == 0) and (t < len(tags) or t >= end_of_text)
        if whole and t <= end_of_text:
            odds = path(begin, t, tags[begin:t]) - path(begin, t, np.zeros(t - begin, np.int64))
            spans.append((KINDS[kind], start + begin, start + t, float(odds) / (t - begin)))
    return spans


def reconcile(spans: list) -> list:
    """The spans without overlaps whose scores times lengths sum to most."""
    best = {}
    for kind, a, b, score in spans:
        best[(kind, a, b)] = max(score, best.get((kind, a, b), -np.inf))
    order = sorted(((b, a, kind, score * (b - a)) for (kind, a, b), score in best.items()
                    if score > 0), key=lambda s: s[:3])
    ends = [s[0] for s in order]
    total, taken = [0.0], []
    for i, (b, a, kind, gain) in enumerate(order):
        before = int(np.searchsorted(ends[:i], a, side="right"))
        use = total[before] + gain
        taken.append((use > total[i], before))
        total.append(max(use, total[i]))
    chosen, i = [], len(order)
    while i:
        use, before = taken[i - 1]
        if use:
            b, a, kind, _ = order[i - 1]
            chosen.append((kind, a, b, best[(kind, a, b)]))
            i = before
        else:
            i -= 1
    return chosen[::-1]


def find_spans(texts: list, p: dict, block: int = 4096) -> list:
    """For each text, (rule spans, added spans)."""
    fast = {k: v.astype(np.float32) for k, v in p.items()}
    found = [rule_spans(text) for text in texts]
    tagged = [[] for _ in texts]
    owners, begins, codes, held = [], [], [], 0

    def flush():
        nonlocal owners, begins, codes, held
        if held:
            x = np.concatenate(codes)
            for lo in range(0, len(x), block):
                e = emissions(x[lo:lo + block], fast)[0]
                tags = viterbi(e, fast["move"])
                for k in np.flatnonzero(tags.any(axis=1)):
                    i = owners[lo + k]
                    tagged[i] += window_spans(tags[k], e[k], fast["move"], begins[lo + k],
                                              len(texts[i]))
        owners, begins, codes, held = [], [], [], 0

    for i, text in enumerate(texts):
        starts = windows(text) if text else []
        for lo in range(0, len(starts), block):
            part = starts[lo:lo + block]
            low = part[0]
            codes.append(encode(text[low:part[-1] + WINDOW], [s - low for s in part]))
            owners += [i] * len(part)
            begins += part
            held += len(part)
            if held >= block:
                flush()
    flush()
    out = []
    for text, rules, spans in zip(texts, found, tagged):
        taken = sorted((a, b) for _, a, b in rules)
        starts = [a for a, _ in taken]
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
        added = []
        for kind, a, b, score in reconcile(spans) if spans else []:
            before = int(np.searchsorted(starts, b, side="left"))
            clear = before == 0 or reach[before - 1] <= a
            if clear and score * (b - a) >= LEAST_SCORE and accepted(kind, text, a, b):
                added.append((kind, a, b))
        out.append((rules, added))
    return out


# ---- Spark ----------------------------------------------------------------------------------

def labelled_windows(text: str, spans: list, every: int = 4, only_spans: bool = False) -> list:
    """(codes, tags) of about `every` windows, spread over the text or over those with a span."""
    marks = np.zeros(len(text) + WINDOW, np.uint8)
    for kind, a, b in apart(spans):
        marks[a:b] = 2 + 2 * KINDS.index(kind)
        marks[a] -= 1
    starts = windows(text)
    if only_spans:
        starts = [s for s in starts if marks[s:s + WINDOW].any()]
    out = []
    # Spread, so that a text full of numbers gives no more than others.
    for s in starts[::max(1, len(starts) // every)]:
        part = marks[s:s + WINDOW].copy()
        if part[0] and part[0] % 2 == 0:
            # A span cut by the window's start isn't learned from.
            ends = np.flatnonzero((part == 0) | (part % 2 == 1))
            part[:ends[0] if len(ends) else WINDOW] = 0
        out.append((encode(text[s:s + WINDOW], [0])[0].astype(np.uint8), part))
    return out


def training_windows(text: str) -> list:
    """Windows of the text as it stands, and of the text with its spans rewritten."""
    spans = rule_spans(text)
    found = labelled_windows(text, spans)
    return found + labelled_windows(*altered(text, spans), only_spans=True) if spans else found


def _sampler(batches):
    """Labelled windows of each text: codes and tags, as bytes."""
    for batch in batches:
        keys, codes, tags = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for code, tag in training_windows(text):
                keys.append(key)
                codes.append(code.tobytes())
                tags.append(tag.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(codes, pa.binary()), pa.array(tags, pa.binary())],
            names=["key", "codes", "tags"])


def learn(docs: DataFrame, text: str = "text", limit: int = SAMPLE_WINDOWS) -> dict:
    """Parameters from at most `limit` windows of hash-drawn texts with a trigger.

    About eight texts per window are looked at, each text once however often it is repeated.
    """
    text_workers(docs.sparkSession)
    share = min(1.0, 8.0 * limit / max(1, docs.count()))
    drawn = docs.select(F.xxhash64(F.lit("pii"), F.col(f"`{text}`")).alias("key"),
                        F.col(f"`{text}`").alias("t")).where(
        (F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30))) & F.col("t").rlike("[0-9@]"))
    rows = drawn.dropDuplicates(["key"]).mapInArrow(
        _sampler, "key bigint, codes binary, tags binary").orderBy(
        "key", "codes", "tags").limit(limit).collect()
    codes = np.array([np.frombuffer(r.codes, np.uint8) for r in rows], np.int64).reshape(-1, WINDOW)
    tags = np.array([np.frombuffer(r.tags, np.uint8) for r in rows], np.int64).reshape(-1, WINDOW)
    return fit(codes, tags)


def redact(docs: DataFrame, p: dict, text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs with personal data in `text` replaced by its kind, and `size`, if there, counted anew.

    Null texts stay null, with a null size; empty ones stay empty. Repeated rows stay repeated. All
    other columns pass through, whatever their names. No documents give no rows.
    """
    found = detect(docs, p, docs.columns, text, with_text=True)
    new = {text: F.col("redacted"), size: F.length("redacted").cast("long")}
    return found.select(*[(new[c] if c == text or c == size and docs.schema[c].dataType.typeName()
                           == "long" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def joined(spans: list) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in order)


def redacted(text: str, spans: list) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, p: dict, columns=("doc_id",), text: str = "text",
           with_text: bool = False) -> DataFrame:
    """The given columns with rule spans, all spans (strings), counts of rule spans, and the
    redacted text if wanted. A null text has no spans and stays null. Repeated rows stay repeated;
    of overlapping tagged spans those that score most in all stay."""
    text_workers(docs.sparkSession)
    # A text that is wanted anyway isn't sent twice.
    own = text in columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                        *([] if own else [F.col(f"`{text}`").alias("t")]))
    at = list(columns).index(text) if own else None
    schema = row_schema(inner, "rules string, spans string, " + ", ".join(
        f"n_{k} bigint" for k in KINDS) + ", redacted string")

    def run(batches):
        for batch in batches:
            rules, spans, counts, texts = [], [], [], []
            column = batch.column(1) if at is None else batch.column(0).field(at)
            for lo in range(0, batch.num_rows, 1000):
                part = column.slice(lo, 1000).to_pylist()
                for text_, (own, added) in zip(part, find_spans(part, p)):
                    rules.append(joined(own))
                    spans.append(joined(own + added))
                    counts.append([sum(s[0] == k for s in own) for k in KINDS])
                    texts.append(redacted(text_, own + added) if with_text and text_ is not None
                                 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rules, pa.string()), pa.array(spans, pa.string()),
                 *[pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))],
                 pa.array(texts, pa.string())],
                names=["row", "rules", "spans", *[f"n_{k}" for k in KINDS], "redacted"])

    return inner.mapInArrow(run, schema)


@register("op6_pii")
def op6_pii(spark, sf_dir):
    """Counts, digest and spans of every document; counts and digest are those of the rules."""
    docs = table(spark, sf_dir, "documents")
    found = detect(docs, learn(docs))
    return found.select("row.doc_id", *[f"n_{k}" for k in KINDS],
                        F.sha2(F.col("rules").cast("binary"), 256).alias("base_sha256"), "spans")
