"""The pipeline, stage by stage, against brute force on a small set of documents."""
import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from mooring.llm import language, pii, simhash
from mooring.llm.common import stored
from test_large_operators import fingerprint_by_hand, roots_by_hand, spans_by_hand
from test_small_operators import figures_by_hand

WORDS = {"en": "the of and to with from when river mountain stone light water garden".split(),
         "de": "der die und das mit ein fluss berg stein licht wasser garten nicht".split()}


def build(make_docs):
    rng = random.Random(4)

    def prose(lang, n):
        own = [w + rng.choice(["", "s", "en"]) for w in WORDS[lang] for _ in range(3)]
        return " ".join(rng.choice(WORDS[lang][:4]) if rng.random() < 0.3 else rng.choice(own)
                        + rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(n))

    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, prose(lang, rng.randint(60, 400)), lang))
    for i in range(60, 70):  # exact and near copies
        text = rows[i - 60][1]
        rows.append((i, text if i % 2 else text + " end", rows[i - 60][2]))
    rows.append((70, rows[1][1] + " call +1 (555) 555-3824 or write a.b@mail.example.com now", "en"))
    rows.append((71, rows[3][1][:1500] + " from 10.20.30.40 with 4111 1111 1111 1111 today", "en"))
    rows += [(72, "*** ".join(rows[5][1].split()), "en"), (73, "too short", "en"), (74, None, "en"),
             (75, "12345 67890 !!", None), (76, "again and again it goes on " * 40, "en"),
             (77, prose("en", 3000), "en")]
    return make_docs(rows)


@pytest.fixture(scope="module")
def stages(spark, make_docs):
    docs = build(make_docs)
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, None), name)
        out.append((name, docs))
    return {name: (frame, frame.collect()) for name, frame in out}, docs


def test_columns_stay_until_the_last_stage(stages):
    found, _ = stages
    want = found["documents"][0].dtypes
    for name in list(found)[1:-1]:
        assert found[name][0].dtypes == want


def test_language_stage_drops_what_has_no_language(stages):
    before, after = stages[0]["documents"][1], stages[0]["language_id"][1]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {r.doc_id for r in before if not any(c.isalpha() for c in r.text or "")} == {74, 75}
    predicted = language.identify(stages[0]["documents"][0], language.learn(stages[0]["documents"][0]))
    clean = [r for r in predicted.collect() if r.doc_id < 72]
    assert sum(r.language.pred == r.lang for r in clean) >= 0.95 * len(clean)


def test_quality_stage_keeps_what_passes_by_hand(stages):
    before, after = stages[0]["language_id"][1], stages[0]["quality_rules"][1]
    stop = set(("the of and to in a is that for it as was on with by this are be "
                "de la le et les des en un une du que est pour qui dans "
                "el los las del por con una su para no lo "
                "der die das und den von mit sich dem ein eine ist im").split())
    kept = set()
    for r in before:
        words, chars, symbols, dup_lines, repeated = figures_by_hand(r.text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in r.text.split("\n"))
        n = max(words, 1)
        if (words >= 50 and 100 * repeated <= 50 * words and 2 <= chars / n <= 20
                and symbols / n <= 0.1 and dup_lines / max(lines, 1) <= 0.5
                and sum(w in stop for w in r.text.split()) / n >= 0.02):
            kept.add(r.doc_id)
    assert {r.doc_id for r in after} == kept and not kept & {72, 73, 76} and 77 in kept


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    before, after = stages[0]["quality_rules"][1], stages[0]["simhash_near_dedup"][1]
    prints = {r.doc_id: fingerprint_by_hand(r.text) for r in before}
    links = [(a, b) for a in prints for b in prints
             if a < b and bin(prints[a] ^ prints[b]).count("1") <= simhash.MAX_BITS]
    groups = collections.defaultdict(set)
    for node, root in roots_by_hand(list(prints), links).items():
        groups[root].add(node)
    assert {r.doc_id for r in after} == {min(g) for g in groups.values()} and len(after) < len(before)


def test_personal_data_stage_replaces_every_span(stages):
    frame, before = stages[0]["simhash_near_dedup"]
    after = stages[0]["personal_data"][1]
    found = {r.row.doc_id: r.spans for r in pii.detect(frame, pii.learn(frame)).collect()}
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == set(texts) and any(found.values())
    for r in after:
        spans = [(kind, int(a), int(b)) for kind, a, b in (
            span.split(":") for span in found[r.doc_id].split(",") if span)]
        assert set(spans_by_hand(texts[r.doc_id])) <= set(spans)
        assert r.text == pii.redacted(texts[r.doc_id], spans) and r.n_chars == len(r.text)
        assert spans_by_hand(r.text) == []


def test_packing_stage_holds_every_token_once(stages):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, pieces = stages[0]["personal_data"][1], stages[0]["best_fit_packing"][1]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {r.doc_id for r in docs}
    for r in docs:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        parts = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1].tolist()]
        assert sum(p.length for p in parts) == len(ids)
    for parts in by_sequence.values():
        ends = sorted((p.offset, p.offset + p.length) for p in parts)
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
        assert ends[-1][1] <= 1024
    total = sum(p.length for p in pieces)
    assert len(by_sequence) <= 11 / 9 * -(-total // 1024) + 1


def test_packing_stage_returns_the_token_ids(stages):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, pieces = stages[0]["personal_data"][1], stages[0]["best_fit_packing"][1]
    got = collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        got[p.doc_id] += p.ids
    assert got == {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
                   for r in docs}


def test_run_on_the_smallest_tables(spark, sf, no_docs, table_dir):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert corpus_pipeline.run(spark, table_dir(documents=no_docs)).count() == 0
