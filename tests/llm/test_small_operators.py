"""Quality rules, sharding, language, archives: odd inputs, brute force, and laws."""
import collections
import hashlib
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mooring.llm import language, quality_rules, sharding, warc
from mooring.llm.catalog import QUERIES

# ---- quality rules


def figures_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i:i + 3])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def check_figures(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality_rules.judge(docs).select("text", "quality.*").collect()
    for row in rows:
        n = dict(zip(names, figures_by_hand(row.text)))
        assert {k: row[k] for k in names} == n, repr(row.text)[:200]
        failed = n["n_words"] < 50 or 100 * n["n_repeat_words"] > 50 * n["n_words"]
        assert row.base_failed == failed
        assert not (row.kept and failed)
    return rows


def test_quality_figures_on_odd_texts(odd_docs):
    assert len(check_figures(odd_docs)) == odd_docs.count()


def test_quality_figures_on_random_texts(make_docs):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n#|é") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    check_figures(make_docs(texts))


def test_quality_windows_beyond_the_packed_place(make_docs, monkeypatch):
    """With few bits for the place, texts take the path that sorts the windows themselves."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 4)
    rng = random.Random(5)
    check_figures(make_docs([" ".join(rng.choice("abc") for _ in range(n)) for n in range(0, 90, 3)]))


def test_quality_filter_keeps_clean_and_drops_junk(make_docs):
    rng = random.Random(6)

    def prose(n):
        return " ".join(rng.choice(["the", "of", "and"] * 30 + [f"word{i}" for i in range(200)])
                        for _ in range(n))

    docs = make_docs([prose(200), prose(60), "junk*** " * 3 + prose(80).replace(" ", "*** "), "short",
                      "again and again it goes on " * 30]).withColumn("quality", F.lit("mine"))
    kept = quality_rules.keep(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1]
    assert kept.columns == docs.columns and {r.quality for r in kept.collect()} == {"mine"}


def test_quality_of_no_rows(no_docs):
    assert quality_rules.judge(no_docs).count() == 0


# ---- sharding


def read_back(spark, docs, **options):
    return sharding.read_shards(spark, sharding.shard(docs, **options), docs.schema).collect()


def check_law(rows, shards):
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    sizes = [len(by_shard[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_sharding_keeps_every_row_and_its_law(spark, odd_docs):
    rows = read_back(spark, odd_docs, shards=4, bucket_bytes=5_000)
    check_law(rows, 4)
    key = lambda r: (r.doc_id, r.text, r.lang)
    assert collections.Counter(key(r.row) for r in rows) == collections.Counter(
        map(key, odd_docs.collect()))


def test_sharding_mixes_the_input_order(spark, make_docs):
    rows = read_back(spark, make_docs([f"text {i}" for i in range(2000)]), shards=5)
    check_law(rows, 5)
    means = collections.defaultdict(list)
    for r in rows:
        means[r.shard].append(r.row.doc_id)
    assert all(850 < np.mean(v) < 1150 for v in means.values())
    first = [r.row.doc_id for r in sorted(rows, key=lambda r: r.slot) if r.shard == 0]
    assert first != sorted(first)


def test_sharding_of_clashing_names_and_no_rows(spark, make_docs, no_docs):
    docs = make_docs(["a", "b", "c"]).withColumns({"shard": F.lit("x"), "_bucket": F.lit(1.5),
                                                   "_rows": F.lit(None).cast("string")})
    rows = read_back(spark, docs, shards=2)
    assert sorted(r.row.text for r in rows) == ["a", "b", "c"] and rows[0].row.shard == "x"
    assert read_back(spark, no_docs, shards=2) == []


def test_sharding_plan_has_no_python(spark, sf, capsys):
    frame = QUERIES["op8_sharding"](spark, sf)
    rows = frame.collect()
    check_law(rows, 40)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "rows")
    for name in ("op7_quality_rules", "op8_sharding"):
        QUERIES[name](spark, sf).explain()
        plan = capsys.readouterr().out
        assert "Scan" in plan and not re.search("Python|Arrow|Pandas", plan)


# ---- language


def longest_match_phrases(text, reference):
    """Greedy cross-parse by plain substring search."""
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i:i + n + 1] in reference:
            n += 1
        count, i = count + 1, i + n
    return count


@pytest.mark.parametrize("stretch", [7, 1000])
def test_phrases_equal_substring_search(stretch):
    rng = random.Random(1)
    refs = {"a": "".join(rng.choice("abc ") for _ in range(300)),
            "b": "".join(rng.choice("bcd ") for _ in range(200))}
    model = language.fit(refs)
    clean = [language.letters_only(t) for t in refs.values()]
    texts = [language.letters_only("".join(rng.choice("abcde ") for _ in range(rng.randint(1, 80))))
             + " " for _ in range(60)]
    texts = [t for t in texts if t.strip()]
    unknown = len(model["alphabet"])
    letters = np.array([model["alphabet"].get(c, unknown) for t in texts for c in t])
    counts = language.phrases(np.array([len(t) for t in texts]), letters, model["walks"], stretch)
    for t, row in zip(texts, counts):
        parts = [t[i:i + stretch] for i in range(0, len(t), stretch)]
        assert row.tolist() == [sum(longest_match_phrases(p, r) for p in parts) for r in clean]


def test_language_on_odd_texts(odd_docs, no_docs):
    model = {"x": "the cat sat on the mat", "y": "der hund lief in den wald"}
    rows = language.identify(odd_docs.withColumn("language", F.lit(1)), model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        blank = not any(c.isalpha() for c in r.text or "")
        assert (r.language.pred == "und") == blank and 0.0 <= r.language.score <= 1.0
    assert language.identify(no_docs, model).count() == 0
    assert {r.language.pred for r in language.identify(odd_docs, {}).collect()} == {"und"}
    assert language.sample(no_docs) == {}


def test_language_is_learned_from_other_folds_only(spark, sf):
    rows = QUERIES["op1_language"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in rows if r.held_out]
    right = sum(docs[r.doc_id].lang == r.lang_pred for r in held)
    assert right / len(held) > 0.95


# ---- archives


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 3)
    big = "é" * 700
    pages = [(1, "u1", big), (2, "u2", big), (3, None, None), (4, "u 4\r\nx", ""), (5, "u5", big),
             (6, "u6", "x" * 999), (7, "u7", "x" * 999), (8, "u8", "y" * 300_000), (None, "n", big),
             (5, "u5", big)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn(
        "same", F.lit("clash"))
    rows = warc.read_archives(warc.write_archives(frame)).collect()
    assert len(rows) == len(pages)
    expected = collections.Counter()
    for page_id, _, html in pages:
        data = (html or "").encode()
        last = 5 if html == big else page_id
        revisit = len(data) >= 1000 and page_id != last
        expected[page_id, len(data), hashlib.sha1(data).hexdigest(),
                 "revisit" if revisit else "response", 5 if revisit else None,
                 b"" if revisit else data] += 1
    assert expected == collections.Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload))
        for r in rows)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none)).count() == 0


def test_archive_reader_takes_foreign_zips(tmp_path):
    raw, _ = warc.record(9, "http://x/", b"hello", None)
    path = tmp_path / "a.wacz"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("other.txt", "squeezed " * 99, zipfile.ZIP_DEFLATED)
        with z.open(warc.DATA_MEMBER, "w", force_zip64=True) as out:
            out.write(raw)
        z.writestr(warc.INDEX_MEMBER, '- 2024 {"offset": "0", "length": %d}\n' % len(raw))
        z.comment = b"a comment with PK\5\6 inside"
    archive = warc.Archive(str(path))
    assert [warc.parse(r)["payload"] for r in archive.records()] == [b"hello"]
    with pytest.raises(ValueError):
        archive.span("other.txt")


def test_archive_reader_reads_zip64_directories(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    path = tmp_path / "wide.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(9):
            z.writestr(f"m{i}", bytes([65 + i]) * 30)
    archive = warc.Archive(str(path))
    assert len(archive.members) == 9
    assert all(archive.read(*archive.span(f"m{i}")) == bytes([65 + i]) * 30 for i in range(9))


def test_damaged_records_are_errors(tmp_path):
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: \r\n" \
          b"WARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Length: 43\r\n\r\n" \
          b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    with pytest.raises(ValueError):
        warc.parse(raw)
    path = tmp_path / "broken.zip"
    path.write_bytes(b"no zip at all" * 10)
    with pytest.raises(ValueError):
        warc.Archive(str(path))
