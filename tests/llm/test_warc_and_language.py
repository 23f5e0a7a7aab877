import base64
import hashlib
import zlib
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rolloom.llm import language_id, warc


def test_round_trip(spark, tmp_path):
    rows = [(3, "http://a", "x"), (1, "http://b\r\nX: y", "x"), (2, None, "x"), (4, "u", None), (5, "u", ""), (6, "u", "a\r\n\r\nb\r\n\r\n"), (7, "u", "é\n"), (1, "http://b", "x"), (None, "n", "x"), (8, "u", "big" * 90000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, rid int")
    out = warc.archive_pages(pages, str(tmp_path / "w")).collect()
    key = lambda p: (p is None, p or 0)
    first, want = {}, []
    for i, _, h in sorted(rows, key=lambda r: key(r[0])):
        b = (h or "").encode()
        again = b in first
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first.get(b)))
        first.setdefault(b, i)
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    back = {r.page_id: r.payload for r in warc.read_archives(spark, str(tmp_path / "w")).collect() if r.record_type == "response"}
    assert back[6] == "a\r\n\r\nb\r\n\r\n" and back[7] == "é\n" and back[8] == "big" * 90000


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    out = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_pages(pages, str(tmp_path / "w"), 3).collect()}
    assert out == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(pages, str(tmp_path / "w")).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in out)
    assert len(out) > 200 and right / len(out) >= 0.97


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "der hund und die katze", "de"), (4, None, "en"), (5, "123 !", None), (None, "the dog", None), (6, "", "de"), (7, "le chat" * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs).collect()
    by = {r.doc_id: r for r in got}
    assert by[4].lang_pred == by[5].lang_pred == by[6].lang_pred == "und" and by[None].lang_pred == "en" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    none = language_id.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null or doc_id < 0")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def name_of(code):
    return "".join(chr(x) for x in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if x)


def plain_counts(text):
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        padded = f" {w} "
        out.update([*w, *(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))])
    return out


def plain_prediction(profiles, text, top, own):
    counts = plain_counts(text)
    if not counts or not profiles:
        return "und", 0.0
    best = sorted(counts, key=lambda g: (-counts[g], g))[:own]
    distance = {lang: sum(min(abs(i - p.index(g)), top) if g in p else top for i, g in enumerate(best)) for lang, p in profiles.items()}
    lang = min(distance, key=lambda x: (distance[x], x))
    return lang, 1 - distance[lang] / (top * len(best))


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_counts_in_blocks(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    for text in (None, "", "1 2", "a", "a b", "Straße, café! ab_c x²y", "\U0001f600 \U00020000\u0627\u0644", "the cat " * 9):
        codes, counts = language_id.gram_counts(text)
        assert {name_of(int(c)): int(n) for c, n in zip(codes, counts)} == plain_counts(text)
        assert [name_of(int(c)) for c in codes] == sorted(plain_counts(text))


def test_predictions_against_plain_python(spark):
    source = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [tuple(r) for r in source] + [tuple(source[5])] * 3 + [(None, "ab ba ab", "en"), (900, None, "de"), (901, "the dog " * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("gram", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("held_out", F.lit("y")).withColumn("score", F.lit(2))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    totals = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and not held(i):
            totals.setdefault(lang, Counter()).update(plain_counts(text))
    profiles = {lang: sorted(c, key=lambda g: (-c[g], g))[:400] for lang, c in totals.items()}
    want = sorted(((i, held(i), *plain_prediction(profiles, text, 400, 300)) for i, text, _ in rows), key=repr)
    got = sorted(map(tuple, language_id.identify(docs).collect()), key=repr)
    assert [(*g[:3], round(g[3], 9)) for g in got] == [(*w[:3], round(w[3], 9)) for w in want]
