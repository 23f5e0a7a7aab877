"""One table with every awkward row, through the operators that have no such table in their own tests."""

import zlib
from array import array
from collections import Counter

import brute
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolloom.llm import jaccard, language_id, packing, quality_classifier, quality_rules, secrets, sharding, token_counts, warc

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (None, "no id at all in this row"), (None, "no id at all in this row"), (3, LONG), (4, LONG + " and a few more"), (5, "five words are one shingle"), (5, "five words are one shingle"), (6, "FIVE words are one shingle"), (0, LONG), (7, "\U0001f600 é ß \u0627"), (8, " \n\t ")]
#: Names that operators use inside.
CLASHES = ["rid", "_rid", "group_key", "shard", "slot", "class", "label", "set", "head", "h", "n", "rank", "piece", "length", "sequence_id", "value", "part", "gram", "score", "held_out", "pool", "w", "kind", "start", "spans", "key", "pieces", "payload", "places"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, None if i is None else "en", "s") for i, t in ROWS], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("mine") for c in CLASHES})


def test_shards(docs):
    got = sharding.shard_documents(docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in ROWS), key=repr)
    by_text = {}
    for r in got:
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_components(docs):
    got = jaccard.cluster(docs).collect()
    sets = [brute.shingles(t) for _, t in ROWS]
    roots = brute.components(sets)
    smallest = {}
    for (i, _), r in zip(ROWS, roots, strict=True):
        smallest[r] = min((x for x in (smallest.get(r), i) if x is not None), default=None)
    want = [(i, len(s), smallest[r]) for (i, _), s, r in zip(ROWS, sets, roots, strict=True)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert jaccard.cluster(docs.limit(0)).count() == 0


def test_packing(docs):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    want = []
    for i, t in ROWS:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(array("I", ids[k : k + 4096]).tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    places = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places[r.sequence_id]
        places[r.sequence_id] += r.length
    # Pieces longer than half a sequence need one each; the few short ones fit beside them.
    assert max(places.values()) <= 4096 and len(places) == sum(w[3] > 2048 for w in want)


def test_other_operators_ignore_clashing_names(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source")
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (7, 0)], "doc_id long, quality int")
    same = lambda f: sorted(map(repr, f(docs).collect())) == sorted(map(repr, f(plain).collect()))
    assert same(secrets.scan)
    assert same(lambda d: quality_classifier.classify(d, labels))
    assert same(language_id.identify)
    assert same(lambda d: token_counts.count_tokens(d, P.path("byte_bpe_50k.json")))
    assert same(quality_rules.evaluate)


def test_pages(spark, docs, tmp_path):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://u\x01 \r\nX: y\x7f").alias("url"), F.col("text").alias("html"), *[c for c in CLASHES])
    got = warc.archive_pages(pages, str(tmp_path / "w")).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes) for r in got) == sorted((i is None, i or 0, len((t or "").encode())) for i, t in ROWS)
    assert sum(r.record_type == "response" for r in got) == len({t or "" for _, t in ROWS})
