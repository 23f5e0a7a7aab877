import hashlib
import random
import zlib
from collections import Counter

from rolloom.llm import sharding


def best(sizes, k):
    """Smallest capacity by trying every one."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        low, high = (low, mid) if n <= k else (mid + 1, high)
    return low


def run(spark, rows, k=4):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, shard string").repartition(3)
    return sharding.shard_documents(docs, k).collect()


def check(rows, out, k):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(k):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in out if r.shard == s) for s in range(k)]


def test_capacity_is_minimal(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(1, 900) + str(i // 3)) for i in range(700)]
    sizes = check(rows, run(spark, rows), 4)
    groups = Counter()
    for _, t in rows:
        groups[hashlib.md5(t.encode()).hexdigest()] += len(t) + 1
    assert max(sizes) == best([groups[g] for g in sorted(groups)], 4)


def test_copies_stay_together_and_a_hot_text_has_its_own_shard(spark):
    rows = [(i, "hot" * 50 if i % 3 == 0 else f"doc {i} " * 20) for i in range(300)] + [(7, "doc 7 " * 20), (None, None), (None, "")]
    out = run(spark, rows)
    sizes = check(rows, out, 4)
    where = {}
    for r in out:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    rest = sorted(sizes)
    assert max(sizes) - min(rest) < 0.35 * max(sizes)


def test_empty(spark):
    assert run(spark, []) == []
    assert {r.law for r in run(spark, [(1, "a")])} == {"bytes"}
