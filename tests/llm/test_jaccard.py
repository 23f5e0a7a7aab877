import random

import brute
import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from rolloom.llm import jaccard


def rows(n, seed):
    """Texts around the threshold: unrelated ones with one passage, near copies of bases, chains, copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.randrange(30, 200))] for _ in range(8)]
    out = [None, "", " \n", "one", "One", "two words", "a b c d e", "A b\tc D e ", "a b c d e f"]
    while len(out) < n:
        kind = rng.randrange(4)
        if kind == 0:
            t = [word() for _ in range(rng.randrange(10, 150))] + passage
        elif kind == 1:
            t = list(rng.choice(bases))
            for _ in range(rng.randrange(5)):
                t[rng.randrange(len(t))] = word()
        elif kind == 2:
            t = rng.choice(bases)[rng.randrange(30) :] + [word() for _ in range(rng.randrange(12))]
        else:
            t = (rng.choice(out) or "x").split()
        out.append(" ".join(t))
    return out


def check(docs, got):
    sets = [brute.shingles(t) for _, t in docs]
    roots = brute.components(sets)
    smallest = {}
    for (i, _), r in zip(docs, roots, strict=True):
        smallest[r] = min(x for x in (smallest.get(r), i) if x is not None)
    want = [(i, len(s), smallest[r]) for (i, _), s, r in zip(docs, sets, roots, strict=True)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


def test_against_all_pairs(spark):
    for seed, most, chunk in ((1, jaccard.MAX_FREQUENT, jaccard.CHUNK), (2, 0, 1), (3, jaccard.MAX_FREQUENT, 1500)):
        docs = list(enumerate(rows(300, seed)))
        random.Random(seed).shuffle(docs)
        df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, class string").repartition(3)
        check(docs, jaccard.cluster(spark.createDataFrame(df.collect(), df.schema), max_frequent=most, chunk=chunk).collect())


def test_real_texts(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(docs, jaccard.cluster(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")).collect())


def test_empty(spark):
    assert jaccard.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bound_never_drops_a_link():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 80)
        a = set(rng.sample(range(120), n))
        b = {x for x in a if rng.random() > 0.1} | set(rng.sample(range(120), rng.randrange(0, 6)))
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        short = [set(sorted(s)[: len(s) - jaccard._ceil(len(s)) + 1]) for s in (a, b)]
        assert len(short[0] & short[1]) >= jaccard.needed(np.array(len(a)), np.array(len(b)))


def test_divide_skip_finds_all_components():
    rng = random.Random(6)
    base = list(range(100))
    for sides in (None, [i % 2 for i in range(120)]):
        sets = [sorted(set(x for x in base if rng.random() > rng.choice([0.02, 0.12, 0.3])) | set(rng.sample(range(100, 140), rng.randrange(8)))) for _ in range(120)]
        roots = jaccard._Roots(120)
        for i, j in jaccard.divide_skip([np.array(s, np.uint64) for s in sets], sides):
            roots.join(i, j)
        want = jaccard._Roots(120)
        for i in range(120):
            for j in range(i):
                a, b = set(sets[i]), set(sets[j])
                if (not sides or sides[i] != sides[j]) and 100 * len(a & b) >= 80 * len(a | b):
                    want.join(i, j)
        assert [roots.of(i) for i in range(120)] == [want.of(i) for i in range(120)]


def test_near_copies_find_all_components(spark):
    """Two families with texts between them, loose texts, and a family of its own, all sharing a token."""
    rng = random.Random(9)
    one, two = list(range(100)), list(range(38, 100)) + list(range(200, 238))
    sets = []
    for i in range(260):
        base = one if i < 110 else two if i < 200 else [x if rng.random() < 0.5 else y for x, y in zip(one, two)] if i < 245 else rng.sample(range(400), 60)
        noise = rng.choice([0.0, 0.03, 0.08, 0.15])
        sets.append(sorted({x for x in base if rng.random() > noise} | {500} | set(rng.sample(range(300, 340), rng.randrange(4)))))
    rows = [(i, len(s), [1 if i % 2 else 7, 8], bytearray(np.array(s, np.uint64).tobytes())) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "class long, n long, tokens array<long>, set binary")
    want = jaccard._Roots(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            if 100 * len(a & b) >= 80 * len(a | b):
                want.join(i, j)
    for chunk, pivots in ((1500, 3), (10**6, 8), (400, 1)):
        roots = jaccard._Roots(len(sets))
        for r in jaccard.near_copies(df, chunk, pivots).collect():
            a, b = set(sets[r.a]), set(sets[r.b])
            assert 100 * len(a & b) >= 80 * len(a | b)
            roots.join(r.a, r.b)
        assert [roots.of(i) for i in range(len(sets))] == [want.of(i) for i in range(len(sets))]
    assert len({want.of(i) for i in range(len(sets))}) > 3


def test_a_large_family_is_linked_in_one_pass(spark):
    """Nothing is left for the pairs of chunks where all members link to a pivot."""
    rng = random.Random(10)
    sets = [sorted(set(range(200)) - set(rng.sample(range(200), 3))) for _ in range(4000)]
    df = spark.createDataFrame([(i, len(s), [5], bytearray(np.array(s, np.uint64).tobytes())) for i, s in enumerate(sets)], "class long, n long, tokens array<long>, set binary")
    links = jaccard.near_copies(df, 2000, 4).collect()
    assert len(links) <= 4 * 4000 and {r.a for r in links} == set(range(4000)) and len({r.b for r in links}) == 4


def broadcast_rows(monkeypatch):
    """A list that gets the number of rows of each table that is broadcast on purpose, but for those of components (``meet`` bounds them)."""
    sent, real = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(0 if "_label" in df.columns else df.count()) or real(df))
    return sent


def test_candidates_are_fetched_by_bits(spark, tmp_path, monkeypatch):
    words = [F.concat(F.lit(f"w{k}x"), F.expr("id div 2")) for k in range(60)]
    docs = spark.range(0, 6000, 1, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *words, F.concat(F.lit("end"), "id")).alias("text"))
    docs.write.parquet(str(tmp_path / "d"))
    sent = broadcast_rows(monkeypatch)
    got = {r.doc_id: r.component_id for r in jaccard.cluster(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == {i: i // 2 * 2 for i in range(6000)}
    assert max(sent) <= 600  # of 6,000 candidates


def test_of_rows(spark):
    from rolloom.llm.columns import of_rows

    rows = spark.range(0, 3000, 1, 3).select(F.col("id").alias("_word"), F.monotonically_increasing_id().alias("rid"))
    for share in (1, 2, 700):
        listed = rows.where(f"_word % {share} = 0").select("rid")
        listed = listed.union(listed)
        for most in (250_000, -1):
            got = sorted(r[0] for r in of_rows(rows, "rid", listed, most=most).collect())
            rest = sorted(r[0] for r in of_rows(rows, "rid", listed, there=False, most=most).collect())
            assert got == [i for i in range(3000) if i % share == 0]
            assert rest == [i for i in range(3000) if i % share]
    assert of_rows(rows, "rid", rows.select("rid").limit(0)).count() == 0


def test_a_swollen_heap_is_shrunk(spark, monkeypatch):
    from rolloom import session

    calls = []
    monkeypatch.setattr(session, "release", calls.append)
    monkeypatch.setattr(session, "HEAP_SHARE", 1.0)
    session.materialize(spark.range(3))
    assert not calls
    monkeypatch.setattr(session, "HEAP_SHARE", 0.0)
    session.materialize(spark.range(3))
    assert calls
