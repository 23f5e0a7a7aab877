import zlib

import numpy as np
from conftest import DATA

from rolloom.llm import quality_classifier as qc


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = qc.classify(docs, labels).where("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    right = np.mean([r.quality == r.predicted for r in out])
    bad = [r.predicted == 0 for r in out if r.quality == 0]
    good = [r.predicted == 1 for r in out if r.quality == 1]
    assert len(out) > 500 and right >= 0.98 and np.mean(bad) >= 0.85 and np.mean(good) >= 0.99


def test_identity():
    rng = np.random.default_rng(1)
    m = qc.Machine()
    m.w, m.v = rng.normal(size=m.w.shape), rng.normal(size=m.v.shape)
    index, value, starts = m._flat([qc.inputs("some words and some more"), qc.inputs(None)])
    raw, _, _ = m._raw(index, value, starts)
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(index)])):
        i, x = index[a:b], value[a:b]
        slow = m.bias + m.w[i] @ x + sum(m.v[i[p]] @ m.v[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert abs(slow - raw[k]) < 1e-9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "a b", 9), (None, "x", 9), (3, "word " * 20000, 9)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qc.classify(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, None), (7, 0), (None, 1)], "doc_id long, quality int")
    out = qc.classify(docs, some).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert qc.classify(docs.limit(0), some).count() == 0


def plain_raw(m, row):
    buckets, stats = row
    x = {int(b): 1 / np.sqrt(len(buckets)) for b in buckets}
    for k, v in enumerate(stats):
        x[qc.BUCKETS + k] = float(v)
    at = list(x)
    pairs = sum(float(m.v[p] @ m.v[q]) * x[p] * x[q] for i, p in enumerate(at) for q in at[:i])
    return m.bias + sum(m.w[p] * v for p, v in x.items()) + pairs, x


def plain_fit(m, rows, labels, epochs, batch=64, rate=0.1, decay=1e-4, seed=11):
    """The same descent, one input at a time."""
    rng, gw, gv = np.random.default_rng(seed), np.full(m.w.shape, 1e-3), np.full(m.v.shape, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            chosen, dw, dv = order[at : at + batch], {}, {}
            for i in chosen:
                raw, x = plain_raw(m, rows[i])
                error = (1 / (1 + np.exp(-raw)) - labels[i]) / len(chosen)
                for p, v in x.items():
                    others = sum((m.v[q] * u for q, u in x.items() if q != p), np.zeros(qc.RANK))
                    dw[p] = dw.get(p, 0.0) + error * v
                    dv[p] = dv.get(p, np.zeros(qc.RANK)) + error * v * others
            for p in dw:
                a, b = dw[p] + decay * m.w[p], dv[p] + decay * m.v[p]
                gw[p] += a**2
                gv[p] += b**2
                dw[p], dv[p] = a, b
            for p in dw:
                m.w[p] -= rate * dw[p] / np.sqrt(gw[p])
                m.v[p] -= rate * dv[p] / np.sqrt(gv[p])
    return m


def test_fit_and_scores_against_plain_python(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["good", "fine", "text", "of", "some", "kind"] if i % 2 else ["##", "BUY", "now", "7777", "text"], rng.integers(3, 9))) for i in range(90)]
    texts[3] = texts[1]
    rows = [qc.inputs(t) for t in texts]
    labels = np.array([i % 2 for i in range(90)], float)
    fast, slow = qc.Machine(0.4).fit(rows, labels, epochs=2), plain_fit(qc.Machine(0.4), rows, labels, 2)
    assert np.allclose(fast.w, slow.w, atol=1e-9) and np.allclose(fast.v, slow.v, atol=1e-9)
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in enumerate(texts)] + [(1, texts[1], 1.0, 2), (500, None, 1.0, 2)], "doc_id long, text string, score double, y int")
    table = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    machine = qc.train(docs, table)
    for r in qc.classify(docs, table).collect():
        raw, _ = plain_raw(machine, qc.inputs(None if r.doc_id == 500 else texts[r.doc_id]))
        want = 1 / (1 + np.exp(-raw))
        assert abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
