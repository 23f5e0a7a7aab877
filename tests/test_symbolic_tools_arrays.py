"""The symbolic comparer, call readers, guards, and array functions against plain loops."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloom.functions import arrays, symbolic, tools, turns
from rolloom.functions.guard import within
from rolloom.operators import dispatch, relations, tokens
from rolloom.streaming.streams import TokenBucket


@pytest.mark.parametrize("a, b", [
    ("x(y+z)", "xy+xz"), ("\\frac{x}{x^2}", "\\frac1x"), ("(a-b)(a+b)", "a^2-b^2"), ("\\sqrt{50}", "5\\sqrt2"), ("\\frac{3}{\\sqrt{3}}", "\\sqrt{3}"), ("2^{-1}", "0.5"), ("8^{1/3}", "2"), ("(1+i)^2", "2i"), ("\\cos(2x)", "2\\cos^2 x-1"),
    ("\\ln(e)", "1"), ("1\\le x<2", "2>x\\ge 1"), ("\\emptyset", "\\{\\}"), ("x^{12}", "x^{6}x^{6}"), ("\\frac{10}{4}", "2.5"), ("7", "007"), ("\\{(1,2),(3,4)\\}", "\\{(3,4),(1,2)\\}"),
])
def test_equal_answers(a, b):
    assert symbolic.compare(a, b) == symbolic.compare(b, a) == "equal"


@pytest.mark.parametrize("a, b", [("x", "y"), ("x^2", "x"), ("1", "1.01"), ("(1,2)", "(2,1)"), ("\\{1,2\\}", "\\{1,2,3\\}"), ("x<1", "x\\le 1"), ("\\sin x", "x"), ("\\pi", "3.14"), ("\\sqrt2", "1.41"), ("[0,1)", "[0,1]"), ("1", "\\text{one}"), (None, "1")])
def test_different_answers(a, b):
    assert symbolic.compare(a, b) == symbolic.compare(b, a) == "different"


@pytest.mark.parametrize("a", ["\\foo{x}", "1 \\oplus 2", "(((", "\\frac{1}{0}", "x_", "", "\\int x dx", "(x+y+z+w+u)^{40}(a+b+c+d)^{40}"])
def test_what_cannot_be_read(a):
    assert symbolic.compare(a, "1") == "unsupported"


def test_guard():
    assert within(lambda: 5, 1.0) == (5, False)
    began = time.perf_counter()
    assert within(lambda: time.sleep(5), 0.05) == (None, True) and time.perf_counter() - began < 1
    with pytest.raises(KeyError):
        within(lambda: {}["x"], 1.0)


def test_call_scores():
    f = lambda n, **p: {"name": n, "parameters": p}
    assert tools.call_score([f("a", x=1)], [f("a", x=1)]) == 3 and tools.call_score([f("a", x=1)], []) == -3
    # names 1 of 1, keys 1 of 1, no value: (1 + 1) of (1 + 1 + 1)
    assert tools.call_score([f("a", x=1)], [f("a", x=2)]) == -3 + 6 * 2 / 3
    assert tools.call_score([f("a", x=1), f("a", x=2)], [f("a", x=2), f("a", x=1)]) == -3 + 6 * (1 + 2 + 2) / 5
    with pytest.raises(ValueError):
        tools.calls("x", "no such form")


def rows(spark, n, length, seed=3):
    rng = np.random.default_rng(seed)
    data = [(i, rng.normal(size=length).tolist(), (rng.normal(size=length) * 0.1).tolist(), rng.integers(0, 2, length).tolist(), rng.integers(0, 9, length).tolist()) for i in range(n)]
    return data, spark.createDataFrame(data, "i int, v array<double>, w array<double>, m array<int>, ids array<int>")


def test_array_functions_against_loops(spark):
    data, df = rows(spark, 7, 33)
    v, w, m = F.col("v"), F.col("w"), F.col("m")
    got = df.select(
        "i", arrays.entropy(v).alias("entropy"), arrays.sum_pi_squared(v).alias("pi2"), arrays.masked_var(v, m).alias("var"), arrays.response_mask(F.col("ids"), [4]).alias("mask"), arrays.gae(v, w, m, 0.9, 0.8).alias("gae"), arrays.returns_to_go(v, 0.9).alias("back"),
        arrays.importance_weights(v, w, m, "sequence").alias("weights"), arrays.rejection_mask(v, w, m, "seq_mean_k3", None, 0.6).alias("kept")).collect()
    for r, (i, v, w, m, ids) in zip(sorted(got), data, strict=True):
        v, w, m = np.array(v), np.array(w), np.array(m)
        p = np.exp(v) / np.exp(v).sum()
        assert np.isclose(r.entropy, -(p * np.log(p)).sum()) and np.isclose(r.pi2, (p**2).sum()) and np.isclose(r["var"], v[m > 0].var(ddof=1))
        at = ids.index(4) if 4 in ids else len(ids)
        assert list(r.mask) == [int(k <= at) for k in range(len(ids))]
        value = advantage = back = 0.0
        for t in reversed(range(len(v))):
            if m[t]:
                advantage = v[t] + 0.9 * value - w[t] + 0.9 * 0.8 * advantage
                value = w[t]
            back = v[t] + 0.9 * back
            assert np.isclose(r.gae[t], advantage) and np.isclose(r.back[t], back)
        ratio = v - w
        assert np.allclose(r.weights, min(np.exp(np.clip((ratio * m).sum(), -20, 20)), 2.0) * m)
        keep = ((np.exp(ratio) - ratio - 1) * m).sum() / max(m.sum(), 1) <= 0.6
        assert list(r.kept) == list(m * keep)


def test_ragged_and_missing_arrays(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, []), (2, None), (3, [5.0])], "i int, v array<double>")
    got = {r.i: r.x for r in df.select("i", arrays.returns_to_go(F.col("v")).alias("x")).collect()}
    assert got == {0: [6.0, 5.0, 3.0], 1: [], 2: None, 3: [5.0]}


def test_array_functions_take_linear_time(spark):
    """Four times the places take far less than the sixteen times of a quadratic form."""
    times = []
    for length in (2000, 8000):
        _, df = rows(spark, 24, length)
        df = df.coalesce(1).cache()
        df.count()
        v, w, m = F.col("v"), F.col("w"), F.col("m")
        out = df.select(arrays.entropy(v), arrays.response_mask(F.col("ids"), [99]), arrays.rejection_mask(v, w, m, "seq_sum_k1", 0.5, 2.0), arrays.importance_weights(v, w, m, "sequence"), arrays.gae(v, w, m), arrays.returns_to_go(v))
        for _ in range(2):
            began = time.perf_counter()
            out.write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - began
        times.append(taken)
    assert times[1] < 8 * times[0] + 0.5, times


def test_moments_of_large_values(spark):
    df = spark.createDataFrame([([1e9, 1e9 + 1, 1e9 + 2], [1, 1, 1])], "v array<double>, m array<int>")
    assert abs(tokens.masked_moments(df, "v", "m").first()["var"] - 1) < 1e-6


def test_running_sums_and_dynamic_sampling(spark):
    df = spark.createDataFrame([(f"g{i // 4}", i, float(i % 4 == 0 and i // 4 % 3 > 0)) for i in range(64)], "g string, at int, x double")
    total = {r["at"]: r.total_at for r in relations.running(df, ["at"], ["at"]).collect()}
    assert total == {i: i * (i + 1) // 2 for i in range(64)}
    kept = relations.dynamic_sampling(df, "g", "x", "at", 24)  # ten mixed groups of four rows: six of them fill a batch of 24
    assert sorted({r.g for r in kept.collect()}) == sorted(f"g{i}" for i in (1, 2, 4, 5, 7, 8))
    assert relations.dynamic_sampling(df.withColumn("x", F.lit(1.0)), "g", "x", "at", 24).count() == 64


def test_bucket():
    b = TokenBucket(2.0, 4.0)
    assert [b.acquire(1, 0.0) for _ in range(4)] == [0.0] * 4 and b.acquire(1, 0.0) == 0.5
    assert TokenBucket(1.0).acquire(3.0, 0.0) == 2.0


def test_turns_by_hand(spark):
    talk = [("system", "s"), ("user", "hi"), ("assistant", "ok"), ("system", "s"), ("user", "x")]
    df = spark.createDataFrame([(talk,)], "t array<struct<role:string,content:string>>")
    t = turns.Template()
    r = df.select(turns.assembled(F.col("t"), t, turns.character_ids).alias("a"), turns.stream(F.slice("t", 1, 3), t, turns.character_ids).alias("s"), turns.assembled(F.slice("t", 2, 1), turns.Template(system="q"), turns.character_ids)["ids"].alias("d")).first()
    assert r.a.ids == [1, 11, 2, 115, 3, 1, 12, 2, 104, 105, 3, 1, 13, 2, 111, 107, 3, 1, 12, 2, 120, 3]
    assert r.a.loss == [0] * 14 + [1, 1, 1] + [0] * 5 and r.a.positions == list(range(22))
    assert r.s.prompt == r.a.ids[:14] and r.s.response == [111, 107, 3] and r.s.loss == [1, 1, 1] and r.s.boundaries == [0]
    assert r.d == [1, 11, 2, 113, 3, 1, 12, 2, 104, 105, 3]


def test_shares_must_divide(spark):
    with pytest.raises(ValueError):
        dispatch.data_parallel(spark.range(5), 2, ["id"])
    assert relations.at_indices(spark.range(5), ["id"], [4, 0]).orderBy("pos").collect() == [(0, 4), (1, 0)]
    with pytest.raises(Exception, match="out of range"):
        relations.at_indices(spark.range(5), ["id"], [5]).collect()
