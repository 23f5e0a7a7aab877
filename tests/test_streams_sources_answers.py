import json

import pytest
from pyspark.sql import functions as F

from rolloom.functions import answers, normalize, text, tools
from rolloom.operators import balance, relations
from rolloom.operators.tokens import AdaptiveKL
from rolloom.plans.catalog import QUERIES
from rolloom.sources import files
from rolloom.streaming import streams


def rows_to_stream(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def finish(df, spark, tmp_path, mode):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return spark.table("out").collect()


def test_queue_stream(spark, tmp_path):
    schema = "part string, item long, seq long"
    stream = rows_to_stream(spark, tmp_path, [[("a", i, i) for i in range(5)], [("a", i, i) for i in range(5, 9)] + [("b", 1, 1)]], schema)
    out = finish(streams.queue_batches(stream, "part", "item", "seq", 8, 3), spark, tmp_path, "append")
    assert sorted((r.part, tuple(r["items"]), r.dropped) for r in out) == [("a", (0, 1, 2), 0), ("a", (3, 4, 5), 0), ("a", (6, 7, 8), 0)]


def test_queue_drops_the_oldest():
    q = streams.BoundedQueue(2)
    assert [q.put(i) for i in range(3)] == [True, True, False]
    assert q.take(3) is None and q.take(2) == [1, 2] and (q.produced, q.consumed, q.dropped) == (3, 2, 1)


def test_running_totals_equal_batch(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_type", "value")
    parts = [[tuple(r) for r in events.limit(200).collect()], [tuple(r) for r in events.limit(100).collect()]]
    stream = rows_to_stream(spark, tmp_path, parts, "event_type string, value double")
    got = {r.event_type: round(r.total_value, 6) for r in finish(streams.running_totals(stream, "event_type", ["value"]), spark, tmp_path, "complete")}
    want = {}
    for p in parts:
        for k, v in p:
            want[k] = want.get(k, 0) + v
    assert got == {k: round(v, 6) for k, v in want.items()}


def test_budget_and_kl():
    b = streams.StalenessBudget(8, 0.5, 2)
    assert b.limit == 24 and b.add(23) and not b.add(1)
    b.synced(3)
    assert b.made == 3
    assert AdaptiveKL(0.1, 1.0, 100).update(3.0, 10) == pytest.approx(0.1 * 1.02)


def test_rollout_files(spark, tmp_path):
    p = str(tmp_path / "r.jsonl")
    with open(p, "w") as f:
        f.write('{"run_id": "r", "prompt_id": "p", "sample_id": 1}\n\n{"run_id": "r", "prompt_id": "p", "sample_id": 2}\n')
    assert files.read_rollouts(spark, p).count() == 2
    with open(p, "a") as f:
        f.write("[1]\nnot json\n")
    assert [r.line for r in files.bad_lines(spark, p).orderBy("line").collect()] == [4, 5]
    with pytest.raises(Exception):
        files.write_rollouts(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "bad"))
    files.atomic_json(str(tmp_path / "m.json"), {"a": 1})
    assert json.load(open(tmp_path / "m.json")) == {"a": 1}
    with pytest.raises(ValueError):
        files.load_tables(spark, ["x.csv"])
    (tmp_path / "d").mkdir()
    for step in (1, 12):
        (tmp_path / "d" / f"{step}.jsonl").write_text(json.dumps({"input": "a", "score": step}) + "\n")
    assert sorted((r.step, r.score) for r in files.read_dumps(spark, str(tmp_path / "d")).collect()) == [(1, 1), (12, 12)]
    (tmp_path / "g.csv").write_text("time, utilization.gpu [%], memory.used [MiB]\n1, 50 %, 100 MiB\n2, N/A, 300 MiB\n")
    assert sorted(map(tuple, files.read_gpu_csv(spark, str(tmp_path / "g.csv")).collect()), key=repr) == [(50.0, 100.0), (None, 300.0)]
    assert files.manifest(spark, str(tmp_path / "d")).count() == 2
    assert files.flat_parameters({"a": {"b": [1, 2]}}) == {"a/b/list_len": 2, "a/b/0": 1, "a/b/1": 2}
    df = spark.createDataFrame([(1, "x"), (2, "y")], "step int, v string")
    files.step_cache(df, str(tmp_path / "c"), "step")
    assert [r.v for r in files.latest_step(spark, str(tmp_path / "c"), "step").collect()] == ["y"]


@pytest.mark.parametrize("response, status, value", [
    ("The answer is 1,200.", "explicit_final", "1200"), ("x\n#### -3/6", "explicit_final", "-1/2"), ("so \\boxed{\\frac{1}{2}}", "boxed", "1/2"), ("a\n2 + 2 = 4", "implicit_terminal", "4"),
    ("\\boxed{1} \\boxed{2}", "ambiguous", None), ("I saw 3 and 4 birds today", "ambiguous", None), ("none", "missing", None), ("\\boxed{x+y}", "parse_error", None), ("", "missing", None), (None, "missing", None), ("answer: 50%", "explicit_final", "1/2"),
])
def test_extraction(response, status, value):
    got = answers.extract(response)
    assert (got["status"], got["value"]) == (status, value)


@pytest.mark.parametrize("response, truth, error", [
    ("\\boxed{0.5}", "1/2", None), ("\\boxed{3}", "4", "wrong_answer"), ("", "4", "missing_answer"), ("\\boxed{3}", "x", "invalid_ground_truth"), ("\\boxed{-2}", "-2.0", None), ("\\boxed{1} \\boxed{2}", "1", "ambiguous_answer"), ("\\boxed{\\frac{1}", "1", "missing_answer"),
])
def test_verification(response, truth, error):
    got = answers.verify(response, truth)
    assert got["error"] == error and got["correct"] == (error is None)


@pytest.mark.parametrize("a, b, state", [
    ("\\frac12", "0.5", "equal"), ("(1,2)", "(1, 2.0)", "equal"), ("(1,2)", "[1,2]", "different"), ("\\{1,2\\}", "\\{2,1\\}", "equal"), ("x^2", "x*x", "equal"), ("x \\oplus y", "y \\oplus x", "unsupported"), ("50\\%", "0.5", "equal"), ("1", "2", "different"), ("\\sqrt3", "\\sqrt{3}", "equal"), (None, "1", "different"),
])
def test_equality(a, b, state):
    assert answers.equal(a, b) == state


def test_tool_call_forms():
    assert tools.calls("<tool_call><function=f><parameter=x>1</parameter></function></tool_call>", "xml_function") == [{"name": "f", "arguments": '{"x": "1"}'}]
    assert tools.calls(None, "hermes") == []


def test_balance():
    sizes = [100, 200, 150, 50, 300, 250]
    parts = balance.checked(balance.largest_differencing(sizes, 2), 6)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert abs(sums[0] - sums[1]) <= 50
    assert {len(p) for p in balance.largest_differencing(sizes, 2, equal=True)} == {3}
    assert balance.checked(balance.greedy(sizes, 3), 6)
    batches = balance.micro_batches([5, 9, 3, 7, 6], 12)
    assert sorted(i for b in batches for i in b) == list(range(5)) and all(sum([5, 9, 3, 7, 6][i] for i in b) <= 12 for b in batches)
    assert balance.restore([2, 0, 1]) == [1, 2, 0]
    with pytest.raises(ValueError):
        balance.checked([[0], []], 1)


def test_sampled_cases(spark):
    rows = [(0, "####  1,200.5" + "x" * 340, "1,200.5"), (1, "####7", "7"), (2, "#### \u00a0 -3 and 4", "4"), (3, "none", "1"), (4, "#### 5" + "x" * 395, "5")]
    df = spark.createDataFrame(rows, "i int, r string, t string").select("i", text.sampled_case(F.col("r"), F.col("t")).alias("x"))
    got = [(r.x.strict, r.x.flexible, r.x.strict_correct, r.x.flexible_correct, r.x.format_error) for r in df.orderBy("i").collect()]
    assert got == [("1200.5", "1200.5", True, True, False), ("7", "7", True, True, False), ("-3", "4", False, True, False), (None, None, False, False, True), (None, "5", False, True, True)]
    assert tuple(df.agg(*text.case_rates(F.col("x"))).first()) == (0.4, 0.8, 0.4)


def test_modes_mathd_and_prime():
    v = lambda r, m: answers.verify_mode(r, "7", m)["error"]
    assert [v("\\boxed{3} \\boxed{7} \\boxed{x}", m) for m in ("training", "evaluation")] == [None, None]
    assert [v("The answer is 7", m) for m in ("training", "evaluation")] == ["missing_boxed_answer", None]
    assert v("\\boxed{x}", "training") == "boxed_answer_parse_error"
    assert "answer_parse_error" == v("\\boxed{x} or 7", "evaluation")
    assert v("7 or 8. The answer is 7\nThere were 9.", "evaluation") is None
    m = answers.mathd_form
    assert [m(x) for x in ("\\text{ 12 }", "5\\text{ cm}", "5\\text{cm}", "50%", "$5$", "\\frac1{72}", "01/2", "\\sqrt3", "ab = 3", "abc=3", "a\\sqrt")] == [
        "12", "5", "5\\text{cm}", "50%", "$5$", "\\frac{1}{72}", "01/2", "\\sqrt{3}", "ab=3", "abc=3", "a\\sqrt"]
    p = lambda r, t: tuple(answers.prime_score(r, t).values())
    assert p("\\boxed{6.28}", "2\\pi") == (True, False, "6.28") and p("\\boxed{6.2832}", "2\\pi") == (True, False, "6.2832")
    assert p("\\boxed{2/4}", "1/2") == (True, False, "2/4") and p("\\boxed{10000.5}", "10000") == (True, False, "10000.5")
    assert p("Step 2: \\boxed{6}", "2\\pi") == (False, True, "6") and p("\\boxed{8}", "8") == (True, True, "8")


def test_plain_quantities(spark):
    values = {"0,000": "0", "007": "7", "-0": "0", "+5": "5", "-012.00": "-12", "1234,567": "1234567", "1,234,567.": "1234567", "12,34": "12,34", "0.50": "0.50", "-1,200": "-1200"}
    df = spark.createDataFrame([(x,) for x in values], "x string")
    assert {r.x: r.y for r in df.select("x", normalize.plain_quantity(F.col("x")).alias("y")).collect()} == values


def test_order_keeps_every_row(spark, small):
    for name, table, key in (("ord1_all_sorted_groups", "lineitem", "l_orderkey"), ("ord8_all_by_score", "orders", "o_orderkey")):
        n = spark.read.parquet(f"{small}/{table}.parquet").select(key).distinct().count()
        assert sorted(r.place for r in QUERIES[name](spark, small).collect()) == list(range(1, n + 1))


def test_micro_batches_of_all_rows(spark, small):
    rows = [(step, row, 1 + (7 * row + step) % 50) for step in range(3) for row in range(40)]
    out = balance.micro_batched(spark.createDataFrame(rows, "step long, row long, length long"), "step", "row", "length", 120).collect()
    assert sorted((r.step, r.row, r.length) for r in out) == rows
    sums = {}
    for r in out:
        sums[r.step, r.micro] = sums.get((r.step, r.micro), 0) + r.length
    assert max(sums.values()) <= 120
    total = spark.read.parquet(f"{small}/lineitem.parquet").count()
    got = QUERIES["bal5_all_micro_batches"](spark, small).collect()
    assert sum(r.n for r in got) == total and max(r.n for r in got) <= 256


def test_comparison_refuses_drift(spark):
    a = spark.createDataFrame([(1, "x", 1.0)], "k int, truth string, v double")
    with pytest.raises(Exception, match="ground truths differ"):
        relations.compare_runs(a, a.withColumn("truth", F.lit("y")), ["k"], "truth", ["v"]).collect()
    with pytest.raises(Exception, match="missing"):
        relations.compare_runs(a, a.where("k > 1"), ["k"], "truth", ["v"]).collect()
    assert relations.sample_indices(10, 3, 1) == sorted(set(relations.sample_indices(10, 3, 1)))
