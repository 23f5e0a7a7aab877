"""Queries over answers: spellings, scorers, symbolic comparison, tool calls and guards.

The generated tables hold no mathematics, so each query lays a list of varied inputs
over the rows of documents (by id), and its SQL lists the results that were worked out by hand.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.functions import answers, symbolic, text, tools
from rolloom.operators import rewards
from rolloom.plans.registry import Tables, query


def laid_out(t: Tables, rows: list[tuple]) -> DataFrame:
    """doc_id with the inputs c0, c1, ... of case doc_id modulo the number of cases."""
    at = (F.col("doc_id") % len(rows) + 1).cast("int")
    columns = [F.element_at(F.array(*[F.array(*map(F.lit, r[k])) if isinstance(r[k], list) else F.lit(r[k]) for r in rows]), at).alias(f"c{k}") for k in range(len(rows[0]))]
    return t.documents.select("doc_id", *columns)


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value!r}::DOUBLE" if isinstance(value, float) else repr(value)


def expected(**columns: list) -> str:
    """SQL of doc_id with the listed results by case."""
    return "SELECT doc_id, " + ", ".join(f"([{', '.join(map(literal, v))}])[1 + doc_id % {len(v)}] AS {k}" for k, v in columns.items()) + " FROM documents"


# (gold, response, score)
SPELLINGS = [
    ("\\frac{1}{2}", "so \\boxed{\\frac12}", 1.0), ("\\frac{1}{2}", "\\boxed{1/2}", 1.0), ("0.5", "\\boxed{\\frac{1}{2}}", 1.0), ("0.25", "\\boxed{\\frac{1}{4}}", 0.0), ("50", "\\boxed{0.5}", 0.0), ("50\\%", "\\boxed{50}", 1.0), ("5", "\\boxed{4} then \\boxed{5}", 1.0),
    ("4", "\\boxed{4} then \\boxed{5}", 0.0), ("\\sqrt{3}", "\\boxed{\\sqrt3}", 1.0), ("x = 7", "\\boxed{7}", 1.0), ("12", "12", 0.0), ("3", "\\fbox{3}", 1.0), ("9", "\\boxed 9", 1.0), ("\\left(1,2\\right)", "\\boxed{(1, 2)}", 1.0), (".5", "\\boxed{0.5}", 1.0),
    ("x+1", "\\boxed{1+x}", 0.0), ("10\\text{ cm}", "\\boxed{10}", 1.0), ("1", "\\boxed{2", 0.0),
]


@query("scr4_box_scorer", expected(score=[c[2] for c in SPELLINGS]))
def _(t: Tables) -> DataFrame:
    return laid_out(t, SPELLINGS).select("doc_id", answers.box_score_column(F.col("c1"), F.col("c0")).alias("score"))


# (given, truth, correct)
GRADES = [
    ("1/2", "\\frac{1}{2}", True), ("\\frac{2}{4}", "\\frac{1}{2}", False), ("0.75", "\\frac{3}{4}", True), ("x+1", "1+x", True), ("(x+1)^2", "x^2+2x+1", True), ("5", "5.0", True), ("5", "\\sqrt{25}", False), ("\\sqrt{8}", "2\\sqrt{2}", True),
    ("(1,2)", "(1,2)", True), ("(1,2]", "(1,2)", False), ("(1,2,3)", "(1,2)", False), ("(1,x+x)", "(1,2x)", True), ("(2,1)", "(1,2)", False), ("1,000", "1000", True), ("", "1", False), ("\\sin(x)", "\\cos(x)", False), ("2", "3", False), ("x^2", "x*x", True),
    ("(\\frac{2}{4},1)", "(\\frac{1}{2},1)", False),
]


@query("ver6_grades", expected(correct=[c[2] for c in GRADES]))
def _(t: Tables) -> DataFrame:
    return laid_out(t, GRADES).select("doc_id", answers.grade_column(F.col("c0"), F.col("c1")).alias("correct"))


# Spellings under the mathd form (nrm3), which unlike the other one (nrm2) keeps dollars, percents of text and what it cannot read.
FORMS = [
    ("0.5", "\\frac{1}{2}"), ("\\dfrac12", "\\frac{1}{2}"), ("x = 1/2", "\\frac{1}{2}"), ("\\left\\tfrac{1}{2}", "\\frac{1}{2}"), ("\\text{yes}", "yes"), ("30^\\circ", "30"), ("5\\text{ cm}", "5"), (".75", "0.75"), ("\\sqrt2", "\\sqrt{2}"), ("1/3", "\\frac{1}{3}"),
    ("a/b", "a/b"), ("3 000", "3000"), ("\\$7", "7"), ("01/2", "01/2"), ("k=9", "9"), ("long=9", "long=9"),
]


@query("nrm3_latex_variants", expected(answer=[c[1] for c in FORMS]))
def _(t: Tables) -> DataFrame:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(answers.mathd_form)

    return laid_out(t, FORMS).select("doc_id", run("c0").alias("answer"))


# (a, b, state)
EQUALITIES = [
    ("(1, \\frac12)", "(1,0.5)", "equal"), ("50\\%", "0.5", "equal"), ("7", "8", "different"), ("x^2", "x*x", "equal"), ("x^2", "x^3", "different"), ("0.33333", "\\frac{1}{3}", "equal"), ("[1,2]", "(1,2)", "different"), ("{1,2}", "{2,1}", "equal"),
    ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&5\\end{pmatrix}", "different"), ("\\begin{bmatrix}1&x+x\\\\3&4\\end{bmatrix}", "\\begin{pmatrix}1&2x\\\\3&4\\end{pmatrix}", "equal"), ("a \\oplus b", "b", "unsupported"),
    ("2\\pi", "\\pi+\\pi", "equal"), ("\\sqrt{12}", "2\\sqrt{3}", "equal"), ("12", "0.125", "different"),
]


@query("ver5_equality", expected(state=[c[2] for c in EQUALITIES]))
def _(t: Tables) -> DataFrame:
    return laid_out(t, EQUALITIES).select("doc_id", answers.equal_column(F.col("c0"), F.col("c1")).alias("state"))


# (gold, answer, state)
SYMBOLIC = [
    ("(x+1)^2", "x^2+2x+1", "equal"), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt 2}{2}", "equal"), ("(1,2)", "[1,2)", "different"), ("\\{1,2\\}", "\\{2,1\\}", "equal"), ("1,2", "2, 1", "equal"), ("x=5", "5", "equal"), ("y = 2x+3", "2y=4x+6", "equal"), ("x<3", "3>x", "equal"),
    ("x<3", "-x>-3", "equal"), ("x<3", "x>3", "different"), ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{bmatrix}1&2\\\\3&4\\end{bmatrix}", "equal"), ("\\begin{pmatrix}1\\\\2\\end{pmatrix}", "(1,2)", "equal"),
    ("(-\\infty,1)\\cup(2,\\infty)", "(2,\\infty)\\cup(-\\infty,1)", "equal"), ("\\sin^2 x+\\cos^2 x", "1", "equal"), ("2\\pi", "6.28", "different"), ("1,200", "1200", "equal"), ("50\\%", "0.5", "equal"), ("3\\pm\\sqrt{2}", "3+\\sqrt2, 3-\\sqrt2", "equal"),
    ("\\text{Monday}", "monday", "equal"), ("2^{10}", "1024", "equal"), ("i^2", "-1", "equal"), ("\\log_2 8", "3", "equal"), ("5!", "120", "equal"), ("1\\frac{1}{2}", "1.5", "equal"), ("x^2 \\oplus 3", "x", "unsupported"), ("\\frac{x^2-1}{x-1}", "x+1", "equal"),
    ("e^{x}e^{y}", "e^{x+y}", "equal"), ("0.333", "\\frac13", "different"), ("\\sqrt[3]{27}", "3", "equal"), ("a_1+a_2", "a_2+a_1", "equal"), ("\\sqrt{2}\\sqrt{3}", "\\sqrt{6}", "equal"), ("10 \\text{ cm}", "10", "equal"), ("x \\in [0,1]", "[0,1]", "unsupported"),
]


@query("ver4_symbolic", expected(state=[c[2] for c in SYMBOLIC]))
def _(t: Tables) -> DataFrame:
    return laid_out(t, SYMBOLIC).select("doc_id", symbolic.compare_column(F.col("c0"), F.col("c1")).alias("state"))


# (response, gold, error)
BOXES = [
    ("first \\boxed{3}, then \\boxed{x+1}", "1+x", None), ("\\boxed{2x} and \\boxed{a \\oplus b}", "x+x", None), ("\\boxed{a \\oplus b}", "1", "boxed_answer_parse_error"), ("x+1", "x+1", "missing_boxed_answer"), ("\\boxed{4}", "5", "wrong_answer"),
    ("\\boxed{4}", "a \\oplus b", "invalid_ground_truth"), ("\\boxed{\\frac{2}{4}}", "\\frac12", None), (None, "1", "missing_boxed_answer"), ("\\boxed{[0,1)}", "[0,1)", None), ("\\boxed{(0,1)}", "[0,1)", "wrong_answer"),
]


@query("ver3_latex_verifier", expected(error=[c[2] for c in BOXES]))
@query("scr11_pooled_verifier", expected(error=[c[2] for c in BOXES]))
def _(t: Tables) -> DataFrame:
    return laid_out(t, BOXES).select("doc_id", symbolic.verify_column(F.col("c0"), F.col("c1"), seconds=10.0)["error"].alias("error"))


GOLD_BOXES = [("so \\boxed{1} or \\boxed{\\frac{3}{4}}", "\\frac{3}{4}"), ("\\boxed{a \\oplus b}", None), ("no box", None), (None, None), ("\\boxed{ (1, 2) }", "(1, 2)"), ("\\boxed{x^{2}}.", "x^{2}"), ("\\boxed{1} \\boxed{a \\oplus b}", None)]


@query("ext9_gold_box", expected(gold=[c[1] for c in GOLD_BOXES]))
def _(t: Tables) -> DataFrame:
    return laid_out(t, GOLD_BOXES).select("doc_id", symbolic.gold_box_column(F.col("c0")).alias("gold"))


# (golds, predictions, best)
METRICS = [(["1/2"], ["0.5", "3"], 1.0), (["1", "2"], ["3", "4"], 0.0), (["x+1", "7"], ["1+x"], 1.0), (["5"], ["a \\oplus b"], 0.0), (["\\sqrt{4}"], ["9", "2"], 1.0)]


@query("agg40_best_over_pairs", expected(best=[c[2] for c in METRICS]))
def _(t: Tables) -> DataFrame:
    return laid_out(t, METRICS).select("doc_id", symbolic.metric_column(F.col("c0"), F.col("c1")).alias("best"))


# (response, candidates in order)
CANDIDATES = [
    ("The answer is 7.\nso \\boxed{7}", "explicit_final:7:0|boxed:7:0"), ("x = 3", "implicit_terminal:3:0"), ("\\boxed{1} \\boxed{\\frac{1}{2}}\nno", "boxed:1:0|boxed:1/2:0"), ("#### 1,200", "explicit_final:1200:0"), ("nothing", ""), ("Answer: 25\\%\nend", "explicit_final:1/4:0"),
]


@query("ext2_candidates", expected(found=[c[1].replace(":0", "") for c in CANDIDATES]))
def _(t: Tables) -> DataFrame:
    found = F.array_join(F.transform(answers.candidates_column(F.col("c0")), lambda c: F.concat_ws(":", c["tier"], c["value"])), "|")
    return laid_out(t, CANDIDATES).select("doc_id", F.array_join(F.array_distinct(F.split(found, r"\|")), "|").alias("found"))


LAST_BOXES = [("a \\boxed{1} b \\boxed{ 2 }", " 2 ", " 2 ", "2"), ("\\fbox{3}", None, "3", "3"), ("\\boxed 4$ x", None, "4", None), ("\\boxed{5", None, None, None), ("\\boxed{{6}} \\boxed{}", "", "", "")]


@query("ext5_last_boxed", expected(strict=[c[1] for c in LAST_BOXES], framed=[c[2] for c in LAST_BOXES], inner=[c[3] for c in LAST_BOXES]))
def _(t: Tables) -> DataFrame:
    @F.pandas_udf("string")
    def framed(x: pd.Series) -> pd.Series:
        return x.map(answers.last_boxed)

    r = F.col("c0")
    inner = F.try_element_at(text.boxed(F.replace(r, F.lit("\\fbox{"), F.lit("\\boxed{"))), F.lit(-1))
    return laid_out(t, LAST_BOXES).select("doc_id", F.try_element_at(text.boxed(r), F.lit(-1)).alias("strict"), framed(r).alias("framed"), F.trim(inner).alias("inner"))


SCHEMA = {"find": {"n": "integer", "deep": "boolean", "q": "string"}, "add": {"a": "number", "b": "number"}}
# (form, text, calls)
CALLS = [
    ("hermes", 'x <tool_call>{"name": "find", "arguments": {"n": 1}}</tool_call><tool_call>bad</tool_call><tool_call>{"name": "add"}</tool_call>', 'find{"n": 1}'),
    ("gpt-oss", '<|channel|>analysis<|message|>to=functions.no <|end|><|start|>assistant<|channel|>commentary to=functions.find <|constrain|>json<|message|>{"n": 2}<|call|>', 'find{"n": 2}'),
    ("qwen3_coder", "<tool_call>\n<function=find>\n<parameter=n>\n3\n</parameter>\n<parameter=deep>\nTrue\n</parameter>\n<parameter=q>\n4\n</parameter>\n</function>\n</tool_call>", 'find{"deep": true, "n": 3, "q": "4"}'),
    ("glm", '<tool_call>find\n<arg_key>n</arg_key>\n<arg_value>4</arg_value><arg_key>q</arg_key><arg_value>two words</arg_value></tool_call><tool_call>stop</tool_call>', 'find{"n": 4, "q": "two words"};stop{}'),
    ("seed", "<seed:tool_call><function=add><parameter=a>1.5</parameter><parameter=b>[1]</parameter></function></seed:tool_call><seed:tool_call>none</seed:tool_call>", 'add{"a": 1.5, "b": [1]}'),
    ("minimax", '<minimax:tool_call><invoke name="add"><parameter name="a">1</parameter></invoke><invoke name="find"></invoke></minimax:tool_call>', 'add{"a": 1};find{}'),
    ("kimi", '<|tool_calls_section_begin|><|tool_call_begin|>functions.find:0<|tool_call_argument_begin|>{"n": 6}<|tool_call_end|><|tool_call_begin|>x<|tool_call_argument_begin|>{"a": 1, "b": 2}<|tool_call_end|>', 'find{"n": 6};add{"a": 1, "b": 2}'),
    ("gemma4", '<|tool_call>call:find{n:7,q:<|"|>a,b<|"|>,deep:false,x:1.5}<tool_call|>', 'find{"deep": false, "n": 7, "q": "a,b", "x": 1.5}'),
]


@query("ext10_tool_calls", expected(calls=[c[2] for c in CALLS]))
def _(t: Tables) -> DataFrame:
    joined = F.when(F.lit(False), "")
    for form, _, _ in CALLS:
        calls = tools.calls_column(F.col("c1"), form, SCHEMA)
        joined = joined.when(F.col("c0") == form, F.array_join(F.transform(calls, lambda c: F.concat(c["name"], c["arguments"])), ";"))
    return laid_out(t, CALLS).select("doc_id", joined.alias("calls"))


_CALL = '<think>t</think>\n<tool_call>\n{"name": "f", "parameters": {"a": 1, "b": 2}}\n</tool_call>'
# (response, gold, format, calls); an equal call 3, a wrong value 6 * (1 + 2 / 4) ... over 4 parts less 3
TOOL_SCORES = [
    (_CALL, _CALL, 1.0, 3.0), (_CALL.replace("2}", "3}"), _CALL, 1.0, 1.5), (_CALL.replace('"f"', '"g"'), _CALL, 1.0, -3.0), ("none", _CALL, 0.0, -3.0), (_CALL.replace(', "b": 2', ""), _CALL, 1.0, 0.75),
    ("<think>t</think>\n<response>r</response>", "<response>r</response>", 1.0, 0.0), ("<think>t</think>", "plain", 1.0, 0.0), (_CALL + _CALL, _CALL, 0.0, 3.0), ("<tool_call>\nbad\n</tool_call>", _CALL, 0.0, -3.0),
]


@query("scr8_tool_scores", expected(format=[c[2] for c in TOOL_SCORES], calls=[c[3] for c in TOOL_SCORES], score=[c[2] + c[3] for c in TOOL_SCORES]))
def _(t: Tables) -> DataFrame:
    x = tools.score_column(F.col("c0"), F.col("c1"))
    return laid_out(t, TOOL_SCORES).select("doc_id", x.alias("x")).select("doc_id", *[F.round(F.col("x")[k], 6).alias(k) for k in ("format", "calls", "score")])


# Question answering: tags repeated more than ten times quarter an exact score; a substring score ignores that.
QA = "WITH r AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 11 ELSE 1 END AS k, doc_id % 5 = 4 AS bare FROM documents) "


def _qa_responses(t: Tables) -> DataFrame:
    tags = F.repeat(F.lit("<answer> x </answer>"), F.when(F.col("doc_id") % 3 == 0, 10).otherwise(0))
    body = F.concat(tags, F.lit("<answer> The "), "lang", F.lit("! </answer>"))
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 5 == 4, "no tag").otherwise(body).alias("r"))


@query("scr6_tag_count", QA + "SELECT doc_id, CASE WHEN bare OR lang NOT IN ('en', 'fr') THEN 0 WHEN k > 10 THEN 0.25 ELSE 1 END::DOUBLE AS score FROM r")
def _(t: Tables) -> DataFrame:
    return _qa_responses(t).select("doc_id", text.qa_score(F.col("r"), F.array(F.lit("the EN."), F.lit("Fr"))).alias("score"))


@query("scr6_substring_match", QA + "SELECT doc_id, CASE WHEN NOT bare AND contains(lang, 'e') THEN 1 ELSE 0 END::DOUBLE AS score FROM r")
def _(t: Tables) -> DataFrame:
    return _qa_responses(t).select("doc_id", text.qa_score(F.col("r"), F.array(F.lit("the E!")), substring=True).alias("score"))


@query("scr1_dispatch", "WITH x AS (SELECT doc_id, ['sums', 'boxes', 'aime24', 'search', 'aime_x'][1 + doc_id % 5] AS source FROM documents) SELECT source, count(*) AS n, CASE source WHEN 'sums' THEN 1 WHEN 'boxes' THEN 0 WHEN 'search' THEN 1 ELSE -1 END::DOUBLE AS score FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ("sums", "boxes", "aime24", "search", "aime_x"))), (F.col("doc_id") % 5 + 1).cast("int"))
    r = F.lit("#### 12 and \\boxed{3} <answer>yes</answer>\nAnswer: 4")
    from rolloom.functions import normalize

    scorers = {"sums": (text.hash_answer(r) == "12").cast("double"), "boxes": answers.box_score_column(r, F.lit("4")), "search": text.qa_score(r, F.array(F.lit("Yes")))}
    score = rewards.dispatch(F.col("source"), scorers, {"aime": normalize.line_score(r, F.lit("5"))["score"]})
    return t.documents.select(source.alias("source")).withColumn("score", score).groupBy("source").agg(F.count("*").alias("n"), F.avg("score").alias("score"))


@query("scr1_unknown_source", "SELECT 'no scorer for other' AS message")
def _(t: Tables) -> DataFrame:
    """A source without a scorer is an error that names it."""
    try:
        t.documents.limit(1).select(rewards.dispatch(F.lit("other"), {"sums": F.lit(1.0)})).collect()
        message = "none"
    except Exception as e:
        message = "no scorer for other" if "no scorer for other" in str(e) else str(e)[:80]
    return t.spark.createDataFrame([(message,)], "message string")


@query("scr9_batched", "SELECT doc_id, ((n_chars % 10) + 0.5)::DOUBLE AS score FROM documents")
def _(t: Tables) -> DataFrame:
    """A scorer of whole lists: lists in, a list out."""
    run = rewards.batched(lambda sources, responses, truths, extras: [int(g) % 10 + 0.5 for g in truths])
    return t.documents.select("doc_id", run(F.col("source"), F.col("text"), F.col("n_chars").cast("string"), F.lit(None).cast("string")).alias("score"))


@query("udf3_guarded", "SELECT doc_id, CASE WHEN doc_id % 1000 = 7 OR doc_id % 5 = 0 THEN NULL ELSE round(1.0 / (doc_id % 5), 6) END::DOUBLE AS score, CASE WHEN doc_id % 1000 = 7 THEN 'timeout' WHEN doc_id % 5 = 0 THEN 'error' END AS status FROM documents")
def _(t: Tables) -> DataFrame:
    """Rows that fail or take too long have a status and no score."""

    def f(source, response, truth, extra):
        x = int(truth)
        if x % 1000 == 7:
            time.sleep(30)
        if x % 5 == 0:
            raise ValueError("no score")
        return 1 / (x % 5)

    run = rewards.custom_reward(f, on_error="null", seconds=0.05)
    x = run(F.col("source"), F.lit(""), F.col("doc_id").cast("string"), F.lit(None).cast("string"))
    out = t.documents.select("doc_id", x.alias("x"))
    return out.select("doc_id", F.round("x.score", 6).alias("score"), F.when(F.col("x.status") == "timeout", "timeout").when(F.col("x.status").isNotNull(), "error").alias("status"))


@query("scr12_flat_status", "SELECT CASE WHEN doc_id % 4 = 3 THEN 'invalid_ground_truth' WHEN doc_id % 4 = 2 THEN 'missing_answer' WHEN doc_id % 4 = 1 THEN 'wrong_answer' ELSE 'ok' END AS status, CASE WHEN source = 'src1' THEN 'gsm8k' ELSE 'math' END AS source, count(*) AS n, avg((doc_id % 4 = 0)::INT)::DOUBLE AS acc, avg((doc_id % 4 <> 2)::INT)::DOUBLE AS extraction_ok FROM documents GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    r = F.when(k == 2, "nothing here").otherwise("\\boxed{8}")
    x = rewards.flat_status(F.col("source"), r, F.when(k == 3, "x+y").when(k == 1, "9").otherwise("8"), {"src1": "gsm8k"}, "math")
    rows = t.documents.select(x.alias("x")).select("x.*")
    return rows.groupBy("status", "source").agg(F.count("*").alias("n"), F.avg(F.col("acc")).alias("acc"), F.avg(F.col("extraction_ok").cast("int")).alias("extraction_ok"))


@query("scr10_passed_cases", "SELECT conv_id, round(avg((turn % 3 < 2)::INT), 6)::DOUBLE AS score FROM conversations GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The share of passed cases; running model-written code is out of scope, its verdicts come as rows."""
    from rolloom.operators.validation import fraction_of_cases

    return fraction_of_cases(t.conversations.withColumn("ok", F.col("turn") % 3 < 2), ["conv_id"], "ok").select("conv_id", F.round("score", 6).alias("score"))


@query("ver2_modes", expected(training=["ok", "missing_boxed_answer", "wrong_answer", "boxed_answer_parse_error", "ok"], evaluation=["ok", "ok", "wrong_answer", "answer_parse_error", "ok"]))
def _(t: Tables) -> DataFrame:
    rows = [("\\boxed{7} then \\boxed{x}",), ("The answer is 7",), ("\\boxed{8} and 7",), ("\\boxed{x}, 7",), ("\\boxed{6} \\boxed{7.0}",)]
    x = [answers.verify_mode_column(F.col("c0"), F.lit("7"), mode).alias(mode) for mode in ("training", "evaluation")]
    return laid_out(t, rows).select("doc_id", *x).select("doc_id", *[F.coalesce(F.col(m)["error"], F.lit("ok")).alias(m) for m in ("training", "evaluation")])


EXTRACTIONS = [
    ("so \\boxed{\\frac{1}{2}}", "boxed", "1/2"), ("\\boxed{3}\nThe answer is 1,200.", "explicit_final", "1200"), ("\\boxed{1} or \\boxed{2}", "ambiguous", None), ("no number", "missing", None), ("x = 5", "implicit_terminal", "5"), ("#### 7", "explicit_final", "7"),
    ("\\boxed{x}", "parse_error", None), ("Answer: 2\nAnswer: 3", "ambiguous", None), ("Answer: 2\nFinal answer is 2.0", "explicit_final", "2"), ("I saw 3 cats and 4 dogs.", "ambiguous", None), ("I saw 3 cats.", "missing", None), ("", "missing", None), ("$12$", "implicit_terminal", "12"),
    ("3/4", "implicit_terminal", "3/4"), ("it costs\n\\$1,234.50", "implicit_terminal", "2469/2"), ("25\\%", "implicit_terminal", "1/4"), ("\\boxed{4} and \\boxed{4.0}", "boxed", "4"), ("a = b = -8", "implicit_terminal", "-8"), ("\\boxed{5", "missing", None),
]


@query("ext1_statuses", expected(status=[c[1] for c in EXTRACTIONS], value=[c[2] for c in EXTRACTIONS]))
def _(t: Tables) -> DataFrame:
    return laid_out(t, EXTRACTIONS).select("doc_id", answers.extract_column(F.col("c0")).alias("x")).select("doc_id", "x.status", "x.value")


NUMBERS = [
    ("$0.5$", "1/2"), ("\\$1,200", "1200"), ("25\\%", "1/4"), ("-3.50", "-7/2"), ("1/3", "1/3"), ("\\frac{-2}{6}", "-1/3"), (".125", "1/8"), ("+7", "7"), ("1e5", None), ("1,20", None), ("2/0", None), ("10%", "1/10"), ("-\\frac{3}{4}", "-3/4"), ("1,234,567.25", "4938269/4"), ("\\(8\\)", "8"),
    ("- $5", "-5"), ("6 / 8", "3/4"), ("007", "7"), ("five", None),
]


@query("ext3_number_forms", expected(value=[c[1] for c in NUMBERS]))
def _(t: Tables) -> DataFrame:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if (n := answers.parse_number(v)) is None else str(n))

    return laid_out(t, NUMBERS).select("doc_id", run("c0").alias("value"))


BRACES = [("\\boxed{1} \\boxed{2}", "1|2"), ("\\boxed{\\frac{1}{2}}", "\\frac{1}{2}"), ("\\boxed{a\\boxed{b}c}", "b|a\\boxed{b}c"), ("\\boxed{open", ""), ("\\boxed{}", ""), ("x } \\boxed{{y}} }", "{y}"), ("\\boxed{1}\\boxed{", "1"), ("none", "")]


@query("ext4_nested_boxes", expected(boxes=[c[1] for c in BRACES]))
def _(t: Tables) -> DataFrame:
    return laid_out(t, BRACES).select("doc_id", F.array_join(text.boxed(F.col("c0")), "|").alias("boxes"))


ARITHMETIC = [("1+2*3", 7.0), ("2^3^2", 512.0), ("(1+1)*4", 8.0), ("8/4/2", 1.0), ("7/2", 3.5), ("1/0", None), ("abc", None), (".5+.5", 1.0), ("10-3-2", 5.0), ("2*(3+(4-1))", 12.0), ("", None), ("(1", None), ("2 3", None), ("-4+1", -3.0), ("2^(0-1)", 0.5)]


@query("nrm6_expressions", expected(value=[c[1] for c in ARITHMETIC]))
def _(t: Tables) -> DataFrame:
    from rolloom.functions import normalize

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([normalize.safe_arithmetic(v) for v in x], dtype="float64")

    return laid_out(t, ARITHMETIC).select("doc_id", F.nanvl(run("c0"), F.lit(None).cast("double")).alias("value"))


QUANTITIES = [("\\text{$5million}", "5*10^6"), ("7 3/4", "7+3/4"), ("1,000", "1000"), ("3.0", "3"), ("5 cm", "5"), ("90^\\circ", "90"), ("12 degrees", "12"), ("\\$50", "50"), ("2 billion", "2 *10^9"), ("0050", "50"), ("{4}", "4"), ("- 5", "-5"), ("X", "x"), ("-0", "0"), ("1,234.00", "1234")]


@query("nrm4_forms", expected(answer=[c[1] for c in QUANTITIES]))
def _(t: Tables) -> DataFrame:
    from rolloom.functions import normalize

    return laid_out(t, QUANTITIES).select("doc_id", normalize.plain_quantity(F.col("c0")).alias("answer"))


VERDICTS = [
    ("\\boxed{0.5}", "1/2", "ok"), ("\\boxed{3}", "4", "wrong_answer"), ("", "4", "missing_answer"), ("\\boxed{3}", "x", "invalid_ground_truth"), ("\\boxed{-2}", "-2.0", "ok"), ("\\boxed{1} \\boxed{2}", "1", "ambiguous_answer"), ("The answer is 1,200", "1200", "ok"), ("\\boxed{y}", "1", "answer_parse_error"),
    ("#### 50%", "0.5", "ok"), ("so 7", "7", "missing_answer"), ("= 7", "7", "ok"), ("\\boxed{1/3}", "0.3333", "wrong_answer"),
]


@query("ver1_errors", expected(error=[c[2] for c in VERDICTS]))
def _(t: Tables) -> DataFrame:
    return laid_out(t, VERDICTS).select("doc_id", F.coalesce(answers.verify_column(F.col("c0"), F.col("c1"))["error"], F.lit("ok")).alias("error"))


# (response, truth, correct, format, pred): an answer with pi is tried with pi and with 3.14
TRIPLES = [
    ("The answer is \\boxed{7}", "7", True, True, "7"), ("The answer is 6.28", "2\\pi", True, False, "6.28"), ("The answer is \\boxed{\\frac{2}{4}}", "\\frac{1}{2}", True, False, "\\frac{2}{4}"), ("The answer is 9", "8", False, False, "9"), ("Step 2: \\boxed{9}", "8", False, True, "9"), ("The answer is (1, 2)", "(1,2)", True, True, "(1, 2)"),
]


@query("scr5_pi_and_fractions", expected(correct=[c[2] for c in TRIPLES], format=[c[3] for c in TRIPLES], pred=[c[4] for c in TRIPLES]))
def _(t: Tables) -> DataFrame:
    return laid_out(t, TRIPLES).select("doc_id", answers.prime_score_column(F.col("c0"), F.col("c1")).alias("x")).select("doc_id", "x.correct", "x.format", "x.pred")


LINES = [("so\nAnswer: 12", "12", 1.0), ("Answer: 11\nanswer : 12", "12", 1.0), ("Answer: $\\frac12$", "\\frac{1}{2}", 1.0), ("no line 12", "12", -1.0), ("Answer: 1,000", "1000", 1.0), ("Answer: x=3", "3", 1.0), ("Answer: 12 dollars", "12", 1.0), ("Answer: 13", "12", -1.0), ("Answer: \\text{12}", "12", 1.0)]


@query("scr3_line_forms", expected(score=[c[2] for c in LINES]))
def _(t: Tables) -> DataFrame:
    from rolloom.functions import normalize

    return laid_out(t, LINES).select("doc_id", normalize.line_score(F.col("c0"), F.col("c1"))["score"].alias("score"))
