"""Text functions of answer extraction, normalisation and scoring, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARTICLES = r"\b(a|an|the)\b"


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def hash_answer(response: Column, last: int = 300) -> Column:
    """The last "#### number" within the last characters, without commas and dollars; null if none."""
    found = F.regexp_extract_all(F.right(response, F.lit(last)), F.lit(r"#### (\-?[0-9\.\,]+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.translate(F.element_at(found, -1), ",$", ""))


def last_number(response: Column, last: int = 300) -> Column:
    """The last number-like piece that is not "." or empty; if all are, the first; null if none."""
    found = F.regexp_extract_all(F.right(response, F.lit(last)), F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
    good = F.filter(found, lambda x: ~x.isin("", "."))
    return F.when(F.size(good) > 0, F.element_at(good, -1)).when(F.size(found) > 0, F.element_at(found, 1))


def sampled_case(response: Column, truth: Column, last: int = 400) -> Column:
    """Struct strict, flexible (last number after "####", last number, without commas; null if none), strict_correct, flexible_correct and format_error."""
    number = r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)"
    tail = F.right(response, F.lit(last))

    def final(pattern: str) -> Column:
        found = F.regexp_extract_all(tail, F.lit(pattern), F.lit(1))
        return F.when(F.size(found) > 0, F.replace(F.element_at(found, -1), F.lit(","), F.lit("")))

    # White space as Python has it, no-break and other wide spaces included.
    strict, flexible, gold = final(r"(?U)####[\s\x1c-\x1f]*" + number), final(number), stripped(F.replace(truth, F.lit(","), F.lit("")))
    same = lambda x: F.coalesce(x == gold, F.lit(False))
    return F.struct(strict.alias("strict"), flexible.alias("flexible"), same(strict).alias("strict_correct"), same(flexible).alias("flexible_correct"), strict.isNull().alias("format_error"))


def case_rates(case: Column) -> list[Column]:
    """The sampler's three rates over structs of ``sampled_case``."""
    return [F.avg(case[x].cast("int")).alias(name) for x, name in (("strict_correct", "strict_accuracy"), ("flexible_correct", "flexible_accuracy"), ("format_error", "format_error_rate"))]


def tagged_answer(response: Column, tag: str = "answer") -> Column:
    found = F.regexp_extract_all(response, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.when(F.size(found) > 0, stripped(F.element_at(found, -1)))


def boxed(response: Column) -> Column:
    """Contents of every balanced boxed group, in order; unterminated ones are dropped.

    A state machine over the pieces between braces: no Python, one pass.
    """
    parts = F.split(F.regexp_replace(response, r"(\\boxed\{|[{}])", "\u0001$1\u0001"), "\u0001", -1)
    state = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<at:int,text:string>>").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(s, p):
        opens, closes = (p == "\\boxed{") | (p == "{"), p == "}"
        grown = F.transform(s["open"], lambda o: F.struct(o["at"].alias("at"), F.concat(o["text"], p).alias("text")))
        top = F.try_element_at(s["open"], F.lit(-1))
        done = closes & top.isNotNull() & (top["at"] == s["depth"])
        depth = F.when(opens, s["depth"] + 1).when(closes, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        still = F.when(p == "\\boxed{", F.concat(grown, F.array(F.struct((s["depth"] + 1).alias("at"), F.lit("").alias("text")))))
        still = still.when(done, F.slice(grown, 1, F.greatest(F.size(grown) - 1, F.lit(0)))).otherwise(grown)
        return F.struct(depth.alias("depth"), still.alias("open"), F.when(done, F.concat(s["out"], F.array(top["text"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(parts, state, step, lambda s: s["out"])


def normalized_answer(x: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    x = F.regexp_replace(F.lower(x), r"\p{Punct}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, ARTICLES, " "), r"\s+", " "))


def exact_match(prediction: Column, golds: Column) -> Column:
    p = normalized_answer(prediction)
    return F.when(F.exists(golds, lambda g: normalized_answer(g) == p), 1.0).otherwise(0.0)


def substring_match(prediction: Column, golds: Column) -> Column:
    p = normalized_answer(prediction)
    return F.when(F.exists(golds, lambda g: F.contains(p, normalized_answer(g))), 1.0).otherwise(0.0)


def qa_score(response: Column, golds: Column, substring: bool = False, format_score: float = 0.0, score: float = 1.0) -> Column:
    """Score of the last tagged answer. Without a tag 0; an exact match with more than ten opening or closing tags counts a quarter."""
    answer = tagged_answer(response)
    right = (substring_match if substring else exact_match)(answer, golds) == 1.0
    many = (F.regexp_count(response, F.lit("<answer>")) > 10) | (F.regexp_count(response, F.lit("</answer>")) > 10)
    full = F.lit(score) if substring else F.when(many, score / 4).otherwise(score)
    return F.when(answer.isNull(), 0.0).when(right, full).otherwise(format_score)


def capitalized(x: Column) -> Column:
    """The first character in upper case, all others in lower case."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def unmarked(x: Column) -> Column:
    """Without title marks and bracketed parts; double blanks become one, once."""
    x = F.replace(x, F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(x, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def content_parts(x: Column, media: dict[str, Column]) -> tuple[Column, Column]:
    """A text as parts (type, value): texts, and for each <kind> the next of that kind's media; and whether each kind's media are all used, no more and no fewer."""
    kinds = "|".join(media)
    parts = F.filter(F.split(F.regexp_replace(x, f"(<(?:{kinds})>)", "\u0001$1\u0001"), "\u0001", -1), lambda p: p != "")
    start = F.struct(*[F.lit(0).alias(k) for k in media], F.array().cast("array<struct<type:string,value:string>>").alias("out"))

    def step(s, p):
        part = F.struct(F.lit("text").alias("type"), p.alias("value"))
        for k, values in media.items():
            part = F.when(p == f"<{k}>", F.struct(F.lit(k).alias("type"), F.get(values, s[k]).alias("value"))).otherwise(part)
        return F.struct(*[(s[k] + F.when(p == f"<{k}>", 1).otherwise(0)).alias(k) for k in media], F.concat(s["out"], F.array(part)).alias("out"))

    fits = F.lit(True)
    for k, values in media.items():
        fits = fits & (F.regexp_count(x, F.lit(f"<{k}>")) == F.size(values))
    return F.aggregate(parts, start, step, lambda s: s["out"]), fits


def words(x: Column) -> Column:
    """Number of white-space separated words; 0 for a blank text."""
    return F.when(stripped(x) == "", 0).otherwise(F.size(F.split(stripped(x), r"\s+")))


def metric_key(x: Column) -> Column:
    """Keys that trackers accept: @ becomes _at_, slashes collapse, other characters become _."""
    x = F.regexp_replace(F.replace(x, F.lit("@"), F.lit("_at_")), "/+", "/")
    return F.regexp_replace(x, r"[^A-Za-z0-9_\-. :/]", "_")


def flatten_map(prefix: str, *names: str) -> list[Column]:
    """Columns under path-like names, as parameters of a run."""
    return [F.col(n).alias(f"{prefix}/{n}") for n in names]


def overlong_penalty(length: Column, max_length: int, buffer: int, factor: float) -> Column:
    """0 up to the buffer's start, then falling to -factor and beyond."""
    return F.least(-(length - (max_length - buffer)) / buffer * factor, F.lit(0.0))


def reward(correct: Column, format_ok: Column, tokens: Column, correctness: float = 1.0, form: float = 0.1, penalty: float = 0.001) -> Column:
    return F.when(correct, correctness).otherwise(0.0) + F.when(format_ok, form).otherwise(0.0) - penalty * tokens


def finish_reason(hit_max: Column) -> Column:
    return F.when(hit_max, "length").otherwise("eos")
