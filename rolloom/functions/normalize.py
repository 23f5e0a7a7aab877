"""Normal forms of final answers, as built-in expressions, and marker-based extraction."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Pairs replaced in this order, then expressions removed in this order.
REPLACED = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges",
    "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
)
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
BEFORE = ("answer:", "answer is", "answers are")
AFTER = ("is answer", "is the answer", "are answers", "are the answers")
LEADS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")

#: Patterns and replacements in Java's dialect, applied after the tables.
SHORTHAND = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"), (r"(\\overline\{)(.*?)(\})", "$2"), (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", r"frac{$2}{$3}"), (r"(sqrt)([^{])", r"sqrt{$2}"),
)


def final_answer(x: Column) -> Column:
    """The part after the last "=", without units and wrappers, with full fractions and roots and plain digits."""
    x = F.element_at(F.split(x, "=", -1), -1)
    x = reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), REPLACED, x)
    x = reduce(lambda a, w: F.replace(a, F.lit(w), F.lit("")), REMOVED, x)
    x = reduce(lambda a, p: F.regexp_replace(a, p[0], p[1]), SHORTHAND, x)
    x = F.replace(x, F.lit("$"), F.lit(""))
    bare = F.replace(x, F.lit(","), F.lit(""))
    return F.regexp_replace(F.when(bare.rlike(r"^[0-9]+$"), bare).otherwise(x), r"^\s+|\s+$", "")


def line_answer(response: Column, last: int = 300) -> Column:
    """Normal form of the last "Answer: ..." line within the last characters."""
    found = F.regexp_extract_all(F.right(response, F.lit(last)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return final_answer(F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise("[INVALID]"))


def line_score(response: Column, truth: Column) -> Column:
    """Struct score (1 or -1), acc and pred."""
    pred = line_answer(response)
    right = pred == final_answer(truth)
    return F.struct(F.when(right, 1.0).otherwise(-1.0).alias("score"), right.alias("acc"), pred.alias("pred"))


def plain_quantity(x: Column) -> Column:
    """Without units, currency and wrapping text; thousands joined; powers of ten for million and on; lower case."""
    x = F.regexp_replace(x, r"^\\text\{(.+?)\}$", "$1")
    for a, b in (("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = reduce(lambda a, u: F.regexp_replace(a, rf"{u}(es)?(s)? *(\^[0-9]+)?", ""), UNITS, x)
    x = F.regexp_replace(F.regexp_replace(x, r"\^ *\\circ", ""), r"^\{(.*)\}$", "$1")
    x = F.regexp_replace(F.regexp_replace(x, r",\\! *", ""), r"^(-?\d+)\.0+$", "$1")
    x = F.regexp_replace(F.regexp_replace(x, "- *", "-"), r"([0-9]) +([0-9])", "$1+$2")
    x = F.lower(x)
    # Whole numbers in plain form: no thousands, plus sign, zeros in front or after the point.
    whole = F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"^\s*\+?(-?)0*(\d+)(\.0*)?\s*$", 1)
    digits = F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"^\s*[+-]?0*(\d+)(\.0*)?\s*$", 1)
    return F.when(x.rlike(r"^\s*[+-]?\d+(,\d{3})*(\.0*)?\s*$"), F.when(digits == "0", "0").otherwise(F.concat(whole, digits))).otherwise(x)


def _cut(text: str, markers: tuple[str, ...], keep_left: bool = False) -> tuple[str, bool]:
    """What stands right (or left) of the last occurrence of each marker in turn."""
    hit = False
    for m in markers:
        at = text.lower().rfind(m)
        if at >= 0:
            hit, text = True, (text[:at] if keep_left else text[at + len(m) :]).strip()
    return text, hit


def marked_answer(response: str | None) -> tuple[bool, str]:
    """Whether an answer is marked, and the answer: markers, the last box, the first sentence, then leading verbs. It must hold a digit."""
    from rolloom.functions.answers import last_boxed

    text, a = _cut(response or "", BEFORE)
    text, b = _cut(text, AFTER, keep_left=True)
    box = last_boxed(text)
    text = (box if box is not None else text).rpartition(". ")[0].strip() or (box if box is not None else text)
    text, c = _cut(text, LEADS)
    return (a or b or c or box is not None) and any(x.isdigit() for x in text), text


def marked_answer_column(response: Column) -> Column:
    @F.pandas_udf("matched boolean, answer string")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([marked_answer(v) for v in x], columns=["matched", "answer"])

    return run(response)


def safe_arithmetic(text: str) -> float | None:
    """Value of + - * / ^ and brackets over numbers; nothing else is evaluated."""
    tokens = re.findall(r"\d+\.?\d*|\.\d+|[-+*/^()]", text)
    if "".join(tokens) != re.sub(r"\s", "", text) or not tokens:
        return None
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def unit() -> float:
        nonlocal at
        t = peek()
        at += 1
        if t == "(":
            v = chain(0)
            if peek() != ")":
                raise ValueError
            at += 1
            return v
        return -unit() if t == "-" else unit() if t == "+" else float(t)

    def chain(level: int) -> float:
        nonlocal at
        if level == 3:
            return unit()
        v = chain(level + 1)
        while peek() and peek() in ("+-", "*/", "^")[level]:
            op = peek()
            at += 1
            w = chain(level) if op == "^" else chain(level + 1)
            v = {"+": lambda: v + w, "-": lambda: v - w, "*": lambda: v * w, "/": lambda: v / w, "^": lambda: v**w}[op]()
        return v

    try:
        v = chain(0)
        return float(v) if at == len(tokens) else None
    except (ValueError, ZeroDivisionError, OverflowError, IndexError):
        return None
