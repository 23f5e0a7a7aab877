"""Answer extraction, exact numbers and comparison that need a parser; used through Arrow UDFs.

Numbers are exact fractions and equality never goes through floats, except in the
tolerant comparer. Model text is parsed, never evaluated.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|[-+]?\.\d+"
PLAIN = re.compile(rf"(?:{NUMBER})\Z")
RATIO = re.compile(r"([-+]?\d+)\s*/\s*([-+]?\d+)\Z")
LATEX_RATIO = re.compile(r"([-+]?)\\[dt]?frac\{([-+]?\d+)\}\{([-+]?\d+)\}\Z")
WRAPS = (("\\(", "\\)"), ("\\[", "\\]"), ("$$", "$$"), ("$", "$"))
EXPLICIT = re.compile(r"(?:final answer|the answer|answer)\s*(?:is|:|=)\s*(.+?)\s*$|^\s*####\s*(.+?)\s*$", re.I | re.M)
LOOSE = re.compile(rf"(?<![\w.])(?:{NUMBER})(?:\s*/\s*\d+)?%?")


def parse_number(text: str | None, percent: str = "fraction") -> Fraction | None:
    """An exact number. percent: "fraction" divides by 100, "number" drops the sign, "reject" gives none."""
    if text is None:
        return None
    t = text.strip().rstrip(".").strip()
    for a, b in WRAPS:
        if t.startswith(a) and t.endswith(b) and len(t) > len(a) + len(b):
            t = t[len(a) : -len(b)].strip()
    t = t.replace("\\$", "$").replace("\\%", "%").replace("\\,", "").replace("\\!", "")
    is_percent = t.endswith("%")
    if is_percent:
        if percent == "reject":
            return None
        t = t[:-1].strip()
    t = re.sub(r"^([-+]?)\s*\$\s*", r"\1", t)
    try:
        if m := LATEX_RATIO.match(t):
            value = Fraction(int(m[2]), int(m[3])) * (-1 if m[1] == "-" else 1)
        elif m := RATIO.match(t):
            value = Fraction(int(m[1]), int(m[2]))
        elif PLAIN.match(t):
            value = Fraction(t.replace(",", ""))
        else:
            return None
    except ZeroDivisionError:
        return None
    return value / 100 if is_percent and percent == "fraction" else value


def boxed_contents(text: str, unterminated: bool = False) -> list[str]:
    """Balanced boxed groups in order of their end; with ``unterminated`` also the tail of an open one."""
    out, at = [], 0
    while (at := text.find("\\boxed{", at)) >= 0:
        start = i = at + 7
        depth = 1
        while i < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        if not depth:
            out.append((i, text[start : i - 1]))
        elif unterminated:
            out.append((i, text[start:]))
        at = start
    return [x for _, x in sorted(out, key=lambda p: p[0])]


def last_boxed(text: str) -> str | None:
    """Contents of the last boxed or framed group, or of "\\boxed x"."""
    found = boxed_contents(text.replace("\\fbox{", "\\boxed{"))
    if found:
        return found[-1]
    m = re.findall(r"\\boxed\s+([^\s$]+)", text)
    return m[-1] if m else None


def extract(response: str | None, percent: str = "fraction") -> dict:
    """status, answer and canonical value. Explicit lines go before boxes, boxes before the last line.

    Different values in a tier are ambiguous; numbers elsewhere are not an answer.
    """
    response = response or ""
    tiers = (
        ("explicit_final", [m[1] or m[2] for m in EXPLICIT.finditer(response)]),
        ("boxed", boxed_contents(response)),
        ("implicit_terminal", [x.rpartition("=")[2] for x in [response.strip().rpartition("\n")[2]] if x]),
    )
    broken = False
    for status, found in tiers:
        values = [(v, c) for c in found if (v := parse_number(c, percent)) is not None]
        broken |= bool(found) and not values and status != "implicit_terminal"
        if len({v for v, _ in values}) > 1:
            return {"status": "ambiguous", "answer": None, "value": None}
        if values:
            return {"status": status, "answer": values[-1][1].strip(), "value": str(values[-1][0])}
    if broken:
        return {"status": "parse_error", "answer": None, "value": None}
    numbers = {parse_number(x, percent) for x in LOOSE.findall(response)}
    return {"status": "ambiguous" if len(numbers) > 1 else "missing", "answer": None, "value": None}


def verify(response: str | None, truth: str | None, percent: str = "fraction") -> dict:
    """extract() with correct and error: exact equality of fractions."""
    gold = parse_number(truth, percent)
    got = extract(response, percent)
    error = (
        "invalid_ground_truth" if gold is None else
        {"ambiguous": "ambiguous_answer", "missing": "missing_answer", "parse_error": "answer_parse_error"}.get(got["status"]) or (None if got["value"] == str(gold) else "wrong_answer"))
    return got | {"correct": error is None, "error": error}


def verify_mode(response: str | None, truth: str | None, mode: str = "evaluation") -> dict:
    """As verify(), by the last box that holds a number. Training takes boxes only; evaluation falls back to free text
    (explicit lines, then the last number) where no box holds anything."""
    if mode not in ("evaluation", "training"):
        raise ValueError("mode must be evaluation or training")
    response = response or ""
    boxes = boxed_contents(response)
    got = next(({"status": "boxed", "answer": c.strip(), "value": str(v)} for c in reversed(boxes) if (v := parse_number(c)) is not None), None)
    if got is None and mode == "evaluation" and not any(c.strip() for c in boxes):
        found = LOOSE.findall(response) + [m[1] or m[2] for m in EXPLICIT.finditer(response)]
        got = next(({"status": "explicit_final", "answer": c.strip(), "value": str(v)} for c in reversed(found) if (v := parse_number(c)) is not None), None)
    if got is None:
        broken = any(c.strip() for c in boxes) if mode == "evaluation" else bool(boxes)
        got = {"status": "parse_error" if broken else "missing", "answer": None, "value": None}
    gold, kind = parse_number(truth), "boxed_" if mode == "training" else ""
    error = (
        "invalid_ground_truth" if gold is None else
        {"missing": f"missing_{kind}answer", "parse_error": f"{kind}answer_parse_error"}.get(got["status"]) or (None if got["value"] == str(gold) else "wrong_answer"))
    return got | {"correct": error is None, "error": error}


def mathd_form(x: str | None) -> str | None:
    """The mathd normal form: unlike tidy_latex it keeps "$", "%" and text other than units, and fractions stay where they cannot be read."""
    if x is None:
        return None
    x = x.strip()
    if m := re.search(r"^\\text\{(.+?)\}$", x):
        x = m[1].strip()
    whole = x
    x = x.replace("\n", "").replace("\\!", "").replace("\\\\", "\\").replace("tfrac", "frac").replace("dfrac", "frac")
    for drop in ("\\left", "\\right", "^{\\circ}", "^\\circ", "\\$"):
        x = x.replace(drop, "")
    head, *units = x.split("\\text{ ")
    if len(units) > 1:
        return whole
    x = (head if units else x).replace("\\\\%", "").replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    if not x:
        return x
    x = "0" + x if x[0] == "." else x
    if x.count("=") == 1 and len(x.split("=")[0]) <= 2:
        x = x.split("=")[1]
    head, *roots = x.split("\\sqrt")
    if "" in roots:
        return whole
    x = (head + "".join("\\sqrt" + (r if r[0] == "{" else "{" + r[0] + "}" + r[1:]) for r in roots)).replace(" ", "")
    head, *fractions = x.split("\\frac")
    if "" in fractions and all(len(f) > 1 or f == "" or f[0] == "{" for f in fractions[: fractions.index("")]):
        return whole
    if all(f and (f[0] == "{" or len(f) >= 2) for f in fractions):
        x = head + "".join("\\frac" + (f if f[0] == "{" else "{" + f[0] + "}" + (f[1:] if f[1] == "{" else "{" + f[1] + "}" + f[2:])) for f in fractions)
    if x == "0.5":
        return "\\frac{1}{2}"
    if (m := re.fullmatch(r"(-?\d+)/(-?\d+)", x)) and x == f"{int(m[1])}/{int(m[2])}":
        return f"\\frac{{{m[1]}}}{{{m[2]}}}"
    return x


def _with_pi(x: str, pi: str) -> float | None:
    """Value of an expression with pi put in; null where it is not arithmetic."""
    from rolloom.functions.normalize import safe_arithmetic

    x = re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", x.replace("$", "").replace("\\left", "").replace("\\right", "").replace("\\cdot", "*").replace("\\times", "*"))
    x = re.sub(r"\\pi(?![A-Za-z])", pi, re.sub(r"(?<=[\d)])\s*\\pi(?![A-Za-z])", r"*\\pi", x))
    return safe_arithmetic(x.replace("{", "(").replace("}", ")").replace(",", ""))


def prime_score(response: str | None, truth: str | None) -> dict:
    """correct, format and pred. An answer that is equal as it stands counts as well formed; an answer or truth with pi is retried with pi and with 3.14."""
    from rolloom.functions.normalize import marked_answer

    response, truth = response or "", truth or ""
    pred = marked_answer(response)[1]
    # Two different fractions are not the same as they stand, though their values may be.
    as_ratio = [x for x in map(tidy_latex, (pred, truth)) if LATEX_RATIO.match(x)]
    if mathd_form(pred) == mathd_form(truth) or (equal(pred, truth, tolerance=0, percents=False) == "equal" and (len(as_ratio) < 2 or as_ratio[0] == as_ratio[1])):
        return {"correct": True, "format": True, "pred": pred}
    if "\\pi" in pred + truth:
        pairs = [(_with_pi(pred, pi), _with_pi(truth, pi)) for pi in (repr(math.pi), "3.14")]
        right = any(p is not None and q is not None and any(math.isclose(p, q * f, rel_tol=1e-4) for f in (0.01, 1, 100)) for p, q in pairs)
    else:
        right = equal(pred, truth) == "equal"
    return {"correct": right, "format": "Step 2:" in response and "\\box" in response, "pred": pred}


def tidy_latex(x: str) -> str:
    """One spelling for common variants of short LaTeX answers."""
    x = x.replace("\n", "").replace("\\!", "").replace("\\\\", "\\").replace("tfrac", "frac").replace("dfrac", "frac")
    for drop in ("\\left", "\\right", "^{\\circ}", "^\\circ", "\\$", "\\%", "%", "$"):
        x = x.replace(drop, "")
    x = re.sub(r"\\text\{\s*[^}]*\}\s*$", "", x).replace(" .", " 0.").replace("{.", "{0.")
    x = "0" + x if x.startswith(".") else x
    if x.count("=") == 1 and len(x.split("=")[0].strip()) <= 2:
        x = x.split("=")[1]
    x = re.sub(r"\\sqrt\s*([^\s{\\])", r"\\sqrt{\1}", x).replace(" ", "")
    x = re.sub(r"\\frac([^{\s])([^{\s])", r"\\frac{\1}{\2}", x)
    x = re.sub(r"\\frac(\{[^{}]*\})([^{\s])", r"\\frac\1{\2}", x)
    x = re.sub(r"\\frac([^{\s])(\{)", r"\\frac{\1}\2", x)
    if x == "0.5":
        return "\\frac{1}{2}"
    return re.sub(r"^(-?\d+)/(\d+)$", r"\\frac{\1}{\2}", x)


def box_score(response: str | None, truth: str | None) -> float:
    """1 if the last box and the truth have one spelling, else 0."""
    box = last_boxed(response or "")
    return float(box is not None and truth is not None and tidy_latex(box) == tidy_latex(truth))


def grade(given: str | None, truth: str | None) -> bool:
    """Equal spellings; or, part by part of equal brackets: fractions as they stand, whole numbers only to whole numbers, all else by value."""
    from rolloom.functions.symbolic import compare

    if given is None or truth is None:
        return False
    if mathd_form(given) == mathd_form(truth) or tidy_latex(given) == tidy_latex(truth):
        return True
    a, b = tidy_latex(given).replace(" ", ""), tidy_latex(truth).replace(" ", "")
    a, b = (re.sub(r"(\d),(?=\d{3}(?:\D|$))", r"\1", x) for x in (a, b))
    if not a or not b:
        return False
    flat = lambda x: len(x) > 2 and x[0] in "([" and x[-1] in ")]" and not set(x[1:-1]) & set("()[]")
    p, q = (x[1:-1].split(",") if flat(x) else [x] for x in (a, b))
    if len(p) != len(q) or (len(q) > 1 and (a[0], a[-1]) != (b[0], b[-1])):
        return False
    whole = lambda x: bool(re.fullmatch(r"-?\d+(?:\.0*)?", x))
    for x, y in zip(p, q, strict=True):
        if LATEX_RATIO.match(x) and LATEX_RATIO.match(y):
            if x != y:
                return False
        elif whole(x) != whole(y) or compare(y, x, tolerance=0) != "equal":
            return False
    return True


def _members(x: str) -> tuple[str, list[str], str] | None:
    """Brackets and members of a tuple, set or interval."""
    x = x.strip().replace("\\{", "{").replace("\\}", "}")
    if len(x) < 2 or x[0] not in "([{" or x[-1] not in ")]}":
        return None
    out, depth, last = [], 0, 1
    for i, c in enumerate(x[1:-1], 1):
        depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(x[last:i])
            last = i + 1
    return x[0], [*out, x[last:-1]], x[-1]


def equal(a: str | None, b: str | None, tolerance: float = 1e-4, percents: bool = True) -> str:
    """"equal", "different" or "unsupported": strings, numbers (also times or over 100), tuples, intervals and sets.

    What this cannot decide is unsupported, never silently wrong.
    """
    if a is None or b is None:
        return "different"
    raw = a, b
    a, b = tidy_latex(a), tidy_latex(b)
    if a == b:
        return "equal"
    x, y = parse_number(a, "number"), parse_number(b, "number")
    if x is not None and y is not None:
        near = lambda p, q: abs(p - q) <= tolerance * max(abs(p), abs(q))
        return "equal" if any(near(x, y * f) for f in ((1, Fraction(1, 100), 100) if percents else (1,))) else "different"
    p, q = _members(a), _members(b)
    if p and q and len(p[1]) > 1:
        if p[0] != q[0] or p[2] != q[2] or len(p[1]) != len(q[1]):
            return "different"
        if p[0] == "{":
            left = list(q[1])
            for m in p[1]:
                hit = next((i for i, o in enumerate(left) if equal(m, o, tolerance, percents) == "equal"), None)
                if hit is None:
                    return "different"
                left.pop(hit)
            return "equal"
        states = [equal(m, o, tolerance, percents) for m, o in zip(p[1], q[1], strict=True)]
        return "different" if "different" in states else "unsupported" if "unsupported" in states else "equal"
    from rolloom.functions.symbolic import compare

    return compare(*raw, tolerance)


def extract_column(response: Column, percent: str = "fraction") -> Column:
    """Struct status, answer, value of a text column."""

    @F.pandas_udf("status string, answer string, value string")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(v, percent) for v in x], columns=["status", "answer", "value"])

    return run(response)


def verify_column(response: Column, truth: Column, percent: str = "fraction") -> Column:
    """Struct status, answer, value, correct, error."""

    @F.pandas_udf("status string, answer string, value string, correct boolean, error string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verify(a, b, percent) for a, b in zip(x, y, strict=True)], columns=["status", "answer", "value", "correct", "error"])

    return run(response, truth)


def verify_mode_column(response: Column, truth: Column, mode: str = "evaluation") -> Column:
    """Struct status, answer, value, correct, error."""

    @F.pandas_udf("status string, answer string, value string, correct boolean, error string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verify_mode(a, b, mode) for a, b in zip(x, y, strict=True)], columns=["status", "answer", "value", "correct", "error"])

    return run(response, truth)


def prime_score_column(response: Column, truth: Column) -> Column:
    """Struct correct, format, pred."""

    @F.pandas_udf("correct boolean, format boolean, pred string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([prime_score(a, b) for a, b in zip(x, y, strict=True)], columns=["correct", "format", "pred"])

    return run(response, truth)


def equal_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([equal(p, q) for p, q in zip(x, y, strict=True)], dtype="object")

    return run(a, b)


def name_overlap(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two arrays of names; 1 for two empty ones."""
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, n: s + F.least(F.size(F.filter(a, lambda x: x == n)), F.size(F.filter(b, lambda x: x == n))))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def box_score_column(response: Column, truth: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([box_score(a, b) for a, b in zip(x, y, strict=True)], dtype="float64")

    return run(response, truth)


def grade_column(given: Column, truth: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([grade(a, b) for a, b in zip(x, y, strict=True)], dtype="object")

    return run(given, truth)


def candidates(response: str | None, percent: str = "fraction") -> list[dict]:
    """Every candidate of an answer (tier, text, value, start), each place once, in the order of the text."""
    response = response or ""
    found = [(m.start(1) if m[1] else m.start(2), "explicit_final", m[1] or m[2]) for m in EXPLICIT.finditer(response)]
    at = 0
    for box in sorted(boxed_contents(response), key=response.find):
        start = response.find("\\boxed{" + box + "}", at)
        found.append((start + 7, "boxed", box))
        at = start + 1
    last = response.rstrip().rpartition("\n")[2]
    if last:
        tail = last.rpartition("=")[2]
        found.append((len(response.rstrip()) - len(tail), "implicit_terminal", tail))
    out, seen = [], set()
    for start, tier, text in sorted(found, key=lambda x: x[0]):
        value = parse_number(text, percent)
        if value is not None and (start, str(value)) not in seen:
            seen.add((start, str(value)))
            out.append({"tier": tier, "text": text.strip(), "value": str(value), "start": start})
    return out


def candidates_column(response: Column) -> Column:
    @F.pandas_udf("array<struct<tier:string,text:string,value:string,start:int>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([candidates(v) for v in x], dtype="object")

    return run(response)
