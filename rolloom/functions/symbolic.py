r"""Symbolic reading and comparison of short LaTeX answers, without an algebra library.

An answer is read into one of a few kinds: an expression, a list of them in brackets
(tuple, interval, set, matrix rows), a union, a relation or plain text. Expressions are
exact rational functions over atoms: letters, ``\pi``, ``e``, ``i``, roots of squarefree
numbers, and functions or powers that do not reduce, each known by the canonical form of its
arguments. Two expressions are equal if the difference of their cross products is the
zero polynomial; where atoms of functions or powers take part, also if both have the same value
at fixed points. What cannot be read is ``unsupported``, never silently wrong.

Work is bounded by ``LIMIT`` terms; beyond, an answer is unsupported as well.
"""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rolloom.functions.guard import within

LIMIT = 4000
TOKEN = re.compile(r"\\[A-Za-z]+|\\[{}|]|\d+(?:\.\d+)?|\.\d+|[A-Za-z]|<=|>=|!=|[-+*/^=<>(){}\[\],|!_%:]")
DROPPED = ("\\left", "\\right", "\\big", "\\Big", "\\displaystyle", "\\,", "\\;", "\\!", "\\:", "\\ ", "\\quad", "$", "^{\\circ}", "^\\circ", "^{\\prime}", "~")
RENAMED = {
    "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cfrac": "\\frac", "\\cdot": "*", "\\times": "*", "\\ast": "*", "\\div": "/", "\\leq": "<=", "\\le": "<=", "\\leqslant": "<=", "\\geq": ">=", "\\ge": ">=", "\\geqslant": ">=",
    "\\lt": "<", "\\gt": ">", "\\ne": "!=", "\\neq": "!=", "\\{": "{{", "\\}": "}}", "\\lbrace": "{{", "\\rbrace": "}}", "\\vert": "|", "\\lvert": "|", "\\rvert": "|",
}
FUNCTIONS: dict[str, Callable[[complex], complex]] = {
    "\\sin": cmath.sin, "\\cos": cmath.cos, "\\tan": cmath.tan, "\\cot": lambda x: 1 / cmath.tan(x), "\\sec": lambda x: 1 / cmath.cos(x), "\\csc": lambda x: 1 / cmath.sin(x), "\\arcsin": cmath.asin, "\\arccos": cmath.acos,
    "\\arctan": cmath.atan, "\\sinh": cmath.sinh, "\\cosh": cmath.cosh, "\\tanh": cmath.tanh, "\\ln": cmath.log, "\\exp": cmath.exp, "abs": abs, "root": cmath.sqrt,
}
GREEK = {"\\" + x for x in "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega".split()}
RELATIONS = ("=", "<=", ">=", "!=", "<", ">")
MIRROR = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


class Unsupported(ValueError):
    """What the reader does not know."""


# Polynomials: {monomial: coefficient}; a monomial is a sorted tuple of (atom, exponent).
Poly = dict


def _clean(p: Poly) -> Poly:
    if len(p) > LIMIT:
        raise Unsupported("too many terms")
    return {m: c for m, c in p.items() if c}


def _add(a: Poly, b: Poly, sign: int = 1) -> Poly:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, Fraction(0)) + sign * c
    return _clean(out)


def _reduced(monomial: dict) -> tuple[tuple, Fraction]:
    """Squares of roots and of i become numbers."""
    factor, out = Fraction(1), {}
    for atom, e in monomial.items():
        if atom == ("i",):
            factor *= -1 if e % 4 in (2, 3) else 1
            e %= 2
        elif atom[0] == "sqrt" and isinstance(atom[1], int):
            factor *= Fraction(atom[1]) ** (e // 2)
            e %= 2
        if e:
            out[atom] = e
    return tuple(sorted(out.items(), key=repr)), factor


def _mul(a: Poly, b: Poly) -> Poly:
    if len(a) * len(b) > LIMIT * 10:
        raise Unsupported("too many terms")
    out: Poly = {}
    for m, c in a.items():
        for n, d in b.items():
            both = dict(m)
            for atom, e in n:
                both[atom] = both.get(atom, 0) + e
            # Two different roots of numbers make one.
            roots = [x for x in both if x[0] == "sqrt" and isinstance(x[1], int) and both[x] % 2]
            factor = Fraction(1)
            if len(roots) > 1:
                product = math.prod(x[1] for x in roots)
                for x in roots:
                    both[x] -= 1
                k, rest = _square_part(product)
                factor *= k
                if rest != 1:
                    both[("sqrt", rest)] = both.get(("sqrt", rest), 0) + 1
            key, f = _reduced(both)
            out[key] = out.get(key, Fraction(0)) + c * d * factor * f
    return _clean(out)


def _square_part(n: int) -> tuple[int, int]:
    k, d = 1, 2
    while d * d <= n and d < 10_000:
        while n % (d * d) == 0:
            n //= d * d
            k *= d
        d += 1
    return k, n


def _number(x: Fraction | int) -> tuple[Poly, Poly]:
    return ({(): Fraction(x)} if x else {}), {(): Fraction(1)}


def _atom(*name) -> tuple[Poly, Poly]:
    return {((name, 1),): Fraction(1)}, {(): Fraction(1)}


Ratio = tuple  # (numerator, denominator)


def _plus(a: Ratio, b: Ratio, sign: int = 1) -> Ratio:
    if a[1] == b[1]:
        return _add(a[0], b[0], sign), a[1]
    return _add(_mul(a[0], b[1]), _mul(b[0], a[1]), sign), _mul(a[1], b[1])


def _times(a: Ratio, b: Ratio) -> Ratio:
    return _mul(a[0], b[0]), _mul(a[1], b[1])


def _over(a: Ratio, b: Ratio) -> Ratio:
    if not b[0]:
        raise Unsupported("division by zero")
    return _mul(a[0], b[1]), _mul(a[1], b[0])


def _constant(a: Ratio) -> Fraction | None:
    if set(a[0]) <= {()} and set(a[1]) == {()}:
        return a[0].get((), Fraction(0)) / a[1][()]
    return None


def _canonical(a: Ratio) -> tuple:
    """A hashable form: denominators that are numbers are divided out."""
    if set(a[1]) == {()}:
        a = ({m: c / a[1][()] for m, c in a[0].items()}, {(): Fraction(1)})
    return tuple(tuple(sorted(p.items(), key=repr)) for p in a)


def _root(a: Ratio, n: int = 2) -> Ratio:
    c = _constant(a)
    if c is not None and n == 2:
        k, rest = _square_part(abs(c.numerator) * c.denominator)
        out = _number(Fraction(k, c.denominator))
        if rest != 1:
            out = _times(out, _atom("sqrt", rest))
        return _times(out, _atom("i")) if c < 0 else out
    if c is not None:
        sign = -1 if c < 0 and n % 2 else 1
        top, low = (round(abs(x) ** (1 / n)) for x in (c.numerator, c.denominator))
        if (c >= 0 or n % 2) and top**n == abs(c.numerator) and low**n == c.denominator:
            return _number(Fraction(sign * top, low))
    return _atom("root", n, _canonical(a))


def _power(a: Ratio, b: Ratio) -> Ratio:
    e = _constant(b)
    if e is not None and e.denominator == 1 and abs(e) <= 40:
        out, base = _number(1), a if e >= 0 else _over(_number(1), a)
        for _ in range(abs(int(e))):
            out = _times(out, base)
        return out
    if e is not None and e.denominator in (2, 3, 4) and abs(e.numerator) <= 40:
        return _power(_root(a, e.denominator), _number(e.numerator))
    return _atom("power", _canonical(a), _canonical(b))


def value(a: Ratio, letters: dict[str, complex]) -> complex:
    """The number that an expression has, given its letters."""

    def of_atom(atom) -> complex:
        kind = atom[0]
        if kind == "letter":
            return letters.setdefault(atom[1], complex(0.37 + 0.211 * (sum(map(ord, atom[1])) % 17), 0))
        if kind in ("i", "pi", "e", "inf"):
            return {"i": 1j, "pi": math.pi, "e": math.e, "inf": math.inf}[kind]
        if kind == "sqrt":
            return complex(math.sqrt(atom[1]))
        if kind == "root":
            return of_form(atom[2]) ** (1 / atom[1])
        if kind == "power":
            return of_form(atom[1]) ** of_form(atom[2])
        if kind == "log":
            return cmath.log(of_form(atom[1])) / cmath.log(of_form(atom[2]))
        if kind == "factorial":
            return complex(math.gamma(of_form(atom[1]).real + 1))
        return complex(FUNCTIONS[atom[1]](of_form(atom[2])))

    def of_poly(p) -> complex:
        return sum((float(c) * math.prod((of_atom(a) ** e for a, e in m), start=complex(1)) for m, c in p), complex(0))

    def of_form(form) -> complex:
        return of_poly(form[0]) / of_poly(form[1])

    return of_form(_canonical(a))


class _Reader:
    def __init__(self, text: str):
        for d in DROPPED:
            text = text.replace(d, " " if d in ("\\ ", "~", "\\quad") else "")
        text = re.sub(r"(\d),(?=\d{3}(?:\D|$))", r"\1", text.replace("\\%", "%"))
        text = re.sub(r"\\(?:text|mathrm|textbf|mbox|operatorname)\s*\{([^{}]*)\}", lambda m: " " if re.fullmatch(r"\s*(and|or|units?|cm|m|km|degrees?|dollars?|inches|feet|square\s+\w+)?\s*", m[1]) else "\\" + re.sub(r"\W", "", m[1]), text)
        found, at = [], 0
        for m in TOKEN.finditer(text):
            if text[at : m.start()].strip():
                raise Unsupported(text[at : m.start()])
            found.append(RENAMED.get(m[0], m[0]))
            at = m.end()
        if text[at:].strip() or not found:
            raise Unsupported(text[at:])
        self.tokens, self.at = found, 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or (want is not None and t != want):
            raise Unsupported(f"{want or 'more'} expected")
        self.at += 1
        return t

    def whole(self):
        out = self.relation()
        if self.peek():
            raise Unsupported(self.peek())
        return out

    def relation(self):
        parts, signs = [self.listed()], []
        while self.peek() in RELATIONS:
            signs.append(self.take())
            parts.append(self.listed())
        return parts[0] if not signs else ("relation", parts, signs)

    def listed(self):
        """Comma lists without brackets are sets; unions of intervals."""
        parts = [self.item()]
        if self.peek() == "\\cup":
            while self.peek() == "\\cup":
                self.take()
                parts.append(self.item())
            return ("union", parts)
        while self.peek() == ",":
            self.take()
            parts.append(self.item())
        return parts[0] if len(parts) == 1 else ("set", parts)

    def item(self):
        t = self.peek()
        if t in ("(", "[", "{{") and (found := self.bracketed()) is not None:
            return found
        if t == "\\begin":
            return self.matrix()
        if t in ("\\emptyset", "\\varnothing"):
            self.take()
            return ("set", [])
        return ("expression", self.sum())

    def bracketed(self):
        """A bracket with a comma at its own level; None where it is a group."""
        start, opened = self.at, self.take()
        try:
            parts = [] if self.peek() == "}}" else [self.item()]
            while self.peek() == ",":
                self.take()
                parts.append(self.item())
            closed = self.take()
        except Unsupported:
            self.at = start
            return None
        if opened == "{{" and closed == "}}":
            return ("set", parts)
        if len(parts) < 2 or closed not in (")", "]"):
            self.at = start
            return None
        return ("tuple", opened, parts, closed)

    def matrix(self):
        text = " ".join(self.tokens)
        raise Unsupported(text)

    def sum(self) -> Ratio:
        sign = 1
        while self.peek() in ("+", "-"):
            sign *= -1 if self.take() == "-" else 1
        out = self.product()
        out = _times(_number(sign), out)
        while self.peek() in ("+", "-"):
            minus = self.take() == "-"
            out = _plus(out, self.product(), -1 if minus else 1)
        return out

    def product(self) -> Ratio:
        out = self.power()
        while True:
            t = self.peek()
            if t in ("*", "/"):
                self.take()
                right = self.signed()
                out = _times(out, right) if t == "*" else _over(out, right)
            elif t and (t[0].isdigit() or t[0] == "." or t.isalpha() or t in ("(", "{") or (t[0] == "\\" and t not in ("\\cup", "\\begin", "\\end", "\\in", "\\pm", "\\to"))):
                out = _times(out, self.power())
            else:
                return out

    def signed(self) -> Ratio:
        if self.peek() in ("+", "-"):
            return _times(_number(-1 if self.take() == "-" else 1), self.signed())
        return self.power()

    def power(self) -> Ratio:
        base = self.unit()
        while self.peek() in ("^", "!", "%"):
            t = self.take()
            if t == "^":
                base = _power(base, self.signed_unit())
            elif t == "%":
                base = _over(base, _number(100))
            else:
                c = _constant(base)
                base = _number(math.factorial(int(c))) if c is not None and c.denominator == 1 and 0 <= c <= 200 else _atom("factorial", _canonical(base))
        return base

    def signed_unit(self) -> Ratio:
        if self.peek() in ("+", "-"):
            return _times(_number(-1 if self.take() == "-" else 1), self.signed_unit())
        t = self.peek()
        if re.fullmatch(r"\d{2,}", t) and self.tokens[self.at - 1] == "^":  # x^12 is x^1 times 2 in LaTeX, but nobody writes so
            return _number(Fraction(self.take()))
        return self.unit()

    def group(self) -> Ratio:
        """A braced argument, or the next single character."""
        if self.peek() == "{":
            self.take()
            out = self.sum()
            self.take("}")
            return out
        t = self.peek()
        if re.fullmatch(r"\d{2,}", t):
            self.tokens[self.at : self.at + 1] = [t[0], t[1:]]
        return self.unit()

    def unit(self) -> Ratio:
        t = self.take()
        if t[0].isdigit() or t[0] == ".":
            n = _number(Fraction(t))
            if "." not in t and self.peek() == "\\frac" and self.peek(1):  # a mixed number
                f = self.unit()
                c = _constant(f)
                return _plus(n, f) if c is not None and 0 < c < 1 else _times(n, f)
            return n
        if t in ("(", "{", "["):
            out = self.sum()
            self.take({"(": ")", "{": "}", "[": "]"}[t])
            return out
        if t == "|":
            inner = self.sum()
            self.take("|")
            c = _constant(inner)
            return _number(abs(c)) if c is not None else _atom("function", "abs", _canonical(inner))
        if t == "\\frac":
            top = self.group()
            return _over(top, self.group())
        if t == "\\sqrt":
            n = 2
            if self.peek() == "[":
                self.take()
                c = _constant(self.sum())
                self.take("]")
                if c is None or c.denominator != 1 or not 2 <= c <= 20:
                    raise Unsupported("root")
                n = int(c)
            return _root(self.group(), n)
        if t == "\\pi":
            return _atom("pi")
        if t == "\\infty":
            return _atom("inf")
        if t in ("\\log", "\\lg"):
            base = _number(10)
            if self.peek() == "_":
                self.take()
                base = self.group()
            return _atom("log", _canonical(self.argument()), _canonical(base))
        if t in FUNCTIONS:
            squared = None
            if self.peek() == "^":
                self.take()
                squared = self.signed_unit()
            out = _atom("function", t, _canonical(self.argument()))
            return _power(out, squared) if squared is not None else out
        if t in ("e", "i"):
            return _atom(t)
        if re.fullmatch("[A-Za-z]", t) or t in GREEK:
            if self.peek() == "_":
                self.take()
                start = self.at
                self.group()
                t += "_" + "".join(x for x in self.tokens[start : self.at] if x not in "{}")
            return _atom("letter", t)
        raise Unsupported(t)

    def argument(self) -> Ratio:
        """What a function applies to: a group, or a product up to the next sign or function."""
        if self.peek() in ("(", "{"):
            return self.unit()
        out = self.power()
        while self.peek() and (self.peek()[0].isdigit() or self.peek().isalpha() or self.peek() == "\\pi"):
            out = _times(out, self.power())
        return out


def read(text: str):
    """An answer as a kind and its parts; raises Unsupported."""
    text = text.strip()
    if m := re.fullmatch(r"\\begin\{([pbvB]?matrix|array)\}(?:\{[lcr|]*\})?(.*)\\end\{\1\}", text.replace("\\left", "").replace("\\right", "").strip("()[]$ "), re.S):
        rows = [[_Reader(c).whole() for c in r.split("&")] for r in re.split(r"\\\\", m[2]) if r.strip()]
        return ("matrix", rows)
    if m := re.fullmatch(r"\\(?:text|mathrm|textbf|mbox)\{([^{}]*)\}|([A-Za-z][a-z]{2,}(?: [a-z]+)*)", text):
        return ("text", re.sub(r"\s+", " ", (m[1] or m[2]).strip().lower()))
    if "\\pm" in text and text.count("\\pm") == 1 and "," not in text:
        return ("set", [_Reader(text.replace("\\pm", s)).whole() for s in ("+", "-")])
    return _Reader(text).whole()


def _same_expression(a: Ratio, b: Ratio, tolerance: float) -> bool:
    if not _add(_mul(a[0], b[1]), _mul(b[0], a[1]), -1):
        return True
    letters_in = [x for p in (*a, *b) for m in p for x, _ in m]
    exact = all(x[0] in ("letter", "sqrt", "i") for x in letters_in)
    free = any("letter" in repr(x) for x in letters_in)
    if exact and (free or not tolerance):
        return False
    try:
        for shift in (0.0, 0.61, 1.37) if free else (0.0,):
            points: dict[str, complex] = {}
            value(a, points)
            value(b, points)
            points = {k: v + shift for k, v in points.items()}
            x, y = value(a, dict(points)), value(b, dict(points))
            if cmath.isnan(x) or cmath.isnan(y) or (x != y and abs(x - y) > max(tolerance if not free else 0.0, 1e-9) * max(abs(x), abs(y))):
                return False
    except (ValueError, ZeroDivisionError, OverflowError):
        return False
    return True


def _scaled(p: Poly) -> list:
    """Coefficients over the first one, for comparison up to a factor."""
    items = sorted(p.items(), key=repr)
    return [(m, c / items[0][1]) for m, c in items] if items else []


def _difference(left, right) -> Ratio:
    if left[0] != "expression" or right[0] != "expression":
        raise Unsupported("relation of lists")
    return _plus(left[1], right[1], -1)


def _same_relation(a, b, tolerance: float) -> bool:
    if a[2] != b[2] and [MIRROR.get(s, s) for s in reversed(a[2])] == b[2] and len(a[1]) > 2:
        a = ("relation", a[1][::-1], b[2])
    if len(a[1]) != 2 or len(b[1]) != 2:
        return a[2] == b[2] and all(_same(x, y, tolerance) for x, y in zip(a[1], b[1], strict=True))
    d, e, sign = _difference(*a[1]), _difference(*b[1]), a[2][0]
    p, q = _mul(d[0], {(): Fraction(1)}), _mul(e[0], {(): Fraction(1)})
    if set(d[1]) != {()} or set(e[1]) != {()}:
        return a[2] == b[2] and _same(a[1][0], b[1][0], tolerance) and _same(a[1][1], b[1][1], tolerance)
    if _scaled(p) != _scaled(q):
        return False
    if sign in ("=", "!=") or not p:
        return a[2] == b[2]
    first = sorted(p, key=repr)[0]
    same_side = (p[first] / d[1][()] > 0) == (q[first] / e[1][()] > 0)
    return b[2][0] == (sign if same_side else MIRROR[sign])


def _matched(a: list, b: list, tolerance: float) -> bool:
    """As sets: each member of one side has a partner on the other."""
    return all(any(_same(x, y, tolerance) for y in b) for x in a) and all(any(_same(x, y, tolerance) for x in a) for y in b)


def _same(a, b, tolerance: float) -> bool:
    if a[0] == "relation" and b[0] != "relation" and a[2] == ["="]:
        a = a[1][-1]  # "x = 5" answers "5"
    elif b[0] == "relation" and a[0] != "relation" and b[2] == ["="]:
        b = b[1][-1]
    if a[0] != b[0]:
        if {a[0], b[0]} == {"set", "expression"}:
            one, other = (a, b) if a[0] == "set" else (b, a)
            return len(one[1]) == 1 and _same(one[1][0], other, tolerance)
        if {a[0], b[0]} == {"tuple", "matrix"}:
            one, other = (a, b) if a[0] == "tuple" else (b, a)
            return (len(other[1]) == 1 or all(len(r) == 1 for r in other[1])) and len(one[2]) == len(flat := [x for r in other[1] for x in r]) and all(_same(x, y, tolerance) for x, y in zip(one[2], flat, strict=True))
        return False
    kind = a[0]
    if kind == "expression":
        return _same_expression(a[1], b[1], tolerance)
    if kind == "text":
        return a[1] == b[1]
    if kind == "tuple":
        return a[1] == b[1] and a[3] == b[3] and len(a[2]) == len(b[2]) and all(_same(x, y, tolerance) for x, y in zip(a[2], b[2], strict=True))
    if kind in ("set", "union"):
        return _matched(a[1], b[1], tolerance)
    if kind == "matrix":
        return [len(r) for r in a[1]] == [len(r) for r in b[1]] and all(_same(x, y, tolerance) for r, s in zip(a[1], b[1], strict=True) for x, y in zip(r, s, strict=True))
    return _same_relation(a, b, tolerance)


def compare(gold: str | None, answer: str | None, tolerance: float = 1e-6) -> str:
    """"equal", "different" or "unsupported". tolerance: relative, for numbers only."""
    if gold is None or answer is None:
        return "different"
    if gold.strip() == answer.strip():
        return "equal"
    try:
        return "equal" if _same(read(gold), read(answer), tolerance) else "different"
    except (Unsupported, RecursionError, OverflowError, ZeroDivisionError):
        return "unsupported"


def parses(text: str | None) -> bool:
    try:
        return text is not None and bool(read(text))
    except (Unsupported, RecursionError, OverflowError, ZeroDivisionError):
        return False


def gold_box(solution: str | None) -> str | None:
    """The last box of a solution if it can be read, else null."""
    from rolloom.functions.answers import boxed_contents

    found = boxed_contents(solution or "")
    return found[-1].strip() if found and parses(found[-1]) else None


def verify(response: str | None, gold: str | None, seconds: float = 5.0) -> dict:
    """correct and error: the last box that can be read, against a LaTeX gold. A row has at most ``seconds``."""
    from rolloom.functions.answers import boxed_contents

    boxes = [b for b in boxed_contents(response or "")]
    if not parses(gold):
        return {"correct": False, "error": "invalid_ground_truth", "answer": None}
    answer = next((b.strip() for b in reversed(boxes) if parses(b)), None)
    if answer is None:
        return {"correct": False, "error": "boxed_answer_parse_error" if boxes else "missing_boxed_answer", "answer": None}
    state, late = within(lambda: compare(gold, answer), seconds)
    error = "timeout" if late else {"equal": None, "different": "wrong_answer"}.get(state, state)
    return {"correct": error is None, "error": error, "answer": answer}


def metric(golds: list[str], answers: list[str], reduce: Callable = max) -> float:
    """Every gold against every answer, put together by ``reduce``; 0 without pairs."""
    return float(reduce([float(compare(g, a) == "equal") for g in golds for a in answers] or [0.0]))


def compare_column(gold: Column, answer: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([compare(a, b) for a, b in zip(x, y, strict=True)], dtype="object")

    return run(gold, answer)


def verify_column(response: Column, gold: Column, seconds: float = 5.0) -> Column:
    """Struct correct, error, answer."""

    @F.pandas_udf("correct boolean, error string, answer string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verify(a, b, seconds) for a, b in zip(x, y, strict=True)], columns=["correct", "error", "answer"])

    return run(response, gold)


def gold_box_column(solution: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([gold_box(v) for v in x], dtype="object")

    return run(solution)


def metric_column(golds: Column, answers: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([metric(list(a), list(b)) for a, b in zip(x, y, strict=True)], dtype="float64")

    return run(golds, answers)
