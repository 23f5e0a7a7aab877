r"""Tool calls in responses: readers of the formats that chat models write, and scores of calls.

Each reader gives the calls of a text as (name, arguments). A call that cannot be
read is left out. Readers are registered by the public names of the formats; more may be added.
"""

from __future__ import annotations

import ast
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Call = tuple[str, dict]
Schema = dict[str, dict[str, str]]  # tool -> parameter -> type

READERS: dict[str, Callable[[str, Schema], Iterator[Call]]] = {}
#: Names of types, by how a parameter's text is read.
TEXT_TYPES, INTEGER_TYPES, NUMBER_TYPES, TRUTH_TYPES = ("string", "str", "text", "varchar", "char", "enum"), ("int", "uint", "long", "short", "unsigned"), ("num", "float"), ("boolean", "bool", "binary")


def reader(*names: str):
    def add(f):
        for name in names:
            READERS[name] = f
        return f

    return add


def _json_or_text(raw: str) -> object:
    try:
        return json.loads(raw.strip())
    except ValueError:
        return raw.strip()


def _typed(raw: str, kind: str) -> object:
    """A parameter's text by its declared type; text stays where it does not fit."""
    if raw.lower() == "null":
        return None
    kind = kind.strip().lower()
    if kind in TEXT_TYPES:
        return raw
    if kind in TRUTH_TYPES:
        return raw.lower() == "true"
    try:
        if kind.startswith(INTEGER_TYPES):
            return int(raw)
        if kind.startswith(NUMBER_TYPES):
            return int(float(raw)) if float(raw).is_integer() else float(raw)
        if kind == "object" or kind.startswith("dict"):
            return json.loads(raw)
    except (ValueError, OverflowError):
        if kind != "object" and not kind.startswith("dict"):
            return raw
    try:
        return ast.literal_eval(raw)
    except (ValueError, SyntaxError):
        return raw


def _pairs(pattern: str, body: str) -> dict:
    return {k.strip(): _json_or_text(v) for k, v in re.findall(pattern, body, re.S)}


@reader("hermes", "tagged_json")
def tagged_json(text: str, schema: Schema) -> Iterator[Call]:
    for body in re.findall(r"<tool_call>(.*?)</tool_call>", text, re.S):
        try:
            call = json.loads(body)
            yield call["name"], call["arguments"]
        except (ValueError, KeyError, TypeError):
            continue


@reader("gpt-oss", "harmony")
def harmony(text: str, schema: Schema) -> Iterator[Call]:
    """Calls outside of thoughts. Arguments that are no JSON stay as text: the client decides."""
    text = re.sub(r"(?:<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "", text, flags=re.S)
    for name, body in re.findall(r"<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>", text, re.S):
        yield name, _json_or_text(body)


@reader("qwen3_coder", "xml_function")
def xml_function(text: str, schema: Schema) -> Iterator[Call]:
    """Functions in tool calls; the last call, function or parameter may be open. Parameters are read by their declared types."""
    if "<tool_call>" not in text:
        return
    for body in re.findall(r"<tool_call>(.*?)(?:</tool_call>|$)", text, re.S):
        for function in re.findall(r"<function=(.*?)(?:</function>|$)", body, re.S):
            if ">" not in function:
                return
            name, _, rest = function.partition(">")
            known, found = schema.get(name, {}), {}
            for parameter in re.findall(r"<parameter=(.*?)(?:</parameter>|$)", rest, re.S):
                key, _, raw = parameter.partition(">")
                found[key] = _typed(re.sub(r"^\n|\n$", "", raw), known.get(key, "string"))
            yield name, found


@reader("glm")
def key_value_tags(text: str, schema: Schema) -> Iterator[Call]:
    for body in re.findall(r"<tool_call>(.*?)</tool_call>", text, re.S):
        name, mark, rest = body.partition("<arg_key>")
        yield name.strip(), _pairs(r"<arg_key>(.*?)</arg_key>\s*<arg_value>(.*?)</arg_value>", mark + rest)


@reader("seed")
def seed_tags(text: str, schema: Schema) -> Iterator[Call]:
    for body in re.findall(r"<seed:tool_call>(.*?)</seed:tool_call>", text, re.S):
        if m := re.search(r"<function=([^>\n]+)>\s*(.*?)</function>", body, re.S):
            yield m[1].strip(), _pairs(r"<parameter=([^>\n]+)>(.*?)</parameter>", m[2])


@reader("minimax")
def invoke_tags(text: str, schema: Schema) -> Iterator[Call]:
    for body in re.findall(r"<minimax:tool_call>(.*?)</minimax:tool_call>", text, re.S):
        for name, inner in re.findall(r'<invoke name="([^"]+)">\s*(.*?)</invoke>', body, re.S):
            yield name.strip(), _pairs(r'<parameter name="([^"]+)">(.*?)</parameter>', inner)


@reader("kimi")
def section_tokens(text: str, schema: Schema) -> Iterator[Call]:
    """A name that is no tool is taken for the one tool whose name is in it, or else whose parameters are all there."""
    if "<|tool_calls_section_begin|>" not in text:
        return
    for raw, body in re.findall(r"<\|tool_call_begin\|>(.*?)<\|tool_call_argument_begin\|>(.*?)<\|tool_call_end\|>", text, re.S):
        found, raw = _json_or_text(body), raw.strip()
        found = found if isinstance(found, dict) else {}
        names = [raw] if raw in schema or not schema else [n for n in schema if n.lower() in raw.lower().replace("-", "_")]
        if len(names) != 1:
            names = [n for n, keys in schema.items() if keys and set(keys) <= set(found)]
        yield (names[0] if len(names) == 1 else raw), found


@reader("gemma4")
def brace_calls(text: str, schema: Schema) -> Iterator[Call]:
    words = {"true": True, "false": False, "null": None}
    for name, body in re.findall(r"<\|tool_call>call:(\w+)\{(.*?)\}<tool_call\|>", text, re.S):
        found = {}
        for m in re.finditer(r'(\w+):(?:<\|"\|>(.*?)<\|"\|>|([^,}]*))', body):
            bare = (m[3] or "").strip()
            if m[2] is not None:
                found[m[1]] = m[2]
            elif bare.lower() in words:
                found[m[1]] = words[bare.lower()]
            else:
                try:
                    found[m[1]] = float(bare) if re.search(r"[.eE]", bare) else int(bare)
                except ValueError:
                    found[m[1]] = bare
        yield name, found


def calls(text: str | None, form: str, schema: Schema | None = None) -> list[dict]:
    """Calls (name, arguments as JSON with sorted keys) of a response."""
    if form not in READERS:
        raise ValueError(f"unknown form {form!r}")
    return [{"name": n, "arguments": json.dumps(a, sort_keys=True, ensure_ascii=False)} for n, a in READERS[form](text or "", schema or {})]


def calls_column(text: Column, form: str, schema: Schema | None = None) -> Column:
    if form not in READERS:
        raise ValueError(f"unknown form {form!r}")

    @F.pandas_udf("array<struct<name:string,arguments:string>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([calls(v, form, schema) for v in x], dtype="object")

    return run(text)


def _overlap(a: list, b: list) -> float:
    """Multiset Jaccard; 1 for equal lists, 0 if one is empty."""
    if a == b:
        return 1.0
    both = sum((Counter(a) & Counter(b)).values())
    return both / (len(a) + len(b) - both) if a and b else 0.0


def call_score(golds: list[dict], found: list[dict], low: float = -3.0, high: float = 3.0) -> float:
    """Names by multiset Jaccard, then each gold call takes the best unused call of its name (keys and equal values); from low to high."""
    if golds == found:
        return high
    score, best, used = _overlap([g["name"] for g in golds], [c["name"] for c in found]), 1.0, set()
    for g in golds:
        keys = g["parameters"]
        best += 1 + len(keys)
        fits = [(_overlap(list(keys), list(c["parameters"])) + sum(c["parameters"].get(k, c) == v for k, v in keys.items()), -i) for i, c in enumerate(found) if i not in used and c["name"] == g["name"]]
        if fits and max(fits)[0] > 0:
            used.add(-max(fits)[1])
            score += max(fits)[0]
    return low + (high - low) * score / best


def format_score(response: str, gold: str) -> float:
    """1 if thoughts, calls and reply stand in their places, once each, as the gold has them."""
    call, reply = "<tool_call>" in gold, "<response>" in gold
    shape = r"^<think>.*?</think>" + (r"\n<tool_call>\n.*?\n</tool_call>" if call else "") + (r"\n<response>.*?</response>" if reply else "") + "$"
    once = all(response.count(t) == 1 for t in (["<tool_call>", "</tool_call>"] if call else []) + (["<response>", "</response>"] if reply else []))
    return float(bool(re.search(shape, response, re.S)) and once)


def score(response: str | None, gold: str | None) -> dict:
    """score, format and calls of a response with JSON-line calls, against a gold one. Unreadable calls get the lowest score; a gold without calls gives 0."""
    response, gold = response or "", gold or ""
    lines = lambda x: [json.loads(y) for y in x.split("<tool_call>")[1].split("</tool_call>")[0].strip().split("\n")]
    right = 0.0
    if "<tool_call>" in gold:
        try:
            right = call_score(lines(gold), lines(response)) if "</tool_call>" in response else -3.0
        except (ValueError, IndexError, KeyError, TypeError, AttributeError):
            right = -3.0
    shape = format_score(response, gold)
    return {"score": shape + right, "format": shape, "calls": right}


def score_column(response: Column, gold: Column) -> Column:
    """Struct score, format, calls."""

    @F.pandas_udf("score double, format double, calls double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score(a, b) for a, b in zip(x, y, strict=True)], columns=["score", "format", "calls"])

    return run(response, gold)
