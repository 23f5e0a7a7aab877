"""User reward functions, dispatch by data source, and composite runs."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions.guard import within

#: Reward managers by name: functions from columns to a score column.
MANAGERS: dict[str, Callable[..., Column]] = {}


def manager(name: str):
    """Registers a reward manager; a name can be taken once."""

    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        if name in MANAGERS:
            raise ValueError(f"{name} is registered already")
        MANAGERS[name] = f
        return f

    return add


def load_function(path: str, name: str) -> Callable:
    """A function of a Python file."""
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return getattr(module, name)


def custom_reward(f: Callable, on_error: str = "raise", seconds: float | None = None, **fixed) -> Callable[..., Column]:
    """A column function of (source, response, truth, extra) around f. on_error: raise, or null with the error in a status column.

    seconds: time that a row has; a row that takes longer is stopped and counts as an error ("timeout").
    """

    @F.pandas_udf("score double, status string")
    def run(source: pd.Series, response: pd.Series, truth: pd.Series, extra: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c, d in zip(source, response, truth, extra, strict=True):
            try:
                got, late = within(lambda: f(a, b, c, d, **fixed), seconds) if seconds else (f(a, b, c, d, **fixed), False)  # noqa: B023
                if late and on_error == "raise":
                    raise TimeoutError(f"a row took more than {seconds} s")
                rows.append((None, "timeout") if late else (float(got["score"] if isinstance(got, dict) else got), None))
            except Exception as e:
                if on_error == "raise":
                    raise
                rows.append((None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["score", "status"])

    return run


def batched(f: Callable) -> Callable[..., Column]:
    """A column function around a scorer of lists (sources, responses, truths, extras), which gives a list of scores."""

    @F.pandas_udf("double")
    def run(source: pd.Series, response: pd.Series, truth: pd.Series, extra: pd.Series) -> pd.Series:
        got = f(source.tolist(), response.tolist(), truth.tolist(), extra.tolist())
        if len(got) != len(source):
            raise ValueError("a scorer must give one score a row")
        return pd.Series([float(x["score"] if isinstance(x, dict) else x) for x in got])

    return run


def flat_status(source: Column, response: Column, truth: Column, names: dict[str, str], other: str) -> Column:
    """One flat struct of a verified response: score, acc, raw_correctness, extraction_ok, format_ok, status, error, predicted, raw, source."""
    from rolloom.functions.answers import verify_column

    x = verify_column(response, truth)
    kind = F.lit(other)
    for name, canonical in names.items():
        kind = F.when(source == name, canonical).otherwise(kind)
    found = x["value"].isNotNull()
    one = x["correct"].cast("double")
    return F.struct(
        one.alias("score"), one.alias("acc"), one.alias("raw_correctness"), found.alias("extraction_ok"), (x["status"] == "boxed").alias("format_ok"), F.coalesce(x["error"], F.lit("ok")).alias("status"), x["error"].alias("error"), x["value"].alias("predicted"),
        x["answer"].alias("raw"), kind.alias("source"))


def dispatch(source: Column, scorers: dict[str, Column], prefixes: dict[str, Column] | None = None) -> Column:
    """The scorer of a row's source: by name, then by prefix; another source is an error."""
    out = F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double")
    for p, s in (prefixes or {}).items():
        out = F.when(source.startswith(p), s).otherwise(out)
    for name, s in scorers.items():
        out = F.when(source == name, s).otherwise(out)
    return out


@manager("naive")
def naive(score: Column, length: Column, **_) -> Column:
    return score


@manager("overlong")
def overlong(score: Column, length: Column, max_length: int = 1024, buffer: int = 256, factor: float = 1.0, **_) -> Column:
    from rolloom.functions.text import overlong_penalty

    return score + overlong_penalty(length, max_length, buffer, factor)


@manager("batch")
def batch(score: Column, length: Column, **_) -> Column:
    return score


@manager("prime")
def prime(score: Column, length: Column, **_) -> Column:
    """Scorers run beside each other; one that failed (null) counts 0."""
    return F.coalesce(score, F.lit(0.0))


@manager("combined")
def combined(score: Column, length: Column, others: dict[float, Column] | None = None, **_) -> Column:
    """Several rewards with weights; each is also an advantage of its own, see advantages.per_dimension."""
    for weight, other in (others or {}).items():
        score = score + weight * other
    return score


@manager("limited")
def limited(score: Column, length: Column, **_) -> Column:
    """Scores of a rate-limited scorer; the limit itself is streaming.limited."""
    return score


@manager("remote")
def remote(score: Column, length: Column, answered: Column | None = None, **_) -> Column:
    """Scores that came from elsewhere; null where no answer came, which is never counted as 0."""
    return score if answered is None else F.when(answered, score)


def dense_flops(tokens: Column, parameters: float, layers: int, hidden: int, mean_length: Column) -> Column:
    """Training FLOPs of a dense decoder: 6 per parameter and token, and 12 per layer for attention."""
    return 6 * parameters * tokens + 12 * layers * hidden * tokens * mean_length


def run_metrics(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Group metrics, their summary and the rejected rows, from one table of rollouts."""
    from rolloom.operators.groups import group_metrics, summarize, validate

    good, bad = validate(df)
    metrics = group_metrics(good, keys)
    return metrics, summarize(metrics), bad
