"""Validation statistics: best, worst and majority of n, metric reducers and rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expected_best(df: DataFrame, keys: list[str], value: str, ns: tuple[int, ...], worst: bool = False) -> DataFrame:
    """Expected best (or worst) of n draws with replacement in each group, in closed form.

    With the m values in order, the i-th is the best with probability (i/m)^n - ((i-1)/m)^n.
    """
    order = F.desc(value) if worst else F.asc(value)
    w = Window.partitionBy(*keys)
    i, m = F.row_number().over(w.orderBy(order)), F.count(F.lit(1)).over(w)
    ranked = df.select(*keys, F.col(value).alias("_v"), i.alias("_i"), m.alias("_m"))
    name = "worst" if worst else "best"
    share = lambda n: F.pow(F.col("_i") / F.col("_m"), n) - F.pow((F.col("_i") - 1) / F.col("_m"), n)
    return ranked.groupBy(*keys).agg(*[F.sum(F.col("_v") * share(n)).alias(f"{name}_at_{n}") for n in ns])


def bootstrap(df: DataFrame, keys: list[str], value: str, n: int, reducers: tuple[str, ...] = ("mean", "max", "min"), rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and deviation of reducers over seeded resamples of n values of each group.

    A group is one prompt's responses, so it is small; groups run in parallel.
    """
    schema = ", ".join([f"{k} {dict(df.dtypes)[k]}" for k in keys] + [f"{r}_mean double, {r}_std double" for r in reducers])
    name = value

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.RandomState(seed)
        values = np.sort(pdf[name].to_numpy(dtype=float))
        draws = values[rng.choice(len(values), size=(rounds, n), replace=True)]
        row = {k: pdf[k].iloc[0] for k in keys}
        for r in reducers:
            reduced = getattr(np, r)(draws, axis=1)
            row |= {f"{r}_mean": reduced.mean(), f"{r}_std": reduced.std()}
        return pd.DataFrame([row])

    return df.groupBy(*keys).applyInPandas(one, schema)


def majority(df: DataFrame, keys: list[str], vote: str, value: str, position: str) -> DataFrame:
    """The value of the first row with the most common vote; ties go to the vote met first."""
    votes = df.groupBy(*keys, vote).agg(F.count("*").alias("c"), F.min(position).alias("p"), F.min_by(value, position).alias("v"))
    return votes.groupBy(*keys).agg(F.max_by("v", F.struct("c", -F.col("p"))).alias("majority"))


def by_prompt_then_source(df: DataFrame, source: str, prompt: str, values: list[str]) -> DataFrame:
    """Mean and population deviation of each variable per prompt, averaged over the prompts of a source (long form)."""
    long = df.unpivot([source, prompt], values, "variable", "value").where("value IS NOT NULL")
    g = long.groupBy(source, "variable", prompt).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
    return g.groupBy(source, "variable").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.max("n").alias("n_max"), F.count("*").alias("prompts"))


def reduce_by_name(df: DataFrame, name: str, value: str) -> DataFrame:
    """One number per metric: its maximum, minimum or mean, as its name says (max before min)."""
    n = F.col(name)
    g = df.groupBy(name).agg(F.max(value).alias("_x"), F.min(value).alias("_n"), F.avg(value).alias("_a"))
    return g.select(name, F.when(n.contains("max"), F.col("_x")).when(n.contains("min"), F.col("_n")).otherwise(F.col("_a")).alias("value"))


def across_ranks(df: DataFrame, step: str, position: str, value: str, how: str) -> DataFrame:
    """Sum or mean of position-wise means over ranks, or the largest or smallest of all."""
    if how in ("max", "min"):
        return df.groupBy(step).agg(getattr(F, how)(value).alias("value"))
    by = df.groupBy(step, position).agg(F.avg(value).alias("v"))
    return by.groupBy(step).agg((F.sum("v") if how == "sum" else F.avg("v")).alias("value"))


#: Name parts by which a metric's aggregate is chosen; the first that fits counts.
RULES = (("time", "sum"), ("avg", "avg"), ("mean", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("total", "sum"))


def by_rules(df: DataFrame, name: str, value: str, step: str) -> DataFrame:
    """One number per metric over steps, by rules on its name; without a rule the last value."""
    n, kind = F.lower(F.col(name)), F.lit("last")
    for part, how in reversed(RULES):
        kind = F.when(n.contains(part), how).otherwise(kind)
    g = df.groupBy(name).agg(F.sum(value).alias("s"), F.avg(value).alias("a"), F.max(value).alias("x"), F.min(value).alias("m"), F.max_by(value, step).alias("l"))
    out = F.when(kind == "sum", F.col("s")).when(kind == "avg", F.col("a")).when(kind == "max", F.col("x")).when(kind == "min", F.col("m")).otherwise(F.col("l"))
    return g.select(name, kind.alias("rule"), out.alias("value"))


def fraction_of_cases(df: DataFrame, keys: list[str], passed: str) -> DataFrame:
    """Share of passed test cases per response."""
    return df.groupBy(*keys).agg(F.avg(F.col(passed).cast("double")).alias("score"))

