"""Ways in which one call reaches ranks, and how rows come back.

A rank is a number, not a machine: Spark places the work. What others do with worker
pools is a resource profile here.
"""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.operators.relations import numbered, pad_to_multiple


def one_to_all(df: DataFrame, ranks: int) -> DataFrame:
    """Every row on every rank."""
    return df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))


def data_parallel(df: DataFrame, ranks: int, order: list[str]) -> DataFrame:
    """Contiguous shares of the ordered rows; the number of ranks must divide their number."""
    n = df.count()
    if n % ranks:
        raise ValueError(f"{n} rows cannot be shared by {ranks} ranks")
    return numbered(df, order).withColumn("rank", F.floor(F.col("rn") / max(n // ranks, 1)).cast("int"))


def padded_parallel(df: DataFrame, ranks: int, order: list[str]) -> DataFrame:
    """As data_parallel, after rows are repeated from the start so that they can be shared; is_padding marks those."""
    out = pad_to_multiple(df, ranks, order)
    return data_parallel(out, ranks, ["is_padding", *order])


def rank_zero(df: DataFrame, ranks: int) -> DataFrame:
    """All rows on the first rank."""
    return df.withColumn("rank", F.lit(0))


#: Modes by name: how rows reach ranks. Results come back as rows, in the order of their rn or of the caller.
MODES: dict[str, Callable[..., DataFrame]] = {
    "one_to_all": lambda df, ranks, order: one_to_all(df, ranks), "all_to_all": lambda df, ranks, order: df.withColumn("rank", F.pmod(F.col(order[0]), F.lit(ranks)).cast("int")),
    "data_parallel": data_parallel, "padded_parallel": padded_parallel, "rank_zero": lambda df, ranks, order: rank_zero(df, ranks),
}


def mean_of_ranks(df: DataFrame, value: str) -> DataFrame:
    """One metric from every rank, and their mean."""
    return df.groupBy("rank").agg(F.avg(value).alias("m")).agg(F.avg("m").alias(value))


def pool(cores: int, memory_mb: int, gpus: int = 0) -> ResourceProfile:
    """What the executors of a group of stages need; the cluster manager places them."""
    executor, task = ExecutorResourceRequests().cores(cores).memory(f"{memory_mb}m"), TaskResourceRequests().cpus(1)
    if gpus:
        executor, task = executor.resource("gpu", gpus), task.resource("gpu", 1)
    return ResourceProfileBuilder().require(executor).require(task).build


#: Names of types in a JSON schema.
JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


def tool_schema(f: Callable) -> dict:
    """The JSON schema of a function from its signature and docstring."""
    hints, properties, required = typing.get_type_hints(f), {}, []
    for name, p in inspect.signature(f).parameters.items():
        kind = hints.get(name, str)
        options = [k for k in typing.get_args(kind) if k is not type(None)]
        if type(None) in typing.get_args(kind) and len(options) == 1:
            kind = options[0]
        if typing.get_origin(kind) is typing.Literal:
            properties[name] = {"type": "string", "enum": list(typing.get_args(kind))}
        else:
            properties[name] = {"type": JSON_TYPES.get(typing.get_origin(kind) or kind, "string")}
        if p.default is inspect.Parameter.empty:
            required.append(name)
    return {"type": "function", "function": {"name": f.__name__, "description": inspect.getdoc(f) or "", "parameters": {"type": "object", "properties": properties, "required": required}}}
