"""A registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from rolloom.session import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a data folder, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = table(self.spark, self.sf_dir, name)
        setattr(self, name, df)
        return df

    @cached_property
    def rollouts(self) -> DataFrame:
        """lineitem as rollouts: one row per generated response, with repeated sample ids."""
        return self.lineitem.selectExpr(
            "'run' AS run_id", "cast(l_orderkey AS string) AS prompt_id", "cast(l_linenumber AS bigint) AS sample_id", "l_returnflag = 'R' AS is_correct", "l_tax < 0.04 AS format_ok", "l_discount < 0.08 AS extraction_ok",
            "l_quantity >= 50 AS hit_max", "CASE WHEN l_returnflag = 'R' THEN 1D ELSE 0D END AS raw_reward",
            "CASE WHEN l_returnflag = 'R' THEN 1D ELSE 0D END + CASE WHEN l_tax < 0.04 THEN 0.1D ELSE 0D END - 0.001D * cast(l_quantity AS bigint) AS final_reward", "cast(l_quantity AS bigint) AS response_tokens",
            "cast(l_suppkey % 5 AS string) AS answer", "l_linestatus AS dataset", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")

    @cached_property
    def unique(self) -> DataFrame:
        """Rollouts with each sample once."""
        from rolloom.operators.groups import first_of_each

        return first_of_each(self.rollouts, ["prompt_id"], "sample_id", ORDER)


ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]

#: The same in DuckDB: relations r (all) and d (each sample once).
ROLLOUTS = """r AS (
  SELECT 'run' AS run_id, cast(l_orderkey AS VARCHAR) AS prompt_id, l_linenumber::BIGINT AS sample_id, l_returnflag = 'R' AS is_correct, l_tax < 0.04 AS format_ok, l_discount < 0.08 AS extraction_ok,
    l_quantity >= 50 AS hit_max, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS raw_reward,
    CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN l_tax < 0.04 THEN 0.1::DOUBLE ELSE 0 END - 0.001::DOUBLE * l_quantity::BIGINT AS final_reward, l_quantity::BIGINT AS response_tokens,
    (l_suppkey % 5)::VARCHAR AS answer, l_linestatus AS dataset, l_partkey, l_suppkey, l_extendedprice, l_shipdate
  FROM lineitem
), d AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, sample_id ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM r) WHERE k = 1
)"""


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name, with its DuckDB SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.replace("{ROLLOUTS}", ROLLOUTS)
        return f

    return add
