"""Queries on tables of more rows than the given small ones, in the ways that go wrong only there."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

from rolloom.operators import relations
from rolloom.plans.catalog import ORACLES, QUERIES


@pytest.fixture
def small_ranges(spark):
    """Many ranges, put together to a few by their size, as with large tables."""
    changed = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    kept = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["agg37_imbalance", "prj2_numbered_then_filtered"])
def test_numbers_do_not_depend_on_a_second_cut(spark, small, tmp_path, small_ranges, name):
    for table, key in (("orders", "o_orderkey"), ("documents", "doc_id")):
        rows = spark.read.parquet(f"{small}/{table}.parquet")
        shift = rows.agg(F.max(key) + 1).first()[0]
        rows.crossJoin(spark.range(30)).withColumn(key, F.col(key) + F.col("id") * shift).drop("id").write.parquet(str(tmp_path / f"{table}.parts"))
        spark.read.parquet(str(tmp_path / f"{table}.parts")).coalesce(1).write.parquet(str(tmp_path / f"{table}.dir"))
        next((tmp_path / f"{table}.dir").glob("*.parquet")).rename(tmp_path / f"{table}.parquet")
    compare(spark, name, QUERIES[name], ORACLES[name], str(tmp_path))


def test_running_sums_do_not_depend_on_a_second_cut(spark, small_ranges):
    rows = spark.range(0, 60000, 1, 4).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.repeat(F.lit("x"), (F.col("id") % 200).cast("int")).alias("other"))
    got = relations.running(rows, ["k"], ["v"])
    assert got.where("total_v <> k + 1").count() == 0 and got.count() == 60000


def test_ids_that_are_null_or_negative_are_numbered_as_in_sql(spark, tmp_path):
    rows = spark.range(-500, 1500, 1, 3).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("doc_id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.dir"))
    next((tmp_path / "documents.dir").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    name = "prj2_numbered_then_filtered"
    compare(spark, name, QUERIES[name], ORACLES[name], str(tmp_path))
