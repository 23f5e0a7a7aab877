"""A corpus pipeline of five operators: quality rules, near duplicates, decontamination, secrets, packing.

Decisions meet the rows again by row number, which a second scan of the same files
gives again. Rows that go are broadcast as bits of their numbers (``of_rows``), so texts do
not move. Spans of secrets are broadcast up to ``MAX_BROADCAST`` rows, counted first; beyond,
the rows that have any, and no others, are shuffled.

Defined results: as each operator states. A stage that filters keeps every row that it
does not reject as it is, with all its columns, whatever their names: row numbers and
decisions take names that no column has. Of the rows of one near-duplicate component, the
one with the smallest doc_id stays (null ids last; of repeated ids, the first row); texts
without words have no duplicates, so null and empty texts stay there, while the quality
rules reject them. A redacted text has ``[SECRET]`` for each stretch of spans, and its
n_chars, where there is such a column, is counted anew. Very long texts are taken whole. An
empty table passes through all stages as an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.llm import decontamination, jaccard, packing, quality_rules, secrets
from rolloom.llm.columns import free_name, meet, of_rows
from rolloom.session import materialize, prepare, table

MAX_BROADCAST = 100_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their number, and the name of its column."""
    name = free_name(docs.columns, "_rid")
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose number is not in ``gone`` (one column)."""
    rows, name = _numbered(docs)
    return of_rows(rows, name, gone, there=False).drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows, name = _numbered(docs)
    return _without(docs, quality_rules.evaluate(rows, id_col=name).where(~F.col("kept")).select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = jaccard.cluster(docs).where("label IS NOT NULL").select("label", "doc_id", "rid")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"), F.count("*").alias("n"))
    # Only components of more than one row; one of very many rows is dealt out.
    gone = meet(rows, first.where("n > 1").select("label", F.col("first.rid").alias("stays")), ["label"]).where("rid <> stays")
    return _without(docs, gone.select("rid"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows, name = _numbered(docs)
    found = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=name)
    return _without(docs, found.where("contaminated").select("doc_id"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows, name = _numbered(docs)
    spans = free_name(rows.columns, "_spans")
    found = secrets.scan(rows, id_col=name).where(F.size("span_list") > 0).select("doc_id", "span_list").toDF(name, spans)
    found, hit = materialize(found), F.col(spans).isNotNull()
    if found.count() <= MAX_BROADCAST:
        rows = rows.join(F.broadcast(found), name, "left")
    else:
        clean = of_rows(rows, name, found.select(name), there=False).withColumn(spans, F.lit(None).cast(found.schema[spans].dataType))
        rows = of_rows(rows, name, found.select(name)).join(found.hint("merge"), name).unionByName(clean)
    rows = rows.withColumn("text", F.when(hit, secrets.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: No SQL: tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
