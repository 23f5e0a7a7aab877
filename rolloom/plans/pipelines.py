"""Composite runs: an experiment, an analysis, a rescoring and a comparison, each from and to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.functions import answers, symbolic
from rolloom.functions.text import reward
from rolloom.operators import groups, relations
from rolloom.sources import files

LINES = "run_id STRING, prompt_id STRING, sample_id BIGINT, response STRING, ground_truth STRING, answer STRING, is_correct BOOLEAN, format_ok BOOLEAN, extraction_ok BOOLEAN, hit_max BOOLEAN, raw_reward DOUBLE, final_reward DOUBLE, response_tokens BIGINT"


def scored(rows: DataFrame, percent: str = "fraction", symbolic_gold: bool = False) -> DataFrame:
    """Responses with what extraction, verification and reward say of them."""
    if symbolic_gold:
        x = symbolic.verify_column(F.col("response"), F.col("ground_truth"))
        rows = rows.withColumn("_x", x)
        answer, correct, boxed, found = F.col("_x.answer"), F.col("_x.correct"), F.col("_x.answer").isNotNull(), F.col("_x.answer").isNotNull()
    else:
        rows = rows.withColumn("_x", answers.verify_column(F.col("response"), F.col("ground_truth"), percent))
        answer, correct, boxed, found = F.col("_x.value"), F.col("_x.correct"), F.col("_x.status") == "boxed", F.col("_x.value").isNotNull()
    rows = rows.withColumns({"answer": answer, "is_correct": correct, "format_ok": boxed, "extraction_ok": found})
    raw = F.col("is_correct").cast("int").cast("double")
    return rows.withColumns({"raw_reward": raw, "final_reward": reward(F.col("is_correct"), F.col("format_ok"), F.col("response_tokens"))}).drop("_x")


def report(rows: DataFrame, folder: str) -> DataFrame:
    """Group metrics, their summary and the issues, written to a folder; gives the summary."""
    good, bad = groups.validate(rows)
    metrics = groups.group_metrics(good, ["prompt_id"])
    summary = groups.summarize(metrics)
    files.write_report(metrics, summary, bad.select("prompt_id", "sample_id", "issue_code"), folder)
    return summary


def run_experiment(prompts: DataFrame, responses: DataFrame, folder: str, config: dict) -> DataFrame:
    """Scores the responses of prompts (prompt_id, gold), writes rollouts, report, configuration and manifest; gives the summary.

    Responses (prompt_id, sample_id, response, response_tokens, hit_max) come from a table: generation is not ours.
    """
    spark = prompts.sparkSession
    rows = scored(responses.join(prompts.select("prompt_id", F.col("gold").alias("ground_truth")), "prompt_id")).withColumn("run_id", F.lit(config["name"]))
    files.write_rollouts(rows, f"{folder}/rollouts.jsonl")
    summary = report(files.read_rollouts(spark, f"{folder}/rollouts.jsonl", schema=LINES), folder)
    files.write_json(spark, f"{folder}/provenance.json", files.provenance(spark, config))
    files.manifest(spark, folder).write.mode("overwrite").json(f"{folder}/manifest")
    return summary


def analyze(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The report of a file of rollouts."""
    return report(files.read_rollouts(spark, path, schema=LINES), folder)


def rescore(spark: SparkSession, path: str, percent: str = "fraction", symbolic_gold: bool = False) -> tuple[DataFrame, DataFrame]:
    """A finished run scored anew: moves of rows (before, after, n) and moves of group outcomes."""
    before = files.read_rollouts(spark, path, schema=LINES)
    after = scored(before.drop("answer", "is_correct", "format_ok", "extraction_ok", "raw_reward", "final_reward"), percent, symbolic_gold)
    keys = ["prompt_id", "sample_id"]
    both = relations.beside(before.select(*keys, "is_correct"), after.select(*keys, "is_correct"), keys)
    outcome = lambda df: groups.group_metrics(df, ["prompt_id"]).select("prompt_id", "outcome")
    moved = relations.beside(outcome(before), outcome(after), ["prompt_id"])
    return relations.transitions(both, F.col("before.is_correct"), F.col("after.is_correct")), relations.transitions(moved, F.col("before.outcome"), F.col("after.outcome"))


def compare_files(spark: SparkSession, candidate: str, baseline: str) -> DataFrame:
    """Moves between correct and wrong, and tokens, of two files of rollouts with equal keys and truths."""
    a, b = (files.read_rollouts(spark, p, schema=LINES) for p in (candidate, baseline))
    both = relations.compare_runs(a, b, ["prompt_id", "sample_id"], "ground_truth", ["is_correct", "response_tokens"])
    move = lambda x, y: F.count_if((F.col("base_is_correct") == x) & (F.col("is_correct") == y))
    return both.agg(
        F.count("*").alias("n"), move(False, True).alias("fixed"), move(True, False).alias("broken"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"), F.avg(F.col("base_is_correct").cast("int")).alias("base_accuracy"),
        F.avg(F.col("response_tokens") - F.col("base_response_tokens")).alias("mean_token_delta"))


def record(source: str | Column, prompt: Column, ability: str | Column, truth: Column, split: str, index: Column, extra: dict[str, Column] | None = None, style: str = "rule") -> Column:
    """One training record: data_source, prompt (chat messages), ability, reward_model and extra_info."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    info = [F.lit(split).alias("split"), index.alias("index"), *[c.alias(k) for k, c in (extra or {}).items()]]
    return F.struct(lit(source).alias("data_source"), prompt.alias("prompt"), lit(ability).alias("ability"), F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(*info).alias("extra_info"))


def chat(*turns: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns])
