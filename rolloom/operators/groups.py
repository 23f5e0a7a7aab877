"""Prompt-group diagnostics: validation, consistency, group metrics, pass@k and summaries.

One shuffle by group serves the consistency windows and the group aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ("explicit_final", "boxed", "implicit_terminal", "ambiguous", "missing", "parse_error")


def issue_code(df: DataFrame) -> Column:
    """The first rule a rollout row breaks, null for a good row."""
    blank = lambda c: F.col(c).isNull() | (F.regexp_replace(F.col(c).cast("string"), r"\s", "") == "")
    unfinite = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    has, code = set(df.columns), F.lit(None).cast("string")
    rules: list[tuple[Column, str]] = []
    for c in ("run_id", "prompt_id"):
        if c in has:
            rules.append((blank(c), f"invalid_{c}"))
    for c in ("sample_id", "response_tokens"):
        if c in has:
            rules.append((F.col(c).isNull() | (F.col(c) < 0), f"invalid_{c}"))
    for c in ("raw_reward", "final_reward"):
        if c in has:
            rules.append((unfinite(c), f"invalid_{c}"))
    if "extraction_status" in has:
        rules.append((~F.col("extraction_status").isin(*STATUSES), "invalid_status"))
    if {"is_correct", "extraction_ok"} <= has:
        rules.append((F.col("is_correct") & ~F.col("extraction_ok"), "correct_without_answer"))
    if {"finish_reason", "hit_max"} <= has:
        rules.append(((F.col("finish_reason") == "length") != F.col("hit_max"), "finish_reason_mismatch"))
    for test, name in reversed(rules):
        code = F.when(F.coalesce(test, F.lit(True)), name).otherwise(code)
    return code


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others with their issue_code."""
    marked = df.withColumn("issue_code", issue_code(df))
    return marked.where("issue_code IS NULL").drop("issue_code"), marked.where("issue_code IS NOT NULL")


def mark_consistency(df: DataFrame, keys: list[str], member: str, order: list[str], same: list[str]) -> DataFrame:
    """Adds issue: "mismatch" where ``same`` differs from the group's first row, then "duplicate" for members met before."""
    by = Window.partitionBy(*keys).orderBy(*order)
    df = df.repartition(*keys).withColumn("_first", F.first(F.struct(*same)).over(by)) if same else df.repartition(*keys)
    ok = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_first.{c}")) for c in same], F.lit(True))
    df = df.withColumn("_ok", ok)
    rank = F.row_number().over(Window.partitionBy(*keys, member, "_ok").orderBy(*order))
    return df.withColumn("issue", F.when(~F.col("_ok"), "mismatch").when(rank > 1, "duplicate")).drop("_first", "_ok")


def first_of_each(df: DataFrame, keys: list[str], member: str, order: list[str]) -> DataFrame:
    """One row per member of a group: the first in order."""
    rank = F.row_number().over(Window.partitionBy(*keys, member).orderBy(*order))
    return df.repartition(*keys).withColumn("_n", rank).where("_n = 1").drop("_n")


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k), null where n < k."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(n - c - i, F.lit(0)) / (n - i))
    return F.when(n >= k, 1 - miss)


def group_metrics(df: DataFrame, keys: list[str], ks: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """One row per group: outcome, rewards, tokens, pass@k, distinct answers and tags."""
    count = lambda c: F.count_if(F.col(c))
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), count("is_correct").alias("n_correct"), count("format_ok").alias("n_format"), count("extraction_ok").alias("n_extracted"), count("hit_max").alias("n_truncated"),
        F.avg("raw_reward").alias("raw_mean"), F.var_pop("raw_reward").alias("raw_var"), (F.max("raw_reward") - F.min("raw_reward")).alias("raw_range"),
        F.avg("final_reward").alias("final_mean"), F.stddev_pop("final_reward").alias("final_std"), (F.max("final_reward") == F.min("final_reward")).alias("zero_final_variance"),
        F.sum("response_tokens").alias("tokens"), F.count_distinct(F.when(F.col("extraction_ok"), F.col("answer"))).alias("n_answers"),
    )
    outcome = F.when(F.col("n_correct") == 0, "all_wrong").when(F.col("n_correct") == F.col("n"), "all_correct").otherwise("mixed")
    g = g.withColumn("outcome", outcome).withColumns({f"pass_at_{k}": pass_at_k(F.col("n"), F.col("n_correct"), k) for k in ks})
    tags = F.array(
        F.when(F.col("outcome") == "all_wrong", "all_wrong"), F.when(F.col("outcome") == "all_correct", "all_correct"), F.when(F.col("raw_range") == 0, "zero_variance"),
        F.when(F.col("n_truncated") > 0, "truncated"), F.when(F.col("n_extracted") < F.col("n"), "extraction_failure"))
    return g.withColumn("tags", F.array_distinct(F.filter(tags, lambda x: x.isNotNull())))


def summarize(groups: DataFrame, ks: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """One row over all groups; rates are null for no group."""
    rate = lambda o: F.try_divide(F.count_if(F.col("outcome") == o), F.count("*"))
    return groups.agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), rate("all_correct").alias("all_correct_rate"), rate("all_wrong").alias("all_wrong_rate"), rate("mixed").alias("mixed_rate"),
        F.avg("raw_var").alias("mean_raw_var"), F.try_divide(F.sum("n_format"), F.sum("n")).alias("format_rate"), F.try_divide(F.sum("n_extracted"), F.sum("n")).alias("extraction_rate"),
        F.sum("tokens").alias("tokens"), F.try_divide(F.sum("tokens"), F.count_if(F.col("outcome") == "mixed")).alias("tokens_per_mixed"),
        F.try_divide(F.sum("n_correct"), F.sum("tokens")).alias("correct_per_token"), *[F.avg(f"pass_at_{k}").alias(f"pass_at_{k}") for k in ks], *[F.count(f"pass_at_{k}").alias(f"eligible_{k}") for k in ks])


def tag_counts(groups: DataFrame) -> DataFrame:
    return groups.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def online_metrics(df: DataFrame, uid: str, correct: str, size: int) -> DataFrame:
    """Step metrics of groups with exactly ``size`` rows; others are counted as incomplete or oversized, blank uids as missing."""
    named = F.when(F.col(uid).isNotNull() & (F.col(uid).cast("string") != ""), F.col(uid))
    g = df.withColumn("_u", named).groupBy("_u").agg(F.count("*").alias("n"), F.count_if(F.col(correct) >= 0.5).alias("c"))
    has, valid = F.col("_u").isNotNull(), F.col("_u").isNotNull() & (F.col("n") == size)
    rate = F.when(valid, F.col("c") / F.col("n"))
    k = lambda test: F.count_if(valid & test)
    out = g.agg(
        F.count_if(has).alias("num_groups"), F.count_if(valid).alias("valid"), k(F.col("c") == size).alias("all_correct"), k(F.col("c") == 0).alias("all_wrong"), k((F.col("c") > 0) & (F.col("c") < size)).alias("mixed"),
        F.count_if(has & (F.col("n") < size)).alias("incomplete"), F.count_if(has & (F.col("n") > size)).alias("oversized"), F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("pass_rate"), F.coalesce(F.stddev_pop(rate), F.lit(0.0)).alias("pass_rate_std"))
    share = lambda c: F.col(c) / F.greatest(F.col("valid"), F.lit(1))
    return out.withColumns({"nonzero_variance": share("mixed"), "all_correct_ratio": share("all_correct"), "all_wrong_ratio": share("all_wrong")})


def length_metrics(df: DataFrame, length: str, correct: str, limit: int) -> DataFrame:
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    right = F.col(correct) >= 0.5
    return df.agg(
        *[zero(F.percentile(length, p)).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.95)], zero(F.avg((F.col(length) >= limit).cast("double"))).alias("truncated"),
        zero(F.avg(F.when(right, F.col(length)))).alias("correct_mean"), zero(F.avg(F.when(~right, F.col(length)))).alias("incorrect_mean"))


def validation_by_source(df: DataFrame, source: str, value: str) -> DataFrame:
    """Means over all rows (source null) and for each source, in one aggregate."""
    g = df.groupingSets([[], [F.col(source)]], F.col(source)).agg(F.grouping(source).alias("whole"), F.avg(value).alias("mean"), F.count("*").alias("n"))
    return g.select(F.when(F.col("whole") == 1, "all").otherwise(F.col(source)).alias("source"), "mean", "n")


def reward_extras(df: DataFrame) -> DataFrame:
    """Means of what a reward gives beside its score; missing columns fall back (raw_correctness to acc, score to that), format reward and length penalty count 0."""
    has = set(df.columns)
    raw = next((c for c in ("raw_correctness", "acc") if c in has), None)
    score = "score" if "score" in has else raw
    mean = lambda c: F.avg(F.col(c).cast("double"))
    out = [mean(raw).alias("raw_correctness_mean")] if raw else []
    out += [mean(score).alias("final_score_mean")] if score else []
    out += [mean("extraction_ok").alias("extraction_ok_ratio"), (1 - mean("extraction_ok")).alias("extraction_failure_ratio")] if "extraction_ok" in has else []
    out += [mean("format_ok").alias("format_ok_ratio")] if "format_ok" in has else []
    return df.agg(*(out or [F.count("*").alias("_n")])).drop("_n").withColumns({"format_reward_mean": F.lit(0.0), "length_penalty_mean": F.lit(0.0)})


def all_reduced(df: DataFrame, key: str, rank: str, value: str, mask: str) -> DataFrame:
    """mean, max, min, std (of all) and masked_mean by key, put together from each rank's counts, sums and central moments."""
    on = F.when(F.col(mask), F.col(value))
    local = df.groupBy(key, rank).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("q"), F.max(value).alias("x"), F.min(value).alias("y"), F.sum(on).alias("s"), F.count(on).alias("k"))
    whole = local.groupBy(key).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    both = local.join(whole, key).groupBy(key).agg(
        F.first("mean").alias("mean"), F.max("x").alias("max"), F.min("y").alias("min"), F.sqrt(F.sum(F.col("q") + F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))) / F.sum("n")).alias("std"), F.try_divide(F.sum("s"), F.sum("k")).alias("masked_mean"))
    return both


def curriculum(df: DataFrame, key: str, order: str, passed: str, value: str, step: str, rate: float, recent: int) -> DataFrame:
    """What a sampler knows of each prompt: pass rate, its moving average, recent progress (the last ``recent`` against those before), reward variance, times and last step."""
    v = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(passed).alias("p")))), lambda x: x["p"])
    g = df.groupBy(key).agg(F.avg(passed).alias("pass_rate"), F.var_pop(value).alias("reward_variance"), v.alias("_v"), F.count("*").alias("times_sampled"), F.max(step).alias("last_step"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    n = F.size("_v")
    last = F.slice("_v", F.greatest(n - recent, F.lit(0)) + 1, recent)
    before = F.slice("_v", F.greatest(n - 2 * recent, F.lit(0)) + 1, F.greatest(F.least(n - recent, F.lit(recent)), F.lit(0)))
    ema = F.aggregate(F.slice("_v", 2, F.greatest(n - 1, F.lit(0))), F.col("_v")[0], lambda s, x: (1 - rate) * s + rate * x)
    return g.withColumns({"pass_rate_ema": ema, "progress": F.when(F.size(before) > 0, mean(last) - mean(before)).otherwise(0.0)}).drop("_v")
