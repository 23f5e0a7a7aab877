"""Batch-wide statistics of token arrays: data metrics, losses, drift, load and off-policy metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions import arrays as A


def masked_moments(df: DataFrame, values: str, mask: str) -> DataFrame:
    """n, mean and unbiased variance over all unmasked tokens of the batch (central moments, so large means cancel nothing)."""
    kept = df.select(F.explode(A.without_padding(F.col(values), F.col(mask))).alias("x"))
    return kept.agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def whiten(df: DataFrame, values: str, mask: str, shift_mean: bool = True) -> DataFrame:
    """Values normalised by the batch's mean and deviation; one small row is broadcast."""
    stats = masked_moments(df, values, mask)
    back = F.lit(0.0) if shift_mean else F.col("mean")
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumn("whitened", F.transform(values, lambda x: (x - F.col("mean")) / F.sqrt(F.col("var") + 1e-8) + back)).drop("n", "mean", "var")


def data_metrics(df: DataFrame, columns: dict[str, str], mask: str) -> DataFrame:
    """mean, max and min of row sums (scores, rewards) or of unmasked tokens (others); NaN where all is masked."""
    out = []
    nan = F.lit(float("nan"))
    for name, kind in columns.items():
        if kind == "row":
            s = A.total(F.col(name))
            out += [F.avg(s).alias(f"{name}_mean"), F.max(s).alias(f"{name}_max"), F.min(s).alias(f"{name}_min")]
        else:
            kept = F.filter(F.zip_with(name, mask, lambda x, m: F.when(m != 0, x)), lambda x: x.isNotNull())
            out += [
                F.coalesce(F.try_divide(F.sum(A.total(kept)), F.sum(F.size(kept))), nan).alias(f"{name}_mean"), F.coalesce(F.max(F.array_max(kept)), nan).alias(f"{name}_max"), F.coalesce(F.min(F.array_min(kept)), nan).alias(f"{name}_min")]
    return df.agg(*out)


def explained_variance(df: DataFrame, returns: str, values: str, mask: str) -> DataFrame:
    """1 - var(returns - values) / (var(returns) + 1e-5)."""
    rest = masked_moments(df.withColumn("_d", F.zip_with(returns, values, lambda a, b: a - b)), "_d", mask).select(F.col("var").alias("d"))
    whole = masked_moments(df, returns, mask).select(F.col("var").alias("r"))
    return rest.crossJoin(whole).select((1 - F.col("d") / (F.col("r") + 1e-5)).alias("explained_variance"))


def loss(df: DataFrame, values: str, mask: str, how: str, horizon: int = 1) -> DataFrame:
    """token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm."""
    s, n = A.masked_sum(F.col(values), F.col(mask)), A.mask_count(F.col(mask))
    seen = F.when(n > 0, 1)
    out = {
        "token-mean": F.sum(s) / F.sum(n), "seq-mean-token-sum": F.sum(s) / F.sum(seen), "seq-mean-token-mean": F.sum(F.when(n > 0, s / n)) / F.sum(seen), "seq-mean-token-sum-norm": F.sum(s) / horizon,
    }[how]
    return df.agg(out.alias("loss"))


def clipped_objective(advantage: Column, ratio: Column, low: float, high: float) -> Column:
    """max(-A r, -A clip(r)) per token."""
    return F.zip_with(advantage, ratio, lambda a, r: F.greatest(-a * r, -a * A.clip(r, 1 - low, 1 + high)))


def drift(df: DataFrame, old: str, new: str, mask: str) -> DataFrame:
    """Largest, mean and deviation of the probability differences, and their correlation."""
    rows = df.select(F.explode(F.arrays_zip(F.col(old).alias("a"), F.col(new).alias("b"), F.col(mask).alias("m"))).alias("x")).where("x.m <> 0").select(F.exp("x.a").alias("a"), F.exp("x.b").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return rows.agg(F.max(gap).alias("max"), F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("std"), F.corr("a", "b").alias("correlation"))


def differing(a: Column, b: Column, mask: Column) -> Column:
    """Unmasked places at which two id lists differ."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m")), lambda x: (x["m"] != 0) & ~x["a"].eqNullSafe(x["b"])))


def expert_load(df: DataFrame, layer: str, expert: str, experts: int) -> DataFrame:
    """Share of an expert times their number, minus 1, per layer: largest, smallest and mean size; experts without tokens count."""
    counts = df.groupBy(layer, expert).agg(F.count("*").alias("n"))
    every = df.select(layer).distinct().select(layer, F.explode(F.sequence(F.lit(0), F.lit(experts - 1))).alias(expert))
    full = every.join(counts.withColumn(expert, F.col(expert).cast("int")), [layer, expert], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = full.groupBy(layer).agg(F.max("n").alias("x"), F.min("n").alias("m"), F.sum("n").alias("s"))
    both = full.join(sums, layer).withColumn("v", F.col("n") / F.col("s") * experts - 1)
    return both.groupBy(layer).agg(F.max("v").alias("max"), F.min("v").alias("min"), F.avg(F.abs("v")).alias("mean_abs"))


def accept_stats(df: DataFrame, drafts: str, accepts: str, verifies: str) -> DataFrame:
    """Accept rate and length of speculative decoding."""
    return df.agg(F.coalesce(F.try_divide(F.sum(accepts), F.sum(drafts)), F.lit(0.0)).alias("rate"), (1 + F.coalesce(F.try_divide(F.sum(accepts), F.sum(verifies)), F.lit(0.0))).alias("length"))


def off_policy(df: DataFrame, old: str, rollout: str, mask: str) -> DataFrame:
    """KL, k3, perplexities of both policies and chi-squared divergences over the batch."""
    o, r, m = F.col(old), F.col(rollout), F.col(mask)
    n = A.mask_count(m)
    ratio = F.zip_with(o, r, lambda a, b: a - b)
    rows = df.select(
        n.alias("n"), A.masked_sum(F.transform(ratio, lambda x: -x), m).alias("k1"), A.masked_sum(F.transform(ratio, lambda x: F.exp(x) - x - 1), m).alias("k3"),
        (A.masked_sum(o, m) / n).alias("lo"), (A.masked_sum(r, m) / n).alias("lr"), A.masked_sum(F.transform(ratio, lambda x: F.exp(2 * x)), m).alias("c"), A.masked_sum(ratio, m).alias("s"))
    return rows.agg(
        (F.sum("k1") / F.sum("n")).alias("kl"), (F.sum("k3") / F.sum("n")).alias("k3_kl"), F.avg(F.exp(-F.col("lo"))).alias("train_ppl"), F.avg(F.exp(-F.col("lr"))).alias("rollout_ppl"),
        F.avg(F.col("lr") - F.col("lo")).alias("log_ppl_diff"), F.avg(F.exp(F.col("lr") - F.col("lo"))).alias("ppl_ratio"), (F.sum("c") / F.sum("n") - 1).alias("chi2_token"), (F.avg(F.exp(2 * A.clip(F.col("s"), -20.0, 20.0))) - 1).alias("chi2_seq"))


def weight_stats(df: DataFrame, weights: str, mask: str, low: float, high: float) -> DataFrame:
    """Mean, extremes, deviation, effective sample size and out-of-band share of importance weights."""
    w = df.select(F.explode(F.arrays_zip(F.col(weights).alias("w"), F.col(mask).alias("m"))).alias("x")).where("x.m <> 0").select("x.w")
    g = w.agg(F.avg("w").alias("mean"), F.max("w").alias("max"), F.min("w").alias("min"), F.stddev_pop("w").alias("std"), F.avg(F.col("w") * F.col("w")).alias("_q"), F.avg(((F.col("w") < low) | (F.col("w") > high)).cast("int")).alias("out_of_band"))
    return g.select("mean", "max", "min", "std", (F.col("mean") * F.col("mean") / F.col("_q")).alias("ess"), "out_of_band")


class AdaptiveKL:
    """A coefficient that follows a target divergence."""

    def __init__(self, coefficient: float, target: float, horizon: int):
        self.value, self.target, self.horizon = coefficient, target, horizon

    def update(self, current: float, steps: int) -> float:
        error = min(max(current / self.target - 1, -0.2), 0.2)
        self.value *= 1 + error * steps / self.horizon
        return self.value
