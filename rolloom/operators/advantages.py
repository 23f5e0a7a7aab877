"""Group-relative advantages: one window by group, no join, no collect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _by(group: str) -> Window:
    return Window.partitionBy(group)


def group_mean_std(reward: str, group: str) -> tuple[Column, Column]:
    """Mean and unbiased deviation of the group; a single row counts as mean 0 and deviation 1."""
    w = _by(group)
    alone = F.count(F.lit(1)).over(w) == 1
    return F.when(alone, 0.0).otherwise(F.avg(reward).over(w)), F.when(alone, 1.0).otherwise(F.stddev_samp(reward).over(w))


def group_advantage(df: DataFrame, reward: str, group: str, eps: float = 1e-6, scale: bool = True) -> DataFrame:
    """(r - mean) / (std + eps); without scale, r - mean only."""
    mean, std = group_mean_std(reward, group)
    gap = F.col(reward) - mean
    return df.withColumn("advantage", gap / (std + eps) if scale else gap)


def leave_one_out(df: DataFrame, reward: str, group: str) -> DataFrame:
    """The reward minus the mean of the others; alone, the reward itself."""
    w = _by(group)
    n = F.count(F.lit(1)).over(w)
    return df.withColumn("advantage", F.when(n > 1, (n * F.col(reward) - F.sum(reward).over(w)) / (n - 1)).otherwise(F.col(reward)))


def length_weighted(df: DataFrame, reward: str, length: str, group: str) -> DataFrame:
    """The reward minus the length-weighted mean of the group."""
    w = _by(group)
    return df.withColumn("advantage", F.col(reward) - F.try_divide(F.sum(F.col(length) * F.col(reward)).over(w), F.sum(length).over(w)))


def greedy_baseline(df: DataFrame, reward: str, greedy: str, group: str) -> DataFrame:
    """Sampled rows minus the greedy row of their prompt; greedy rows go."""
    base = F.max(F.when(F.col(greedy), F.col(reward))).over(_by(group))
    return df.withColumn("advantage", F.col(reward) - base).where(~F.col(greedy))


def per_dimension(df: DataFrame, rewards: dict[str, float], group: str, eps: float = 1e-6) -> DataFrame:
    """Weighted sum of the advantages of several rewards, each normalised in its group."""
    out = F.lit(0.0)
    for name, weight in rewards.items():
        mean, std = group_mean_std(name, group)
        out = out + weight * (F.col(name) - mean) / (std + eps)
    return df.withColumn("advantage", out)


def dense_ids(df: DataFrame, label: str) -> DataFrame:
    """Labels numbered from 0 in their order, without one task that holds all labels."""
    from rolloom.operators.relations import numbered

    return df.join(numbered(df.select(label).distinct(), [label], "dense_id"), label)


def final_of_session(df: DataFrame, group: str, session: str, index: str, value: str) -> DataFrame:
    """The value of a session's last output, on all its outputs."""
    return df.withColumn("final_" + value, F.max_by(value, index).over(Window.partitionBy(group, session)))
