"""Joins, set operations, ordering, sampling and splitting of rollout tables."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolloom.session import materialize


def _assert(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Rows as they are; running the plan fails at a row where ``bad`` holds."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def compare_runs(candidate: DataFrame, baseline: DataFrame, keys: list[str], truth: str, values: list[str]) -> DataFrame:
    """Candidate rows beside their baseline. A missing or repeated key or another ground truth is an error; baseline-only rows are left out."""
    base = baseline.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(truth).alias("_truth"), *[F.first(v).alias(f"base_{v}") for v in values])
    both = candidate.join(base, keys, "left")
    both = _assert(both, F.col("_n").isNull() | (F.col("_n") > 1), "a key is missing from the baseline or repeated in it")
    both = _assert(both, ~F.col(truth).eqNullSafe(F.col("_truth")), "ground truths differ")
    return both.drop("_n", "_truth")


def transitions(df: DataFrame, before: Column, after: Column) -> DataFrame:
    return df.groupBy(before.alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


def beside(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Equal key sets joined one to one; a key on one side only is an error."""
    b = before.select(*keys, F.struct(*[c for c in before.columns if c not in keys]).alias("before"))
    a = after.select(*keys, F.struct(*[c for c in after.columns if c not in keys]).alias("after"))
    return _assert(b.join(a, keys, "full_outer"), F.col("before").isNull() | F.col("after").isNull(), "key sets differ")


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def gather(df: DataFrame, positions: DataFrame, row_id: str) -> DataFrame:
    """Rows by a relation (pos, row id): a row comes as often as it is named, with its place."""
    return positions.join(df, row_id)


def repeat_rows(df: DataFrame, n: int | Column, order: list[str], interleave: bool = True) -> DataFrame:
    """Each row n times, with ``rep``; ``place`` gives a,a,b,b (interleaved) or a,b,a,b as sort key."""
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1)))
    place = F.struct(*order, "rep") if interleave else F.struct("rep", *order)
    return out.withColumn("place", place)


def _ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """The rows in ranges of the order, with the range's number ``_p``, made once.

    They are kept, since a second run of the same plan may cut other ranges: bounds are sampled, and small
    ranges are put together by the size of the columns in use.
    """
    return materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[str | Column], name: str = "rn") -> DataFrame:
    """Rows numbered from 0 in a total order, without one task that holds all rows.

    Rows are range-partitioned by the order; counts of partitions give offsets.
    """
    parts = _ranged(df, order)
    w = Window.partitionBy("_p").orderBy(*order)
    parts = parts.withColumn("_k", F.row_number().over(w) - 1)
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_o")
    return parts.join(offsets, "_p").withColumn(name, (F.col("_k") + F.col("_o")).cast("long")).drop("_p", "_k", "_o")


def running(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Adds total_<v>, the sum of v up to each row of a total order, without one task that holds all rows."""
    parts = _ranged(df, order)
    upto = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumns({f"total_{v}": F.sum(v).over(upto) for v in values})
    sums = parts.groupBy("_p").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_p", *[F.sum(v).over(before).alias(f"_o_{v}") for v in values])
    zero = lambda v: F.coalesce(F.col(f"_o_{v}"), F.lit(0))
    return parts.join(F.broadcast(offsets), "_p").withColumns({f"total_{v}": F.col(f"total_{v}") + zero(v) for v in values}).drop("_p", *[f"_o_{v}" for v in values])


def at_indices(df: DataFrame, order: list[str], indices: list[int]) -> DataFrame:
    """pos and the row at each listed place of the order, as often and in the order as listed; a place beyond the rows is an error."""
    listed = df.sparkSession.createDataFrame(list(enumerate(indices)), "pos int, rn long")
    found = F.broadcast(listed).join(numbered(df, order), "rn", "left")
    return _assert(found, F.col(order[0]).isNull(), "an index is out of range").drop("rn")


def column_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both sides by row id; a shared column must be equal, and both sides must have the same rows."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    both = left.withColumn("_left", F.lit(True)).join(right.withColumnsRenamed({c: f"_r_{c}" for c in shared}).withColumn("_right", F.lit(True)), key, "full_outer")
    both = _assert(both, F.col("_left").isNull() | F.col("_right").isNull(), "row sets differ")
    for c in shared:
        both = _assert(both, ~F.col(c).eqNullSafe(F.col(f"_r_{c}")), f"{c} differs")
    return both.drop("_left", "_right", *[f"_r_{c}" for c in shared])


def merged_maps(a: Column, b: Column) -> tuple[Column, Column]:
    """Both maps together (b goes first where they disagree), and whether shared keys have equal values."""
    fits = F.forall(F.map_keys(b), lambda k: ~F.map_contains_key(a, k) | F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b), fits


def equal_splits(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """k contiguous splits of equal size; the rows that are left over go."""
    rows = numbered(df, order)
    size = F.lit(df.count() // k)
    return rows.withColumn("split", F.when(size > 0, F.floor(F.col("rn") / size))).where(F.col("split") < k)


def percent_slice(df: DataFrame, low: float, high: float, order: list[str]) -> DataFrame:
    """Rows from low to high percent of the order."""
    n = df.count()
    return numbered(df, order).where((F.col("rn") >= int(n * low / 100)) & (F.col("rn") < int(n * high / 100)))


def sample_indices(n: int, k: int, seed: int) -> list[int]:
    """k of n indices without replacement from a seeded generator, in order."""
    return sorted(random.Random(seed).sample(range(n), k))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows with the smallest seeded hash of a key: a stable random sample."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def hash_split(df: DataFrame, key: str, test: int, of: int = 100) -> DataFrame:
    """Adds ``is_test`` for about test/of of the keys, always the same ones."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_test", h % of < test)


def quotas(df: DataFrame, source: str, counts: dict[str, int], order: list[str]) -> DataFrame:
    """The first rows of each source, as many as its quota. The largest quota limits each task's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    limit = F.coalesce(*[F.when(F.col(source) == s, n) for s, n in counts.items()], F.lit(0))
    first = df.where(F.col(source).isin(list(counts))).withColumn("_r", rank).where(F.col("_r") <= max(counts.values(), default=0))
    return first.where(F.col("_r") <= limit).drop("_r")


def diverse(df: DataFrame, categories: Column, key: str, order: str, each: int = 8, limit: int = 100) -> DataFrame:
    """The first ``each`` rows of every category, without repeats, filled up with further rows in order."""
    rows = df.select("*", F.explode_outer(categories).alias("_c"))
    rank = F.when(F.col("_c").isNotNull(), F.row_number().over(Window.partitionBy("_c").orderBy(order)))
    best = rows.withColumn("_in", rank <= each).groupBy(key).agg(F.max(F.coalesce("_in", F.lit(False))).alias("_in"), F.min(order).alias("_o"))
    top = best.orderBy(F.desc("_in"), "_o").limit(limit)
    return df.join(top.select(key, F.col("_in").alias("by_category")), key)


def staleness(df: DataFrame, step: int, made: str, sync: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows fresh enough, and statistics of the dropped ones."""
    age = (F.lit(step) - F.col(made) + 1) / sync
    marked = df.withColumn("staleness", age)
    dropped = marked.where(age > threshold).agg(F.count("*").alias("n"), F.avg("staleness").alias("mean"), F.max("staleness").alias("max"), F.min("staleness").alias("min"))
    return marked.where(age <= threshold), dropped


def nonconstant_groups(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Groups with both positive and other values; all rows if there is no such group."""
    w = Window.partitionBy(group)
    marked = df.withColumn("_keep", (F.max(metric).over(w) > 0) & (F.min(metric).over(w) <= 0))
    some = marked.agg(F.max("_keep").alias("_some"))
    return marked.crossJoin(F.broadcast(some)).where(F.col("_keep") | ~F.coalesce("_some", F.lit(False))).drop("_keep", "_some")


def _seen_groups(df: DataFrame, group: str, seen: str) -> DataFrame:
    """Each group with its number of rows and its first appearance."""
    return df.groupBy(group).agg(F.count("*").alias("_n"), F.min(seen).alias("_seen"))


def dynamic_sampling(df: DataFrame, group: str, metric: str, seen: str, divisor: int) -> DataFrame:
    """Rows of groups with both positive and other values, in whole mini-batches: the groups that appear last go until the rows divide. All rows if nothing is left."""
    mixed = df.groupBy(group).agg(((F.max(metric) > 0) & (F.min(metric) <= 0)).alias("_mixed"), F.count("*").alias("_n"), F.min(seen).alias("_seen")).where("_mixed").drop("_mixed")
    upto = running(mixed, ["_seen", group], ["_n"])
    last = upto.where(F.col("total__n") % divisor == 0).agg(F.max("total__n").alias("_last"))
    kept = upto.crossJoin(F.broadcast(last)).where(F.col("total__n") <= F.col("_last")).select(group, F.lit(True).alias("_kept"))
    some = last.select(F.col("_last").isNotNull().alias("_some"))
    return df.join(kept, group, "left").crossJoin(F.broadcast(some)).where(F.coalesce("_kept", F.lit(False)) | ~F.col("_some")).drop("_kept", "_some")


def first_groups(df: DataFrame, group: str, seen: str, n: int) -> DataFrame:
    """Rows of the n groups that appear first."""
    return df.join(_seen_groups(df, group, seen).orderBy("_seen", group).limit(n).select(group), group, "left_semi")


def pad_to_multiple(df: DataFrame, divisor: int, order: list[str]) -> DataFrame:
    """Rows repeated from the start until their number divides; repeated ones have is_padding."""
    n = df.count()
    extra = -n % divisor
    if not n or not extra:
        return df.withColumn("is_padding", F.lit(False))
    rows = numbered(df, order)
    copies = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit((extra - 1) // n)))).where(F.col("_i") * n + F.col("rn") < extra).drop("_i")
    return rows.withColumn("is_padding", F.lit(False)).unionByName(copies.withColumn("is_padding", F.lit(True))).drop("rn")


def leaked(train: DataFrame, test: DataFrame, text: str) -> DataFrame:
    """Training rows whose normalised text occurs in the test split."""
    key = F.sha2(F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " ")), 256)
    return train.withColumn("_k", key).join(test.select(key.alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def latest_status(events: DataFrame, key: list[str], status: str, order: str) -> DataFrame:
    """The last status of every key: the state of a replay buffer."""
    return events.groupBy(*key).agg(F.max_by(status, order).alias("status"), F.max(order).alias("at"))


def upsert(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last write wins."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return events.withColumn("_r", rank).where("_r = 1").drop("_r")


def cumulative(df: DataFrame, by: str, counters: list[str]) -> DataFrame:
    """Running totals over steps; steps are aggregated first."""
    steps = df.groupBy(by).agg(*[F.sum(c).alias(c) for c in counters])
    return running(steps, [by], counters).select(by, *counters, *[f"total_{c}" for c in counters])


def at_milestones(steps: DataFrame, cumulative_col: str, metric: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """The metric reached by each share of the whole budget (an as-of lookup)."""
    whole = steps.agg(F.max(cumulative_col).alias("_all"))
    marks = steps.crossJoin(F.broadcast(whole)).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return marks.where(F.col(cumulative_col) <= F.col("share") * F.col("_all")).groupBy("share").agg(F.max_by(metric, cumulative_col).alias("metric"))
