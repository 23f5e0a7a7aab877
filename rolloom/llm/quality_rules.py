"""Quality rules and robust multivariate outliers (DataFrame operations only).

Base rules look at a text alone. Texts that pass them are then judged by how far
their statistics lie from those of their own language and source: the centre and
scatter are minimum-covariance-determinant estimates, and a text goes where its
squared Mahalanobis distance is beyond the ``1 - tail`` quantile of a chi-squared
variable with one degree of freedom a statistic.

The estimate is FastMCD: from ``STARTS`` deterministic starts (distances from
coordinatewise medians as a sum of squares and as a maximum, and a start of
arbitrary texts), concentration steps keep the ``share`` of texts with the smallest
distances and estimate from these. After ``first_steps`` steps the start with the
smallest determinant goes on alone, until its determinant falls no more (or after
``max_steps`` steps). Distances are then scaled so that their median is that of the
chi-squared variable.

The statistics are transformed so that clean texts are near normal: the logarithm
of the mean word length, square roots of the shares of symbols and capitals, and
the shares of repeated lines and words as they are (clean texts repeat a line now
and then, so small shares must not be stretched by a root). They are kept as whole
256ths, so texts with equal statistics are counted together before anything is
estimated (the steps then work on counted vectors, however many texts a group has),
and all sums are exact, whatever the order in which tasks add them. A fixed floor
keeps the scatter invertible where a statistic is constant, see ``RIDGE``.

Groups with fewer than ``min_group`` passing texts are pooled by language, and
those again over all; a pool that is still smaller rejects nothing. Group
parameters are one row a group: they are counted and broadcast, or where they are many
joined with hot groups apart (``columns.meet``), so a hot source costs no more than its
share.

Defined results: a null text has no words and fails; null languages and sources
are groups of their own; repeated rows are judged each; texts with equal statistics
in one group get the same verdict, so ties need no order; very long texts are judged
whole; null ids are carried through; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.columns import UPPER, covered, meet, total, window_hashes, words
from rolloom.session import materialize, prepare

SPACES = " \t\n\x0b\f\r"
SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SCALE = 256
FEATURES = ("length", "symbols", "capitals", "lines", "repeats")
#: Standard deviation added to each statistic. It is the floor of what counts as unusual where clean texts show less.
RIDGE = {"length": 0.06, "symbols": 0.02, "capitals": 0.06, "lines": 0.06, "repeats": 0.06}
#: Median of a chi-squared variable with five degrees of freedom.
CHI2_MEDIAN = 4.3515


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The counts of every text, with base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    df = df.select(
        "doc_id", "lang", "source", F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"), without(UPPER).cast("long").alias("n_capitals"),
        F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "").alias("lines"), words(text, SEPARATORS).alias("words"),
    )
    df = df.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "n_capitals", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "words",
    )
    df = window_hashes(df, "words", [WINDOW]).drop("words").withColumnRenamed(f"h{WINDOW}", "h")
    again = F.size("h") > F.size(F.array_distinct("h"))
    df = df.withColumn("s", F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h")
    n = F.size("s") - 1
    equal = F.zip_with(F.slice("s", 1, n), F.slice("s", 2, n), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    df = df.withColumn("at", F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull())))))).drop("s")
    repeated = covered(F.transform("at", lambda p: F.struct(p.alias("start"), (p + WINDOW).alias("end"))))
    df = df.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long")).drop("at")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    """The transformed statistics in whole 256ths."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    x = {
        "length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), "symbols": share("n_symbols", "word_chars"), "capitals": share("n_capitals", "word_chars"),
        "lines": F.col("n_dup_lines") / (F.col("n_lines") + 4), "repeats": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    }
    return {k: F.round(v * SCALE).cast("long") for k, v in x.items()}


#: Parameters of a pool: how many texts it was estimated from, log determinant, centre and Cholesky factor.
K = range(len(FEATURES))
PARAMETERS = ["log_det", *[f"m{i}" for i in K], *[f"l{i}_{j}" for i in K for j in range(i + 1)]]
STARTS = 3


def chi2_quantile(tail: float) -> float:
    """Where a chi-squared variable with five degrees of freedom is larger with probability ``tail``."""
    above = lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > tail else (low, mid)
    return low


def _estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters of the counted vectors of each key."""
    w = F.col("w")
    sums = [F.sum(w).alias("n")] + [F.sum(w * F.col(FEATURES[i])).alias(f"s{i}") for i in K]
    sums += [F.sum(w * F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i in K for j in range(i + 1)]
    g = rows.groupBy(*keys).agg(*sums)
    n = F.col("n").cast("double")
    g = g.withColumns({f"m{i}": F.col(f"s{i}") / n for i in K})
    cov = {f"c{i}_{j}": F.col(f"q{i}_{j}") / n - F.col(f"m{i}") * F.col(f"m{j}") + (F.lit((RIDGE[FEATURES[i]] * SCALE) ** 2) if i == j else F.lit(0.0)) for i in K for j in range(i + 1)}
    g = g.withColumns(cov)
    for j in K:  # one column of the factor after the other
        g = g.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(F.col(f"c{j}_{j}") - total([F.lit(0.0)] + [F.col(f"l{j}_{p}") ** 2 for p in range(j)]), F.lit(1e-6))))
        g = g.withColumns({f"l{i}_{j}": (F.col(f"c{i}_{j}") - total([F.lit(0.0)] + [F.col(f"l{i}_{p}") * F.col(f"l{j}_{p}") for p in range(j)])) / F.col(f"l{j}_{j}") for i in K if i > j})
    return g.withColumn("log_det", 2 * total(F.log(f"l{j}_{j}") for j in K)).select(*keys, *PARAMETERS)


def _distance(rows: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance as d2 to rows with their pool's parameters, which go."""
    names = [c for c in rows.columns if c not in PARAMETERS]
    for i in K:  # forward substitution
        y = (F.col(FEATURES[i]) - F.col(f"m{i}") - total([F.lit(0.0)] + [F.col(f"l{i}_{p}") * F.col(f"y{p}") for p in range(i)])) / F.col(f"l{i}_{i}")
        rows = rows.withColumn(f"y{i}", y)
    return rows.withColumn("d2", total(F.col(f"y{i}") ** 2 for i in K)).select(*names, "d2")


#: Distances in whole 32nds, so that exact percentiles have few distinct values.
def _binned(d2: Column) -> Column:
    return F.round(F.least(F.sqrt(d2), F.lit(1000.0)) * 32).cast("long")


def _concentrated(near: DataFrame, keys: list[str], share: float, n: int) -> DataFrame:
    """One concentration step: parameters of the vectors with the smallest bins that hold ``share`` of the texts."""
    limits = near.groupBy(*keys).agg(F.percentile("bin", share, F.col("w")).alias("limit"))
    return materialize(_estimate(meet(near, limits, keys, n=n).where("bin <= limit"), keys))


def fitted(vectors: DataFrame, n: int, share: float, first_steps: int, max_steps: int) -> DataFrame:
    """pool and its minimum-determinant parameters, over counted vectors (pool, FEATURES, w) of at most n pools."""
    mids = vectors.groupBy("pool").agg(*[F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("w")).alias(f"p_{x}") for x in FEATURES])
    z = [F.abs(F.col(x) - F.col(f"p_{x}")[1]) / ((F.col(f"p_{x}")[2] - F.col(f"p_{x}")[0]) / 1.349 + RIDGE[x] * SCALE) for x in FEATURES]
    starts = [_binned(total(v**2 for v in z)), _binned(F.greatest(*z) ** 2), F.pmod(F.xxhash64(*FEATURES), F.lit(1000))]
    bins = F.array(*[F.struct(F.lit(i).alias("start"), b.alias("bin")) for i, b in enumerate(starts)])
    near = meet(vectors, mids, ["pool"], n=n).select("pool", *FEATURES, "w", F.explode(bins).alias("x")).select("pool", *FEATURES, "w", "x.*")
    every = vectors.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(STARTS)])))
    for k in range(first_steps):
        found = _concentrated(near, ["pool", "start"], share, STARTS * n)
        if k + 1 < first_steps:
            near = _distance(meet(every, found, ["pool", "start"], n=STARTS * n)).withColumn("bin", _binned(F.col("d2")))
    best = found.groupBy("pool").agg(F.min(F.struct("log_det", "start", *PARAMETERS[1:])).alias("x")).select("pool", *[F.col(f"x.{c}").alias(c) for c in PARAMETERS])
    for _ in range(max_steps):
        near = _distance(meet(vectors, best, ["pool"], n=n)).withColumn("bin", _binned(F.col("d2")))
        new = _concentrated(near, ["pool"], share, n).select("pool", F.struct(*PARAMETERS).alias("new"))
        both = best.join(new, "pool").withColumn("falls", F.col("new.log_det") < F.col("log_det") - 1e-6)
        best = materialize(both.select("pool", *[F.when(F.col("falls"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in PARAMETERS], "falls"))
        falls = best.where("falls").limit(1).count()
        best = best.drop("falls")
        if not falls:
            break
    return best


def pooled(passing: DataFrame, min_group: int) -> DataFrame:
    """lang, source and the pool in which the texts of that group are judged."""
    by_group = passing.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("own", F.col("n") >= min_group)
    by_lang = by_group.groupBy(F.col("lang").alias("_lang")).agg(F.sum(F.when(~F.col("own"), F.col("n"))).alias("n_lang"))
    both = by_group.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")))
    own, lang = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang"))
    return both.select("lang", "source", F.when(F.col("own"), own).when(F.col("n_lang") >= min_group, lang).otherwise("[]").alias("pool"))


def evaluate(docs: DataFrame, share: float = 0.75, first_steps: int = 2, max_steps: int = 12, tail: float = 1e-5, min_group: int = 100, **columns: str) -> DataFrame:
    """The statistics of every row with distance (null where not judged) and kept."""
    prepare(docs.sparkSession)
    rows = materialize(statistics(docs, **columns).withColumns(_vector()))
    passing = rows.where(~F.col("base_failed"))
    pools = materialize(pooled(passing, min_group))
    n = pools.count()
    counted = passing.groupBy("lang", "source", *FEATURES).agg(F.count("*").alias("w"))
    vectors = materialize(meet(counted, pools, ["lang", "source"], n=n).groupBy("pool", *FEATURES).agg(F.sum("w").alias("w")))
    best = fitted(vectors, n, share, first_steps, max_steps)
    near = _distance(meet(vectors, best, ["pool"], n=n))
    scale = near.groupBy("pool").agg(F.sum("w").alias("n_pool"), F.percentile(_binned(F.col("d2")), 0.5, F.col("w")).alias("mid"))
    scale = scale.select("pool", "n_pool", F.greatest(F.lit(1.0), (F.col("mid") / 32) ** 2 / CHI2_MEDIAN).alias("scale"))
    known = meet(pools, best.join(scale, "pool"), ["pool"], n=n).drop("pool")
    judged = _distance(meet(passing, known, ["lang", "source"], n=n)).withColumn("distance", F.when(F.col("n_pool") >= min_group, F.col("d2") / F.col("scale")))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = judged.select(*names, (F.col("distance").isNull() | (F.col("distance") <= chi2_quantile(tail))).alias("kept"), "distance")
    return rows.where("base_failed").select(*names, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")).unionByName(kept)
