"""Queries over rollouts: groups, online metrics, advantages, joins, order, sets and balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.functions import text
from rolloom.operators import advantages, balance, groups, relations, validation
from rolloom.plans.registry import ORDER, Tables, query


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})


@query("agg7_group_summary", """WITH {ROLLOUTS}, g AS (
  SELECT prompt_id, count(*) n, count_if(is_correct) c, count_if(format_ok) f, count_if(extraction_ok) e, var_pop(raw_reward) v, sum(response_tokens) t FROM d GROUP BY 1
), p AS (SELECT *, CASE WHEN n >= 1 THEN c / n END p1, CASE WHEN n >= 2 THEN 1 - (n - c)::DOUBLE * (n - c - 1) / (n * (n - 1)) END p2,
  CASE WHEN n >= 4 THEN 1 - greatest(n - c, 0)::DOUBLE * greatest(n - c - 1, 0) * greatest(n - c - 2, 0) * greatest(n - c - 3, 0) / (n * (n - 1) * (n - 2) * (n - 3)) END p4 FROM g)
SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_rows, round(count_if(c = n) / count(*), 6) AS all_correct_rate, round(count_if(c = 0) / count(*), 6) AS all_wrong_rate, round(count_if(c > 0 AND c < n) / count(*), 6) AS mixed_rate,
  round(avg(v), 6) AS mean_raw_var, round(sum(f) / sum(n), 6) AS format_rate, round(sum(e) / sum(n), 6) AS extraction_rate, sum(t)::BIGINT AS tokens, round(sum(t) / count_if(c > 0 AND c < n), 6) AS tokens_per_mixed,
  round(sum(c) / sum(t), 6) AS correct_per_token, round(avg(p1), 6) AS pass_at_1, round(avg(p2), 6) AS pass_at_2, round(avg(p4), 6) AS pass_at_4, count(p1) AS eligible_1, count(p2) AS eligible_2, count(p4) AS eligible_4 FROM p""")
def summary(t: Tables) -> DataFrame:
    out = groups.summarize(groups.group_metrics(t.unique, ["prompt_id"]))
    return rounded(out, *[c for c, kind in out.dtypes if kind == "double"])


@query("agg1_group_metrics", """WITH {ROLLOUTS}
SELECT prompt_id, count(*) AS n, count_if(is_correct)::BIGINT AS n_correct, count_if(format_ok)::BIGINT AS n_format, count_if(hit_max)::BIGINT AS n_truncated, sum(response_tokens)::BIGINT AS tokens,
  CASE WHEN count_if(is_correct) = 0 THEN 'all_wrong' WHEN count_if(is_correct) = count(*) THEN 'all_correct' ELSE 'mixed' END AS outcome FROM d GROUP BY 1""")
def group_rows(t: Tables) -> DataFrame:
    return groups.group_metrics(t.unique, ["prompt_id"]).select("prompt_id", "n", "n_correct", "n_format", "n_truncated", "tokens", "outcome")


@query("agg2_reward_moments", """WITH {ROLLOUTS}
SELECT prompt_id, round(avg(raw_reward), 6) AS raw_mean, round(var_pop(raw_reward), 6) AS raw_var, round(max(raw_reward) - min(raw_reward), 6) AS raw_range, round(avg(final_reward), 6) + 0.0 AS final_mean,
  round(stddev_pop(final_reward), 6) AS final_std, max(final_reward) = min(final_reward) AS zero_final_variance FROM d GROUP BY 1""")
def moments(t: Tables) -> DataFrame:
    g = groups.group_metrics(t.unique, ["prompt_id"]).select("prompt_id", "raw_mean", "raw_var", "raw_range", "final_mean", "final_std", "zero_final_variance")
    return rounded(g, "raw_mean", "raw_var", "raw_range", "final_mean", "final_std")


CONSISTENT = """WITH {ROLLOUTS}, f AS (SELECT *, first_value(dataset) OVER (PARTITION BY prompt_id ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS fd FROM r), o AS (
  SELECT *, CASE WHEN dataset <> fd THEN 'mismatch' WHEN row_number() OVER (PARTITION BY prompt_id, sample_id, dataset = fd ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) > 1 THEN 'duplicate' END AS issue FROM f)
"""


@query("agg3_consistency", CONSISTENT + "SELECT coalesce(issue, 'ok') AS issue, count(*) AS n FROM o GROUP BY 1")
def consistency(t: Tables) -> DataFrame:
    marked = groups.mark_consistency(t.rollouts, ["prompt_id"], "sample_id", ORDER, ["dataset"])
    return marked.groupBy(F.coalesce("issue", F.lit("ok")).alias("issue")).agg(F.count("*").alias("n"))


@query("win2_duplicates", "WITH {ROLLOUTS} SELECT prompt_id, count(*) - count(DISTINCT sample_id) AS repeated FROM r GROUP BY 1")
def duplicates(t: Tables) -> DataFrame:
    marked = groups.mark_consistency(t.rollouts, ["prompt_id"], "sample_id", ORDER, [])
    return marked.groupBy("prompt_id").agg(F.count_if(F.col("issue") == "duplicate").alias("repeated"))


@query("win1_canonical_row", "WITH {ROLLOUTS} SELECT DISTINCT prompt_id, first_value(dataset) OVER (PARTITION BY prompt_id ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS dataset FROM r")
def canonical(t: Tables) -> DataFrame:
    return t.rollouts.groupBy("prompt_id").agg(F.min_by("dataset", F.struct(*ORDER)).alias("dataset"))


@query("agg4_tags", """WITH {ROLLOUTS}, g AS (SELECT prompt_id, count(*) n, count_if(is_correct) c, count_if(extraction_ok) e, count_if(hit_max) h FROM d GROUP BY 1)
SELECT prompt_id, array_to_string(list_filter([CASE WHEN c = 0 THEN 'all_wrong' END, CASE WHEN c = n THEN 'all_correct' END, CASE WHEN c = 0 OR c = n THEN 'zero_variance' END, CASE WHEN h > 0 THEN 'truncated' END,
  CASE WHEN e < n THEN 'extraction_failure' END], lambda x: x IS NOT NULL), ';') AS tags FROM g""")
def tags(t: Tables) -> DataFrame:
    return groups.group_metrics(t.unique, ["prompt_id"]).select("prompt_id", F.concat_ws(";", "tags").alias("tags"))


@query("agg5_distinct_answers", "WITH {ROLLOUTS} SELECT prompt_id, count(DISTINCT CASE WHEN extraction_ok THEN answer END) AS n_answers FROM d GROUP BY 1")
def answers(t: Tables) -> DataFrame:
    return groups.group_metrics(t.unique, ["prompt_id"]).select("prompt_id", "n_answers")


@query("agg6_pass_at_k", """WITH {ROLLOUTS}, g AS (SELECT prompt_id, count(*) n, count_if(is_correct) c FROM d GROUP BY 1)
SELECT prompt_id, round(CASE WHEN n >= 2 THEN 1 - (n - c)::DOUBLE * (n - c - 1) / (n * (n - 1)) END, 6) AS pass_at_2, round(CASE WHEN n >= 3 THEN 1 - greatest(n - c, 0)::DOUBLE * greatest(n - c - 1, 0) * greatest(n - c - 2, 0) / (n * (n - 1) * (n - 2)) END, 6) AS pass_at_3 FROM g""")
def pass_at(t: Tables) -> DataFrame:
    g = groups.group_metrics(t.unique, ["prompt_id"], (2, 3)).select("prompt_id", "pass_at_2", "pass_at_3")
    return rounded(g, "pass_at_2", "pass_at_3")


@query("agg7_tag_counts", """WITH {ROLLOUTS}, g AS (SELECT prompt_id, count(*) n, count_if(is_correct) c, count_if(extraction_ok) e, count_if(hit_max) h FROM d GROUP BY 1), x AS (
  SELECT 'all_wrong' tag FROM g WHERE c = 0 UNION ALL SELECT 'all_correct' FROM g WHERE c = n UNION ALL SELECT 'zero_variance' FROM g WHERE c = 0 OR c = n UNION ALL SELECT 'truncated' FROM g WHERE h > 0 UNION ALL SELECT 'extraction_failure' FROM g WHERE e < n)
SELECT tag, count(*) AS n FROM x GROUP BY 1""")
def tag_table(t: Tables) -> DataFrame:
    return groups.tag_counts(groups.group_metrics(t.unique, ["prompt_id"]))


@query("flt1_validation", """WITH {ROLLOUTS} SELECT coalesce(CASE WHEN is_correct AND NOT extraction_ok THEN 'correct_without_answer' END, 'ok') AS code, count(*) AS n FROM r GROUP BY 1""")
def validation_codes(t: Tables) -> DataFrame:
    good, bad = groups.validate(t.rollouts)
    return good.select(F.lit("ok").alias("code")).unionByName(bad.select(F.col("issue_code").alias("code"))).groupBy("code").agg(F.count("*").alias("n"))


@query("agg8_online_groups", """WITH {ROLLOUTS}, g AS (SELECT CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE prompt_id END u, count(*) n, count_if(raw_reward >= 0.5) c FROM r GROUP BY 1), v AS (SELECT *, u IS NOT NULL AND n = 4 ok FROM g)
SELECT count_if(u IS NOT NULL)::BIGINT AS num_groups, count_if(ok)::BIGINT AS valid, count_if(ok AND c = 4)::BIGINT AS all_correct, count_if(ok AND c = 0)::BIGINT AS all_wrong, count_if(ok AND c > 0 AND c < 4)::BIGINT AS mixed,
  count_if(u IS NOT NULL AND n < 4)::BIGINT AS incomplete, count_if(u IS NOT NULL AND n > 4)::BIGINT AS oversized, coalesce(sum(CASE WHEN u IS NULL THEN n END), 0)::BIGINT AS missing, round(coalesce(avg(CASE WHEN ok THEN c / 4 END), 0), 6) AS pass_rate,
  round(coalesce(stddev_pop(CASE WHEN ok THEN c / 4 END), 0), 6) AS pass_rate_std, round(count_if(ok AND c > 0 AND c < 4) / greatest(count_if(ok), 1), 6) AS nonzero_variance,
  round(count_if(ok AND c = 4) / greatest(count_if(ok), 1), 6) AS all_correct_ratio, round(count_if(ok AND c = 0) / greatest(count_if(ok), 1), 6) AS all_wrong_ratio FROM v""")
def online(t: Tables) -> DataFrame:
    rows = t.rollouts.withColumn("uid", F.when(F.col("l_partkey") % 7 != 0, F.col("prompt_id")))
    return rounded(groups.online_metrics(rows, "uid", "raw_reward", 4), "pass_rate", "pass_rate_std", "nonzero_variance", "all_correct_ratio", "all_wrong_ratio")


@query("agg9_length_metrics", """WITH {ROLLOUTS} SELECT quantile_cont(response_tokens, 0.5) AS p50, round(quantile_cont(response_tokens, 0.9), 6) AS p90, round(quantile_cont(response_tokens, 0.95), 6) AS p95, round(avg((response_tokens >= 50)::INT), 6) AS truncated,
  round(avg(CASE WHEN is_correct THEN response_tokens END), 6) AS correct_mean, round(avg(CASE WHEN NOT is_correct THEN response_tokens END), 6) AS incorrect_mean FROM r""")
def lengths(t: Tables) -> DataFrame:
    return rounded(groups.length_metrics(t.rollouts, "response_tokens", "raw_reward", 50), "p50", "p90", "p95", "truncated", "correct_mean", "incorrect_mean")


@query("agg11_validation_sources", "WITH {ROLLOUTS} SELECT CASE WHEN grouping(dataset) = 1 THEN 'all' ELSE dataset END AS source, round(avg(raw_reward), 6) AS mean, count(*) AS n FROM r GROUP BY GROUPING SETS ((), (dataset))")
def by_source(t: Tables) -> DataFrame:
    return rounded(groups.validation_by_source(t.rollouts, "dataset", "raw_reward"), "mean")


@query("agg12_run_summary", """WITH {ROLLOUTS}, g AS (SELECT prompt_id, min_by(raw_reward, sample_id) one, bool_or(is_correct) hit, count_if(is_correct) c, count(*) n, var_samp(final_reward) v FROM d GROUP BY 1)
SELECT round(avg(one), 6) AS pass_1, round(avg(hit::INT), 6) AS pass_k, round(avg((c = n)::INT), 6) AS all_correct, round(avg((c = 0)::INT), 6) AS all_wrong, round(avg(v), 6) AS mean_variance FROM g""")
def run_summary(t: Tables) -> DataFrame:
    g = t.unique.groupBy("prompt_id").agg(F.min_by("raw_reward", "sample_id").alias("first"), F.bool_or("is_correct").alias("any"), F.count_if("is_correct").alias("c"), F.count("*").alias("n"), F.var_samp("final_reward").alias("v"))
    share = lambda c: F.avg(c.cast("int"))
    out = g.agg(F.avg("first").alias("pass_1"), share(F.col("any")).alias("pass_k"), share(F.col("c") == F.col("n")).alias("all_correct"), share(F.col("c") == 0).alias("all_wrong"), F.avg("v").alias("mean_variance"))
    return rounded(out, *out.columns)


@query("agg16_throughput", "WITH {ROLLOUTS} SELECT dataset, round(sum(response_tokens) / (100.0 * 8), 6) AS tokens_per_gpu_second FROM r GROUP BY 1")
def throughput(t: Tables) -> DataFrame:
    return t.rollouts.groupBy("dataset").agg(F.round(F.sum("response_tokens") / (100.0 * 8), 6).alias("tokens_per_gpu_second"))


@query("agg15_timing", """WITH {ROLLOUTS} SELECT dataset, round(CASE WHEN sum(response_tokens) > 0 THEN 12.5 * 1000 / sum(response_tokens) ELSE 0 END, 6) AS gen_ms_per_token, round(CASE WHEN sum(response_tokens + 32) > 0 THEN 3.5 * 1000 / sum(response_tokens + 32) ELSE 0 END, 6) AS ref_ms_per_token FROM r GROUP BY 1""")
def timing(t: Tables) -> DataFrame:
    g = t.rollouts.groupBy("dataset").agg(F.sum("response_tokens").alias("r"), F.sum(F.col("response_tokens") + 32).alias("a"))
    per = lambda s, n: F.round(F.when(F.col(n) > 0, F.lit(s) * 1000 / F.col(n)).otherwise(0.0), 6)
    return g.select("dataset", per(12.5, "r").alias("gen_ms_per_token"), per(3.5, "a").alias("ref_ms_per_token"))


@query("agg20_group_mean_std", "WITH {ROLLOUTS} SELECT prompt_id, round(CASE WHEN count(*) = 1 THEN 0 ELSE avg(final_reward) END, 6) AS mean, round(CASE WHEN count(*) = 1 THEN 1 ELSE stddev_samp(final_reward) END, 6) AS std, count(*) AS n FROM d GROUP BY 1")
def mean_std(t: Tables) -> DataFrame:
    mean, std = advantages.group_mean_std("final_reward", "prompt_id")
    rows = t.unique.select("prompt_id", mean.alias("mean"), std.alias("std"))
    return rounded(rows.groupBy("prompt_id").agg(F.max("mean").alias("mean"), F.max("std").alias("std"), F.count("*").alias("n")), "mean", "std")


@query("agg21_dense_ids", "SELECT l_orderkey, dense_rank() OVER (ORDER BY l_orderkey) - 1 AS dense_id FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def dense(t: Tables) -> DataFrame:
    return advantages.dense_ids(t.lineitem.select("l_orderkey").distinct(), "l_orderkey").select("l_orderkey", F.col("dense_id").cast("long"))


ADV = "WITH {ROLLOUTS} SELECT prompt_id, sample_id, round(%s + 1.234e-6, 5) + 0.0 AS advantage FROM d WINDOW w AS (PARTITION BY prompt_id)"


#: Added before rounding, here and in the SQL: rewards have few decimals, and ties would round by the last bit.
NUDGE = 1.234e-6


def advantage_rows(df: DataFrame) -> DataFrame:
    return df.select("prompt_id", "sample_id", (F.round(F.col("advantage") + NUDGE, 5) + 0.0).alias("advantage"))


@query("win3_group_advantage", ADV % "CASE WHEN count(*) OVER w = 1 THEN final_reward / (1 + 1e-6) ELSE (final_reward - avg(final_reward) OVER w) / (stddev_samp(final_reward) OVER w + 1e-6) END")
def grpo(t: Tables) -> DataFrame:
    return advantage_rows(advantages.group_advantage(t.unique, "final_reward", "prompt_id"))


@query("win3_unscaled_advantage", ADV % "CASE WHEN count(*) OVER w = 1 THEN final_reward ELSE final_reward - avg(final_reward) OVER w END")
def unscaled(t: Tables) -> DataFrame:
    return advantage_rows(advantages.group_advantage(t.unique, "final_reward", "prompt_id", scale=False))


@query("win4_leave_one_out", ADV % "CASE WHEN count(*) OVER w = 1 THEN final_reward ELSE (count(*) OVER w * final_reward - sum(final_reward) OVER w) / (count(*) OVER w - 1) END")
def rloo(t: Tables) -> DataFrame:
    return advantage_rows(advantages.leave_one_out(t.unique, "final_reward", "prompt_id"))


@query("win5_length_weighted", ADV % "final_reward - sum(response_tokens * final_reward) OVER w / sum(response_tokens) OVER w")
def opo(t: Tables) -> DataFrame:
    return advantage_rows(advantages.length_weighted(t.unique, "final_reward", "response_tokens", "prompt_id"))


@query("win6_greedy_baseline", "WITH {ROLLOUTS}, x AS (SELECT *, max(CASE WHEN sample_id = 1 THEN final_reward END) OVER (PARTITION BY prompt_id) b FROM d) SELECT prompt_id, sample_id, round(final_reward - b + 1.234e-6, 5) + 0.0 AS advantage FROM x WHERE sample_id <> 1")
def remax(t: Tables) -> DataFrame:
    return advantage_rows(advantages.greedy_baseline(t.unique.withColumn("greedy", F.col("sample_id") == 1), "final_reward", "greedy", "prompt_id"))


@query("win9_per_dimension", ADV % """CASE WHEN count(*) OVER w = 1 THEN 0.7 * raw_reward / (1 + 1e-6) + 0.3 * response_tokens / (1 + 1e-6) ELSE
  0.7 * (raw_reward - avg(raw_reward) OVER w) / (stddev_samp(raw_reward) OVER w + 1e-6) + 0.3 * (response_tokens - avg(response_tokens) OVER w) / (stddev_samp(response_tokens) OVER w + 1e-6) END""")
def gdpo(t: Tables) -> DataFrame:
    return advantage_rows(advantages.per_dimension(t.unique, {"raw_reward": 0.7, "response_tokens": 0.3}, "prompt_id"))


@query("win11_budget", """WITH {ROLLOUTS}, s AS (SELECT year(l_shipdate) AS step, count(*) AS responses, sum(response_tokens)::BIGINT AS tokens FROM r GROUP BY 1)
SELECT step::INT AS step, responses, tokens, sum(responses) OVER (ORDER BY step)::BIGINT AS total_responses, sum(tokens) OVER (ORDER BY step)::BIGINT AS total_tokens FROM s""")
def budget(t: Tables) -> DataFrame:
    rows = t.rollouts.select(F.year("l_shipdate").alias("step"), F.lit(1).cast("long").alias("responses"), F.col("response_tokens").alias("tokens"))
    return relations.cumulative(rows, "step", ["responses", "tokens"])


@query("win15_milestones", """WITH {ROLLOUTS}, s AS (SELECT year(l_shipdate) AS step, avg(raw_reward) AS metric, sum(response_tokens) AS tokens FROM r GROUP BY 1), c AS (SELECT metric, sum(tokens) OVER (ORDER BY step) AS cum, sum(tokens) OVER () AS whole FROM s)
SELECT share::DOUBLE AS share, round(max_by(metric, cum), 6) AS metric FROM c, (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS share) WHERE cum <= share * whole GROUP BY 1""")
def milestones(t: Tables) -> DataFrame:
    steps = t.rollouts.groupBy(F.year("l_shipdate").alias("step")).agg(F.avg("raw_reward").alias("metric"), F.sum("response_tokens").alias("tokens"))
    w = relations.Window.orderBy("step").rowsBetween(relations.Window.unboundedPreceding, 0)
    return rounded(relations.at_milestones(steps.withColumn("cum", F.sum("tokens").over(w)), "cum", "metric"), "metric")


@query("flt10_staleness", "SELECT count(*) AS n, round(avg((1998 - year(l_shipdate) + 1) / 2), 6) AS mean, max((1998 - year(l_shipdate) + 1) / 2) AS max, min((1998 - year(l_shipdate) + 1) / 2) AS min FROM lineitem WHERE (1998 - year(l_shipdate) + 1) / 2 > 1.5")
def stale(t: Tables) -> DataFrame:
    _, dropped = relations.staleness(t.lineitem.withColumn("made", F.year("l_shipdate")), 1998, "made", 2, 1.5)
    return rounded(dropped, "mean")


@query("flt11_padding_excluded", "SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_linenumber <> 7")
def unpadded(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("is_padding", F.col("l_linenumber") == 7)
    return rows.where(~F.col("is_padding")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


RUNS = """WITH {ROLLOUTS}, b AS (SELECT prompt_id, sample_id, format_ok AS ok, response_tokens + 3 AS t FROM d) """


def baseline(t: Tables) -> DataFrame:
    return t.unique.select("prompt_id", "sample_id", "answer", F.col("format_ok").alias("is_correct"), (F.col("response_tokens") + 3).alias("response_tokens"))


@query("jon1_compare_runs", RUNS + "SELECT d.prompt_id, d.sample_id, d.is_correct, b.ok AS base_is_correct FROM d JOIN b USING (prompt_id, sample_id)")
def compare(t: Tables) -> DataFrame:
    return relations.compare_runs(t.unique.select("prompt_id", "sample_id", "answer", "is_correct"), baseline(t), ["prompt_id", "sample_id"], "answer", ["is_correct"]).select("prompt_id", "sample_id", "is_correct", "base_is_correct")


@query("agg30_transitions", RUNS + "SELECT b.ok AS before, d.is_correct AS after, count(*) AS n FROM d JOIN b USING (prompt_id, sample_id) GROUP BY ALL")
def moved(t: Tables) -> DataFrame:
    return relations.transitions(compare(t), F.col("base_is_correct"), F.col("is_correct"))


@query("agg31_token_delta", RUNS + "SELECT sum(d.response_tokens)::BIGINT AS tokens, sum(b.t)::BIGINT AS base_tokens, round(avg(d.response_tokens - b.t), 6) AS mean_delta FROM d JOIN b USING (prompt_id, sample_id)")
def token_delta(t: Tables) -> DataFrame:
    both = relations.compare_runs(t.unique.select("prompt_id", "sample_id", "answer", "response_tokens"), baseline(t), ["prompt_id", "sample_id"], "answer", ["response_tokens"])
    return both.agg(F.sum("response_tokens").alias("tokens"), F.sum("base_response_tokens").alias("base_tokens"), F.round(F.avg(F.col("response_tokens") - F.col("base_response_tokens")), 6).alias("mean_delta"))


@query("jon2_rescored_rows", RUNS + "SELECT prompt_id, sample_id, d.is_correct AS after, b.ok AS before FROM d JOIN b USING (prompt_id, sample_id)")
def rescored(t: Tables) -> DataFrame:
    rows = relations.beside(baseline(t).select("prompt_id", "sample_id", "is_correct"), t.unique.select("prompt_id", "sample_id", "is_correct"), ["prompt_id", "sample_id"])
    return rows.select("prompt_id", "sample_id", F.col("after.is_correct").alias("after"), F.col("before.is_correct").alias("before"))


@query("jon3_rescored_groups", """WITH {ROLLOUTS}, g AS (SELECT prompt_id, count_if(is_correct) c, count_if(format_ok) f, count(*) n FROM d GROUP BY 1), o AS (SELECT CASE WHEN f = 0 THEN 'all_wrong' WHEN f = n THEN 'all_correct' ELSE 'mixed' END AS before,
  CASE WHEN c = 0 THEN 'all_wrong' WHEN c = n THEN 'all_correct' ELSE 'mixed' END AS after FROM g) SELECT before, after, count(*) AS n FROM o GROUP BY ALL""")
def rescored_groups(t: Tables) -> DataFrame:
    after = groups.group_metrics(t.unique, ["prompt_id"]).select("prompt_id", "outcome")
    before = groups.group_metrics(t.unique.withColumn("is_correct", F.col("format_ok")), ["prompt_id"]).select("prompt_id", "outcome")
    return relations.transitions(relations.beside(before, after, ["prompt_id"]), F.col("before.outcome"), F.col("after.outcome"))


@query("jon4_prompt_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def lookup(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderpriority")


@query("jon6_repeat_prompts", "SELECT o_orderkey, rep::INT AS rep FROM orders, range(3) x(rep)")
@query("bal11_repeat", "SELECT o_orderkey, rep::INT AS rep FROM orders, range(3) x(rep)")
def repeated(t: Tables) -> DataFrame:
    return relations.repeat_rows(t.orders.select("o_orderkey"), 3, ["o_orderkey"]).select("o_orderkey", "rep")


@query("jon7_gather", "SELECT c_custkey, (c_custkey // 3)::BIGINT AS pos FROM customer WHERE c_custkey % 3 = 0")
def gathered(t: Tables) -> DataFrame:
    positions = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.floor(F.col("c_custkey") / 3).alias("pos"))
    return relations.gather(t.customer.select("c_custkey"), positions, "c_custkey").select("c_custkey", "pos")


@query("jon8_final_of_session", "SELECT l_orderkey, l_linenumber, l_partkey, first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS final_l_quantity FROM lineitem")
@query("win12_final_output", "SELECT l_orderkey, l_linenumber, l_partkey, first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS final_l_quantity FROM lineitem")
def final_output(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return advantages.final_of_session(rows, "l_orderkey", "l_orderkey", "at", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "final_l_quantity")


@query("jon9_semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50)")
def semi(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_quantity >= 50"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("jon10_by_source", "WITH {ROLLOUTS} SELECT dataset, round(avg(raw_reward), 6) AS score, count(*) AS n FROM r GROUP BY 1")
def source_means(t: Tables) -> DataFrame:
    return t.rollouts.groupBy("dataset").agg(F.round(F.avg("raw_reward"), 6).alias("score"), F.count("*").alias("n"))


@query("set1_union", "SELECT l_linestatus AS dataset, count(*) AS n FROM (SELECT * FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT * FROM lineitem) GROUP BY 1")
def union(t: Tables) -> DataFrame:
    return t.lineitem.where("l_linestatus = 'F'").unionByName(t.lineitem).groupBy(F.col("l_linestatus").alias("dataset")).agg(F.count("*").alias("n"))


@query("set2_interleave", "SELECT l_orderkey, l_linenumber, l_partkey, unnest(['chosen', 'rejected']) AS side FROM lineitem")
def interleave(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))).alias("side"))


@query("set3_key_difference", "SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def keys(t: Tables) -> DataFrame:
    return relations.key_difference(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"])


@query("set4_batch_equality", "SELECT 0::BIGINT AS only_a, count(*) AS only_b FROM lineitem WHERE l_linenumber = 1")
def equality(t: Tables) -> DataFrame:
    a, b = t.lineitem.where("l_linenumber <> 1"), t.lineitem
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))


@query("set6_removed", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def removed(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_quantity >= 50"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("ord2_first_n", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def first_n(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(25)


@query("ord5_equal_splits", "WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () // 7 AS size FROM orders) SELECT o_orderkey, rn // size AS split FROM x WHERE rn // size < 7")
def splits(t: Tables) -> DataFrame:
    return relations.equal_splits(t.orders.select("o_orderkey"), 7, ["o_orderkey"]).select("o_orderkey", "split")


@query("ord6_percent_slice", "WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM x WHERE rn < floor(n * 0.75)")
def head(t: Tables) -> DataFrame:
    return relations.percent_slice(t.orders.select("o_orderkey"), 0, 75, ["o_orderkey"]).select("o_orderkey")


@query("ord8_all_by_score", "SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END, 0) DESC, o_orderkey) AS place FROM orders")
def all_by_score(t: Tables) -> DataFrame:
    score = F.coalesce(F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")), F.lit(0.0))
    rows = relations.numbered(t.orders.select("o_orderkey", (F.lit(0.0) - score).alias("s")), ["s", "o_orderkey"], "place")
    return rows.select("o_orderkey", (F.col("place") + 1).alias("place"))


@query("ord9_oldest_first", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40")
def oldest(t: Tables) -> DataFrame:
    return t.orders.orderBy("o_orderdate", "o_orderkey").limit(40).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("ord11_mixture", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= CASE o_orderpriority WHEN '1-URGENT' THEN 60 WHEN '5-LOW' THEN 40 ELSE 0 END")
def mixture(t: Tables) -> DataFrame:
    return relations.quotas(t.orders, "o_orderpriority", {"1-URGENT": 60, "5-LOW": 40}, ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("ord12_mini_batches", "SELECT o_orderkey, epoch::INT AS epoch, (row_number() OVER (PARTITION BY epoch ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders, range(2) x(epoch)")
def mini_batches(t: Tables) -> DataFrame:
    rows = relations.numbered(t.orders.select("o_orderkey"), ["o_orderkey"]).withColumn("batch", F.floor(F.col("rn") / 64))
    return rows.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("epoch"), "batch")


@query("bal10_chunks", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS chunk FROM orders")
def chunks(t: Tables) -> DataFrame:
    return relations.numbered(t.orders.select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", F.floor(F.col("rn") / 100).alias("chunk"))


@query("bal8_padding", "WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, false AS is_padding FROM x UNION ALL SELECT o_orderkey, true FROM x WHERE rn < (7 - n % 7) % 7")
def padded(t: Tables) -> DataFrame:
    return relations.pad_to_multiple(t.orders.select("o_orderkey"), 7, ["o_orderkey"])


@query("bal9_synthetic_padding", "SELECT count(*) + (64 - count(*) % 64) % 64 AS n, (64 - count(*) % 64) % 64 AS padding FROM orders")
def synthetic(t: Tables) -> DataFrame:
    n = t.orders.agg(F.count("*").alias("c"))
    rows = n.select(F.explode(F.sequence(F.lit(1), F.greatest(F.pmod(-F.col("c"), F.lit(64)), F.lit(1)))).alias("i"), F.pmod(-F.col("c"), F.lit(64)).alias("p")).where("i <= p").select(F.lit(None).cast("long").alias("o_orderkey"), F.lit(True).alias("is_padding"))
    both = t.orders.select("o_orderkey", F.lit(False).alias("is_padding")).unionByName(rows)
    return both.agg(F.count("*").alias("n"), F.count_if("is_padding").alias("padding"))


@query("bal12_prefix_groups", "WITH {ROLLOUTS} SELECT prompt_id, count(*) AS n, array_to_string(list(sample_id::VARCHAR ORDER BY sample_id), ',') AS members FROM d GROUP BY 1")
def prefix_groups(t: Tables) -> DataFrame:
    members = F.array_join(F.transform(F.sort_array(F.collect_list("sample_id")), lambda x: x.cast("string")), ",")
    return t.unique.groupBy("prompt_id").agg(F.count("*").alias("n"), members.alias("members"))


@query("bal1_workload", "SELECT l_orderkey, sum(24576 * l_quantity::BIGINT + l_quantity::BIGINT * l_quantity::BIGINT)::BIGINT AS work FROM lineitem GROUP BY 1")
def work(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(balance.workload(F.col("l_quantity").cast("long"))).alias("work"))


def batches(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_orderkey") % 10).alias("batch"), F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("uid"), F.round("o_totalprice").cast("long").alias("length"))


EVERY = "SELECT o_orderkey % 10 AS batch, count(*) AS n, least(count(*), 4) AS parts, true AS balanced FROM orders GROUP BY 1"


def balanced(t: Tables, parts: DataFrame, slack: int) -> DataFrame:
    g = parts.join(batches(t), ["batch", "row"]).groupBy("batch", "part").agg(F.count("*").alias("n"), F.sum("length").alias("s"), F.max("length").alias("x"))
    return g.groupBy("batch").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), ((F.max("s") - F.min("s")) <= slack * F.max("x")).alias("balanced"))


@query("bal2_differencing", EVERY)
def differencing(t: Tables) -> DataFrame:
    return balanced(t, balance.partition(batches(t), "batch", "row", "length", 4), 1)


@query("bal3_greedy", EVERY)
def greedy(t: Tables) -> DataFrame:
    return balanced(t, balance.partition(batches(t), "batch", "row", "length", 4, method="greedy"), 1)


@query("bal7_uid_partition", "SELECT o_orderkey % 10 AS batch, count(*) AS n, 0::BIGINT AS torn FROM orders GROUP BY 1")
def uid_partition(t: Tables) -> DataFrame:
    parts = balance.grouped_partition(batches(t), "batch", "uid", "row", "length", 4).join(batches(t), ["batch", "row"])
    g = parts.groupBy("batch", "uid").agg(F.count_distinct("part").alias("p"), F.count("*").alias("n"))
    return g.groupBy("batch").agg(F.sum("n").alias("n"), F.count_if(F.col("p") > 1).alias("torn"))


@query("agg37_imbalance", "WITH x AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS c, round(o_totalprice)::BIGINT AS l FROM orders), s AS (SELECT c, sum(l)::BIGINT t FROM x GROUP BY 1) SELECT min(t) AS min, max(t) AS max, max(t) - min(t) AS gap FROM s")
def imbalance(t: Tables) -> DataFrame:
    rows = relations.numbered(t.orders.select("o_orderkey", F.round("o_totalprice").cast("long").alias("l")), ["o_orderkey"])
    s = rows.groupBy(F.floor(F.col("rn") / 100).alias("c")).agg(F.sum("l").alias("t"))
    return s.agg(F.min("t").alias("min"), F.max("t").alias("max"), (F.max("t") - F.min("t")).alias("gap"))


@query("agg36_correct_histogram", "WITH {ROLLOUTS}, g AS (SELECT prompt_id, count_if(is_correct)::BIGINT c, count(*) n FROM d GROUP BY 1) SELECT n, c AS n_correct, count(*) AS groups FROM g GROUP BY ALL")
def histogram(t: Tables) -> DataFrame:
    return groups.group_metrics(t.unique, ["prompt_id"]).groupBy("n", "n_correct").agg(F.count("*").alias("groups"))


@query("rwd1_reward", "SELECT l_orderkey, l_linenumber, l_partkey, round((CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + (CASE WHEN l_tax < 0.04 THEN 0.1 ELSE 0 END) - 0.001 * l_quantity, 6) AS reward FROM lineitem")
def rewards(t: Tables) -> DataFrame:
    r = text.reward(F.col("l_returnflag") == "R", F.col("l_tax") < 0.04, F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(r, 6).alias("reward"))


@query("rwd2_overlong", "SELECT l_orderkey, l_linenumber, l_partkey, round(least(-(l_quantity - 40) / 10 * 0.5, 0), 6) + 0.0 AS penalty FROM lineitem")
def overlong(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.round(text.overlong_penalty(F.col("l_quantity"), 50, 10, 0.5), 6) + 0.0).alias("penalty"))


@query("rwd4_finish_reason", "SELECT CASE WHEN l_quantity >= 50 THEN 'length' ELSE 'eos' END AS finish_reason, count(*) AS n FROM lineitem GROUP BY 1")
def finish(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(text.finish_reason(F.col("l_quantity") >= 50).alias("finish_reason")).agg(F.count("*").alias("n"))


@query("rwd6_index_pairs", "WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) SELECT o_orderkey, rn // 8 AS prompt_index, rn % 8 AS sample_index FROM x")
def index_pairs(t: Tables) -> DataFrame:
    rows = relations.numbered(t.orders.select("o_orderkey"), ["o_orderkey"])
    return rows.select("o_orderkey", F.floor(F.col("rn") / 8).alias("prompt_index"), (F.col("rn") % 8).alias("sample_index"))


BEST = """WITH x AS (SELECT l_returnflag, l_orderkey, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity {dir}) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
SELECT l_orderkey, round(sum(v * (pow(i / m, 2) - pow((i - 1) / m, 2))), 5) AS {n}_at_2, round(sum(v * (pow(i / m, 4) - pow((i - 1) / m, 4))), 5) AS {n}_at_4 FROM x GROUP BY 1"""


@query("agg22_expected_best", BEST.replace("{dir}", "").replace("{n}", "best"))
def best(t: Tables) -> DataFrame:
    return validation.expected_best(t.lineitem, ["l_orderkey"], "l_quantity", (2, 4)).select("l_orderkey", F.round("best_at_2", 5).alias("best_at_2"), F.round("best_at_4", 5).alias("best_at_4"))


@query("agg22_expected_worst", BEST.replace("{dir}", "DESC").replace("{n}", "worst"))
def worst(t: Tables) -> DataFrame:
    return validation.expected_best(t.lineitem, ["l_orderkey"], "l_quantity", (2, 4), worst=True).select("l_orderkey", F.round("worst_at_2", 5).alias("worst_at_2"), F.round("worst_at_4", 5).alias("worst_at_4"))


@query("agg22_bootstrap")
def bootstrap(t: Tables) -> DataFrame:
    return validation.bootstrap(t.events, ["user_id"], "value", 4)


@query("agg23_majority", """WITH v AS (SELECT user_id, event_type, count(*) c, min(event_id) p, min_by(value, event_id) v FROM events GROUP BY 1, 2) SELECT user_id, round(max_by(v, (c, -p)), 6) AS majority FROM v GROUP BY 1""")
def majority(t: Tables) -> DataFrame:
    return rounded(validation.majority(t.events, ["user_id"], "event_type", "value", "event_id"), "majority")


@query("agg24_validation", """WITH l AS (SELECT event_type, user_id, 'value' AS variable, value FROM events UNION ALL SELECT event_type, user_id, 'half', value / 2 FROM events), g AS (SELECT event_type, variable, user_id, avg(value) m, stddev_pop(value) s, count(*) n FROM l WHERE value IS NOT NULL GROUP BY ALL)
SELECT event_type, variable, round(avg(m), 5) AS mean, round(avg(s), 5) AS std, max(n) AS n_max, count(*) AS prompts FROM g GROUP BY ALL""")
def validation_stats(t: Tables) -> DataFrame:
    out = validation.by_prompt_then_source(t.events.withColumn("half", F.col("value") / 2), "event_type", "user_id", ["value", "half"])
    return out.withColumns({"mean": F.round("mean", 5), "std": F.round("std", 5)})


NAMES = "SELECT CASE event_type WHEN 'click' THEN 'loss/max' WHEN 'view' THEN 'len/min' ELSE 'mean_' || event_type END AS name, value, event_id FROM events"


def named(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.events.select(F.when(e == "click", "loss/max").when(e == "view", "len/min").otherwise(F.concat(F.lit("mean_"), e)).alias("name"), "value", "event_id", (F.col("user_id") % 4).alias("rank"), (F.col("event_id") % 50).alias("step"))


@query("agg25_reduce_by_name", f"WITH m AS ({NAMES}) SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM m GROUP BY 1")
def reduced(t: Tables) -> DataFrame:
    return rounded(validation.reduce_by_name(named(t), "name", "value"), "value")


@query("agg26_across_ranks", "WITH p AS (SELECT event_id % 50 AS step, user_id % 4 AS rank, avg(value) v FROM events GROUP BY ALL) SELECT step, round(avg(v), 3) AS value FROM p GROUP BY 1")
def ranks(t: Tables) -> DataFrame:
    return validation.across_ranks(named(t), "step", "rank", "value", "mean").withColumn("value", F.round("value", 3))


@query("agg27_rules", f"WITH m AS ({NAMES}) SELECT name, CASE WHEN contains(name, 'mean') THEN 'avg' WHEN contains(name, 'max') THEN 'max' ELSE 'min' END AS rule, round(CASE WHEN contains(name, 'mean') THEN avg(value) WHEN contains(name, 'max') THEN max(value) ELSE min(value) END, 6) AS value FROM m GROUP BY 1")
def rules(t: Tables) -> DataFrame:
    return rounded(validation.by_rules(named(t), "name", "value", "event_id"), "value")


@query("agg28_batch_assembly", "SELECT event_type, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95, round(quantile_cont(value, 0.99), 5) AS p99, round(avg((value > 50)::INT), 6) AS partial_ratio, count(DISTINCT user_id % 16) AS versions FROM events GROUP BY 1")
def assembly(t: Tables) -> DataFrame:
    q = lambda p: F.round(F.percentile("value", p), 5)
    return t.events.groupBy("event_type").agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("partial_ratio"), F.count_distinct(F.col("user_id") % 16).alias("versions"))


@query("agg38_rank_timing", "WITH q AS (SELECT event_type, quantile_cont(value, 0.9) t FROM events GROUP BY 1) SELECT event_type, round(avg(value), 5) AS mean, round(avg((value > t)::INT), 6) AS tail, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events JOIN q USING (event_type) GROUP BY 1")
def rank_timing(t: Tables) -> DataFrame:
    q = t.events.groupBy("event_type").agg(F.percentile("value", 0.9).alias("t"))
    g = t.events.join(q, "event_type").groupBy("event_type").agg(F.round(F.avg("value"), 5).alias("mean"), F.avg((F.col("value") > F.col("t")).cast("int")).alias("tail"), F.min("value").alias("min"), F.max("value").alias("max"))
    return rounded(g, "tail", "min", "max")


@query("agg39_running_tokens", """WITH s AS (SELECT o_orderdate::DATE AS day, count(*) AS tokens FROM orders GROUP BY 1) SELECT day, tokens, sum(tokens) OVER (ORDER BY day)::BIGINT AS total_tokens FROM s""")
def running(t: Tables) -> DataFrame:
    return relations.cumulative(t.orders.select(F.col("o_orderdate").cast("date").alias("day"), F.lit(1).cast("long").alias("tokens")), "day", ["tokens"])


@query("str4_latest_status", "SELECT user_id, max_by(event_type, event_id) AS status, max(event_id) AS at FROM events GROUP BY 1")
@query("win13_last_value", "SELECT user_id, max_by(event_type, event_id) AS status, max(event_id) AS at FROM events GROUP BY 1")
def latest(t: Tables) -> DataFrame:
    return relations.latest_status(t.events, ["user_id"], "event_type", "event_id")


@query("str7_upsert", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def upserted(t: Tables) -> DataFrame:
    return relations.upsert(t.events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("flt12_leakage", "WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM documents) SELECT doc_id FROM n WHERE doc_id % 2 = 0 AND k IN (SELECT k FROM n WHERE doc_id % 2 = 1)")
def leakage(t: Tables) -> DataFrame:
    return relations.leaked(t.documents.where("doc_id % 2 = 0"), t.documents.where("doc_id % 2 = 1"), "text").select("doc_id")
