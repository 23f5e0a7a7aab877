"""Queries over normal forms, user functions, batches and composite runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.functions import answers, normalize, text
from rolloom.operators import balance, groups, relations, rewards
from rolloom.plans.registry import Tables, query
from rolloom.plans.rollout_queries import rounded


@query("nrm1_final_answer", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '\\frac{1}{' || (doc_id % 9) || '}' WHEN 1 THEN '1' || lpad((doc_id % 9)::VARCHAR, 3, '0') WHEN 2 THEN '\\sqrt{3}' ELSE (doc_id % 9)::VARCHAR END AS answer FROM documents")
def final_answers(t: Tables) -> DataFrame:
    k, d = F.col("doc_id") % 4, (F.col("doc_id") % 9).cast("string")
    x = F.when(k == 0, F.concat(F.lit("x = \\frac1"), d)).when(k == 1, F.concat(F.lit("1,"), F.lpad(d, 3, "0"), F.lit(" dollars"))).when(k == 2, "$\\sqrt3$").otherwise(F.concat(F.lit("\\boxed{\\text{"), d, F.lit("}} square feet")))
    return t.documents.select("doc_id", normalize.final_answer(x).alias("answer"))


@query("scr3_line_scorer", "SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 1 ELSE -1 END::DOUBLE AS score, (doc_id % 5)::VARCHAR AS pred FROM documents")
def line_scores(t: Tables) -> DataFrame:
    r = F.concat(F.col("text"), F.lit("\nAnswer: 9\nanswer : $"), (F.col("doc_id") % 5).cast("string"), F.lit("$ units\n"))
    return t.documents.select("doc_id", normalize.line_score(r, F.lit("2")).alias("x")).select("doc_id", "x.score", "x.pred")


@query("nrm4_all_quantities", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (doc_id % 9 * 1000)::VARCHAR WHEN 1 THEN '5*10^6' ELSE '7+3/4' END AS answer FROM documents")
def all_quantities(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    x = F.when(k == 0, F.concat((F.col("doc_id") % 9).cast("string"), F.lit(",000"))).when(k == 1, "\\text{$5million}").otherwise("7 3/4")
    return t.documents.select("doc_id", normalize.plain_quantity(x).alias("answer"))


@query("nrm6_arithmetic", "SELECT doc_id, round((doc_id % 9) * 2 + 0.5, 6)::DOUBLE AS value FROM documents")
def arithmetic(t: Tables) -> DataFrame:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(normalize.safe_arithmetic)

    return t.documents.select("doc_id", F.round(run(F.concat((F.col("doc_id") % 9).cast("string"), F.lit("*(1+1)+2^(0-1)"))), 6).alias("value"))


@query("ext8_marked_answer", "SELECT doc_id, true AS matched, (doc_id % 9)::VARCHAR AS answer FROM documents")
def marked(t: Tables) -> DataFrame:
    r = F.concat(F.lit("We find. The answer is x = "), (F.col("doc_id") % 9).cast("string"))
    return t.documents.select("doc_id", normalize.marked_answer_column(r).alias("x")).select("doc_id", "x.matched", "x.answer")


@query("ext3_exact_numbers", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '1/2' WHEN 1 THEN '1200' ELSE '1/4' END AS value FROM documents")
def numbers(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    r = F.concat(F.lit("Answer: "), F.when(k == 0, "$0.5$").when(k == 1, "\\$1,200").otherwise("25\\%"))
    return t.documents.select("doc_id", answers.extract_column(r)["value"].alias("value"))


@query("nrm2_latex_spelling", "SELECT doc_id, '\\frac{1}{2}' AS answer FROM documents")
def spelled(t: Tables) -> DataFrame:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(answers.tidy_latex)

    k = F.col("doc_id") % 4
    return t.documents.select("doc_id", run(F.when(k == 0, "0.5").when(k == 1, "\\dfrac12").when(k == 2, "x = 1/2").otherwise("\\left\\tfrac{1}{2}")).alias("answer"))


@query("scr5_graded", "SELECT doc_id, (doc_id % 2 = 0) AS correct FROM documents")
def prime_graded(t: Tables) -> DataFrame:
    r = F.concat(F.lit("\\boxed{(1,"), (F.col("doc_id") % 2).cast("string"), F.lit(".0)}"))
    return t.documents.select("doc_id", answers.prime_score_column(r, F.lit("(1, 0)"))["correct"].alias("correct"))


@query("scr5_triples", "SELECT doc_id, doc_id % 3 < 2 AS correct, doc_id % 3 <> 1 AS format, CASE doc_id % 3 WHEN 0 THEN '7' WHEN 1 THEN '6.28' ELSE '9' END AS pred FROM documents")
def prime_triples(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    r = F.when(k == 0, "\\boxed{7}").when(k == 1, "The answer is 6.28").otherwise("Step 2: \\boxed{9}")
    return t.documents.select("doc_id", answers.prime_score_column(r, F.when(k == 1, "2\\pi").otherwise("7")).alias("x")).select("doc_id", "x.correct", "x.format", "x.pred")


@query("scr12_adapter", "SELECT CASE WHEN source IN ('src1', 'src2') THEN 'numbers' ELSE 'latex' END AS reward_source, round(avg((doc_id % 3 = 0)::INT), 6) AS acc, count(*) AS n FROM documents GROUP BY 1")
def adapted(t: Tables) -> DataFrame:
    x = answers.verify_column(F.concat(F.lit("\\boxed{"), (F.col("doc_id") % 3).cast("string"), F.lit("}")), F.lit("0"))
    kind = F.when(F.col("source").isin("src1", "src2"), "numbers").otherwise("latex")
    return t.documents.select(kind.alias("reward_source"), x.alias("x")).groupBy("reward_source").agg(F.round(F.avg(F.col("x.correct").cast("int")), 6).alias("acc"), F.count("*").alias("n"))


@query("udf1_custom_reward", "SELECT doc_id, (n_chars % 10)::DOUBLE AS score FROM documents")
def custom(t: Tables) -> DataFrame:
    run = rewards.custom_reward(lambda source, response, truth, extra: {"score": int(truth) % 10}, on_error="null")
    return t.documents.select("doc_id", run(F.col("source"), F.col("lang"), F.col("n_chars"), F.lit(None).cast("string"))["score"].alias("score"))


@query("udf2_managers", "SELECT doc_id, round(1 + least(-(n_chars - 3000) / 1000.0, 0), 6)::DOUBLE AS score FROM documents")
def managed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(rewards.MANAGERS["overlong"](F.lit(1.0), F.col("n_chars"), max_length=4000, buffer=1000), 6).alias("score"))


@query("udf6_custom_aggregate", "SELECT source, round(sum(n_chars) / 2.0, 3)::DOUBLE AS value FROM documents GROUP BY 1")
def custom_aggregate(t: Tables) -> DataFrame:
    @F.pandas_udf("double")
    def half(x: pd.Series) -> float:
        return float(x.sum()) / 2

    return t.documents.groupBy("source").agg(F.round(half("n_chars"), 3).alias("value"))


@query("udf7_generator", "SELECT doc_id, unnest(range(doc_id % 3)) AS session_id FROM documents")
def generator(t: Tables) -> DataFrame:
    return t.documents.where("doc_id % 3 > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3 - 1)).alias("session_id"))


@query("ord4_head_samples", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 30")
def head_samples(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy("doc_id").limit(30)


@query("ord10_resumed_sampler", "SELECT doc_id FROM documents ORDER BY md5(doc_id || ':3'), doc_id LIMIT 40 OFFSET 20")
def resumed(t: Tables) -> DataFrame:
    key = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":3")))
    return t.documents.select("doc_id", key.alias("k")).orderBy("k", "doc_id").offset(20).limit(40).select("doc_id")


@query("bal5_all_micro_batches", "WITH x AS (SELECT l_quantity::BIGINT AS q, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1) // 256 AS step FROM lineitem) SELECT step, count(*) AS n, sum(q)::BIGINT AS tokens, true AS fits FROM x GROUP BY 1")
def all_micro(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
    rows = relations.numbered(t.lineitem.select(*order), order).select(F.floor(F.col("rn") / 256).alias("step"), "rn", F.col("l_quantity").cast("long").alias("length"))
    micro = balance.micro_batched(rows, "step", "rn", "length", 400).groupBy("step", "micro").agg(F.count("*").alias("k"), F.sum("length").alias("s"))
    return micro.groupBy("step").agg(F.sum("k").alias("n"), F.sum("s").alias("tokens"), (F.max("s") <= 400).alias("fits"))


@query("bal13_dense_flops", "SELECT l_linestatus AS status, round((6 * 7e9 * sum(l_quantity) + 12.0 * 28 * 3584 * sum(l_quantity) * avg(l_quantity)) / 1e15, 4) AS petaflops FROM lineitem GROUP BY 1")
def flops(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy(F.col("l_linestatus").alias("status")).agg(F.sum("l_quantity").alias("s"), F.avg("l_quantity").alias("m"))
    return g.select("status", F.round(rewards.dense_flops(F.col("s"), 7e9, 28, 3584, F.col("m")) / 1e15, 4).alias("petaflops"))


@query("str_window_sliding", "SELECT epoch(w)::BIGINT AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1")
def sliding(t: Tables) -> DataFrame:
    from rolloom.streaming.streams import windowed

    out = windowed(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "1 hour", "0 seconds", "30 minutes")
    return out.select(F.unix_timestamp("start").alias("start"), "n")


@query("pip6_run_summary", "WITH {ROLLOUTS}, s AS (SELECT 'gpu/util' AS name, avg(l_discount * 100) AS value FROM lineitem UNION ALL SELECT 'pass@1', avg(raw_reward) FROM d WHERE sample_id = 1) SELECT name, round(value, 5) AS value FROM s")
def summary(t: Tables) -> DataFrame:
    gpu = t.lineitem.agg(F.avg(F.col("l_discount") * 100).alias("value")).select(F.lit("gpu/util").alias("name"), "value")
    first = t.unique.where("sample_id = 1").agg(F.avg("raw_reward").alias("value")).select(F.lit("pass@1").alias("name"), "value")
    return gpu.unionByName(first).withColumn("value", F.round("value", 5))


@query("ord1_all_sorted_groups", "WITH {ROLLOUTS} SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) AS place FROM (SELECT DISTINCT prompt_id FROM r)")
def all_sorted_groups(t: Tables) -> DataFrame:
    g = groups.group_metrics(t.unique, ["prompt_id"]).select("prompt_id")
    return relations.numbered(g, ["prompt_id"], "place").select("prompt_id", (F.col("place") + 1).alias("place"))


@query("src25_collected_responses", "SELECT l_orderkey, array_to_string(list(l_quantity::BIGINT::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), ',') AS responses FROM lineitem GROUP BY 1")
def collected(t: Tables) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["q"].cast("string")), ",").alias("responses"))


@query("prj10_lists", "SELECT vec_id, len(embedding)::INT AS n, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def lists(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.size("embedding").alias("n"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))
