"""Queries over texts, logs and events: extraction, scoring, sources and step metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.functions import answers, text
from rolloom.operators import groups, relations
from rolloom.plans.registry import Tables, query
from rolloom.sources import files

#: The generated texts hold no answers, so responses are put together: a text, a hash answer, a box and tags.
RESPONSE = "text || ' so 12.5, #### ' || n_chars || ',000 and \\boxed{' || (doc_id % 7) || '} <answer> The ' || lang || '! </answer>'"
R = f"WITH r AS (SELECT doc_id, lang, source, n_chars, {RESPONSE} AS response FROM documents) "


def responses(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", "lang", "source", "n_chars",
        F.concat("text", F.lit(" so 12.5, #### "), F.col("n_chars").cast("string"), F.lit(",000 and \\boxed{"), (F.col("doc_id") % 7).cast("string"), F.lit("} <answer> The "), "lang", F.lit("! </answer>")).alias("response"))


@query("ext6_hash_answer", R + "SELECT doc_id, n_chars || '000' AS strict, (doc_id % 7)::VARCHAR AS flexible FROM r")
def hash_answers(t: Tables) -> DataFrame:
    return responses(t).select("doc_id", text.hash_answer(F.col("response")).alias("strict"), text.last_number(F.col("response")).alias("flexible"))


@query("src27_case_rates", "SELECT round(avg((doc_id % 3 < 2)::INT), 6) AS strict_accuracy, round(avg((doc_id % 3 <> 1)::INT), 6) AS flexible_accuracy, round(avg((doc_id % 3 = 2)::INT), 6) AS format_error_rate FROM documents")
def case_rates(t: Tables) -> DataFrame:
    k, n = F.col("doc_id") % 3, F.col("n_chars").cast("string")
    r = F.when(k == 0, F.concat(F.lit("#### "), n)).when(k == 1, F.concat(F.lit("####"), n, F.lit(" or 0"))).otherwise(F.concat(F.lit("so "), n))
    case = text.sampled_case(F.concat("text", F.lit(" "), r), n)
    out = t.documents.select(case.alias("x")).agg(*text.case_rates(F.col("x")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("ext7_tagged_answer", R + "SELECT doc_id, 'The ' || lang || '!' AS answer FROM r")
def tagged(t: Tables) -> DataFrame:
    return responses(t).select("doc_id", text.tagged_answer(F.col("response")).alias("answer"))


@query("ext4_boxed", "SELECT doc_id, '{' || (doc_id % 7) || '}x' AS last, 2::INT AS n FROM documents")
def boxes(t: Tables) -> DataFrame:
    full = F.concat(F.lit("a \\boxed{1} b \\boxed{{"), (F.col("doc_id") % 7).cast("string"), F.lit("}x} c \\boxed{open"))
    found = text.boxed(full)
    return t.documents.select("doc_id", F.element_at(found, -1).alias("last"), F.size(found).alias("n"))


@query("nrm5_normalized", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(url), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS answer FROM pages")
def normalized(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.normalized_answer(F.col("url")).alias("answer"))


@query("scr2_hash_scorer", R + "SELECT source, round(avg(CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0.1 END), 6) AS score FROM r GROUP BY 1")
def scored(t: Tables) -> DataFrame:
    gold = F.when(F.col("n_chars") % 2 == 0, F.concat(F.col("n_chars").cast("string"), F.lit("000"))).otherwise("none")
    got = text.hash_answer(F.col("response"))
    score = F.when(got.isNull(), 0.0).when(got == gold, 1.0).otherwise(0.1)
    return responses(t).groupBy("source").agg(F.round(F.avg(score), 6).alias("score"))


@query("scr6_exact_match", R + "SELECT lang, round(avg((lang IN ('en', 'fr'))::INT), 6) AS score, count(*) AS n FROM r GROUP BY 1")
def matched(t: Tables) -> DataFrame:
    score = text.exact_match(text.tagged_answer(F.col("response")), F.array(F.lit("the EN."), F.lit("Fr")))
    return responses(t).groupBy("lang").agg(F.round(F.avg(score), 6).alias("score"), F.count("*").alias("n"))


@query("scr7_format_score", R + "SELECT doc_id, round(0.9 * (doc_id % 7 = 3)::INT + 0.1 * (doc_id % 2)::INT, 6) AS score FROM r")
def formatted(t: Tables) -> DataFrame:
    whole = F.concat(F.when(F.col("doc_id") % 2 == 1, F.lit("<think>x\n")).otherwise(F.lit("")), F.lit("</think>\\boxed{"), (F.col("doc_id") % 7).cast("string"), F.lit("}"))
    ok = whole.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$")
    return t.documents.select("doc_id", F.round(0.9 * (F.element_at(text.boxed(whole), -1) == "3").cast("int") + 0.1 * ok.cast("int"), 6).alias("score"))


@query("ext1_numeric_extraction", "SELECT CASE doc_id % 4 WHEN 0 THEN 'boxed' WHEN 1 THEN 'explicit_final' WHEN 2 THEN 'ambiguous' ELSE 'missing' END AS status, count(*) AS n FROM documents GROUP BY 1")
def extraction(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    r = F.when(k == 0, "so \\boxed{\\frac{1}{2}}").when(k == 1, "\\boxed{3}\nThe answer is 1,200.").when(k == 2, "\\boxed{1} or \\boxed{2}").otherwise("no number")
    return t.documents.select(answers.extract_column(r).alias("x")).groupBy("x.status").agg(F.count("*").alias("n"))


@query("ver1_verify", "SELECT CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'wrong_answer' WHEN 2 THEN 'invalid_ground_truth' ELSE 'missing_answer' END AS error, count(*) AS n FROM documents GROUP BY 1")
def verified(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    gold = F.when(k == 0, "0.5").when(k == 1, "2").when(k == 2, "x+y").otherwise("3")
    r = F.when(k == 3, "none").otherwise("\\boxed{\\frac{1}{2}}")
    return t.documents.select(answers.verify_column(r, gold).alias("x")).groupBy(F.coalesce("x.error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query("ver2_both_modes", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing_boxed_answer' ELSE 'boxed_answer_parse_error' END AS training, CASE WHEN doc_id % 3 < 2 THEN 'ok' ELSE 'answer_parse_error' END AS evaluation FROM documents")
def both_modes(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    r = F.when(k == 0, "\\boxed{7} then \\boxed{x}").when(k == 1, "The answer is 7").otherwise("\\boxed{x}")
    x = [answers.verify_mode_column(r, F.lit("7"), mode).alias(mode) for mode in ("training", "evaluation")]
    return t.documents.select("doc_id", *x).select("doc_id", *[F.coalesce(F.col(m)["error"], F.lit("ok")).alias(m) for m in ("training", "evaluation")])


@query("agg12_word_lengths", "SELECT source, round(avg(len(regexp_extract_all(text, '\\S+'))), 5) AS words FROM documents GROUP BY 1")
def word_lengths(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.round(F.avg(text.words(F.col("text"))), 5).alias("words"))


@query("agg9_text_lengths", "SELECT round(quantile_cont(n_chars, 0.5), 5) AS p50, round(quantile_cont(n_chars, 0.9), 5) AS p90, round(quantile_cont(n_chars, 0.95), 5) AS p95, round(avg((n_chars >= 5000)::INT), 6) AS truncated, round(avg(CASE WHEN quality = 1 THEN n_chars END), 4) AS correct_mean, round(avg(CASE WHEN quality = 0 THEN n_chars END), 4) AS incorrect_mean FROM documents JOIN labels USING (doc_id)")
def text_lengths(t: Tables) -> DataFrame:
    out = groups.length_metrics(t.documents.join(t.labels, "doc_id"), "n_chars", "quality", 5000)
    return out.select(*[F.round(c, 4 if "mean" in c else 6 if c == "truncated" else 5).alias(c) for c in out.columns])


@query("flt2_levels", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr')")
def levels(t: Tables) -> DataFrame:
    return t.documents.where(F.col("lang").isin("en", "fr")).select("doc_id")


@query("flt3_long_prompts", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\\S+')) <= 300")
def short_prompts(t: Tables) -> DataFrame:
    return t.documents.where(text.words(F.col("text")) <= 300).select("doc_id")


@query("flt4_nonempty", "SELECT doc_id FROM documents WHERE length(lang) > 0")
def nonempty(t: Tables) -> DataFrame:
    return t.documents.where(F.length("lang") > 0).select("doc_id")


@query("flt7_search", "SELECT event_id FROM events WHERE contains(props, '\"k\": 1') OR replace(event_id::VARCHAR, '-', '') = '42'")
def searched(t: Tables) -> DataFrame:
    return t.events.where(F.contains("props", F.lit('"k": 1')) | (F.replace(F.col("event_id").cast("string"), F.lit("-"), F.lit("")) == "42")).select("event_id")


@query("prj3_templates", "SELECT doc_id, 'Q: ' || lang || chr(10) || 'A {x}' AS prompt FROM documents")
def templated(t: Tables) -> DataFrame:
    filled = F.replace(F.replace(F.replace(F.lit("Q: {question}\nA {{x}}"), F.lit("{question}"), F.col("lang")), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    return t.documents.select("doc_id", filled.alias("prompt"))


@query("prj4_few_shot", "SELECT doc_id, 3::INT AS n, lang AS last FROM documents")
def few_shot(t: Tables) -> DataFrame:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    chat = F.concat(F.array(turn("user", F.lit("1+1?")), turn("assistant", F.lit("2"))), F.array(turn("user", F.col("lang"))))
    return t.documents.select("doc_id", F.size(chat).alias("n"), F.element_at(chat, -1)["content"].alias("last"))


@query("prj1_numbered_prompts", "SELECT doc_id, 'data-train-' || lpad(doc_id::VARCHAR, 6, '0') AS prompt_id FROM documents")
def prompt_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.format_string("data-%s-%06d", F.lit("train"), "doc_id").alias("prompt_id"))


@query("prj7_coalesced_truth", "SELECT doc_id, 'src_' || source AS data_source, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'gold') AS truth FROM documents")
def truths(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.lit("src_"), "source").alias("data_source"), F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit("gold")).alias("truth"))


@query("prj9_defaults", "SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS index FROM events")
def defaults(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("index"))


@query("prj11_columns", "SELECT doc_id, lang FROM documents")
def columns(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang")


@query("prj12_prefixed", "SELECT doc_id AS batch_doc_id, lang AS batch_lang FROM documents")
def prefixed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").withColumnsRenamed({"doc_id": "batch_doc_id", "lang": "batch_lang"})


@query("src18_metric_keys", "SELECT page_id, regexp_replace(regexp_replace(replace(url || '@2//x é', '@', '_at_'), '/+', '/', 'g'), '[^A-Za-z0-9_\\-. :/]', '_', 'g') AS key FROM pages")
def metric_keys(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.metric_key(F.concat("url", F.lit("@2//x é"))).alias("key"))


@query("src14_log_values", "SELECT 'critic/' || event_type AS key, round(max_by(value, event_id), 4) AS number FROM events GROUP BY 1")
def log_values(t: Tables) -> DataFrame:
    line = F.concat(F.lit("step {'critic/"), "event_type", F.lit("': "), F.col("value").cast("decimal(20,6)").cast("string"), F.lit(", 'other/x': 1}"))
    out = files.log_values(t.events.select("event_id", line.alias("value")), ("critic/", "actor/"), ["event_id"])
    return out.select("key", F.round("number", 4).alias("number"))


@query("src15_last_lines", "SELECT event_id, event_type AS value FROM events WHERE event_type ILIKE '%click%' ORDER BY event_id DESC LIMIT 20")
def last_lines(t: Tables) -> DataFrame:
    return files.last_lines(t.events.select("event_id", F.col("event_type").alias("value")), "CLICK", 20, "event_id")


@query("src26_metric_lines", "SELECT max(n_chars)::DOUBLE AS best FROM documents")
def metric_lines(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.create_map(F.lit("val/acc"), F.col("n_chars").cast("double"), F.lit("len"), F.lit(1.0)).alias("m"))
    return files.best_of_lines(files.metric_lines(rows, "doc_id", "m"), "val/acc")


@query("src16_step_log", "SELECT event_id % 20 AS step, count(*)::DOUBLE AS n, round(avg(value), 3) AS mean FROM events GROUP BY 1")
def step_log(t: Tables) -> DataFrame:
    g = t.events.groupBy((F.col("event_id") % 20).alias("step")).agg(F.create_map(F.lit("n"), F.count("*").cast("double"), F.lit("mean"), F.avg("value")).alias("data"))
    return g.select("step", F.col("data")["n"].alias("n"), F.round(F.col("data")["mean"], 3).alias("mean"))


@query("src20_generation_table", "WITH x AS (SELECT event_id % 20 AS step, event_id, event_type, row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id) i FROM events) SELECT step, max(CASE WHEN i = 1 THEN event_type END) AS event_type_1, max(CASE WHEN i = 2 THEN event_type END) AS event_type_2 FROM x GROUP BY 1")
def generation_table(t: Tables) -> DataFrame:
    return files.generation_table(t.events.withColumn("step", F.col("event_id") % 20), "step", "event_id", ["event_type"], 2)


@query("src4_load_many", "SELECT count(*) * 2 AS n FROM documents")
def load_many(t: Tables) -> DataFrame:
    path = f"{t.sf_dir}/documents.parquet"
    return files.load_tables(t.spark, [path, path]).agg(F.count("*").alias("n"))


@query("str6_reward_of_session", "SELECT conv_id, turn, role, max_by(length(text), (turn, role, text)) OVER (PARTITION BY conv_id) AS final_score FROM conversations")
def session_reward(t: Tables) -> DataFrame:
    w = relations.Window.partitionBy("conv_id")
    return t.conversations.select("conv_id", "turn", "role", F.max_by(F.length("text"), F.struct("turn", "role", "text")).over(w).cast("long").alias("final_score"))


@query("str11_by_version", "SELECT event_id // 500 AS version, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def by_version(t: Tables) -> DataFrame:
    return t.events.groupBy(F.floor(F.col("event_id") / 500).alias("version"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("str_window_tumbling", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def tumbling(t: Tables) -> DataFrame:
    g = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return g.select(F.unix_timestamp("window.start").alias("start"), "n", "total")
