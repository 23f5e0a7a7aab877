"""Queries over conversations: chat assembly, pairs, continuous streams and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions import turns
from rolloom.plans.registry import Tables, query

TEMPLATE = turns.Template()

#: One row per id of a conversation in SQL: c(conv_id, turn, role, i, id, loss); a header of three ids, the characters, an end.
CHARACTERS = """WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS t FROM conversations), p AS (
  SELECT conv_id, t, role, list_concat(list_concat([1, CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 12 WHEN 'assistant' THEN 13 WHEN 'tool' THEN 14 ELSE 0 END, 2], list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: unicode(x))), [3]) AS ids FROM m
), c AS (SELECT conv_id, t, role, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, i) - 1 AS pos, (role = 'assistant' AND i >= 3)::INT AS loss FROM c) """


def conversations(t: Tables) -> DataFrame:
    kept = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    g = t.conversations.groupBy("conv_id").agg(kept.alias("k"))
    return g.select("conv_id", F.transform("k", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("turns"))


def total(c: str) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


@query("tok14_chat_tokens", CHARACTERS + "SELECT conv_id, count(*) AS n, sum(id)::BIGINT AS id_sum, sum(loss)::BIGINT AS trained, sum(id * loss)::BIGINT AS trained_sum FROM n GROUP BY 1")
def _(t: Tables) -> DataFrame:
    x = conversations(t).select("conv_id", turns.assembled(F.col("turns"), TEMPLATE, turns.character_ids).alias("x")).select("conv_id", "x.*")
    both = F.zip_with("ids", "loss", lambda a, b: a * b)
    return x.select("conv_id", F.size("ids").cast("long").alias("n"), total("ids").alias("id_sum"), total("loss").alias("trained"), F.aggregate(both, F.lit(0).cast("long"), lambda a, v: a + v).alias("trained_sum"))


@query("tok14_padded", CHARACTERS + "SELECT conv_id, 200::BIGINT AS n, sum(id) FILTER (pos < 200)::BIGINT AS id_sum, least(count(*), 200) AS attended, (sum(pos) FILTER (pos < 200))::BIGINT AS positions, coalesce(sum(loss) FILTER (pos < 200), 0)::BIGINT AS trained FROM n GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Cut or padded to 200 ids."""
    x = conversations(t).select("conv_id", turns.assembled(F.col("turns"), TEMPLATE, turns.character_ids, 200).alias("x")).select("conv_id", "x.*")
    return x.select("conv_id", F.size("ids").cast("long").alias("n"), total("ids").alias("id_sum"), total("attention").alias("attended"), total("positions").alias("positions"), total("loss").alias("trained"))


@query("tok14_repeated_system", "SELECT conv_id, 7 + length(coalesce(text, '')) + 7 AS n FROM (SELECT conv_id, min_by(coalesce(text, ''), (turn, role, text)) AS text FROM conversations GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    """A system prompt that comes again is dropped."""
    first = F.col("turns")[0]["content"]
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    talk = F.array(say("system", F.lit("abc")), say("user", first), say("system", F.lit("abc")))
    x = conversations(t).select("conv_id", turns.assembled(talk, TEMPLATE, turns.character_ids)["ids"].alias("ids"))
    return x.select("conv_id", (F.size("ids") + 3).cast("long").alias("n"))


@query("tok15_pair_encoding", """SELECT doc_id, least(length(lang || source) + 1, 9)::BIGINT AS chosen, least(length(lang || lang) + 1, 9)::BIGINT AS rejected, 18::BIGINT AS width, list_sum(list_transform(list_filter(string_split(lang || source, ''), lambda x: x <> '')[1:9], lambda x: unicode(x)))::BIGINT
  + CASE WHEN length(lang || source) < 9 THEN 7 ELSE 0 END AS chosen_sum FROM documents""")
def _(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", turns.pair(F.col("lang"), F.col("source"), F.col("lang"), turns.character_ids, 9, end=7).alias("p"))
    sum_of = lambda k, c: F.aggregate(F.col("p")[k][c], F.lit(0).cast("long"), lambda a, v: a + v)
    width = (F.size(F.col("p")[0]["ids"]) + F.size(F.col("p")[1]["ids"])).cast("long")
    return x.select("doc_id", sum_of(0, "attention").alias("chosen"), sum_of(1, "attention").alias("rejected"), width.alias("width"), sum_of(0, "ids").alias("chosen_sum"))


@query("tok22_turn_stream", CHARACTERS + """, f AS (SELECT conv_id, min(t) FILTER (role = 'assistant') AS f, count(*) AS turns FROM m GROUP BY 1), s AS (SELECT n.*, f, turns, f IS NULL OR t < f OR (t = f AND i < 3) AS is_prompt FROM n JOIN f USING (conv_id))
SELECT conv_id, count_if(is_prompt)::BIGINT AS prompt, count_if(NOT is_prompt)::BIGINT AS response, coalesce(sum(loss) FILTER (NOT is_prompt), 0)::BIGINT AS own, coalesce(sum(id) FILTER (NOT is_prompt), 0)::BIGINT AS id_sum, CASE WHEN any_value(f) IS NULL THEN 0 ELSE any_value(turns) - any_value(f) + 1 END::BIGINT AS parts FROM s GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    x = conversations(t).select("conv_id", turns.stream(F.col("turns"), TEMPLATE, turns.character_ids).alias("x")).select("conv_id", "x.*")
    return x.select("conv_id", F.size("prompt").cast("long").alias("prompt"), F.size("response").cast("long").alias("response"), total("loss").alias("own"), total("response").alias("id_sum"), F.size("boundaries").cast("long").alias("parts"))


@query("tok23_turn_accumulator", CHARACTERS + """, r AS (SELECT conv_id, t, role, lag(role) OVER (PARTITION BY conv_id ORDER BY t) AS before, max(t) OVER (PARTITION BY conv_id) AS last FROM m), v AS (SELECT conv_id, any_value(last) AS turns, max_by(role, t) AS role, bool_and(CASE
    WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role IN ('user', 'tool') ELSE role IN ('tool', 'assistant') END) AS ok FROM r GROUP BY 1),
a AS (SELECT conv_id, count(*) AS n, sum(id) FILTER (pos < 300)::BIGINT AS id_sum, coalesce(sum(loss) FILTER (pos < 300), 0)::BIGINT AS own FROM n GROUP BY 1)
SELECT conv_id, turns::INT AS turns, CASE WHEN NOT ok THEN 'invalid' WHEN n > 300 THEN 'length' WHEN role = 'assistant' THEN 'finished' ELSE 'waiting' END AS state, least(n, 300) AS n, id_sum, own FROM v JOIN a USING (conv_id)""")
def _(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("o", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))
    x = turns.accumulated(rows, "conv_id", "o", "role", "text", TEMPLATE, turns.character_ids, 300)
    return x.select("conv_id", "turns", "state", F.size("ids").cast("long").alias("n"), total("ids").alias("id_sum"), total("loss").alias("own"))
