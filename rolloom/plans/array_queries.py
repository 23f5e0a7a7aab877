"""Queries over token arrays, bound to the embeddings table: 64 numbers a row, every third place masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions import arrays as A
from rolloom.operators import tokens
from rolloom.plans.registry import Tables, query


def batch(t: Tables) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    df = t.embeddings.select("vec_id", "label", v.alias("v"))
    df = df.withColumn("m", F.transform("v", lambda x, i: F.when(i % 3 != 0, 1).otherwise(0)))
    return df.withColumn("w", F.transform("v", lambda x, i: x * 0.9 + 0.01 * (i % 5))).withColumn("ids", F.transform("v", lambda x: F.floor(F.abs(x) * 20).cast("int")))


#: One row a token: vec_id, label, i, v, w, id, m.
TOKENS = """WITH x AS (SELECT vec_id, label, i, v, v * 0.9 + 0.01 * (i % 5) AS w, floor(abs(v) * 20)::INT AS id, (i % 3 <> 0)::INT AS m
  FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)) """


def per_row(t: Tables, value: Column, name: str = "value") -> DataFrame:
    return batch(t).select("vec_id", (F.round(value, 5) + 0.0).alias(name))


def tok(name: str, sql: str):
    return query(name, TOKENS + sql)


@tok("tok1_masked_sum", "SELECT vec_id, round(sum(v * m), 5) + 0.0 AS value FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return per_row(t, A.masked_sum(F.col("v"), F.col("m")))


@tok("tok2_masked_mean", "SELECT vec_id, round(sum(v * m) / (sum(m) + 1e-8), 5) + 0.0 AS value FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return per_row(t, A.masked_mean(F.col("v"), F.col("m")))


@tok("tok3_masked_var", "SELECT vec_id, round(var_samp(v), 5) AS value FROM x WHERE m = 1 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return per_row(t, A.masked_var(F.col("v"), F.col("m")))


@tok("tok4_whiten", ", s AS (SELECT avg(v) a, var_samp(v) q FROM x WHERE m = 1) SELECT vec_id, round(sum((v - a) / sqrt(q + 1e-8) * (i + 1)), 3) + 0.0 AS value FROM x, s GROUP BY 1")
def _(t: Tables) -> DataFrame:
    out = tokens.whiten(batch(t), "v", "m")
    return out.select("vec_id", (F.round(A.total(F.transform("whitened", lambda x, i: x * (i + 1))), 3) + 0.0).alias("value"))


@tok("tok5_response_mask", ", f AS (SELECT vec_id, min(CASE WHEN id IN (1, 2) THEN i END) p FROM x GROUP BY 1) SELECT vec_id, coalesce(p + 1, 64)::BIGINT AS n FROM f")
def _(t: Tables) -> DataFrame:
    return batch(t).select("vec_id", A.mask_count(A.response_mask(F.col("ids"), [1, 2])).cast("long").alias("n"))


@tok("tok6_pad_truncate", "SELECT vec_id, array_to_string(list(id::VARCHAR ORDER BY i) FILTER (i < 5), ',') || ',9,9' AS padded, array_to_string(list(id::VARCHAR ORDER BY i) FILTER (i >= 60), ',') AS tail, array_to_string(list(id::VARCHAR ORDER BY i) FILTER (i < 2 OR i >= 61), ',') AS middle FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    ids = F.col("ids")
    return batch(t).select("vec_id", text(A.pad_right(A.truncate(ids, 5), 7, 9)).alias("padded"), text(A.truncate(ids, 4, "left")).alias("tail"), text(A.truncate(ids, 5, "middle")).alias("middle"))


@tok("tok7_remove_padding", "SELECT vec_id, array_to_string(list(id::VARCHAR ORDER BY i) FILTER (m = 1), ',') AS ids FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    kept = A.without_padding(F.col("ids"), F.col("m"))
    return batch(t).select("vec_id", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("ids"))


@tok("tok8_entropy", ", z AS (SELECT vec_id, ln(sum(exp(v))) l, ln(sum(exp(2 * v))) l2 FROM x GROUP BY 1) SELECT vec_id, round(any_value(l) - sum(exp(v - l) * v), 5) AS entropy, round(exp(any_value(l2) - 2 * any_value(l)), 6) AS sum_pi_squared FROM x JOIN z USING (vec_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return batch(t).select("vec_id", F.round(A.entropy(F.col("v")), 5).alias("entropy"), F.round(A.sum_pi_squared(F.col("v")), 6).alias("sum_pi_squared"))


@tok("tok9_logprobs", "SELECT vec_id, round(max(CASE WHEN i = label THEN v END) - ln(sum(exp(v))), 5) AS value FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return per_row(t, A.logprob_of(F.col("v"), F.col("label")))


@tok("tok10_clip", "SELECT vec_id, round(sum(greatest(least(v, 0.5), -0.25)), 5) + 0.0 AS value FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return per_row(t, A.total(F.transform("v", lambda x: A.clip(x, -0.25, 0.5))))


@tok("tok11_loss_modes", """, r AS (SELECT vec_id, sum(v * m) s, sum(m) n FROM x GROUP BY 1)
SELECT 'token-mean' AS mode, round(sum(s) / sum(n), 6) AS loss FROM r UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) FROM r UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / n), 6) FROM r UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / 64, 6) FROM r""")
def _(t: Tables) -> DataFrame:
    out = None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        one = tokens.loss(batch(t), "v", "m", mode, 64).select(F.lit(mode).alias("mode"), F.round("loss", 6).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


@tok("tok12_clipped_objective", "SELECT vec_id, round(sum(greatest(-w * exp(v - w), -w * greatest(least(exp(v - w), 1.28), 0.8))), 5) + 0.0 AS value FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    ratio = F.zip_with("v", "w", lambda a, b: F.exp(a - b))
    return per_row(t, A.total(tokens.clipped_objective(F.col("w"), ratio, 0.2, 0.28)))


@tok("tok13_masked_nll", "SELECT round(-sum(v * m) / sum(m), 6) AS nll FROM x")
def _(t: Tables) -> DataFrame:
    return batch(t).agg(F.round(-F.sum(A.masked_sum(F.col("v"), F.col("m"))) / F.sum(A.mask_count(F.col("m"))), 6).alias("nll"))


@tok("tok13_topk_overlap", ", a AS (SELECT DISTINCT vec_id, id FROM x WHERE i < 32), b AS (SELECT DISTINCT vec_id, id FROM x WHERE i >= 32), o AS (SELECT vec_id, count(*) AS n FROM a JOIN b USING (vec_id, id) GROUP BY 1) SELECT vec_id, coalesce(n, 0) AS n FROM embeddings LEFT JOIN o USING (vec_id)")
def _(t: Tables) -> DataFrame:
    both = F.size(F.array_intersect(F.slice("ids", 1, 32), F.slice("ids", 33, 32))).cast("long")
    return batch(t).select("vec_id", both.alias("n"))


@tok("tok16_truncated_weights", "SELECT vec_id, round(sum(least(exp(v - w), 1.01) * m), 5) AS value FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return per_row(t, A.total(A.importance_weights(F.col("v"), F.col("w"), F.col("m"), upper=1.01)))


@tok("tok16_banded_weights", "SELECT vec_id, round(sum(CASE WHEN exp(v - w) BETWEEN 0.98 AND 1.02 THEN exp(v - w) ELSE 0 END * m), 5) AS value FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return per_row(t, A.total(A.importance_weights(F.col("v"), F.col("w"), F.col("m"), band=(0.98, 1.02))))


@tok("tok16_sequence_weights", "SELECT vec_id, round(least(exp(greatest(least(sum((v - w) * m), 20), -20)), 2) * sum(m), 5) AS value FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return per_row(t, A.total(A.importance_weights(F.col("v"), F.col("w"), F.col("m"), "sequence")))


REJECTED = """, s AS (SELECT vec_id, sum((w - v) * m) s1, sum(0.5 * (v - w) * (v - w) * m) s2, max(CASE WHEN m = 1 THEN exp(v - w) - (v - w) - 1 END) x3, sum(m) n FROM x GROUP BY 1)
SELECT count_if(exp(-s1) BETWEEN 0.5 AND 2)::BIGINT AS seq_sum_k1, count_if(s2 / n <= 0.0001)::BIGINT AS seq_mean_k2, count_if(x3 <= 0.0005)::BIGINT AS seq_max_k3, (SELECT count(*) FROM x WHERE m = 1 AND exp(v - w) BETWEEN 0.98 AND 1.02) AS token_k1 FROM s"""


@tok("tok17_rejection_modes", REJECTED)
def _(t: Tables) -> DataFrame:
    cut = lambda mode, low, high: A.mask_count(A.rejection_mask(F.col("v"), F.col("w"), F.col("m"), mode, low, high))
    return batch(t).agg(
        F.count_if(cut("seq_sum_k1", 0.5, 2.0) > 0).alias("seq_sum_k1"), F.count_if(cut("seq_mean_k2", None, 0.0001) > 0).alias("seq_mean_k2"),
        F.count_if(cut("seq_max_k3", None, 0.0005) > 0).alias("seq_max_k3"), F.sum(cut("token_k1", 0.98, 1.02)).cast("long").alias("token_k1"))


@tok("tok18_off_policy", """, r AS (SELECT vec_id, sum(m) n, sum((w - v) * m) k1, sum((exp(v - w) - (v - w) - 1) * m) k3, sum(v * m) / sum(m) lo, sum(w * m) / sum(m) lr, sum(exp(2 * (v - w)) * m) c, sum((v - w) * m) s FROM x GROUP BY 1)
SELECT round(sum(k1) / sum(n), 6) + 0.0 AS kl, round(sum(k3) / sum(n), 6) AS k3_kl, round(avg(exp(-lo)), 5) AS train_ppl, round(avg(exp(-lr)), 5) AS rollout_ppl, round(avg(lr - lo), 6) + 0.0 AS log_ppl_diff, round(avg(exp(lr - lo)), 6) AS ppl_ratio,
  round(sum(c) / sum(n) - 1, 6) + 0.0 AS chi2_token, round(avg(exp(2 * greatest(least(s, 20), -20))) - 1, 4) AS chi2_seq FROM r""")
def _(t: Tables) -> DataFrame:
    out = tokens.off_policy(batch(t), "v", "w", "m")
    places = {"train_ppl": 5, "rollout_ppl": 5, "chi2_seq": 4}
    return out.select(*[(F.round(c, places.get(c, 6)) + 0.0).alias(c) for c in out.columns])


@tok("tok18_weight_stats", ", e AS (SELECT exp(v - w) r FROM x WHERE m = 1) SELECT round(avg(r), 6) AS mean, round(max(r), 6) AS max, round(min(r), 6) AS min, round(stddev_pop(r), 6) AS std, round(avg(r) * avg(r) / avg(r * r), 6) AS ess, round(avg((r < 0.98 OR r > 1.02)::INT), 6) AS out_of_band FROM e")
def _(t: Tables) -> DataFrame:
    df = batch(t).withColumn("r", A.importance_weights(F.col("v"), F.col("w"), F.col("m"), upper=None))
    out = tokens.weight_stats(df, "r", "m", 0.98, 1.02)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@tok("tok21_positions", "SELECT vec_id, sum(i * m)::BIGINT AS total FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    at = F.zip_with(F.sequence(F.lit(0), F.size("v") - 1), "m", lambda i, m: (i * m).cast("double"))
    return batch(t).select("vec_id", A.total(at).cast("long").alias("total"))


@tok("win7_gae", """, r AS (SELECT vec_id, i, m, v, w, sum(m) OVER (PARTITION BY vec_id ORDER BY i DESC) AS later, row_number() OVER (PARTITION BY vec_id, m ORDER BY i DESC) - 1 AS back FROM x), d AS (
  SELECT vec_id, i, back, v + coalesce(lag(w) OVER (PARTITION BY vec_id ORDER BY i DESC), 0) - w AS delta FROM r WHERE m = 1)
SELECT vec_id, round(sum(delta), 4) + 0.0 AS first_advantage FROM d GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    out = A.gae(F.col("v"), F.col("w"), F.col("m"))
    return batch(t).select("vec_id", (F.round(F.element_at(out, 2), 4) + 0.0).alias("first_advantage"))


@tok("win8_returns", "SELECT vec_id, round(sum(v * (i + 1)), 4) + 0.0 AS value FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return batch(t).select("vec_id", (F.round(A.total(A.returns_to_go(F.col("v"))), 4) + 0.0).alias("value"))


@tok("win8_position_baseline", "SELECT label, i, round(sum(w * id) / (sum(id) + 1e-8), 4) + 0.0 AS baseline FROM x GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    rows = batch(t).select("label", F.posexplode(F.arrays_zip("w", "ids")).alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), "x.w", "x.ids")
    return rows.groupBy("label", "i").agg((F.round(F.sum(F.col("w") * F.col("ids")) / (F.sum("ids") + 1e-8), 4) + 0.0).alias("baseline"))


@tok("win10_kl", "SELECT vec_id, round(sum(v - w), 5) + 0.0 AS k1, round(sum(abs(v - w)), 5) AS abs, round(sum(0.5 * (v - w) * (v - w)), 6) AS k2, round(sum(exp(w - v) - (w - v) - 1), 6) AS k3 FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    k = lambda kind, n: (F.round(A.total(A.kl(F.col("v"), F.col("w"), kind)), n) + 0.0).alias(kind)
    return batch(t).select("vec_id", k("k1", 5), k("abs", 5), k("k2", 6), k("k3", 6))


@tok("agg13_data_metrics", ", r AS (SELECT vec_id, sum(v) s FROM x GROUP BY 1), q AS (SELECT avg(w) a, max(w) b, min(w) c FROM x WHERE m = 1) SELECT round(avg(s), 5) + 0.0 AS v_mean, round(max(s), 5) AS v_max, round(min(s), 5) AS v_min, round(any_value(a), 5) + 0.0 AS w_mean, round(any_value(b), 5) AS w_max, round(any_value(c), 5) AS w_min FROM r, q")
def _(t: Tables) -> DataFrame:
    out = tokens.data_metrics(batch(t), {"v": "row", "w": "token"}, "m")
    return out.select(*[(F.round(c, 5) + 0.0).alias(c) for c in out.columns])


@tok("agg14_explained_variance", "SELECT round(1 - var_samp(v - w) / (var_samp(v) + 1e-5), 5) AS explained_variance FROM x WHERE m = 1")
def _(t: Tables) -> DataFrame:
    return tokens.explained_variance(batch(t), "v", "w", "m").select(F.round("explained_variance", 5).alias("explained_variance"))


@tok("agg17_w_score", ", z AS (SELECT vec_id, ln(sum(exp(v))) l FROM x GROUP BY 1), s AS (SELECT vec_id, 1 - 2 * exp(max(CASE WHEN i = label THEN v END) - any_value(l)) + sum(exp(2 * (v - l))) AS w FROM x JOIN z USING (vec_id) GROUP BY 1) SELECT round(avg(w), 6) AS mean, round(max(w), 6) AS max FROM s")
def _(t: Tables) -> DataFrame:
    w = 1 - 2 * F.exp(A.logprob_of(F.col("v"), F.col("label"))) + A.sum_pi_squared(F.col("v"))
    return batch(t).select(w.alias("w")).agg(F.round(F.avg("w"), 6).alias("mean"), F.round(F.max("w"), 6).alias("max"))


@tok("agg18_expert_load", ", e AS (SELECT label, id % 8 AS e, count(*) n FROM x WHERE m = 1 GROUP BY ALL), f AS (SELECT l.label, k.e, coalesce(n, 0) n FROM (SELECT DISTINCT label FROM x) l CROSS JOIN range(8) k(e) LEFT JOIN e ON e.label = l.label AND e.e = k.e), s AS (SELECT label, n / sum(n) OVER (PARTITION BY label) * 8 - 1 v FROM f) SELECT label, round(max(v), 6) AS max, round(min(v), 6) AS min, round(avg(abs(v)), 6) AS mean_abs FROM s GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = batch(t).select("label", F.explode(A.without_padding(F.col("ids"), F.col("m"))).alias("id")).select("label", (F.col("id") % 8).alias("e"))
    out = tokens.expert_load(rows, "label", "e", 8)
    return out.select("label", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@tok("agg19_expert_steps", "SELECT vec_id // 100 AS bucket, id % 8 AS expert, count(*) AS n FROM x WHERE m = 1 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    rows = batch(t).select(F.floor(F.col("vec_id") / 100).alias("bucket"), F.explode(A.without_padding(F.col("ids"), F.col("m"))).alias("id"))
    return rows.groupBy("bucket", (F.col("id") % 8).alias("expert")).agg(F.count("*").alias("n"))


@tok("agg32_drift", ", p AS (SELECT exp(v) a, exp(w) b FROM x WHERE m = 1) SELECT round(max(abs(a - b)), 6) AS max, round(avg(abs(a - b)), 6) AS mean, round(stddev_samp(abs(a - b)), 6) AS std, round(corr(a, b), 6) AS correlation FROM p")
def _(t: Tables) -> DataFrame:
    out = tokens.drift(batch(t), "v", "w", "m")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@tok("agg33_list_differences", "SELECT vec_id, count_if(m = 1 AND id <> floor(abs(w) * 20)::INT)::INT AS n FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    other = F.transform("w", lambda x: F.floor(F.abs(x) * 20).cast("int"))
    return batch(t).withColumn("other", other).select("vec_id", tokens.differing(F.col("ids"), F.col("other"), F.col("m")).alias("n"))


@tok("agg35_accept_rate", ", r AS (SELECT vec_id, sum(m) d, sum((v > 0)::INT * m) a FROM x GROUP BY 1) SELECT round(sum(a) / sum(d), 6) AS rate, round(1 + sum(a) / (3 * count(*)), 6) AS length FROM r")
def _(t: Tables) -> DataFrame:
    m, good = F.col("m"), F.transform("v", lambda x: (x > 0).cast("double"))
    rows = batch(t).select(A.mask_count(m).alias("d"), A.masked_sum(good, m).alias("a"), F.lit(3).alias("k"))
    return tokens.accept_stats(rows, "d", "a", "k").select(F.round("rate", 6).alias("rate"), F.round("length", 6).alias("length"))


@tok("rwd3_on_last_token", ", n AS (SELECT vec_id, 1 + any_value(label) AS n FROM x GROUP BY 1) SELECT vec_id, i::INT AS i, CASE WHEN i = n - 1 THEN 0.5 ELSE 0 END::DOUBLE AS reward FROM x JOIN n USING (vec_id) WHERE i < n")
def _(t: Tables) -> DataFrame:
    spread = A.on_last_token(F.lit(0.5), F.col("label") + 1)
    return batch(t).select("vec_id", F.posexplode(spread).alias("i", "reward"))


@tok("rwd5_stop_tokens", ", f AS (SELECT vec_id, min(CASE WHEN id = 1 THEN i END) p, count(*) n FROM x GROUP BY 1) SELECT vec_id, CASE WHEN p IS NULL THEN 'length' ELSE 'eos' END AS finish, coalesce(p, n)::INT AS kept FROM f")
def _(t: Tables) -> DataFrame:
    at = F.array_position("ids", F.lit(1))
    return batch(t).select("vec_id", F.when(at == 0, "length").otherwise("eos").alias("finish"), F.when(at == 0, F.size("ids")).otherwise(at - 1).cast("int").alias("kept"))
