"""Registered group-advantage queries over the ``tokens`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.operators import groups as G
from rollframe.plans import tables as T
from rollframe.plans.catalog import TOKENS_SQL, ROLLOUTS_SQL, register, r6, r6a, with_

# Oracle pieces: per-row sequence score and group statistics
_STATS = """, scored AS (SELECT *, list_sum(token_level_rewards) AS s FROM tokens)
, st AS (SELECT uid, count(*) AS n, avg(s) AS mean, stddev_samp(s) AS std FROM scored GROUP BY uid)
, j AS (SELECT scored.*, st.n, st.mean, st.std FROM scored JOIN st USING (uid))"""

# Oracle: two-pass masked mean / Bessel variance per batch of an array column `x`
def _whiten_sql(src: str, col: str) -> str:
    return f"""
, ms AS (SELECT batch_id, sum(list_sum(list_transform(list_zip({col}, response_mask), lambda e: e[1] * e[2])))
                          / (sum(list_sum(response_mask)) + 1e-8) AS mu,
                sum(list_sum(response_mask)) AS s0 FROM {src} GROUP BY batch_id)
, mv AS (SELECT w.batch_id, any_value(ms.mu) AS mu,
                sum(list_sum(list_transform(list_zip(w.{col}, w.response_mask), lambda e: (e[1] - ms.mu) * (e[1] - ms.mu) * e[2])))
                / (any_value(ms.s0) + 1e-8) * any_value(ms.s0) / (any_value(ms.s0) - 1) AS var
         FROM {src} w JOIN ms USING (batch_id) GROUP BY w.batch_id)"""


def _rs(x: str, c: str) -> str:
    """Oracle reverse scan y_t = x_t + c_t * y_{t+1} via list_reduce (quadratic, exact)."""
    return (f"list_reduce(list_reverse(list_zip({x}, {c})), lambda acc, e: "
            f"list_prepend(e[1] + e[2] * coalesce(acc[1], 0.0), acc), []::DOUBLE[])")


@register("sequence_scores", with_(TOKENS_SQL) + """
SELECT response_id, round(list_sum(token_level_rewards), 6) AS seq_score FROM tokens""")
def q_sequence_scores(spark, sf_dir):
    d = G.sequence_scores(T.tokens(spark, sf_dir))
    return d.select("response_id", r6("seq_score").alias("seq_score"))


@register("adv_grpo", with_(TOKENS_SQL) + _STATS + """
SELECT response_id, list_transform(response_mask, lambda m: round(
   (s - CASE WHEN n = 1 THEN 0.0 ELSE mean END) / (CASE WHEN n = 1 THEN 1.0 ELSE std END + 1e-6) * m, 6) + 0.0) AS advantages
FROM j""")
def q_adv_grpo(spark, sf_dir):
    d = G.adv_grpo(T.tokens(spark, sf_dir))
    return d.select("response_id", r6a("advantages").alias("advantages"))


@register("adv_grpo_centered", with_(TOKENS_SQL) + _STATS + """
SELECT response_id, list_transform(response_mask, lambda m: round(
   (s - CASE WHEN n = 1 THEN 0.0 ELSE mean END) * m, 6) + 0.0) AS advantages
FROM j""")
def q_adv_grpo_centered(spark, sf_dir):
    d = G.adv_grpo_centered(T.tokens(spark, sf_dir))
    return d.select("response_id", r6a("advantages").alias("advantages"))


@register("adv_rloo", with_(TOKENS_SQL) + _STATS + """
SELECT response_id, list_transform(response_mask, lambda m: round(
   CASE WHEN n > 1 THEN s * n / (n - 1) - mean * n / (n - 1) ELSE s END * m, 6) + 0.0) AS advantages
FROM j""")
def q_adv_rloo(spark, sf_dir):
    d = G.adv_rloo(T.tokens(spark, sf_dir))
    return d.select("response_id", r6a("advantages").alias("advantages"))


@register("masked_whiten", with_(TOKENS_SQL) + _whiten_sql("tokens", "log_probs") + """
SELECT t.response_id, list_transform(t.log_probs, lambda v: round((v - mv.mu) / sqrt(mv.var + 1e-8), 6)) AS whitened
FROM tokens t JOIN mv USING (batch_id)""")
def q_masked_whiten(spark, sf_dir):
    d = G.masked_whiten(T.tokens(spark, sf_dir), "log_probs", "response_mask", out_col="whitened")
    return d.select("response_id", r6a("whitened").alias("whitened"))


@register("masked_sum/mean/var", with_(TOKENS_SQL) + _whiten_sql("tokens", "log_probs") + """
SELECT mv.batch_id, CAST(ms.s0 AS BIGINT) AS mask_sum, round(mv.mu, 6) AS mean, round(mv.var, 6) AS var
FROM mv JOIN ms USING (batch_id)""")
def q_masked_stats(spark, sf_dir):
    d = G.masked_stats(T.tokens(spark, sf_dir), "log_probs", "response_mask")
    return d.select("batch_id", F.col("mask_sum").cast("bigint").alias("mask_sum"),
                    r6("mean").alias("mean"), r6("var").alias("var"))


@register("adv_rfpp_baseline", with_(TOKENS_SQL) + _STATS + """
, b AS (SELECT response_id, batch_id, response_mask,
          list_transform(response_mask, lambda m: (s - CASE WHEN n = 1 THEN 0.0 ELSE mean END) * m) AS a FROM j)"""
          + _whiten_sql("b", "a") + """
SELECT b.response_id, list_transform(b.a, lambda v: round((v - mv.mu) / sqrt(mv.var + 1e-8), 6)) AS advantages
FROM b JOIN mv USING (batch_id)""")
def q_adv_rfpp_baseline(spark, sf_dir):
    d = G.adv_rfpp_baseline(T.tokens(spark, sf_dir))
    return d.select("response_id", r6a("advantages").alias("advantages"))


@register("adv_rfpp", with_(TOKENS_SQL) + """
, b AS (SELECT response_id, batch_id, response_mask,
          """ + _rs("token_level_rewards",
                    "list_transform(response_mask, lambda m, i: 0.99 * coalesce(response_mask[i + 1], 0))") + """ AS ret
        FROM tokens)""" + _whiten_sql("b", "ret") + """
SELECT b.response_id, list_transform(list_zip(b.ret, b.response_mask),
          lambda e: round((e[1] - mv.mu) / sqrt(mv.var + 1e-8) * e[2], 6) + 0.0) AS advantages,
       list_transform(b.ret, lambda v: round(v, 6)) AS returns
FROM b JOIN mv USING (batch_id)""")
def q_adv_rfpp(spark, sf_dir):
    d = G.adv_rfpp(T.tokens(spark, sf_dir), gamma=0.99)
    return d.select("response_id", r6a("advantages").alias("advantages"), r6a("returns").alias("returns"))


@register("adv_gae", with_(TOKENS_SQL) + """
, b AS (SELECT response_id, batch_id, response_mask, "values",
          """ + _rs("list_transform(token_level_rewards, lambda r, i: r + 0.99 * coalesce(\"values\"[i + 1], 0.0) - \"values\"[i])",
                    "list_transform(token_level_rewards, lambda r: 0.99 * 0.95)") + """ AS A
        FROM tokens)""" + _whiten_sql("b", "A") + """
SELECT b.response_id, list_transform(b.A, lambda v: round((v - mv.mu) / sqrt(mv.var + 1e-8), 6)) AS advantages,
       list_transform(list_zip(b.A, b."values"), lambda e: round(e[1] + e[2], 6)) AS returns
FROM b JOIN mv USING (batch_id)""")
def q_adv_gae(spark, sf_dir):
    d = G.adv_gae(T.tokens(spark, sf_dir), gamma=0.99, lam=0.95)
    return d.select("response_id", r6a("advantages").alias("advantages"), r6a("returns").alias("returns"))


@register("adv_remax", with_(TOKENS_SQL) + """
, base AS (SELECT uid, min(list_sum(token_level_rewards)) AS reward_baseline FROM tokens GROUP BY uid)
, b AS (SELECT t.*, base.reward_baseline,
          """ + _rs("list_transform(list_zip(token_level_rewards, response_mask), lambda e: e[1] * e[2])",
                    "list_transform(token_level_rewards, lambda r: 1.0)") + """ AS ret
        FROM tokens t JOIN base USING (uid))
SELECT response_id, list_transform(list_zip(ret, response_mask), lambda e: round(e[1] - reward_baseline * e[2], 6)) AS advantages,
       list_transform(ret, lambda v: round(v, 6)) AS returns
FROM b""")
def q_adv_remax(spark, sf_dir):
    tok = T.tokens(spark, sf_dir)
    # greedy-baseline stand-in derived from the data: the group's lowest sequence score
    base = G.sequence_scores(tok).groupBy("uid").agg(F.min("seq_score").alias("reward_baseline"))
    d = G.adv_remax(tok, base)
    return d.select("response_id", r6a("advantages").alias("advantages"), r6a("returns").alias("returns"))


@register("group_context_arrays", with_(ROLLOUTS_SQL) + """
SELECT r.response_id, g.group_score, g.group_acc FROM rollouts r JOIN (
  SELECT uid, list_transform(list_sort(list(struct_pack(i := sample_idx, s := score))), lambda x: x.s) AS group_score,
              list_transform(list_sort(list(struct_pack(i := sample_idx, a := acc))), lambda x: x.a) AS group_acc
  FROM rollouts GROUP BY uid) g USING (uid)""")
def q_group_context_arrays(spark, sf_dir):
    d = G.group_context_arrays(T.rollouts(spark, sf_dir))
    return d.select("response_id", "group_score", "group_acc")


@register("batch_norm_rewards", with_(TOKENS_SQL) + """
, b AS (SELECT *, list_max(list_transform(""" + _rs("token_level_rewards", "list_transform(token_level_rewards, lambda r: 1.0)") + """,
                 lambda x: abs(x))) AS rc FROM tokens)
, mx AS (SELECT batch_id, max(rc) AS m FROM b GROUP BY batch_id)
SELECT response_id, list_transform(token_level_rewards, lambda r: round(r / (mx.m + 1e-6), 6)) AS normed
FROM b JOIN mx USING (batch_id)""")
def q_batch_norm_rewards(spark, sf_dir):
    d = G.batch_norm_rewards(T.tokens(spark, sf_dir), "token_level_rewards", out_col="normed")
    return d.select("response_id", r6a("normed").alias("normed"))
