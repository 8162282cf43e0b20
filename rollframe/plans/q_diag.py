"""Registered KL / policy / preference diagnostics over ``tokens``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.operators import diagnostics as D
from rollframe.operators import groups as G
from rollframe.plans import tables as T
from rollframe.plans.catalog import ROLLOUTS_SQL, TOKENS_SQL, register, r6, r6a, with_

_ZM = "list_sum(list_transform(list_zip({a}, response_mask), lambda e: e[1] * e[2]))"


def _ms(a: str) -> str:
    return _ZM.format(a=a)


@register("kl_estimate", with_(TOKENS_SQL) + """
SELECT response_id,
  list_transform(list_zip(old_log_probs, ref_log_probs), lambda e: round(e[1] - e[2], 6) + 0.0) AS kl,
  list_transform(list_zip(old_log_probs, ref_log_probs), lambda e: round(abs(e[1] - e[2]), 6)) AS kl_abs,
  list_transform(list_zip(old_log_probs, ref_log_probs), lambda e: round(0.5 * (e[1] - e[2]) * (e[1] - e[2]), 6)) AS kl_mse,
  list_transform(list_zip(old_log_probs, ref_log_probs), lambda e: round(least(greatest(exp(e[2] - e[1]) - (e[2] - e[1]) - 1, -10.0), 10.0), 6)) AS kl_low_var
FROM tokens""")
def q_kl_estimate(spark, sf_dir):
    t = T.tokens(spark, sf_dir)
    return t.select("response_id", *[r6a(D.kl_penalty("old_log_probs", "ref_log_probs", k)).alias(n) for k, n in
                                     [("kl", "kl"), ("abs", "kl_abs"), ("mse", "kl_mse"), ("low_var_kl", "kl_low_var")]])


@register("kl_shaped_rewards", with_(TOKENS_SQL) + """
SELECT response_id,
  list_transform(list_zip(token_level_scores, old_log_probs, ref_log_probs, response_mask),
                 lambda e: round(e[1] - 0.05 * (e[2] - e[3]) * e[4], 6)) AS token_level_rewards,
  round(list_sum(list_transform(list_zip(old_log_probs, ref_log_probs, response_mask), lambda e: (e[1] - e[2]) * e[3]))
        / (list_sum(response_mask) + 1e-8), 6) AS seq_kl
FROM tokens""")
def q_kl_shaped_rewards(spark, sf_dir):
    d = D.kl_shaped_rewards(T.tokens(spark, sf_dir), 0.05)
    return d.select("response_id", r6a("token_level_rewards").alias("token_level_rewards"), r6("seq_kl").alias("seq_kl"))


@register("adaptive_kl_path", with_(ROLLOUTS_SQL) + """
, s AS (SELECT data_source AS run, step, avg(score) / 1000.0 AS kl, count(*) AS n_steps FROM rollouts GROUP BY 1, 2)
, f AS (SELECT *, 1 + least(greatest(kl / 0.1 - 1, -0.2), 0.2) * n_steps / 10000.0 AS m FROM s)
SELECT run, step, round(0.2 * exp(coalesce(sum(ln(m)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS kl_coef
FROM f""")
def q_adaptive_kl_path(spark, sf_dir):
    r = T.rollouts(spark, sf_dir)
    s = r.groupBy(F.col("data_source").alias("run"), "step").agg((F.avg("score") / 1000.0).alias("kl"),
                                                                  F.count(F.lit(1)).alias("n_steps"))
    d = D.adaptive_kl_path(s, 0.2, 0.1, 10000)
    return d.select("run", "step", r6("kl_coef").alias("kl_coef"))


@register("loss_aggregate", with_(TOKENS_SQL) + f"""
SELECT batch_id,
  round(sum({_ms('log_probs')}) / (sum(list_sum(response_mask)) + 1e-8), 6) AS token_mean,
  round(avg({_ms('log_probs')}), 6) AS seq_mean_token_sum,
  round(avg({_ms('log_probs')} / list_sum(response_mask)), 6) AS seq_mean_token_mean,
  round(sum({_ms('log_probs')}) / max(len(response_mask)), 6) AS seq_mean_token_sum_norm
FROM tokens GROUP BY batch_id""")
def q_loss_aggregate(spark, sf_dir):
    t = T.tokens(spark, sf_dir)
    modes = ["token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"]
    out = D.loss_aggregates(t, "log_probs", "response_mask", modes, ["batch_id"])
    return out.select("batch_id", *[r6(c).alias(c) for c in out.columns if c != "batch_id"])


_ADV_SQL = """, st AS (SELECT uid, count(*) AS n, avg(list_sum(token_level_rewards)) AS mean,
                  stddev_samp(list_sum(token_level_rewards)) AS std FROM tokens GROUP BY uid)
, a AS (SELECT t.*, list_transform(response_mask, lambda m: (list_sum(token_level_rewards) - CASE WHEN n = 1 THEN 0.0 ELSE mean END)
          / (CASE WHEN n = 1 THEN 1.0 ELSE std END + 1e-6) * m) AS advantages FROM tokens t JOIN st USING (uid))
, pl AS (SELECT *, list_transform(list_zip(old_log_probs, log_probs, advantages), lambda e: struct_pack(
     l1 := -e[3] * exp(e[2] - e[1]),
     l2 := -e[3] * least(greatest(exp(e[2] - e[1]), 0.8), 1.28),
     l3 := -e[3] * 3.0, a := e[3], nkl := e[1] - e[2])) AS z FROM a)
, pt AS (SELECT *, list_transform(z, lambda x: CASE WHEN x.a < 0 THEN least(x.l3, greatest(x.l1, x.l2)) ELSE greatest(x.l1, x.l2) END) AS pg,
     list_transform(z, lambda x: CASE WHEN x.l2 > x.l1 THEN 1.0 ELSE 0.0 END) AS clip,
     list_transform(z, lambda x: CASE WHEN greatest(x.l1, x.l2) > x.l3 AND x.a < 0 THEN 1.0 ELSE 0.0 END) AS clip_lo,
     list_transform(z, lambda x: x.nkl) AS nkl FROM pl)"""


@register("policy_clip_report", with_(TOKENS_SQL) + _ADV_SQL + f"""
SELECT round(sum({_ms('pg')}) / (sum(list_sum(response_mask)) + 1e-8), 6) AS pg_loss,
       round(sum({_ms('clip')}) / (sum(list_sum(response_mask)) + 1e-8), 6) AS pg_clipfrac,
       round(sum({_ms('nkl')}) / (sum(list_sum(response_mask)) + 1e-8), 6) AS ppo_kl,
       round(sum({_ms('clip_lo')}) / (sum(list_sum(response_mask)) + 1e-8), 6) AS pg_clipfrac_lower
FROM pt""")
def q_policy_clip_report(spark, sf_dir):
    d = G.adv_grpo(T.tokens(spark, sf_dir))
    r = D.policy_clip_report(d, clip_low=0.2, clip_high=0.28)
    return r.select(*[r6(c).alias(c) for c in r.columns])


@register("value_clip_report", with_(TOKENS_SQL) + """
, v AS (SELECT *, list_transform(list_zip(log_probs, token_level_rewards, "values"), lambda e: struct_pack(
      l1 := (e[1] - e[2]) * (e[1] - e[2]),
      l2 := (least(greatest(e[1], e[3] - 0.5), e[3] + 0.5) - e[2]) * (least(greatest(e[1], e[3] - 0.5), e[3] + 0.5) - e[2]))) AS z FROM tokens)
SELECT round(0.5 * sum(list_sum(list_transform(list_zip(z, response_mask), lambda e: greatest(e[1].l1, e[1].l2) * e[2])))
             / (sum(list_sum(response_mask)) + 1e-8), 6) AS vf_loss,
       round(sum(list_sum(list_transform(list_zip(z, response_mask), lambda e: CASE WHEN e[1].l2 > e[1].l1 THEN 1.0 ELSE 0.0 END * e[2])))
             / (sum(list_sum(response_mask)) + 1e-8), 6) AS vf_clipfrac
FROM v""")
def q_value_clip_report(spark, sf_dir):
    r = D.value_clip_report(T.tokens(spark, sf_dir), "log_probs", returns_col="token_level_rewards")
    return r.select(*[r6(c).alias(c) for c in r.columns])


@register("entropy_report", with_(TOKENS_SQL) + f"""
SELECT round(sum({_ms('ref_log_probs')}) / (sum(list_sum(response_mask)) + 1e-8), 6) AS entropy FROM tokens""")
def q_entropy_report(spark, sf_dir):
    r = D.entropy_report(T.tokens(spark, sf_dir), "ref_log_probs")
    return r.select(r6("entropy").alias("entropy"))


_ACC = "CASE WHEN response_id % 3 = 0 THEN 1.0 ELSE 0.0 END"


@register("dpo_ce_loss", with_(TOKENS_SQL) + f"""
, p AS (SELECT 1.0 / (1 + exp(-{_ms('log_probs')} * 0.5)) AS p, {_ACC} AS y FROM tokens)
SELECT round(avg(-(y * greatest(ln(p), -100) + (1 - y) * greatest(ln(1 - p), -100))), 6) AS dpo_ce_loss FROM p""")
def q_dpo_ce_loss(spark, sf_dir):
    t = T.tokens(spark, sf_dir).withColumn("acc", F.when(F.col("response_id") % 3 == 0, 1.0).otherwise(0.0))
    r = D.dpo_ce_loss(t, "log_probs", "acc", "response_mask", 0.5)
    return r.select(r6("dpo_ce_loss").alias("dpo_ce_loss"))


@register("dpo_group_loss", with_(TOKENS_SQL) + f"""
, q AS (SELECT uid, response_id, {_ms('log_probs')} AS q, {_ACC} AS acc FROM tokens)
, o AS (SELECT a.response_id, a.q, a.acc, avg(b.q) AS other FROM q a LEFT JOIN q b
          ON a.uid = b.uid AND ((a.acc > 0 AND b.acc < a.acc) OR (a.acc <= 0 AND b.acc > a.acc))
        GROUP BY a.response_id, a.q, a.acc)
SELECT round(avg(-ln(1.0 / (1 + exp(-(q * 0.5 - coalesce(other * 0.5, 0.0)) * CASE WHEN acc > 0 THEN 1.0 ELSE -1.0 END)))), 6) AS dpo_loss
FROM o""")
def q_dpo_group_loss(spark, sf_dir):
    t = T.tokens(spark, sf_dir).withColumn("acc", F.when(F.col("response_id") % 3 == 0, 1.0).otherwise(0.0))
    r = D.dpo_group_loss(t, "log_probs", "acc", "response_mask", 0.5)
    return r.select(r6("dpo_loss").alias("dpo_loss"))


@register("pairwise_accuracy", with_(TOKENS_SQL) + f"""
, q AS (SELECT uid, response_id, {_ms('log_probs')} AS s, {_ACC} AS a FROM tokens)
, pairs AS (SELECT x.uid, CASE WHEN (x.s - y.s > 0) = (x.a - y.a > 0) THEN 1.0 ELSE 0.0 END * abs(x.a - y.a) AS num, abs(x.a - y.a) AS den
            FROM q x JOIN q y ON x.uid = y.uid AND x.response_id < y.response_id)
, g AS (SELECT uid, sum(num) AS n, sum(den) AS d FROM pairs GROUP BY uid)
SELECT round(avg(CASE WHEN d = 0 THEN 0.5 ELSE n / d END), 6) AS pairwise_accuracy FROM g""")
def q_pairwise_accuracy(spark, sf_dir):
    t = T.tokens(spark, sf_dir).withColumn("acc", F.when(F.col("response_id") % 3 == 0, 1.0).otherwise(0.0))
    r = D.pairwise_accuracy(t, "log_probs", "acc", "response_mask", order_col="response_id")
    return r.select(r6("pairwise_accuracy").alias("pairwise_accuracy"))


@register("sign_accuracy", with_(TOKENS_SQL) + f"""
SELECT round(avg(CASE WHEN sign({_ms('log_probs')}) = sign({_ACC} * 2 - 1) THEN 1.0 ELSE 0.0 END), 6) AS sign_accuracy FROM tokens""")
def q_sign_accuracy(spark, sf_dir):
    t = T.tokens(spark, sf_dir).withColumn("acc", F.when(F.col("response_id") % 3 == 0, 1.0).otherwise(0.0))
    r = D.sign_accuracy(t, "log_probs", "acc", "response_mask")
    return r.select(r6("sign_accuracy").alias("sign_accuracy"))
