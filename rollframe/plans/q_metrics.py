"""Registered metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.operators import metrics as M
from rollframe.plans import tables as T
from rollframe.plans.catalog import ROLLOUTS_SQL, register, r6, with_

_LONG_SQL = """, long AS (
  SELECT data_source, uid, 'score' AS var, CAST(score AS DOUBLE) AS value FROM rollouts
  UNION ALL SELECT data_source, uid, 'acc' AS var, CAST(acc AS DOUBLE) AS value FROM rollouts)"""


@register("val_score_by_source", with_(ROLLOUTS_SQL) + """
SELECT coalesce(data_source, 'unknown') AS data_source, round(avg(score), 6) AS mean_score, count(*) AS n
FROM rollouts GROUP BY 1""")
def q_val_score_by_source(spark, sf_dir):
    out = M.val_score_by_source(T.rollouts(spark, sf_dir))
    return out.select("data_source", r6("mean_score").alias("mean_score"), "n")


@register("validation_metrics", with_(ROLLOUTS_SQL) + _LONG_SQL + """
, basic AS (SELECT data_source, uid, var, count(*) AS N, avg(value) AS m, stddev_pop(value) AS sd
            FROM long GROUP BY ALL)
, dv AS (SELECT data_source, uid, var, value AS v, count(*) AS c FROM long GROUP BY ALL)
, dv2 AS (SELECT *, sum(c) OVER (PARTITION BY data_source, uid, var ORDER BY v
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                    sum(c) OVER (PARTITION BY data_source, uid, var) AS N FROM dv)
, dv3 AS (SELECT *, unnest(list_concat(list_filter(list_transform(range(1, 40), lambda e: CAST(pow(2, e) AS BIGINT)),
                                                   lambda p: p < N), [CAST(N AS BIGINT)])) AS s FROM dv2)
, mom AS (SELECT data_source, uid, var, s,
     sum(v * (pow(cum / N, s) - pow((cum - c) / N, s))) AS e_max,
     sum(v * v * (pow(cum / N, s) - pow((cum - c) / N, s))) AS e_max2,
     sum(v * (pow(1 - (cum - c) / N, s) - pow(1 - cum / N, s))) AS e_min,
     sum(v * v * (pow(1 - (cum - c) / N, s) - pow(1 - cum / N, s))) AS e_min2
   FROM dv3 GROUP BY ALL)
, per_prompt AS (
  SELECT data_source, uid, var, 'mean@' || N AS metric, m AS value FROM basic
  UNION ALL SELECT data_source, uid, var, 'std@' || N, sd FROM basic
  UNION ALL SELECT data_source, uid, var, 'best@' || s || '/mean', e_max FROM mom
  UNION ALL SELECT data_source, uid, var, 'best@' || s || '/std', sqrt(greatest(e_max2 - e_max * e_max, 0)) FROM mom
  UNION ALL SELECT data_source, uid, var, 'worst@' || s || '/mean', e_min FROM mom
  UNION ALL SELECT data_source, uid, var, 'worst@' || s || '/std', sqrt(greatest(e_min2 - e_min * e_min, 0)) FROM mom)
SELECT data_source, var, metric, round(avg(value), 6) AS value FROM per_prompt GROUP BY ALL""")
def q_validation_metrics(spark, sf_dir):
    out = M.validation_metrics(T.rollouts(spark, sf_dir), ["score", "acc"])
    return out.select("data_source", "var", "metric", r6("value").alias("value"))


from rollframe.plans.q_outcomes import CLASSIFY_SQL, classified  # noqa: E402


@register("reward_type_share", with_(ROLLOUTS_SQL) + """
, g AS (SELECT data_source, pred AS reward_type, count(*) AS n, grouping(data_source) AS gid FROM rollouts
        GROUP BY GROUPING SETS ((pred), (data_source, pred)))
SELECT data_source, reward_type, round(n / sum(n) OVER (PARTITION BY gid, data_source), 6) AS share FROM g""")
def q_reward_type_share(spark, sf_dir):
    r = T.rollouts(spark, sf_dir).withColumnRenamed("pred", "reward_type")
    out = M.reward_type_share(r)
    return out.select("data_source", "reward_type", r6("share").alias("share"))


@register("fail_reason_share", CLASSIFY_SQL + """
SELECT fail_reason, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cls WHERE fail_reason IS NOT NULL GROUP BY fail_reason""")
def q_fail_reason_share(spark, sf_dir):
    c = classified(spark, sf_dir)
    return M.fail_reason_share(c).select("fail_reason", r6("share").alias("share"))


@register("seeded_outcome_summary", CLASSIFY_SQL + """
, per AS (SELECT response_id % 4 AS pos,
    avg(CASE WHEN reward_type = 'PassGoodFailBad' THEN 100.0 ELSE 0.0 END) AS PassGoodFailBad,
    avg(CASE WHEN reward_type = 'FailGood' THEN 100.0 ELSE 0.0 END) AS FailGood,
    avg(CASE WHEN reward_type = 'GoodInputFailGood' THEN 100.0 ELSE 0.0 END) AS GoodInputFailGood,
    avg(CASE WHEN reward_type = 'PassGoodPassBad' THEN 100.0 ELSE 0.0 END) AS PassGoodPassBad,
    avg(CASE WHEN reward_type = 'GoodInputPassGoodPassBad' THEN 100.0 ELSE 0.0 END) AS GoodInputPassGoodPassBad,
    avg(CASE WHEN reward_type = 'FormatError' THEN 100.0 ELSE 0.0 END) AS FormatError,
    avg(CASE WHEN reward_type IN ('GoodInputFailGood', 'GoodInputPassGoodPassBad', 'PassGoodFailBad') THEN 100.0 ELSE 0.0 END) AS good_input,
    avg(CASE WHEN reward_type IN ('FailGood', 'GoodInputFailGood') THEN 100.0 ELSE 0.0 END) AS fail_good,
    avg(CASE WHEN num_inputs >= 0 THEN CAST(num_inputs AS DOUBLE) END) AS num_inputs
  FROM cls GROUP BY 1)
, long AS (UNPIVOT per ON PassGoodFailBad, FailGood, GoodInputFailGood, PassGoodPassBad, GoodInputPassGoodPassBad, FormatError, good_input, fail_good, num_inputs
           INTO NAME metric VALUE pct)
SELECT metric, round(avg(pct), 6) AS mean, round(stddev_pop(pct), 6) AS std FROM long GROUP BY metric""")
def q_seeded_outcome_summary(spark, sf_dir):
    c = classified(spark, sf_dir).withColumn("pos", F.col("response_id") % 4)
    out = M.seeded_outcome_summary(c, "pos", num_inputs_col="num_inputs")
    return out.select("metric", r6("mean").alias("mean"), r6("std").alias("std"))


@register("majority_vote", with_(ROLLOUTS_SQL) + """
, g AS (SELECT uid, pred, count(*) AS c, arg_min(acc, sample_idx) AS v, min(sample_idx) AS first FROM rollouts GROUP BY uid, pred)
SELECT uid, pred AS maj_pred, v AS maj_val, c AS maj_count FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY c DESC, first) AS rk FROM g) WHERE rk = 1""")
def q_majority_vote(spark, sf_dir):
    return M.majority_vote(T.rollouts(spark, sf_dir), ["uid"], "pred", "acc", "sample_idx")


@register("pivot_samples_wide", with_(ROLLOUTS_SQL) + """
SELECT uid, max(CASE WHEN sample_idx = 0 THEN score END) AS score_0, max(CASE WHEN sample_idx = 1 THEN score END) AS score_1,
  max(CASE WHEN sample_idx = 2 THEN score END) AS score_2,
  max(CASE WHEN sample_idx = 0 THEN pred END) AS pred_0, max(CASE WHEN sample_idx = 1 THEN pred END) AS pred_1,
  max(CASE WHEN sample_idx = 2 THEN pred END) AS pred_2
FROM rollouts GROUP BY uid""")
def q_pivot_samples_wide(spark, sf_dir):
    return M.pivot_samples_wide(T.rollouts(spark, sf_dir), "uid", "sample_idx", ["score", "pred"], 3)


@register("reduce_metrics", with_(ROLLOUTS_SQL) + """
SELECT step, data_source AS metric, round(avg(score), 6) AS value FROM rollouts GROUP BY step, data_source""")
def q_reduce_metrics(spark, sf_dir):
    r = T.rollouts(spark, sf_dir).select("step", F.col("data_source").alias("metric"), F.col("score").alias("value"))
    out = M.reduce_metrics(r, ["step"])
    return out.select("step", "metric", r6("value").alias("value"))


@register("best_reward_from_logs", """SELECT max(CAST(regexp_extract(props, '"k": (-?[0-9.]+)', 1) AS DOUBLE)) AS best_reward,
  max(CAST(regexp_extract(props, '"k": (-?[0-9.]+)', 1) AS DOUBLE)) >= 90 AS reached FROM events""")
def q_best_reward_from_logs(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    return M.best_reward_from_logs(e, "props", r'"k": (-?[0-9.]+)', target=90)


@register("sample_sizes", with_(ROLLOUTS_SQL) + """
, n AS (SELECT uid, count(*) AS n FROM rollouts GROUP BY uid)
SELECT uid, CAST(unnest(list_concat(list_filter(list_transform(range(1, 40), lambda e: CAST(pow(2, e) AS BIGINT)), lambda p: p < n), [n])) AS INTEGER) AS sample_size FROM n""")
def q_sample_sizes(spark, sf_dir):
    n = T.rollouts(spark, sf_dir).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    return M.sample_sizes(n).select("uid", "sample_size")


@register("plurality_at_n", with_(ROLLOUTS_SQL) + """
, c AS (SELECT uid, pred, count(*) AS c, avg(acc) AS m, avg(acc * acc) AS q FROM rollouts GROUP BY uid, pred)
, p AS (SELECT uid, m, q, c / sum(c) OVER (PARTITION BY uid) AS p FROM c)
, s AS (SELECT uid, sum(p * p) AS p2 FROM p GROUP BY uid)
, w AS (
  SELECT uid, 2 AS n, m, q, p AS w FROM p
  UNION ALL
  SELECT p.uid, 3, m, q, p * p * p + 3 * p * p * (1 - p) + p * ((1 - p) * (1 - p) - (p2 - p * p)) FROM p JOIN s ON p.uid = s.uid)
SELECT uid, n, round(sum(w * m), 6) AS maj_mean, round(sqrt(greatest(sum(w * q) - sum(w * m) * sum(w * m), 0)), 6) AS maj_std FROM w GROUP BY uid, n""")
def q_plurality_at_n(spark, sf_dir):
    """Exact majority of two and of three draws, for which SQL has a closed form."""
    d = M.plurality_at_n(T.rollouts(spark, sf_dir), ["uid"], "pred", "acc", [2, 3])
    return d.select("uid", "n", r6("maj_mean").alias("maj_mean"), r6("maj_std").alias("maj_std"))


@register("best_worst_at_n", with_(ROLLOUTS_SQL) + """
, r AS (SELECT uid, score, count(*) OVER (PARTITION BY uid) AS N, rank() OVER (PARTITION BY uid ORDER BY score) AS lo,
    rank() OVER (PARTITION BY uid ORDER BY score) + count(*) OVER (PARTITION BY uid, score) - 1 AS hi FROM rollouts)
, v AS (SELECT DISTINCT uid, score, N, lo, hi FROM r)
, s AS (SELECT *, CAST(unnest(list_concat(list_filter(list_transform(range(1, 40), lambda e: CAST(pow(2, e) AS BIGINT)), lambda p: p < N), [N])) AS INTEGER) AS s FROM v WHERE N > 1)
, p AS (SELECT uid, s, score, pow(hi / N, s) - pow((lo - 1) / N, s) AS pmax, pow((N - lo + 1) / N, s) - pow((N - hi) / N, s) AS pmin FROM s)
SELECT uid, s, round(sum(score * pmax), 6) AS best_mean, round(sum(score * pmin), 6) AS worst_mean FROM p GROUP BY uid, s""")
def q_best_worst_at_n(spark, sf_dir):
    d = M.best_worst_at_n(T.rollouts(spark, sf_dir), ["uid"], "score")
    return d.select("uid", "s", r6("best_mean").alias("best_mean"), r6("worst_mean").alias("worst_mean"))
