"""Registered filter / sampling queries over ``rollouts`` and ``tokens``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.functions import arrays as AR
from rollframe.operators import filters as FL
from rollframe.operators import scoring as S
from rollframe.plans import tables as T
from rollframe.plans.catalog import ROLLOUTS_SQL, TOKENS_SQL, register, r6, with_


@register("filter_zero_variance_groups", with_(ROLLOUTS_SQL) + """
SELECT response_id, uid, data_source, acc FROM rollouts WHERE (uid, data_source) IN (
  SELECT (uid, data_source) FROM rollouts GROUP BY uid, data_source HAVING count(*) = 1 OR min(acc) <> max(acc))""")
def q_filter_zero_variance_groups(spark, sf_dir):
    r = T.rollouts(spark, sf_dir).withColumn("grp", F.struct("uid", "data_source"))
    d = FL.filter_zero_variance_groups(r, "grp", "acc")
    return d.select("response_id", "uid", "data_source", "acc")


@register("accuracy_band_filter", with_(ROLLOUTS_SQL) + """
SELECT r.response_id, r.uid, g.m >= 0.3 AND g.m <= 0.6 AS pass_filter
FROM rollouts r JOIN (SELECT uid, avg(acc) AS m FROM rollouts GROUP BY uid) g USING (uid)""")
def q_accuracy_band_filter(spark, sf_dir):
    d = FL.accuracy_band_filter(T.rollouts(spark, sf_dir), 0.3, 0.6)
    return d.select("response_id", "uid", "pass_filter")


@register("truncation_filter", with_(TOKENS_SQL) + """
, t AS (SELECT response_id, uid, list_sum(response_mask) AS response_len FROM tokens)
SELECT t.response_id, t.uid, t.response_len, g.mx < 64 - 1 AS pass_filter
FROM t JOIN (SELECT uid, max(response_len) AS mx FROM t GROUP BY uid) g USING (uid)""")
def q_truncation_filter(spark, sf_dir):
    t = T.tokens(spark, sf_dir).withColumn("response_len", AR.arr_isum("response_mask"))
    d = FL.truncation_filter(t, 64)
    return d.select("response_id", "uid", "response_len", "pass_filter")


@register("prioritized_downsample", with_(ROLLOUTS_SQL) + """
, g AS (SELECT uid, avg(acc) >= 0.3 AND avg(acc) <= 0.6 AS p FROM rollouts GROUP BY uid)
, rk AS (SELECT uid, row_number() OVER (ORDER BY p DESC, uid) - 1 AS grank FROM g)
SELECT response_id, uid, new_pos FROM (
  SELECT r.response_id, r.uid, row_number() OVER (ORDER BY rk.grank, r.sample_idx) - 1 AS new_pos
  FROM rollouts r JOIN rk USING (uid)) WHERE new_pos < (SELECT count(*) FROM rollouts) // 2""")
def q_prioritized_downsample(spark, sf_dir):
    r = T.rollouts(spark, sf_dir)
    flagged = FL.accuracy_band_filter(r, 0.3, 0.6).withColumn("group_pos", F.col("uid"))
    d = FL.prioritized_downsample(flagged, T.table(spark, sf_dir, "events").count() // 2)
    return d.select("response_id", "uid", "new_pos")


@register("accumulate_to_target", with_(ROLLOUTS_SQL) + """
, rr AS (SELECT *, step // 10 AS gen_round FROM rollouts)
, kept AS (SELECT rr.* FROM rr JOIN (SELECT gen_round, uid FROM rr GROUP BY gen_round, uid
                                       HAVING count(*) = 1 OR min(acc) <> max(acc)) k USING (gen_round, uid))
, cum AS (SELECT gen_round, sum(cnt) OVER (ORDER BY gen_round) AS c
          FROM (SELECT gen_round, count(DISTINCT uid) AS cnt FROM kept GROUP BY gen_round))
, target AS (SELECT max(c) // 2 AS t FROM cum)
, lim AS (SELECT min(gen_round) AS last FROM cum WHERE c >= (SELECT t FROM target))
SELECT response_id, gen_round, uid, batch_pos FROM (
  SELECT response_id, gen_round, uid, row_number() OVER (ORDER BY gen_round, uid, sample_idx) - 1 AS batch_pos
  FROM kept WHERE gen_round <= (SELECT last FROM lim)) WHERE batch_pos < (SELECT t FROM target) * 10""")
def q_accumulate_to_target(spark, sf_dir):
    r = T.rollouts(spark, sf_dir).withColumn("gen_round", (F.col("step") / 10).cast("int"))
    # half of the groups that can be kept: reachable at any scale
    groups = r.groupBy("gen_round", "uid").agg(F.count("*").alias("n"), F.min("acc").alias("lo"), F.max("acc").alias("hi"))
    target = groups.where("n = 1 or lo <> hi").count() // 2
    d = FL.accumulate_to_target(r, target, 10, metric_col="acc")
    return d.select("response_id", "gen_round", "uid", "batch_pos")


@register("mask_single_score_groups", with_(ROLLOUTS_SQL) + """
, g AS (SELECT data_source, uid, count(DISTINCT acc) AS nd, min(acc) AS s FROM rollouts GROUP BY data_source, uid)
SELECT g.data_source, s AS score, round(count(*) / any_value(t.n), 6) AS share
FROM g JOIN (SELECT data_source, count(*) AS n FROM g GROUP BY data_source) t USING (data_source)
WHERE nd = 1 GROUP BY g.data_source, s""")
def q_single_score_group_share(spark, sf_dir):
    d = FL.single_score_group_share(T.rollouts(spark, sf_dir), score_col="acc")
    return d.select("data_source", "score", r6("share").alias("share"))


@register("log_sample", with_(ROLLOUTS_SQL) + """
SELECT response_id, uid, score FROM rollouts ORDER BY md5(concat_ws('|', '42', CAST(response_id AS VARCHAR))), response_id LIMIT 20""")
def q_log_sample(spark, sf_dir):
    return FL.log_sample(T.rollouts(spark, sf_dir), 20, "response_id").select("response_id", "uid", "score")


@register("sample_for_review", with_(ROLLOUTS_SQL) + """
SELECT response_id, data_source FROM (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY response_id) AS rn
FROM rollouts) WHERE rn <= 3""")
def q_sample_for_review(spark, sf_dir):
    return S.sample_for_review(T.rollouts(spark, sf_dir), 3).select("response_id", "data_source")


@register("tool_attempt_reward", """
SELECT event_id, user_id, CASE WHEN value > coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0.0)
  THEN 0.0e0 ELSE -0.05e0 END AS tool_reward FROM events""")
def q_tool_attempt_reward(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events").withColumnRenamed("value", "reward")
    d = S.tool_attempt_reward(ev, "user_id", "event_id")
    return d.select("event_id", "user_id", "tool_reward")
