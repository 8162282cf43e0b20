"""Registered scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.functions import answers as A
from rollframe.operators import metrics as M
from rollframe.operators import scoring as S
from rollframe.plans import tables as T
from rollframe.plans.catalog import RESPONSES_SQL, register, r6, with_


@register("score_by_source", with_(RESPONSES_SQL) + r"""
SELECT response_id, data_source,
  CASE
    WHEN data_source = 'openai/gsm8k' THEN CASE
        WHEN NOT regexp_matches(response, '#### (\-?[0-9\.\,]+)') THEN 0.0e0
        WHEN replace(replace(regexp_extract(response, '#### (\-?[0-9\.\,]+)', 1), ',', ''), '$', '') = ground_truth THEN 1.0e0
        ELSE 0.0e0 END
    WHEN data_source IN ('lighteval/MATH', 'DigitalLearningGmbH/MATH-lighteval')
         OR starts_with(data_source, 'math') OR starts_with(data_source, 'AIME') THEN CASE
        WHEN regexp_extract(response, '\\boxed\{([^{}]*)\}[^\\]*$', 1) = ground_truth
             AND regexp_matches(response, '\\boxed\{') THEN 1.0e0 ELSE 0.0e0 END
    WHEN data_source = 'Idavidrein/gpqa' THEN CASE
        WHEN regexp_extract(response, '(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?', 1) = ground_truth THEN 1.0e0 ELSE 0.0e0 END
  END AS score
FROM responses""")
def q_score_by_source(spark, sf_dir):
    df = S.score_by_source(T.responses(spark, sf_dir))
    return df.select("response_id", "data_source", "score")


@register("score_hash_answer", with_(RESPONSES_SQL) + r"""
SELECT response_id,
  CASE WHEN regexp_matches(response, '#### (\-?[0-9\.\,]+)')
       THEN replace(replace(regexp_extract(response, '#### (\-?[0-9\.\,]+)', 1), ',', ''), '$', '') END AS strict_pred,
  CASE WHEN len(regexp_extract_all(response, '(\-?[0-9\.\,]+)', 1)) = 0 THEN NULL
       ELSE coalesce(list_filter(regexp_extract_all(response, '(\-?[0-9\.\,]+)', 1), lambda x: x NOT IN ('', '.'))[-1],
                     regexp_extract_all(response, '(\-?[0-9\.\,]+)', 1)[1]) END AS flexible_pred,
  CASE WHEN NOT regexp_matches(response, '#### (\-?[0-9\.\,]+)') THEN 0.0e0
       WHEN replace(replace(regexp_extract(response, '#### (\-?[0-9\.\,]+)', 1), ',', ''), '$', '') = ground_truth THEN 1.0e0
       ELSE 0.0e0 END AS strict_score
FROM responses""")
def q_score_hash_answer(spark, sf_dir):
    df = T.responses(spark, sf_dir)
    return df.select(
        "response_id",
        A.hash_answer_strict("response").alias("strict_pred"),
        A.hash_answer_flexible("response").alias("flexible_pred"),
        A.score_hash_answer("response", "ground_truth").alias("strict_score"))


@register("score_multiple_choice", with_(RESPONSES_SQL) + r"""
SELECT response_id,
  CASE WHEN regexp_matches(response, '(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?')
       THEN regexp_extract(response, '(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?', 1) END AS pred,
  CASE WHEN regexp_extract(response, '(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?', 1) = ground_truth THEN 1.0e0 ELSE 0.0e0 END AS score
FROM responses""")
def q_score_multiple_choice(spark, sf_dir):
    df = T.responses(spark, sf_dir)
    return df.select("response_id", A.multiple_choice_answer("response").alias("pred"),
                     A.score_multiple_choice("response", "ground_truth").alias("score"))


@register("score_boxed_math", with_(RESPONSES_SQL) + r"""
SELECT response_id,
  CASE WHEN regexp_matches(response, '\\boxed\{') THEN regexp_extract(response, '\\boxed\{([^{}]*)\}[^\\]*$', 1) END AS pred,
  CASE WHEN regexp_matches(response, '\\boxed\{')
        AND regexp_extract(response, '\\boxed\{([^{}]*)\}[^\\]*$', 1) = ground_truth THEN 1.0e0 ELSE 0.0e0 END AS score
FROM responses""")
def q_score_boxed_math(spark, sf_dir):
    df = T.responses(spark, sf_dir)
    return df.select("response_id", A.boxed_answer("response").alias("pred"),
                     A.score_boxed_math("response", "ground_truth").alias("score"))


@register("score_think_format", with_(RESPONSES_SQL) + r"""
SELECT response_id,
  0.9e0 * (CASE WHEN regexp_matches(response, '\\boxed\{')
        AND regexp_extract(response, '\\boxed\{([^{}]*)\}[^\\]*$', 1) = ground_truth THEN 1.0e0 ELSE 0.0e0 END)
  + 0.1e0 * (CASE WHEN regexp_full_match(response, '(?s)<think>.*</think>.*\\boxed\{.*\}.*') THEN 1.0e0 ELSE 0.0e0 END) AS score
FROM responses""")
def q_score_think_format(spark, sf_dir):
    df = T.responses(spark, sf_dir)
    return df.select("response_id", r6(A.score_think_format("response", "ground_truth")).alias("score"))


@register("mean_score_by_source", with_(RESPONSES_SQL) + r"""
, scored AS (
  SELECT uid, data_source,
    CASE
      WHEN data_source = 'openai/gsm8k' THEN CASE
          WHEN replace(replace(regexp_extract(response, '#### (\-?[0-9\.\,]+)', 1), ',', ''), '$', '') = ground_truth
               AND regexp_matches(response, '#### (\-?[0-9\.\,]+)') THEN 1.0e0 ELSE 0.0e0 END
      WHEN data_source = 'Idavidrein/gpqa' THEN CASE
          WHEN regexp_extract(response, '(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?', 1) = ground_truth THEN 1.0e0 ELSE 0.0e0 END
      ELSE CASE WHEN regexp_matches(response, '\\boxed\{')
               AND regexp_extract(response, '\\boxed\{([^{}]*)\}[^\\]*$', 1) = ground_truth THEN 1.0e0 ELSE 0.0e0 END
    END AS score
  FROM responses)
SELECT data_source, round(avg(prompt_score), 6) AS mean_score, count(*) AS n_prompts
FROM (SELECT data_source, uid, avg(score) AS prompt_score FROM scored GROUP BY data_source, uid)
GROUP BY data_source""")
def q_mean_score_by_source(spark, sf_dir):
    scored = S.score_by_source(T.responses(spark, sf_dir))
    out = M.mean_score_by_source(scored)
    return out.select("data_source", r6("mean_score").alias("mean_score"), "n_prompts")


from rollframe.plans.catalog import ROLLOUTS_SQL, EXECUTIONS_SQL  # noqa: E402


@register("place_terminal_reward", with_(ROLLOUTS_SQL) + """
SELECT response_id, list_transform(range(16), lambda i: CASE WHEN i = CAST(sample_idx % 16 AS BIGINT) THEN round(score, 6) ELSE 0.0 END) AS token_level_scores
FROM rollouts""")
def q_place_terminal_reward(spark, sf_dir):
    r = T.rollouts(spark, sf_dir).withColumn("response_len", (F.col("sample_idx") % 16 + 1).cast("int"))
    d = S.place_terminal_reward(r.withColumn("score", r6("score")), width=16)
    return d.select("response_id", "token_level_scores")


@register("overlong_penalty", with_(ROLLOUTS_SQL) + """
SELECT response_id, round(least(-(sample_idx - (80 - 16)) / 16.0 * 1.0, 0.0), 6) AS overlong_reward,
  least(-(sample_idx - (80 - 16)) / 16.0 * 1.0, 0.0) < 0 AS overlong,
  round(score + least(-(sample_idx - (80 - 16)) / 16.0 * 1.0, 0.0), 6) AS score FROM rollouts""")
def q_overlong_penalty(spark, sf_dir):
    d = S.overlong_penalty(T.rollouts(spark, sf_dir), "sample_idx", 80, 16, 1.0)
    return d.select("response_id", r6("overlong_reward").alias("overlong_reward"), "overlong", r6("score").alias("score"))


@register("strip_eos_suffix", with_(RESPONSES_SQL) + """
SELECT response_id, CASE WHEN ends_with(response, '}') THEN substr(response, 1, length(response) - 1) ELSE response END AS response FROM responses""")
def q_strip_eos_suffix(spark, sf_dir):
    return S.strip_eos_suffix(T.responses(spark, sf_dir), "response", "}").select("response_id", "response")


@register("fill_failed_scores", with_(ROLLOUTS_SQL) + """
SELECT r.response_id, coalesce(s.score, 0.0) AS score,
  CASE WHEN s.response_id IS NULL THEN 'TimeoutError' ELSE coalesce(s.reward_type, 'FailGood') END AS reward_type
FROM rollouts r LEFT JOIN (SELECT response_id, score, CASE WHEN acc > 0 THEN 'PassGoodFailBad' END AS reward_type
                           FROM rollouts WHERE step % 5 <> 0) s USING (response_id)""")
def q_fill_failed_scores(spark, sf_dir):
    r = T.rollouts(spark, sf_dir)
    results = r.filter(F.col("step") % 5 != 0).select(
        "response_id", "score", F.when(F.col("acc") > 0, F.lit("PassGoodFailBad")).alias("reward_type"))
    d = S.fill_failed_scores(r.select("response_id"), results, "response_id")
    return d.select("response_id", "score", "reward_type")


@register("score_numeric_tolerance", with_(ROLLOUTS_SQL) + """
SELECT response_id, coalesce(abs(score - CAST(pred AS DOUBLE) * 50) <= 1e-4 * greatest(abs(score), abs(CAST(pred AS DOUBLE) * 50))
   OR abs(score - CAST(pred AS DOUBLE) * 50 / 100) <= 1e-4 * greatest(abs(score), abs(CAST(pred AS DOUBLE) * 50 / 100))
   OR abs(score - CAST(pred AS DOUBLE) * 50 * 100) <= 1e-4 * greatest(abs(score), abs(CAST(pred AS DOUBLE) * 50 * 100)), false) AS correct
FROM rollouts""")
def q_score_numeric_tolerance(spark, sf_dir):
    r = T.rollouts(spark, sf_dir).withColumns({"p": F.col("score").cast("string"),
                                               "ref": (F.col("pred").cast("double") * 50).cast("string")})
    return S.score_numeric_tolerance(r, "p", "ref").select("response_id", "correct")


@register("normalize_interval", r"""
WITH p AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Interval(' WHEN 'view' THEN 'Interval.Ropen('
    WHEN 'purchase' THEN 'Interval.Lopen(' WHEN 'signup' THEN 'Interval.open(' ELSE 'Set(' END
    || CAST(user_id AS VARCHAR) || ', ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ')' AS pred FROM events)
SELECT event_id, CASE
  WHEN regexp_matches(pred, '^Interval\((.*)\)$') THEN '[' || regexp_extract(pred, '^Interval\((.*)\)$', 1) || ']'
  WHEN regexp_matches(pred, '^Interval\.Ropen\((.*)\)$') THEN '[' || regexp_extract(pred, '^Interval\.Ropen\((.*)\)$', 1) || ')'
  WHEN regexp_matches(pred, '^Interval\.Lopen\((.*)\)$') THEN '(' || regexp_extract(pred, '^Interval\.Lopen\((.*)\)$', 1) || ']'
  WHEN regexp_matches(pred, '^Interval\.open\((.*)\)$') THEN '(' || regexp_extract(pred, '^Interval\.open\((.*)\)$', 1) || ')'
  ELSE pred END AS normalized
FROM p""")
def q_normalize_interval(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    et = F.col("event_type")
    head = (F.when(et == "click", "Interval(").when(et == "view", "Interval.Ropen(")
            .when(et == "purchase", "Interval.Lopen(").when(et == "signup", "Interval.open(").otherwise("Set("))
    pred = F.concat(head, F.col("user_id").cast("string"), F.lit(", "), F.floor("value").cast("bigint").cast("string"), F.lit(")"))
    return e.select("event_id", A.normalize_interval(pred).alias("normalized"))
