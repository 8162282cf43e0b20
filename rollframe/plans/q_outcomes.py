"""Registered outcome-classification queries over ``executions``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.functions import answers as A
from rollframe.operators import outcomes as O
from rollframe.plans import tables as T
from rollframe.plans.catalog import EXECUTIONS_SQL, register, r6, with_

CLASSIFY_SQL = with_(EXECUTIONS_SQL) + r"""
, f AS (SELECT *,
    good_status = 'TimeoutError' AS good_to,
    good_status NOT IN ('Correct', 'TimeoutError') AS good_err,
    bad_status <> 'Correct' AS bad_err,
    CASE WHEN good_output IS NULL OR bad_output IS NULL THEN NULL
         ELSE regexp_replace(good_output, '^\s+|\s+$', '', 'g') = regexp_replace(bad_output, '^\s+|\s+$', '', 'g')
           OR list_transform(regexp_split_to_array(regexp_replace(good_output, '^\s+|\s+$', '', 'g'), '\r\n|[\n\r]'),
                             lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))
            = list_transform(regexp_split_to_array(regexp_replace(bad_output, '^\s+|\s+$', '', 'g'), '\r\n|[\n\r]'),
                             lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))
    END AS eq
  FROM executions)
, g AS (SELECT *, NOT good_to AND NOT good_err AS ran FROM f)
, a AS (SELECT uid, response_id, count(*) AS n,
    min(CASE WHEN good_err THEN input_idx END) AS err_idx,
    coalesce(bool_or(ran AND (bad_err OR coalesce(eq = false, false))), false) AS any_diff,
    min(CASE WHEN ran AND NOT check_good THEN input_idx END) AS gfail_idx,
    arg_min(check_good_reason, input_idx) FILTER (ran AND NOT check_good) AS gfail_reason,
    coalesce(bool_or(NOT (ran AND NOT bad_err AND coalesce(eq, false)) AND (bad_err OR NOT check_bad)), false) AS bfail
  FROM g GROUP BY uid, response_id)
, cls AS (SELECT uid, response_id,
    CASE WHEN response_id % 9 IN (0, 8) THEN 'FormatError'
         WHEN err_idx IS NOT NULL THEN 'FailGood'
         WHEN NOT any_diff AND gfail_idx IS NULL THEN 'PassGoodPassBad'
         WHEN NOT any_diff THEN 'FailGood'
         WHEN gfail_idx IS NOT NULL THEN 'GoodInputFailGood'
         WHEN NOT bfail THEN 'GoodInputPassGoodPassBad'
         ELSE 'PassGoodFailBad' END AS reward_type,
    CAST(CASE WHEN response_id % 9 IN (0, 8) THEN NULL WHEN err_idx IS NOT NULL THEN err_idx WHEN gfail_idx IS NOT NULL THEN gfail_idx END AS INTEGER) AS fail_index,
    CASE WHEN response_id % 9 IN (0, 8) THEN NULL WHEN err_idx IS NOT NULL THEN 'ExecutionError' WHEN gfail_idx IS NOT NULL THEN gfail_reason END AS fail_reason,
    CASE WHEN response_id % 9 IN (0, 8) THEN -1 ELSE CAST(n AS BIGINT) END AS num_inputs
  FROM a)
, rew AS (SELECT *, CASE reward_type WHEN 'FailGood' THEN 0.0e0 WHEN 'PassGoodPassBad' THEN 0.0e0
      WHEN 'GoodInputFailGood' THEN 0.1e0 WHEN 'GoodInputPassGoodPassBad' THEN 0.1e0
      WHEN 'PassGoodFailBad' THEN 1.0e0 WHEN 'FormatError' THEN -1.0e0 END AS score FROM cls)
"""


def classified(spark, sf_dir):
    """Outcomes of the executions; responses whose text has no program are format errors."""
    e = T.executions(spark, sf_dir)
    formats = e.select("uid", "response_id").distinct()
    formats = formats.withColumn("format_ok", F.length(A.extract_code_block(T.code_text(F.col("response_id")))) > 0)
    return O.classify_test_outcome(e, formats=formats)


@register("classify_test_outcome", CLASSIFY_SQL + "SELECT * FROM cls")
def q_classify(spark, sf_dir):
    return classified(spark, sf_dir)


@register("outcome_reward", CLASSIFY_SQL + "SELECT uid, response_id, reward_type, score FROM rew")
def q_outcome_reward(spark, sf_dir):
    d = O.outcome_reward(classified(spark, sf_dir))
    return d.select("uid", "response_id", "reward_type", "score")


@register("aggregate_outcomes", CLASSIFY_SQL + """
SELECT uid, CAST(response_id // 2 AS BIGINT) AS pair, min(score) AS score,
  CASE WHEN NOT bool_or(reward_type IN ('GoodInputFailGood', 'GoodInputPassGoodPassBad', 'PassGoodFailBad')) THEN
         CASE WHEN bool_and(reward_type = 'FormatError') THEN 'FormatError'
              WHEN bool_or(reward_type = 'FailGood') THEN 'FailGood' ELSE 'PassGoodPassBad' END
       WHEN bool_or(reward_type IN ('GoodInputFailGood', 'FailGood')) THEN 'GoodInputFailGood'
       WHEN bool_or(reward_type = 'PassGoodFailBad') THEN 'PassGoodFailBad'
       ELSE 'GoodInputPassGoodPassBad' END AS reward_type,
  count(*) AS n_aggregated
FROM rew GROUP BY uid, CAST(response_id // 2 AS BIGINT)""")
def q_aggregate_outcomes(spark, sf_dir):
    d = O.outcome_reward(classified(spark, sf_dir)).withColumn("pair", (F.col("response_id") / 2).cast("bigint"))
    return O.aggregate_outcomes(d, ["uid", "pair"])


@register("reward_type_counts", CLASSIFY_SQL + "SELECT reward_type, count(*) AS n FROM cls GROUP BY reward_type")
def q_reward_type_counts(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("reward_type").agg(F.count(F.lit(1)).alias("n"))


@register("program_pass_counts", with_(EXECUTIONS_SQL) + """
SELECT uid, program, CAST(sum(CAST(passed AS BIGINT)) AS BIGINT) AS num_passed, count(*) AS num_tests FROM (
  SELECT uid, 'good' AS program, good_status = 'Correct' AND check_good AS passed FROM executions
  UNION ALL SELECT uid, 'bad', bad_status = 'Correct' AND check_bad FROM executions) GROUP BY uid, program""")
def q_program_pass_counts(spark, sf_dir):
    e = T.executions(spark, sf_dir)
    long = e.select("uid", F.explode(F.array(
        F.struct(F.lit("good").alias("program"), ((F.col("good_status") == "Correct") & F.col("check_good")).alias("passed")),
        F.struct(F.lit("bad").alias("program"), ((F.col("bad_status") == "Correct") & F.col("check_bad")).alias("passed")),
    )).alias("p")).select("uid", "p.program", "p.passed")
    return O.program_pass_counts(long, "uid", "program", "passed")


@register("test_case_pass_fraction", with_(EXECUTIONS_SQL) + """
SELECT response_id, round(CASE WHEN bool_and(p) THEN 1.0e0 ELSE coalesce(avg(CASE WHEN input_idx < 10 THEN CAST(p AS DOUBLE) END), 0.0e0) END, 6) AS pass_fraction
FROM (SELECT response_id, input_idx, good_status = 'Correct' AND check_good AS p FROM executions) GROUP BY response_id""")
def q_test_case_pass_fraction(spark, sf_dir):
    e = T.executions(spark, sf_dir).withColumn("p", (F.col("good_status") == "Correct") & F.col("check_good"))
    d = O.test_case_pass_fraction(e, ["response_id"], "input_idx", "p", first_n=10)
    return d.select("response_id", r6("pass_fraction").alias("pass_fraction"))


@register("normalized_output_equal", with_(EXECUTIONS_SQL) + r"""
SELECT response_id, input_idx, good_output, bad_output,
  CASE WHEN good_output IS NULL OR bad_output IS NULL THEN NULL
       ELSE regexp_replace(good_output, '^\s+|\s+$', '', 'g') = regexp_replace(bad_output, '^\s+|\s+$', '', 'g') END AS equal
FROM executions""")
def q_normalized_output_equal(spark, sf_dir):
    e = T.executions(spark, sf_dir)
    return e.select("response_id", "input_idx", "good_output", "bad_output",
                    O.output_equal("good_output", "bad_output").alias("equal"))
