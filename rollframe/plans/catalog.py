"""Registered queries: one Spark plan per operator, each paired with an independent
DuckDB oracle over the same source tables.

Every query reads whole given tables (or tables Spark derives from them in
:mod:`rollframe.plans.tables`); nothing runs on made-up input.  Doubles are rounded to 6
decimals on both sides so the value hashes compare.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c):
    """Round a double column to 6 decimals (both engines round half away from zero)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r6a(c):
    """Round every element of an array<double> column."""
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: F.round(x, 6))


# ---------------------------------------------------------------------------
# Oracle-side derivations of the engine tables (DuckDB SQL, mirrors plans.tables)
# ---------------------------------------------------------------------------
ROLLOUTS_SQL = """rollouts AS (
  SELECT event_id AS response_id, user_id AS uid, event_type AS data_source,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS step,
         value AS score, CASE WHEN value >= 250 THEN 1.0e0 ELSE 0.0e0 END AS acc,
         CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS pred,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample_idx
  FROM events)"""

RESPONSES_SQL = r"""responses AS (
  SELECT event_id AS response_id, user_id AS uid,
    CASE event_type WHEN 'click' THEN 'openai/gsm8k' WHEN 'view' THEN 'lighteval/MATH'
      WHEN 'purchase' THEN 'Idavidrein/gpqa' WHEN 'signup' THEN 'AIME2024'
      WHEN 'error' THEN 'math_geometry' END AS data_source,
    CASE
      WHEN event_type = 'click' THEN CASE WHEN event_id % 7 = 0 THEN 'The total is ' || a
           ELSE 'Step ' || CAST(event_id AS VARCHAR) || ': adding gives ' || a || '.' || chr(10) || '#### ' || a END
      WHEN event_type = 'view' THEN CASE WHEN event_id % 7 = 0 THEN 'It is ' || a
           ELSE 'So the result is $\boxed{' || a || '}$.' END
      WHEN event_type = 'purchase' THEN 'Reasoning ' || CAST(event_id AS VARCHAR) || '. Answer: ' || substr('ABCD', CAST(ans % 4 + 1 AS INTEGER), 1)
      WHEN event_type = 'signup' THEN 'We get \boxed{' || a || '} finally'
      ELSE '<think>case ' || CAST(event_id AS VARCHAR) || '</think> so \boxed{' || a || '}'
    END AS response,
    CASE WHEN event_type = 'purchase' THEN substr('ABCD', CAST(gt % 4 + 1 AS INTEGER), 1)
         ELSE CAST(gt AS VARCHAR) END AS ground_truth
  FROM (SELECT *, CAST(floor(value) AS BIGINT) AS ans,
               CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS a,
               CAST(floor(value) AS BIGINT) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS gt
        FROM events))"""

TOKENS_SQL = """tokens AS (
  SELECT vec_id AS response_id, CAST(vec_id // 40 * 100 + label AS BIGINT) AS uid, CAST(vec_id // 128 AS BIGINT) AS batch_id,
         list_transform(range(64), lambda i: CASE WHEN i < 16 + vec_id % 49 THEN 1 ELSE 0 END) AS response_mask,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS log_probs,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 0.95) AS old_log_probs,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 0.9) AS ref_log_probs,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 0.5) AS "values",
         list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS token_level_rewards,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS token_level_scores
  FROM embeddings)"""

EXECUTIONS_SQL = """executions AS (
  SELECT CAST(l_orderkey // 4 AS BIGINT) AS uid, l_orderkey AS response_id, 0 AS testcase_idx,
         l_linenumber AS input_idx, good_status, q AS good_output, bad_status,
         CASE WHEN bad_status <> 'Correct' THEN NULL
              WHEN l_linestatus = 'F' AND l_quantity > 40 THEN CAST(CAST(l_quantity AS BIGINT) + 1 AS VARCHAR)
              WHEN l_partkey % 13 = 0 THEN NULL
              ELSE ' ' || q || chr(10) END AS bad_output,
         NOT (l_returnflag = 'N' AND l_quantity <= 2) AS check_good,
         CASE l_linenumber % 3 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'AssertionError' ELSE 'RuntimeError' END AS check_good_reason,
         (l_suppkey % 4) <> 0 AS check_bad
  FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q,
          CASE WHEN l_returnflag = 'R' AND l_tax >= 0.07 THEN 'RuntimeError'
               WHEN l_discount = 0.0 THEN 'TimeoutError' ELSE 'Correct' END AS good_status,
          CASE WHEN l_returnflag = 'A' AND l_tax = 0.0 THEN 'RuntimeError'
               WHEN l_linestatus = 'O' AND l_discount = 0.1 THEN 'TimeoutError' ELSE 'Correct' END AS bad_status
        FROM lineitem))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# Import the query modules so their @register decorators run.
from rollframe.plans import q_scoring, q_metrics, q_groups, q_batch, q_outcomes, q_filters, q_tokens, q_diag, q_prep, q_balance, q_io, q_more  # noqa: E402,F401
