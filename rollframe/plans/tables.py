"""Engine tables derived from the given source tables.

The registered queries never run on made-up input: every engine table below is a lazy
projection of a given table (``events``, ``embeddings``, ``lineitem``, ``documents``,
``labels``, ``conversations``), so its size grows with the data.  Each derivation is a
narrow transformation (no shuffle) except ``sample_idx``, a window partitioned by the
prompt key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollframe.session import ship_package

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# event_type -> data_source used by the scoring fixtures
EVENT_SOURCE = {
    "click": "openai/gsm8k",
    "view": "lighteval/MATH",
    "purchase": "Idavidrein/gpqa",
    "signup": "AIME2024",
    "error": "math_geometry",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _step(ts_col: str = "ts"):
    # days since 2024-01-01; timezone independent for TIMESTAMP_NTZ
    return F.datediff(F.to_date(F.col(ts_col)), F.lit("2024-01-01")).cast("int")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rollouts``: one row per response.

    response_id=event_id, uid=user_id (prompt group), data_source=event_type,
    score=value, acc = value >= 250, pred = floor(value/50), step = day of January."""
    ev = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return ev.select(
        F.col("event_id").alias("response_id"),
        F.col("user_id").alias("uid"),
        F.col("event_type").alias("data_source"),
        _step().alias("step"),
        F.col("value").alias("score"),
        F.when(F.col("value") >= 250, 1.0).otherwise(0.0).alias("acc"),
        F.floor(F.col("value") / 50).cast("bigint").cast("string").alias("pred"),
        (F.row_number().over(w) - 1).alias("sample_idx"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``responses`` for scoring: response text per data source, built from literals and
    ids.  answer = floor(value); ground truth is off by one for every third event."""
    ev = table(spark, sf_dir, "events")
    ans = F.floor("value").cast("bigint")
    gt = ans + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    eid = F.col("event_id").cast("string")
    a = ans.cast("string")
    letter = lambda n: F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), 1)
    miss = F.col("event_id") % 7 == 0
    et = F.col("event_type")
    text = (
        F.when(et == "click", F.when(miss, F.concat(F.lit("The total is "), a)).otherwise(
            F.concat(F.lit("Step "), eid, F.lit(": adding gives "), a, F.lit(".\n#### "), a)))
        .when(et == "view", F.when(miss, F.concat(F.lit("It is "), a)).otherwise(
            F.concat(F.lit("So the result is $\\boxed{"), a, F.lit("}$."))))
        .when(et == "purchase", F.concat(F.lit("Reasoning "), eid, F.lit(". Answer: "), letter(ans)))
        .when(et == "signup", F.concat(F.lit("We get \\boxed{"), a, F.lit("} finally")))
        .otherwise(F.concat(F.lit("<think>case "), eid, F.lit("</think> so \\boxed{"), a, F.lit("}")))
    )
    src = F.lit(None).cast("string")
    for k, v in EVENT_SOURCE.items():
        src = F.when(et == k, F.lit(v)).otherwise(src)
    ground = F.when(et == "purchase", letter(gt)).otherwise(gt.cast("string"))
    return ev.select(
        F.col("event_id").alias("response_id"),
        F.col("user_id").alias("uid"),
        src.alias("data_source"),
        text.alias("response"),
        ground.alias("ground_truth"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tokens``: 64-position arrays from ``embeddings``.

    response_id=vec_id, uid = label within a run of 40 ids (groups of a few, some of one),
    batch_id = run of 128 ids; log_probs = embedding,
    old = 0.95x, ref = 0.9x, values = 0.5x, rewards = x; response mask = first
    16 + vec_id % 49 positions."""
    emb = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    n_valid = F.lit(16) + F.col("vec_id") % 49
    return emb.select(
        F.col("vec_id").alias("response_id"),
        (F.floor(F.col("vec_id") / 40) * 100 + F.col("label")).cast("bigint").alias("uid"),
        F.floor(F.col("vec_id") / 128).cast("bigint").alias("batch_id"),
        F.transform(F.sequence(F.lit(0), F.lit(63)),
                    lambda i: F.when(i < n_valid, 1).otherwise(0)).alias("response_mask"),
        x.alias("log_probs"),
        F.transform(x, lambda v: v * 0.95).alias("old_log_probs"),
        F.transform(x, lambda v: v * 0.9).alias("ref_log_probs"),
        F.transform(x, lambda v: v * 0.5).alias("values"),
        x.alias("token_level_rewards"),
        x.alias("token_level_scores"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``executions`` of a good and a bad program per (response, input), from lineitem.

    response_id=l_orderkey, uid = l_orderkey div 4, input_idx=l_linenumber.  A NULL
    bad_output with a successful status stands for an undecidable comparison."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("bigint").cast("string")
    good_status = (F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.07), "RuntimeError")
                   .when(F.col("l_discount") == 0.0, "TimeoutError").otherwise("Correct"))
    bad_status = (F.when((F.col("l_returnflag") == "A") & (F.col("l_tax") == 0.0), "RuntimeError")
                  .when((F.col("l_linestatus") == "O") & (F.col("l_discount") == 0.1), "TimeoutError")
                  .otherwise("Correct"))
    bad_output = (F.when(bad_status != "Correct", F.lit(None).cast("string"))
                  .when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40),
                        (F.col("l_quantity").cast("bigint") + 1).cast("string"))
                  .when(F.col("l_partkey") % 13 == 0, F.lit(None).cast("string"))
                  .otherwise(F.concat(F.lit(" "), q, F.lit("\n"))))
    return li.select(
        (F.col("l_orderkey") / 4).cast("bigint").alias("uid"),
        F.col("l_orderkey").alias("response_id"),
        F.lit(0).alias("testcase_idx"),
        F.col("l_linenumber").alias("input_idx"),
        good_status.alias("good_status"),
        q.alias("good_output"),
        bad_status.alias("bad_status"),
        bad_output.alias("bad_output"),
        (~((F.col("l_returnflag") == "N") & (F.col("l_quantity") <= 2))).alias("check_good"),
        F.when(F.col("l_linenumber") % 3 == 0, "TimeoutError").when(F.col("l_linenumber") % 3 == 1, "AssertionError")
        .otherwise("RuntimeError").alias("check_good_reason"),
        ((F.col("l_suppkey") % 4) != 0).alias("check_bad"),
    )


# What responses with code look like
_GEN, _ASSERT = "def generate_input_1():\\n    return 1\\n", "def check_output(a, b):\\n    assert a == b\\n    return True"
CODE_KINDS = [
    "no code here",
    "```python\\n" + _GEN + _ASSERT + "\\n```",
    "```python\\n" + _GEN + "def check_output(a, b):\\n    return a == b  # assert a\\n```",
    "```python\\ndef helper():\\n    return 1\\n```",
    "```python\\ndef solve(x):\\n    return x\\n" + _GEN + _ASSERT + "\\n```",
    "Use brute force.\\n```python\\ndef brute_solve(x):\\n    assert x != 1\\n" + _GEN + "\\n```",
    "```python\\ndef my_correct_answer (x):\\n    print(\"assert a > b\")\\n" + _GEN + "def check_output(a, b):\\n    pass\\n```",
    "```python\\nfirst = 1\\n```\\nthen\\n```python\\n    " + _GEN + "assert first # a > b\\n```",
    "```json\\n[1]\\n```",
]


def code_text(key):
    """A response with code: the kind is the key modulo the number of kinds."""
    out = F.lit(None).cast("string")
    for i, t in enumerate(CODE_KINDS):
        out = F.when(key % len(CODE_KINDS) == i, F.lit(t.replace("\\n", "\n"))).otherwise(out)
    return F.concat(F.lit("Answer to "), key.cast("string"), F.lit(":\n"), out)
