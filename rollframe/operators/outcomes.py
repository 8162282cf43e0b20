"""Test-outcome classification over an ``executions`` table.

Running untrusted code is not part of this library: users bring one row per
(response, input) with the good and bad program's status/output and the output-checker
verdicts.  Classification is one ``groupBy(response)`` of boolean flags (partial
aggregation, so a response with a huge input list is pre-reduced map-side) followed by a
``CASE`` ladder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.functions.answers import let

# Outcome classes and execution statuses
REWARD_TYPES = ["FormatError", "PassGoodFailBad", "PassGoodPassBad", "FailGood", "Truncated",
                "GoodInputFailGood", "GoodInputPassGoodPassBad"]
EXECUTION_RESULTS = ["CompileError", "ExecutionError", "AssertionError", "RuntimeError", "TimeoutError",
                     "Correct", "Wrong", "EarlyStopped", "InputGeneratorError"]

_WS = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _WS, "")


def output_equal(a, b) -> Column:
    """Equal after stripping; otherwise same number of lines and line-wise stripped
    equality.  NULL when either side is NULL (undecidable)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    sa, sb = _strip(a), _strip(b)
    lines = lambda s: F.transform(F.split(s, _LINES, -1), _strip)
    # most outputs are equal as they are; only others are trimmed, and only unequal ones split
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(a == b, True).otherwise(
        let(sa, lambda x: let(sb, lambda y: F.when(x == y, True).otherwise(lines(x) == lines(y)))))


def classify_test_outcome(executions: DataFrame, response_keys: list[str] | None = None,
                          formats: DataFrame | None = None) -> DataFrame:
    """One row per response: ``reward_type``, ``fail_index``, ``fail_reason``, ``num_inputs``.

    Ladder (first match wins):
    1. the good program errs (not a timeout) on some input -> FailGood at the first such input;
    2. no input differs -> PassGoodPassBad if every non-timeout good output checks, else FailGood;
    3. some input differs -> GoodInputFailGood if a good output fails its check; else
       GoodInputPassGoodPassBad if the bad program passes every non-equal input, else
       PassGoodFailBad.
    The reason of a failed output check is the checker's own (``check_good_reason`` of the first
    failing input, if the table has it), else AssertionError.
    ``formats`` (response keys + ``format_ok``) marks FormatError responses; responses without
    executions have no inputs and pass trivially."""
    keys = response_keys or ["uid", "response_id"]
    e = executions
    good_to = F.col("good_status") == "TimeoutError"
    good_err = ~F.col("good_status").isin("Correct", "TimeoutError")
    bad_err = F.col("bad_status") != "Correct"
    eq = output_equal("good_output", "bad_output")
    ran = ~good_to & ~good_err
    diff = ran & (bad_err | (eq == F.lit(False)))
    equal_idx = ran & ~bad_err & F.coalesce(eq, F.lit(False))
    good_fail = ran & ~F.col("check_good")
    bad_fail = ~equal_idx & (bad_err | ~F.col("check_bad"))
    idx = F.col("input_idx")
    reason = F.col("check_good_reason") if "check_good_reason" in e.columns else F.lit(None).cast("string")
    agg = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_inputs"),
        F.min(F.when(good_err, idx)).alias("__err_idx"),
        F.bool_or(diff).alias("__diff"),
        F.min(F.when(good_fail, idx)).alias("__gfail_idx"),
        F.min_by(F.when(good_fail, reason), F.when(good_fail, idx)).alias("__greason"),
        F.bool_or(bad_fail).alias("__bfail"),
    )
    if formats is not None:
        agg = formats.select(*keys, "format_ok").join(agg, keys, "left")
        fmt_bad = ~F.col("format_ok")
    else:
        fmt_bad = F.lit(False)
    has_err = F.col("__err_idx").isNotNull()
    any_diff = F.coalesce(F.col("__diff"), F.lit(False))
    good_ok = F.col("__gfail_idx").isNull()
    bad_ok = ~F.coalesce(F.col("__bfail"), F.lit(False))
    cls = (F.when(fmt_bad, "FormatError")
           .when(has_err, "FailGood")
           .when(~any_diff & good_ok, "PassGoodPassBad")
           .when(~any_diff, "FailGood")
           .when(~good_ok, "GoodInputFailGood")
           .when(bad_ok, "GoodInputPassGoodPassBad")
           .otherwise("PassGoodFailBad"))
    fail_index = (F.when(fmt_bad, F.lit(None)).when(has_err, F.col("__err_idx"))
                  .when(~good_ok, F.col("__gfail_idx")))
    fail_reason = (F.when(fmt_bad, F.lit(None)).when(has_err, F.lit("ExecutionError"))
                   .when(~good_ok, F.coalesce("__greason", F.lit("AssertionError"))))
    out = agg.select(*keys, cls.alias("reward_type"), fail_index.cast("int").alias("fail_index"),
                     fail_reason.alias("fail_reason"),
                     F.when(fmt_bad, F.lit(-1)).otherwise(F.coalesce(F.col("num_inputs"), F.lit(0)))
                     .cast("bigint").alias("num_inputs"))
    return out


def outcome_reward(df: DataFrame, class_col: str = "reward_type", wrong_test_penalty: float = 0.0,
                   good_input_reward: float = 0.1, good_test_reward: float = 1.0,
                   format_penalty: float = -1.0, out_col: str = "score") -> DataFrame:
    c = F.col(class_col)
    r = (F.when(c == "FailGood", F.lit(float(wrong_test_penalty)))
         .when(c == "PassGoodPassBad", F.lit(0.0))
         .when(c.isin("GoodInputFailGood", "GoodInputPassGoodPassBad"), F.lit(float(good_input_reward)))
         .when(c == "PassGoodFailBad", F.lit(float(good_test_reward)))
         .when(c == "FormatError", F.lit(float(format_penalty)))
         .otherwise(F.raise_error(F.concat(F.lit("Unexpected reward type: "), c)).cast("double")))
    return df.withColumn(out_col, r)


def aggregate_outcomes(df: DataFrame, keys: list[str], class_col: str = "reward_type",
                       score_col: str = "score") -> DataFrame:
    """Combine the responses of each aggregation group: score = min; class by the
    precedence ladder (no good-input class -> FormatError if all are, FailGood if any,
    else PassGoodPassBad; otherwise GoodInputFailGood if any good-input-fail or fail-good,
    then PassGoodFailBad, else GoodInputPassGoodPassBad)."""
    c = F.col(class_col)
    g = df.groupBy(*keys).agg(
        F.min(score_col).alias(score_col),
        F.bool_or(c.isin("GoodInputFailGood", "GoodInputPassGoodPassBad", "PassGoodFailBad")).alias("__good_in"),
        F.bool_and(c == "FormatError").alias("__all_fmt"),
        F.bool_or(c == "FailGood").alias("__any_fg"),
        F.bool_or(c.isin("GoodInputFailGood", "FailGood")).alias("__any_gifg"),
        F.bool_or(c == "PassGoodFailBad").alias("__any_pgfb"),
        F.count(F.lit(1)).alias("n_aggregated"))
    cls = (F.when(~F.col("__good_in") & F.col("__all_fmt"), "FormatError")
           .when(~F.col("__good_in") & F.col("__any_fg"), "FailGood")
           .when(~F.col("__good_in"), "PassGoodPassBad")
           .when(F.col("__any_gifg"), "GoodInputFailGood")
           .when(F.col("__any_pgfb"), "PassGoodFailBad")
           .otherwise("GoodInputPassGoodPassBad"))
    return g.select(*keys, score_col, cls.alias(class_col), "n_aggregated")


def positional_chunks(df: DataFrame, item_col: str, pos_col: str, k: int, out_col: str = "chunk") -> DataFrame:
    """``chunk = pos div k``; every item's response count must be divisible by ``k``."""
    cnt = df.groupBy(item_col).agg(F.count(F.lit(1)).alias("__c"))
    bad = F.col("__c") % k != 0
    d = df.join(cnt, item_col)
    return d.withColumn(out_col, F.when(bad, F.raise_error(F.lit("response count must be divisible by aggregate_num")))
                        .otherwise((F.col(pos_col) / k).cast("bigint"))).drop("__c")


def program_pass_counts(df: DataFrame, item_col: str, program_col: str, passed_col: str,
                        format_col: str | None = None) -> DataFrame:
    """Per (item, candidate program): tests passed over all responses, and ``num_tests``.  Tests of
    a response with a format error are not run: they count in neither, and an item that has
    no others has ``num_tests`` -1."""
    ran = F.lit(True) if format_col is None else F.col(format_col)
    g = df.groupBy(item_col, program_col).agg(
        F.sum(F.when(ran & F.col(passed_col), 1).otherwise(0)).cast("bigint").alias("num_passed"),
        F.sum(F.when(ran, 1).otherwise(0)).cast("bigint").alias("__n"))
    return g.withColumn("num_tests", F.when(F.col("__n") > 0, F.col("__n")).otherwise(F.lit(-1))).drop("__n")


def test_case_pass_fraction(df: DataFrame, keys: list[str], idx_col: str, passed_col: str,
                            first_n: int = 10) -> DataFrame:
    """1.0 when every test passes, else the share of passes among the first ``first_n``."""
    p = F.col(passed_col)
    g = df.groupBy(*keys).agg(F.bool_and(p).alias("__all"),
                              F.avg(F.when(F.col(idx_col) < first_n, p.cast("double"))).alias("__frac"))
    return g.select(*keys, F.when(F.col("__all"), F.lit(1.0)).otherwise(F.coalesce(F.col("__frac"), F.lit(0.0)))
                    .alias("pass_fraction"))
