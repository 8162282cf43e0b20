"""Response scoring as Spark jobs.

``score_by_source`` routes every response to a grading expression by ``data_source`` with
an ordered ``CASE WHEN`` chain, so one projection scores a mixed table in a single pass
and Catalyst can still prune columns and push filters below it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe.functions import answers as A
from rollframe.session import ship_package

Scorer = Callable[[Column, Column], Column]
Predicate = Callable[[Column], Column]

# Data-source names routed by the reference
MATH_SOURCES = ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval"]
NUMINA_SOURCES = ["numina_aops_forum", "numina_synthetic_math", "numina_amc_aime",
                  "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"]
CODE_SOURCES = ["codecontests", "apps", "codeforces", "taco"]
GPQA_SOURCES = ["Idavidrein/gpqa"]
CONTEST_SOURCES = ["Maxwell-Jia/AIME_2024", "opencompass/cnmo2024_en", "opencompass/cnmo2024_zh"]
EXECUTED = ("code", "testcase")


@dataclass
class ScorerRegistry:
    """Ordered routing table ``(name, predicate on data_source, scorer)``; first match
    wins, exactly like the reference's if/elif chain."""

    routes: list[tuple[str, Predicate, Scorer]] = field(default_factory=list)

    def register(self, name: str, predicate: Predicate, scorer: Scorer) -> "ScorerRegistry":
        self.routes.append((name, predicate, scorer))
        return self

    def copy(self) -> "ScorerRegistry":
        return ScorerRegistry(list(self.routes))

    def route_name(self, source: Column) -> Column:
        out = None
        for name, pred, _ in self.routes:
            out = F.when(pred(source), F.lit(name)) if out is None else out.when(pred(source), F.lit(name))
        return out if out is not None else F.lit(None).cast("string")

    def score(self, source: Column, response: Column, ground_truth: Column,
              on_unknown: str = "error") -> Column:
        out = None
        for _, pred, scorer in self.routes:
            s = scorer(response, ground_truth).cast("double")
            out = F.when(pred(source), s) if out is None else out.when(pred(source), s)
        if on_unknown == "error":
            fallback = F.raise_error(F.concat(
                F.lit("no scorer is registered for source "),
                F.coalesce(source, F.lit("NULL")))).cast("double")
        else:
            fallback = F.lit(None).cast("double")
        return fallback if out is None else out.otherwise(fallback)


def default_registry() -> ScorerRegistry:
    """The text routes, in order.  Code and test-case sources come before the math prefix and
    give no score here: :func:`score_by_source` takes theirs from executed results."""
    none = lambda t, g: F.lit(None).cast("double")
    r = ScorerRegistry()
    r.register("gsm8k", lambda s: s == "openai/gsm8k", lambda t, g: A.score_hash_answer(t, g))
    r.register("math", lambda s: s.isin(*MATH_SOURCES), A.score_boxed_math)
    r.register("prime_math", lambda s: s.isin(*NUMINA_SOURCES),
               lambda t, g: A.let(A.extract_final_answer(t)["answer"], lambda a: F.when(
                   A.score_tuple_answers(a, g) | score_numeric_or_text(a, g), 1.0).otherwise(0.0)))
    r.register("code", lambda s: s.isin(*CODE_SOURCES), none)
    r.register("testcase", lambda s: s.contains("testcase"), none)
    r.register("math_prefix", lambda s: s.startswith("math") | s.startswith("AIME"),
               A.score_boxed_math)
    r.register("contest_math", lambda s: s.isin(*CONTEST_SOURCES), A.score_boxed_math)
    r.register("gpqa", lambda s: s.isin(*GPQA_SOURCES), A.score_multiple_choice)
    return r


def score_by_source(df: DataFrame, registry: ScorerRegistry | None = None,
                    source_col: str = "data_source", response_col: str = "response",
                    ground_truth_col: str = "ground_truth", out_col: str = "score",
                    on_unknown: str = "error", executed: DataFrame | None = None,
                    key_col: str = "response_id") -> DataFrame:
    """Append ``score`` (double) and ``scorer`` (route name) to every response row.

    ``executed(key, score)`` holds the scores of responses whose programs were run (see
    :mod:`rollframe.operators.outcomes`); rows of the code and test-case routes get theirs from
    it, 0.0 if it has none.  Without ``executed`` those rows cannot be scored: they raise, or get
    a null score with ``on_unknown="null"``."""
    reg = registry or default_registry()
    src = F.col(source_col)
    out = df.withColumns({
        "scorer": reg.route_name(src),
        out_col: reg.score(src, F.col(response_col), F.col(ground_truth_col), on_unknown),
    })
    if executed is None:
        if on_unknown != "error":
            return out
        missing = F.raise_error(F.concat(F.lit("no executed results for source "), F.coalesce(src, F.lit("NULL")))).cast("double")
        return out.withColumn(out_col, F.when(F.col("scorer").isin(*EXECUTED), missing).otherwise(F.col(out_col)))
    ran = executed.select(F.col(key_col), F.col("score").cast("double").alias("__ran"))
    out = out.join(ran, key_col, "left")
    return out.withColumn(out_col, F.when(F.col("scorer").isin(*EXECUTED), F.coalesce("__ran", F.lit(0.0))).otherwise(
        F.col(out_col))).drop("__ran")


def custom_scorer(df: DataFrame, fn: Callable, response_col: str = "response", ground_truth_col: str = "ground_truth",
                  out_col: str = "score", batched: bool = False, **kwargs) -> DataFrame:
    """Scores by a user's Python function, on Arrow batches: ``fn(response, ground_truth,
    **kwargs)`` per row, or with lists of both if ``batched``.  A call that fails gives 0.0
    and its message in ``error`` (for a batch, all its rows)."""
    ship_package(df.sparkSession)

    @F.arrow_udf("struct<score:double,error:string>")
    def run(responses: pa.Array, truths: pa.Array) -> pa.Array:
        a, b = responses.to_pylist(), truths.to_pylist()
        if batched:
            try:
                out = [{"score": float(x), "error": None} for x in fn(a, b, **kwargs)]
                if len(out) != len(a):
                    raise ValueError(f"{len(out)} scores for {len(a)} responses")
            except Exception as e:  # noqa: BLE001
                out = [{"score": 0.0, "error": f"{type(e).__name__}: {e}"}] * len(a)
        else:
            out = []
            for x, y in zip(a, b):
                try:
                    out.append({"score": float(fn(x, y, **kwargs)), "error": None})
                except Exception as e:  # noqa: BLE001
                    out.append({"score": 0.0, "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, pa.struct([("score", pa.float64()), ("error", pa.string())]))

    out = df.withColumn("__s", run(F.col(response_col), F.col(ground_truth_col)))
    return out.withColumns({out_col: F.col("__s.score"), "error": F.col("__s.error")}).drop("__s")


def score_hash_answer(df: DataFrame, method: str = "strict", response_col: str = "response",
                      ground_truth_col: str = "ground_truth", format_score: float = 0.0) -> DataFrame:
    ext = A.hash_answer_strict if method == "strict" else A.hash_answer_flexible
    return df.withColumns({
        "pred": ext(F.col(response_col)),
        "score": A.score_hash_answer(response_col, ground_truth_col, method, format_score),
    })


# ---------------------------------------------------------------------------
# Numeric tolerance (prime-math style)
# ---------------------------------------------------------------------------
def _numeric(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"\{,\}", ""), ",", "").try_cast("double")


def numeric_close(a: Column, b: Column, rel_tol: float = 1e-4, include_percentage: bool = True) -> Column:
    """|a - ref| <= rel_tol * max(|a|, |ref|) for ref in {b, b/100, b*100}."""
    refs = [b, b / 100.0, b * 100.0] if include_percentage else [b]
    conds = [F.abs(a - r) <= F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(r)) for r in refs]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def score_numeric_or_text(pred: Column, ref: Column) -> Column:
    """Numeric comparison when both parse as numbers, else case-insensitive space-free
    string equality."""
    pa, pb = _numeric(pred), _numeric(ref)
    txt = F.lower(F.regexp_replace(pred, r"\s", "")) == F.lower(F.regexp_replace(ref, r"\s", ""))
    both_num = pa.isNotNull() & pb.isNotNull()
    return F.coalesce(F.when(both_num, numeric_close(pa, pb)).otherwise(txt), F.lit(False))


def score_numeric_tolerance(df: DataFrame, pred_col: str, ref_col: str, out_col: str = "correct") -> DataFrame:
    return df.withColumn(out_col, score_numeric_or_text(F.col(pred_col), F.col(ref_col)))


# ---------------------------------------------------------------------------
# Reward placement and shaping
# ---------------------------------------------------------------------------
def place_terminal_reward(df: DataFrame, score_col: str = "score", length_col: str = "response_len",
                          width: int | None = None, width_col: str | None = None,
                          out_col: str = "token_level_scores") -> DataFrame:
    """Zeros with the sequence score at index ``response_len - 1`` (array of ``width``).

    An empty response (length 0 or null) has its score at index 0, so that no score is lost, unless
    the width is 0: then there is no token and the array is empty.  A response longer than the
    width is cut: its score stands at the last index."""
    w = F.greatest(F.coalesce((F.lit(width) if width is not None else F.col(width_col or length_col)).cast("int"), F.lit(0)), F.lit(0))
    last = F.least(F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(1)).cast("int"), w)
    s = F.col(score_col).cast("double")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    return df.withColumn(out_col, F.when(w == 0, F.array().cast("array<double>")).otherwise(
        F.concat(zeros(last - 1), F.array(s), zeros(w - last))))


def overlong_penalty(df: DataFrame, length_col: str, max_resp_len: int, buffer_len: int,
                     penalty_factor: float, score_col: str = "score") -> DataFrame:
    """DAPO soft overlong punishment: ``min(-(len - (max - buf)) / buf * factor, 0)``."""
    expected = max_resp_len - buffer_len
    exceed = F.col(length_col) - F.lit(expected)
    pen = F.least(-exceed / F.lit(float(buffer_len)) * F.lit(float(penalty_factor)), F.lit(0.0))
    return df.withColumns({
        "overlong_reward": pen,
        "overlong": pen < 0,
        score_col: F.col(score_col) + pen,
    })


def strip_eos_suffix(df: DataFrame, text_col: str, eos_token: str) -> DataFrame:
    t = F.col(text_col)
    return df.withColumn(text_col, F.when(
        t.endswith(eos_token), F.expr(f"substring({text_col}, 1, length({text_col}) - {len(eos_token)})")
    ).otherwise(t))


def fill_failed_scores(requests: DataFrame, results: DataFrame, key: list[str] | str,
                       default_score: float = 0.0, default_label: str = "FailGood",
                       missing_label: str = "TimeoutError") -> DataFrame:
    """Left-join scored results back onto every request; missing / failed rows get the
    default score and a label (the reference's timeout handling)."""
    keys = [key] if isinstance(key, str) else list(key)
    r = results.withColumn("__present", F.lit(True))
    j = requests.join(r, keys, "left")
    return j.withColumns({
        "score": F.coalesce(F.col("score"), F.lit(float(default_score))),
        "reward_type": F.when(F.col("__present").isNull(), F.lit(missing_label))
                        .otherwise(F.coalesce(F.col("reward_type"), F.lit(default_label))),
    }).drop("__present")


def prefer_model_scores(df: DataFrame, model_col: str = "rm_scores", rule_col: str = "score") -> DataFrame:
    if model_col not in df.columns:
        return df.withColumn("final_score", F.col(rule_col))
    return df.withColumn("final_score", F.coalesce(F.col(model_col), F.col(rule_col)))


def sample_for_review(df: DataFrame, n: int, source_col: str = "data_source",
                      order_col: str = "response_id") -> DataFrame:
    """First ``n`` rows per data source (bounded top-k per key)."""
    w = Window.partitionBy(source_col).orderBy(order_col)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def tool_attempt_reward(df: DataFrame, instance_col: str, attempt_col: str,
                        reward_col: str = "reward", improved: float = 0.0,
                        not_improved: float = -0.05) -> DataFrame:
    """Per attempt: ``improved`` when the reward beats the previous attempt's (initially
    0.0), else ``not_improved``."""
    w = Window.partitionBy(instance_col).orderBy(attempt_col)
    prev = F.coalesce(F.lag(reward_col).over(w), F.lit(0.0))
    return df.withColumn("tool_reward", F.when(F.col(reward_col) > prev, F.lit(improved))
                         .otherwise(F.lit(not_improved)))


def expand_reward_to_eos(df: DataFrame, score_col: str, position_ids_col: str,
                         attention_mask_col: str, response_length: int,
                         out_col: str = "token_level_scores") -> DataFrame:
    """Sequence score placed at ``argmax(position_ids * mask)`` then sliced to the last
    ``response_length`` positions."""
    pm = F.zip_with(position_ids_col, attention_mask_col, lambda p, m: p * m)
    eos = F.array_position(pm, F.array_max(pm)) - 1
    full = A.let(eos, lambda e: F.transform(pm, lambda _, i: F.when(i == e, F.col(score_col).cast("double")).otherwise(0.0)))
    return df.withColumn(out_col, F.slice(full, -response_length, response_length))
