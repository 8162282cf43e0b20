"""KL, policy-loss and preference diagnostics over logged token columns.

Token-level terms are ``zip_with``/``transform`` expressions; every report is one global
(or per-key) aggregation of per-row sums, never an explode of the token arrays.  Pairwise
group statistics avoid emitting pairs: with a small set of accuracy levels they reduce to
per-level counts and running counts over a window partitioned by the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe.functions import arrays as AR
from rollframe.session import ship_package

EPS = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def kl_penalty(logprob, ref_logprob, kind: str = "kl") -> Column:
    """Token KL estimate: ``kl`` d, ``abs`` |d|, ``mse`` d^2/2, ``low_var_kl``
    clip(e^k - k - 1, -10, 10) with k = ref - logp."""
    if kind == "kl":
        f = lambda a, b: a - b
    elif kind == "abs":
        f = lambda a, b: F.abs(a - b)
    elif kind == "mse":
        f = lambda a, b: 0.5 * (a - b) * (a - b)
    elif kind == "low_var_kl":
        f = lambda a, b: F.least(F.greatest(F.exp(b - a) - (b - a) - 1, F.lit(-10.0)), F.lit(10.0))
    else:
        raise NotImplementedError(kind)
    return F.zip_with(_c(logprob), _c(ref_logprob), f)


def kl_estimate(df: DataFrame, logprob_col: str = "old_log_probs", ref_col: str = "ref_log_probs",
                kind: str = "kl", out_col: str = "kld") -> DataFrame:
    return df.withColumn(out_col, kl_penalty(logprob_col, ref_col, kind))


def kl_shaped_rewards(df: DataFrame, beta: float, kind: str = "kl", scores_col: str = "token_level_scores",
                      logprob_col: str = "old_log_probs", ref_col: str = "ref_log_probs",
                      mask_col: str = "response_mask", out_col: str = "token_level_rewards") -> DataFrame:
    """rewards = scores - beta * kld * mask; per-row ``seq_kl`` = masked row mean of kld
    (the batch metric is the mean of ``seq_kl``)."""
    kld = F.zip_with(kl_penalty(logprob_col, ref_col, kind), mask_col, lambda k, m: k * m)
    d = df.withColumn("__kld", kld)
    return d.withColumns({
        out_col: F.zip_with(scores_col, "__kld", lambda s, k: s - F.lit(float(beta)) * k),
        "seq_kl": AR.arr_sum("__kld") / (AR.arr_sum(mask_col) + EPS),
    }).drop("__kld")


def adaptive_kl_path(df: DataFrame, init_coef: float, target: float, horizon: int,
                     run_col: str = "run", step_col: str = "step", kl_col: str = "kl",
                     n_steps_col: str = "n_steps") -> DataFrame:
    """Coefficient path of the adaptive controller: after each step
    ``beta *= 1 + clip(kl/target - 1, -0.2, 0.2) * n/horizon``; the value *used* at a step
    is the product of all earlier factors (running sum of logs over a window partitioned
    by run).  Factors must be positive (n < 5 * horizon)."""
    err = F.least(F.greatest(F.col(kl_col) / F.lit(float(target)) - 1, F.lit(-0.2)), F.lit(0.2))
    mult = 1 + err * F.col(n_steps_col) / F.lit(float(horizon))
    w = Window.partitionBy(run_col).orderBy(step_col)
    d = df.withColumn("kl_mult", F.when(mult > 0, mult).otherwise(F.raise_error(F.lit("adaptive KL factor must be > 0"))))
    logs = F.sum(F.log("kl_mult")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumns({
        "kl_coef": F.lit(float(init_coef)) * F.exp(F.coalesce(logs, F.lit(0.0))),
        "kl_coef_after": F.lit(float(init_coef)) * F.exp(F.sum(F.log("kl_mult")).over(
            w.rowsBetween(Window.unboundedPreceding, 0))),
    })


def loss_aggregate(df: DataFrame, loss_col: str, mask_col: str, mode: str = "token-mean",
                   keys: list[str] | None = None) -> DataFrame:
    """The four loss aggregation modes as one aggregate (per ``keys`` or global)."""
    keys = keys or []
    agg = _loss(mode, AR.masked_sum(loss_col, mask_col), AR.arr_sum(mask_col), F.size(mask_col))
    return df.groupBy(*keys).agg(agg.alias("loss"))


def _loss(mode: str, ls, ms, width):
    if mode == "token-mean":
        return F.sum(ls) / (F.sum(ms) + EPS)
    if mode == "seq-mean-token-sum":
        return F.avg(ls)
    if mode == "seq-mean-token-mean":
        return F.avg(ls / ms)
    if mode == "seq-mean-token-sum-norm":
        return F.sum(ls) / F.max(width)
    raise ValueError(f"no loss aggregation is called {mode}")


def loss_aggregates(df: DataFrame, loss_col: str, mask_col: str, modes: list[str], keys: list[str] | None = None) -> DataFrame:
    """Several of the modes in one aggregation, a column each (dashes as underscores)."""
    d = df.select(*(keys or []), AR.masked_sum(loss_col, mask_col).alias("ls"), AR.arr_sum(mask_col).alias("ms"), F.size(mask_col).alias("width"))
    return d.groupBy(*(keys or [])).agg(*[_loss(m, F.col("ls"), F.col("ms"), F.col("width")).alias(m.replace("-", "_")) for m in modes])


def policy_loss_tokens(df: DataFrame, old_col: str = "old_log_probs", logp_col: str = "log_probs",
                       adv_col: str = "advantages", clip_low: float = 0.2, clip_high: float | None = None,
                       clip_ratio_c: float = 3.0) -> DataFrame:
    """Token arrays of the dual-clip PPO objective: ``pg_losses``, ``clipped`` (clip
    active), ``clipped_lower``, ``neg_kl`` (old - new)."""
    if clip_ratio_c <= 1.0:
        raise ValueError(f"clip_ratio_c must be > 1.0, got {clip_ratio_c}")
    hi = clip_low if clip_high is None else clip_high
    z = F.arrays_zip(F.col(old_col).alias("o"), F.col(logp_col).alias("l"), F.col(adv_col).alias("a"))

    def term(e):
        ratio = F.exp(e["l"] - e["o"])
        a = e["a"]
        l1 = -a * ratio
        l2 = -a * F.least(F.greatest(ratio, F.lit(1 - clip_low)), F.lit(1 + hi))
        c1 = F.greatest(l1, l2)
        l3 = -a * F.lit(float(clip_ratio_c))
        c2 = F.least(l3, c1)
        return F.struct(F.when(a < 0, c2).otherwise(c1).alias("pg"),
                        F.when(l2 > l1, 1.0).otherwise(0.0).alias("clip"),
                        F.when((c1 > l3) & (a < 0), 1.0).otherwise(0.0).alias("clip_lo"),
                        (e["o"] - e["l"]).alias("nkl"))
    d = df.withColumn("__t", F.transform(z, term))
    return d.withColumns({"pg_losses": F.col("__t.pg"), "pg_clipped": F.col("__t.clip"),
                          "pg_clipped_lower": F.col("__t.clip_lo"), "neg_approx_kl": F.col("__t.nkl")}).drop("__t")


def policy_clip_report(df: DataFrame, mask_col: str = "response_mask", mode: str = "token-mean",
                       keys: list[str] | None = None, **kw) -> DataFrame:
    """pg_loss (by ``mode``), pg_clipfrac, ppo_kl, pg_clipfrac_lower as masked means,
    one aggregation per key (or global)."""
    d = policy_loss_tokens(df, **kw)
    ms = AR.arr_sum(mask_col)
    mm = lambda c: F.sum(AR.masked_sum(c, mask_col)) / (F.sum(ms) + EPS)
    return d.groupBy(*(keys or [])).agg(*_policy_aggs(mask_col, mode), mm("pg_clipped").alias("pg_clipfrac"),
                                        mm("neg_approx_kl").alias("ppo_kl"),
                                        mm("pg_clipped_lower").alias("pg_clipfrac_lower"))


def _policy_aggs(mask_col: str, mode: str):
    return [_loss(mode, AR.masked_sum("pg_losses", mask_col), AR.arr_sum(mask_col), F.size(mask_col)).alias("pg_loss")]


def value_clip_report(df: DataFrame, vpred_col: str, returns_col: str = "returns", values_col: str = "values",
                      mask_col: str = "response_mask", cliprange_value: float = 0.5) -> DataFrame:
    """vf_loss = 0.5 * masked mean of max(squared errors), vf_clipfrac."""
    z = F.arrays_zip(F.col(vpred_col).alias("p"), F.col(returns_col).alias("r"), F.col(values_col).alias("v"))

    def term(e):
        clipped = F.least(F.greatest(e["p"], e["v"] - cliprange_value), e["v"] + cliprange_value)
        l1 = (e["p"] - e["r"]) * (e["p"] - e["r"])
        l2 = (clipped - e["r"]) * (clipped - e["r"])
        return F.struct(F.greatest(l1, l2).alias("l"), F.when(l2 > l1, 1.0).otherwise(0.0).alias("c"))
    d = df.withColumn("__t", F.transform(z, term))
    ms = AR.arr_sum(mask_col)
    return d.agg((0.5 * F.sum(AR.masked_sum(F.col("__t.l"), mask_col)) / (F.sum(ms) + EPS)).alias("vf_loss"),
                 (F.sum(AR.masked_sum(F.col("__t.c"), mask_col)) / (F.sum(ms) + EPS)).alias("vf_clipfrac"))


def entropy_report(df: DataFrame, entropy_col: str, mask_col: str = "response_mask") -> DataFrame:
    return df.agg((F.sum(AR.masked_sum(entropy_col, mask_col)) / (F.sum(AR.arr_sum(mask_col)) + EPS)).alias("entropy"))


def dpo_ce_loss(df: DataFrame, scores_col: str, acc_col: str, mask_col: str, beta: float) -> DataFrame:
    """BCE(sigmoid(beta * sum(scores * mask)), acc), mean over rows (log clamped at -100
    like torch)."""
    p = F.lit(1.0) / (1 + F.exp(-AR.masked_sum(scores_col, mask_col) * F.lit(float(beta))))
    y = F.col(acc_col).cast("double")
    lg = lambda x: F.greatest(F.log(x), F.lit(-100.0))
    return df.agg(F.avg(-(y * lg(p) + (1 - y) * lg(1 - p))).alias("dpo_ce_loss"))


def dpo_group_loss(df: DataFrame, scores_col: str, acc_col: str, mask_col: str, beta: float,
                   group_col: str = "uid", bon_mode: str = "none") -> DataFrame:
    """Contrast each response's Q = beta * sum(scores*mask) with the mean Q of strictly
    worse group members (acc > 0) or strictly better ones (acc <= 0); loss
    ``-log sigmoid((Q - Q_other) * sign)``, in a form that stays finite at any margin.

    Members are summed per (group, accuracy); sums of lower and higher accuracies are running
    totals over that smaller table, and each response joins the row of its own accuracy.  No
    pairs and no lists are formed, whatever the number of accuracies."""
    d = df.withColumn("__qraw", AR.masked_sum(scores_col, mask_col)).withColumn("__acc", F.col(acc_col).cast("double"))
    level = d.groupBy(group_col, "__acc").agg(F.count("*").alias("c"), F.sum("__qraw").alias("q"))
    w = Window.partitionBy(group_col).orderBy("__acc")
    below, above = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    a = F.col("__acc")
    side = lambda c: F.when(a > 0, F.sum(c).over(below)).otherwise(F.sum(c).over(above))
    level = level.select(group_col, "__acc", side("c").alias("__oc"), side("q").alias("__oq"),
                         F.sum("c").over(Window.partitionBy(group_col)).alias("__n"), F.sum("c").over(w).alias("__le"))
    d = d.join(level, [group_col, "__acc"], "left")
    other = F.coalesce(F.col("__oq") / F.col("__oc") * F.lit(float(beta)), F.lit(0.0))
    z = (F.col("__qraw") * F.lit(float(beta)) - other) * F.when(a > 0, 1.0).otherwise(-1.0)
    d = d.withColumn("__loss", F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))
    if bon_mode == "none":
        return d.agg(F.avg("__loss").alias("dpo_loss"))
    n = F.col("__n").cast("double")
    if bon_mode == "bon_acc":
        le = F.col("__le")
    elif bon_mode == "bon_rm":
        le = F.count("*").over(Window.partitionBy(group_col).orderBy("__qraw").rangeBetween(Window.unboundedPreceding, 0))
    else:
        raise NotImplementedError(bon_mode)
    d = d.withColumn("__weight", n * F.pow(le / n, n - 1))
    return d.agg(F.sum(F.col("__loss") * F.col("__weight")).alias("dpo_loss"))


def pairwise_accuracy(df: DataFrame, scores_col: str, acc_col: str, mask_col: str,
                      group_col: str = "uid", order_col: str = "sample_idx") -> DataFrame:
    """Mean over groups of the |acc diff|-weighted agreement between score and accuracy
    orderings over pairs i < j (0.5 when all accuracies are equal).

    Computed without forming pairs: with ``s`` ordered by (score, position), a higher-acc member
    agrees with a lower-acc one exactly when it comes later in that order.  One walk in that order
    over sums by accuracy rank counts them; a group is the samples of one prompt, three numbers
    each, in one task.  Null accuracies are left out; a lone response has no pairs and counts in
    no mean."""
    d = df.select(F.col(group_col).alias("__g"), F.col(order_col).alias("__o"), AR.masked_sum(scores_col, mask_col).alias("__s"),
                  F.col(acc_col).cast("double").alias("__a")).where(F.col("__a").isNotNull())
    ship_package(df.sparkSession)
    g = d.groupBy("__g").applyInPandas(_pair_sums, "n double, dd double, c bigint")
    ratio = F.when(F.col("dd") == 0, F.lit(0.5)).otherwise(F.col("n") / F.col("dd"))
    return g.where("c > 1").agg(F.avg(ratio).alias("pairwise_accuracy"))


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Agreeing and all |acc diff| of a group's pairs, from one walk in score order over sums by
    accuracy rank (a binary indexed tree)."""
    a = pdf.sort_values(["__s", "__o"], kind="mergesort")["__a"].to_numpy()
    ranks = np.unique(a, return_inverse=True)[1] + 1
    size = int(ranks.max(initial=0)) + 1
    count, total, agree = np.zeros(size), np.zeros(size), 0.0
    for x, r in zip(a.tolist(), ranks.tolist()):
        i = r - 1
        while i > 0:
            agree += count[i] * x - total[i]
            i -= i & -i
        i = r
        while i < size:
            count[i] += 1
            total[i] += x
            i += i & -i
    s = np.sort(a)
    every = float((s * (2 * np.arange(len(s)) - len(s) + 1)).sum())
    return pd.DataFrame({"n": [agree], "dd": [every], "c": [len(a)]})


def sign_accuracy(df: DataFrame, scores_col: str, acc_col: str, mask_col: str) -> DataFrame:
    s = F.signum(AR.masked_sum(scores_col, mask_col))
    return df.agg(F.avg(F.when(s == F.signum(F.col(acc_col) * 2 - 1), 1.0).otherwise(0.0)).alias("sign_accuracy"))
