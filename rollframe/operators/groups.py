"""Group-relative advantages and batch whitening.

Group statistics are a ``groupBy(uid)`` aggregate (partial aggregation on the map side,
so a prompt holding a third of all rows is pre-reduced before the shuffle) joined back on
``uid``; the join is planned by AQE (broadcast when the per-group table is small at
runtime, otherwise sort-merge with skew splitting).  No window holds a whole group.

Batch statistics for whitening are three sums per ``batch_id`` joined back the same way;
never an unpartitioned window.  Token arrays are handled element-wise in the JVM; only the
reverse recurrences (REINFORCE++ returns, GAE) run in an Arrow-batched pandas UDF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe.functions import arrays as AR
from rollframe.sources.io import materialise

EPS_STD = 1e-6      # GRPO: (s - mean) / (std + 1e-6)
EPS_MASK = 1e-8     # masked_mean: sum / (mask_sum + 1e-8); whiten: rsqrt(var + 1e-8)


def sequence_scores(df: DataFrame, rewards_col: str = "token_level_rewards",
                    out_col: str = "seq_score") -> DataFrame:
    """Per-response score = sum of token rewards (not masked, as in the reference)."""
    return df.withColumn(out_col, AR.arr_sum(rewards_col))


def _group_stats(df: DataFrame, group_col: str, score_col: str) -> DataFrame:
    st = df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(score_col).alias("__mean"),
        F.stddev_samp(score_col).alias("__std"))
    return df.join(st, group_col, "left")


def adv_grpo(df: DataFrame, group_col: str = "uid", rewards_col: str = "token_level_rewards",
             mask_col: str = "response_mask", norm_by_std: bool = True, epsilon: float = EPS_STD,
             out_col: str = "advantages") -> DataFrame:
    """GRPO outcome advantage: ``(s - mean) / (std + eps)`` with the sample std; a
    singleton group uses mean 0 and std 1; broadcast over the response mask.
    ``returns`` equals ``advantages``."""
    d = _group_stats(sequence_scores(df, rewards_col, "__s"), group_col, "__s")
    single = F.col("__n") == 1
    mean = F.when(single, F.lit(0.0)).otherwise(F.col("__mean"))
    std = F.when(single, F.lit(1.0)).otherwise(F.col("__std"))
    a = (F.col("__s") - mean) / (std + F.lit(epsilon)) if norm_by_std else F.col("__s") - mean
    d = d.withColumn("__a", a)
    adv = AR.scalar_times_mask("__a", mask_col)
    return d.withColumns({out_col: adv, "returns": adv}).drop("__s", "__n", "__mean", "__std", "__a")


def adv_grpo_centered(df: DataFrame, **kw) -> DataFrame:
    return adv_grpo(df, norm_by_std=False, **kw)


def adv_rloo(df: DataFrame, group_col: str = "uid", rewards_col: str = "token_level_rewards",
             mask_col: str = "response_mask", out_col: str = "advantages") -> DataFrame:
    """RLOO: ``s*n/(n-1) - mean*n/(n-1)``; a singleton keeps its score."""
    d = _group_stats(sequence_scores(df, rewards_col, "__s"), group_col, "__s")
    n = F.col("__n").cast("double")
    a = F.when(F.col("__n") > 1, F.col("__s") * n / (n - 1) - F.col("__mean") * n / (n - 1)).otherwise(F.col("__s"))
    d = d.withColumn("__a", a)
    adv = AR.scalar_times_mask("__a", mask_col)
    return d.withColumns({out_col: adv, "returns": adv}).drop("__s", "__n", "__mean", "__std", "__a")


# ---------------------------------------------------------------------------
# Masked statistics and whitening per batch
# ---------------------------------------------------------------------------
def masked_stats(df: DataFrame, values_col: str, mask_col: str, batch_col: str = "batch_id") -> DataFrame:
    """Per batch: ``mask_sum``, ``mean = sum(v*m)/(sum(m)+1e-8)`` and the Bessel-corrected
    masked variance.  A batch whose mask sums to 0 or 1 raises, as in the reference."""
    # squares are summed around each row's own mean, then moved to the batch mean: no cancellation
    per_row = df.select(F.col(batch_col).alias("b"), AR.arr_sum(mask_col).alias("m0"), AR.masked_sum(values_col, mask_col).alias("m1"),
                        F.col(values_col).alias("v"), F.col(mask_col).alias("m"))
    per_row = per_row.withColumn("mu_r", F.when(F.col("m0") != 0, F.col("m1") / F.col("m0")).otherwise(F.lit(0.0)))
    per_row = per_row.select("b", "m0", "m1", "mu_r", AR.arr_sum(F.zip_with(
        "v", "m", lambda v, m: (v - F.col("mu_r")) * (v - F.col("mu_r")) * m)).alias("m2"))
    s = per_row.groupBy("b").agg(F.sum("m0").alias("S0"), F.sum("m1").alias("S1"))
    s = s.withColumn("mu", F.col("S1") / (F.col("S0") + EPS_MASK)).withColumnRenamed("b", "__b")
    away = (F.col("mu_r") - F.col("mu")) * (F.col("mu_r") - F.col("mu"))
    s = per_row.join(s, F.col("b").eqNullSafe(F.col("__b"))).groupBy(F.col("__b").alias(batch_col)).agg(
        F.first("S0").alias("S0"), F.first("mu").alias("mu"), F.sum(F.col("m2") + F.col("m0") * away).alias("S2"))
    var = (F.when(F.col("S0") == 0, F.raise_error(F.lit("masked_stats: a batch has an empty mask")))
           .when(F.col("S0") == 1, F.raise_error(F.lit("masked_stats: a batch has one masked-in position, so no variance")))
           .otherwise(F.col("S2") / (F.col("S0") + EPS_MASK) * F.col("S0") / (F.col("S0") - 1)))
    return s.select(batch_col, F.col("S0").alias("mask_sum"), F.col("mu").alias("mean"), var.cast("double").alias("var"))


def masked_whiten(df: DataFrame, values_col: str, mask_col: str, batch_col: str = "batch_id",
                  out_col: str | None = None, shift_mean: bool = True) -> DataFrame:
    """``(v - mean) * rsqrt(var + 1e-8)`` with batch statistics (optionally adding the mean
    back).  Every position is transformed, masked ones included."""
    st = masked_stats(df, values_col, mask_col, batch_col)
    d = df.join(st.select(batch_col, F.col("mean").alias("__mu"), F.col("var").alias("__var")),
                batch_col, "left")
    inv = F.lit(1.0) / F.sqrt(F.col("__var") + EPS_MASK)
    mu = F.col("__mu")
    w = F.transform(values_col, lambda v: (v - mu) * inv + (F.lit(0.0) if shift_mean else mu))
    return d.withColumn(out_col or values_col, w).drop("__mu", "__var")


def adv_rfpp_baseline(df: DataFrame, group_col: str = "uid", rewards_col: str = "token_level_rewards",
                      mask_col: str = "response_mask", batch_col: str = "batch_id",
                      out_col: str = "advantages") -> DataFrame:
    """REINFORCE++ with baseline: ``s - group mean`` (singleton mean 0) tiled over the
    mask, then whitened over the batch (not re-masked)."""
    d = _group_stats(sequence_scores(df, rewards_col, "__s"), group_col, "__s")
    mean = F.when(F.col("__n") == 1, F.lit(0.0)).otherwise(F.col("__mean"))
    d = d.withColumn("__a", AR.scalar_times_mask(F.col("__s") - mean, mask_col))
    d = d.drop("__s", "__n", "__mean", "__std")
    d = masked_whiten(d, "__a", mask_col, batch_col)
    return d.withColumns({out_col: F.col("__a"), "returns": F.col("__a")}).drop("__a")


def adv_rfpp(df: DataFrame, gamma: float = 1.0, rewards_col: str = "token_level_rewards",
             mask_col: str = "response_mask", batch_col: str = "batch_id",
             out_col: str = "advantages") -> DataFrame:
    """REINFORCE++: discounted return whose running value resets after a 0 in the mask;
    whitened over the batch, then masked."""
    m = F.col(mask_col)
    coef = F.transform(AR.shift_left(m, 0.0), lambda nm: F.lit(float(gamma)) * nm)
    # written once: the whitening statistics and the result both read the scanned arrays
    d = materialise(df.withColumn("returns", AR.reverse_scan(F.col(rewards_col), coef)), "rfpp")
    d = masked_whiten(d, "returns", mask_col, batch_col, out_col="__w")
    return d.withColumn(out_col, AR.mul_mask("__w", mask_col)).drop("__w")


def adv_remax(df: DataFrame, baselines: DataFrame, group_col: str = "uid",
              baseline_col: str = "reward_baseline", rewards_col: str = "token_level_rewards",
              mask_col: str = "response_mask", out_col: str = "advantages") -> DataFrame:
    """ReMax: masked reverse cumulative reward minus the per-prompt greedy baseline."""
    d = df.join(baselines.select(group_col, baseline_col), group_col, "left")
    d = d.withColumn("returns", AR.suffix_sum(AR.mul_mask(rewards_col, mask_col)))
    b = F.col(baseline_col)
    return d.withColumn(out_col, F.zip_with("returns", mask_col, lambda r, mm: r - b * mm))


def adv_gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0,
            rewards_col: str = "token_level_rewards", values_col: str = "values",
            mask_col: str = "response_mask", batch_col: str = "batch_id",
            out_col: str = "advantages") -> DataFrame:
    """GAE: ``delta_t = r_t + gamma V_{t+1} - V_t`` (V past the end is 0),
    ``A_t = delta_t + gamma lam A_{t+1}``; returns = A + V before whitening; A whitened over
    the batch and not re-masked."""
    v = F.col(values_col)
    nv = AR.shift_left(v, 0.0)
    delta = F.zip_with(F.zip_with(rewards_col, nv, lambda r, n: r + F.lit(float(gamma)) * n), v,
                       lambda a, b: a - b)
    coef = F.transform(v, lambda _: F.lit(float(gamma * lam)))
    d = materialise(df.withColumn("__A", AR.reverse_scan(delta, coef)), "gae")
    d = d.withColumn("returns", F.zip_with("__A", values_col, lambda a, b: a + b))
    d = masked_whiten(d, "__A", mask_col, batch_col)
    return d.withColumnRenamed("__A", out_col)


def adv_rloo_multi_source(df: DataFrame, sources: list[tuple[str, str, float]], group_col: str = "uid",
                          mask_col: str = "response_mask", batch_col: str = "batch_id",
                          out_col: str = "advantages") -> DataFrame:
    """PRIME-style RLOO over several reward sources.

    ``sources`` = [(reward array column, reward-mask array column, coefficient)].  Per
    source: masked mean per response, baseline = group sum / (n-1), reward positions become
    ``r*n/(n-1) - baseline``; sources are summed with their coefficients; returns are the
    masked reverse cumulative sum; advantages are the whitened returns."""
    d = df
    total = None
    for k, (rcol, mcol, coef) in enumerate(sources):
        mean_k = f"__mean{k}"
        d = d.withColumn(mean_k, AR.masked_sum(rcol, mcol) / AR.arr_sum(mcol))
        st = d.groupBy(group_col).agg(F.sum(mean_k).alias(f"__gs{k}"), F.count(F.lit(1)).alias(f"__n{k}"))
        d = d.join(st, group_col, "left")
        n = F.col(f"__n{k}").cast("double")
        # a lone response has no others to compare with: its rewards stay as they are
        base = F.when(n > 1, F.col(f"__gs{k}") / (n - 1)).otherwise(F.lit(0.0))
        up = F.when(n > 1, n / (n - 1)).otherwise(F.lit(1.0))
        term = F.zip_with(rcol, mcol, lambda r, m: F.when(m > 0, r * up - base).otherwise(F.lit(0.0))
                          * F.lit(float(coef)))
        d = d.withColumn(f"__t{k}", term)
        total = F.col(f"__t{k}") if total is None else F.zip_with(total, F.col(f"__t{k}"), lambda a, b: a + b)
    d = d.withColumn("returns", AR.suffix_sum(AR.mul_mask(total, mask_col)))
    drop = [c for c in d.columns if c.startswith("__")]
    d = d.drop(*drop)
    return masked_whiten(d, "returns", mask_col, batch_col, out_col=out_col)


ESTIMATORS = {
    "gae": adv_gae, "grpo": adv_grpo, "reinforce_plus_plus": adv_rfpp,
    "reinforce_plus_plus_baseline": adv_rfpp_baseline, "remax": adv_remax, "rloo": adv_rloo,
}


def compute_advantage(df: DataFrame, estimator: str, **kw) -> DataFrame:
    """Dispatch to one of the advantage estimators by name."""
    if estimator not in ESTIMATORS:
        raise NotImplementedError(f"no advantage estimator is called {estimator}")
    return ESTIMATORS[estimator](df, **kw)


def token_process_reward(df: DataFrame, beta: float, lam: float = 0.0, granularity: str = "token",
                         logp_col: str = "log_probs", ref_col: str = "ref_log_probs", mask_col: str = "response_mask",
                         acc_col: str | None = None, out_col: str = "token_level_scores") -> DataFrame:
    """Process rewards from a reward model's log ratios ``q = logp - ref`` within the response
    length.

    ``lam`` 0: r = beta q.  Else r_t = beta q_t + lam r_{t+1}, where with ``acc_col`` the last
    token's term is first set so that all terms add up to the accuracy.  ``token`` keeps r of
    all tokens but the last; ``whole`` puts the sum of r at the last token."""
    n = AR.arr_isum(mask_col)
    q = F.zip_with(logp_col, ref_col, lambda a, b: (a - b) * F.lit(float(beta)))
    d = df.withColumn("__n", n).withColumn("__q", F.transform(q, lambda v, i: F.when(i < F.col("__n"), v).otherwise(F.lit(0.0))))
    if lam == 0.0:
        d = d.withColumn("__r", F.col("__q"))
    else:
        if acc_col is not None:
            rest = AR.arr_sum(F.slice("__q", F.lit(1), F.greatest(F.col("__n") - 1, F.lit(0)).cast("int")))
            d = d.withColumn("__last", F.col(acc_col).cast("double") - rest).withColumn("__q", F.transform(
                "__q", lambda v, i: F.when(i == F.col("__n") - 1, F.col("__last")).otherwise(v))).drop("__last")
        d = d.withColumn("__r", AR.reverse_scan(F.col("__q"), F.transform("__q", lambda _: F.lit(float(lam)))))
    if granularity == "token":
        out = F.transform("__r", lambda v, i: F.when(i < F.col("__n") - 1, v).otherwise(F.lit(0.0)))
    elif granularity == "whole":
        d = d.withColumn("__sum", AR.arr_sum(F.slice("__r", F.lit(1), F.greatest(F.col("__n"), F.lit(0)).cast("int"))))
        out = F.transform("__r", lambda _, i: F.when(i == F.col("__n") - 1, F.col("__sum")).otherwise(F.lit(0.0)))
    else:
        raise ValueError(f"no granularity is called {granularity}")
    return d.withColumn(out_col, out).drop("__n", "__q", "__r", "__sum")


def group_arrays(df: DataFrame, group_col: str = "uid", order_col: str = "sample_idx",
                 cols: tuple[str, ...] = ("score", "acc"), max_group: int = 4096) -> DataFrame:
    """One row per group with the arrays of its members' values, ordered by ``order_col``: as many
    values as the table has.  A group is the samples of one prompt; more than ``max_group`` of
    them fail the job before any list is built."""
    size = df.groupBy(group_col).agg(F.count("*").alias("__n"))
    most = size.agg(F.max("__n")).first()[0] or 0
    if most > max_group:
        raise ValueError(f"a group has {most} rows; group arrays are for {max_group} at most")
    agg = df.groupBy(group_col).agg(F.array_sort(F.collect_list(F.struct(order_col, *cols))).alias("__g"))
    def field(c):
        return F.transform("__g", lambda s: s[c]).alias(f"group_{c}")
    return agg.select(group_col, *[field(c) for c in cols])


def group_context_arrays(df: DataFrame, group_col: str = "uid", order_col: str = "sample_idx",
                         cols: tuple[str, ...] = ("score", "acc"), max_group: int = 4096) -> DataFrame:
    """Attach to each response the arrays of all group members' values (:func:`group_arrays`).

    The arrays are kept once per group until this join, which the output needs: a group of n rows
    has n arrays of n values there.  Where one row per group will do, take the arrays themselves."""
    return df.join(group_arrays(df, group_col, order_col, cols, max_group), group_col, "left")


def batch_norm_rewards(df: DataFrame, rewards_col: str, batch_col: str = "batch_id",
                       out_col: str | None = None) -> DataFrame:
    """Divide by (max over the batch of |reverse cumulative sum|) + 1e-6."""
    d = df.withColumn("__rc", F.array_max(F.transform(AR.suffix_sum(rewards_col), lambda x: F.abs(x))))
    mx = d.groupBy(batch_col).agg(F.max("__rc").alias("__mx"))
    d = d.join(mx, batch_col, "left")
    return d.withColumn(out_col or rewards_col,
                        F.transform(rewards_col, lambda r: r / (F.col("__mx") + 1e-6))).drop("__rc", "__mx")
