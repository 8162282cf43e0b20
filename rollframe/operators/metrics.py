"""Evaluation and training-batch metrics as grouped aggregations.

Every metric is a ``groupBy`` (partial aggregation on the map side, so a hot source or
prompt is pre-aggregated before the shuffle) or a global one-row ``agg``.  Outputs are long
tables ``(keys..., metric, value)`` so they append to a ``metrics`` table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_score_by_source(df: DataFrame, source_col: str = "data_source", prompt_col: str = "uid",
                         score_col: str = "score") -> DataFrame:
    """Mean over the responses of each prompt, then mean over prompts per data source."""
    per_prompt = df.groupBy(source_col, prompt_col).agg(F.avg(score_col).alias("prompt_score"))
    return per_prompt.groupBy(source_col).agg(
        F.avg("prompt_score").alias("mean_score"),
        F.count(F.lit(1)).alias("n_prompts"))


def val_score_by_source(df: DataFrame, source_col: str = "data_source", score_col: str = "score") -> DataFrame:
    """Mean over rows per data source; a missing source counts as ``"unknown"``."""
    return (df.withColumn("__src", F.coalesce(F.col(source_col), F.lit("unknown")))
            .groupBy(F.col("__src").alias(source_col))
            .agg(F.avg(score_col).alias("mean_score"), F.count(F.lit(1)).alias("n")))


def _sample_sizes(n: Column) -> Column:
    """{2, 4, 8, ... < n} followed by n itself (array of int)."""
    k = F.greatest(F.ceil(F.log2(n.cast("double"))).cast("int"), F.lit(1))
    pows = F.transform(F.sequence(F.lit(1), k), lambda e: F.pow(F.lit(2), e).cast("int"))
    return F.concat(F.filter(pows, lambda p: p < n), F.array(n.cast("int")))


def sample_sizes(df: DataFrame, n_col: str = "n") -> DataFrame:
    return df.withColumn("sample_size", F.explode(_sample_sizes(F.col(n_col))))


def _order_stat_moments(df: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    """Exact moments of max/min of a with-replacement draw of size s from each group.

    The group is first reduced to its distinct values with multiplicities (map-side
    partial aggregation, skew-proof), then with cumulative counts ``C`` over the sorted
    distinct values: ``P(max <= v) = (C(v)/N)^s``, so
    ``E[max^p] = sum v^p ((C/N)^s - (C_prev/N)^s)`` and symmetrically for min."""
    dv = df.groupBy(*keys, F.col(value_col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("v")
    dv = dv.withColumns({
        "cum": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "N": F.sum("c").over(Window.partitionBy(*keys)),
    })
    dv = dv.withColumn("s", F.explode(_sample_sizes(F.col("N"))))
    hi, lo = F.col("cum") / F.col("N"), (F.col("cum") - F.col("c")) / F.col("N")
    pmax = F.pow(hi, F.col("s")) - F.pow(lo, F.col("s"))
    pmin = F.pow(1 - lo, F.col("s")) - F.pow(1 - hi, F.col("s"))
    v = F.col("v")
    return dv.groupBy(*keys, "s", "N").agg(
        F.sum(v * pmax).alias("e_max"), F.sum(v * v * pmax).alias("e_max2"),
        F.sum(v * pmin).alias("e_min"), F.sum(v * v * pmin).alias("e_min2"))


def best_worst_at_n(df: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    """``best@s/mean|std`` and ``worst@s/mean|std`` per group, exact (closed form of the
    reference's 1000-sample bootstrap)."""
    m = _order_stat_moments(df, keys, value_col)
    sd = lambda e2, e: F.sqrt(F.greatest(F.col(e2) - F.col(e) * F.col(e), F.lit(0.0)))
    return m.select(*keys, "s",
                    F.col("e_max").alias("best_mean"), sd("e_max2", "e_max").alias("best_std"),
                    F.col("e_min").alias("worst_mean"), sd("e_min2", "e_min").alias("worst_std"))


def validation_metrics(df: DataFrame, var_cols: list[str], source_col: str = "data_source",
                       prompt_col: str = "uid", pred_col: str | None = None, order_col: str = "sample_idx",
                       majority: str = "exact") -> DataFrame:
    """String variables are skipped.  With ``pred_col``, ``maj@s`` mean and std of each variable
    are exact (:func:`plurality_at_n`), or with ``majority="bootstrap"`` from the seeded draws of
    :func:`majority_at_n_bootstrap`.

    Per (source, prompt, var): ``mean@N``, population ``std@N``, ``best@s``/``worst@s``
    mean and std; then the mean over prompts per (source, var, metric).

    Output: ``(data_source, var, metric, value)``."""
    var_cols = [v for v in var_cols if df.schema[v].dataType.simpleString() != "string"]
    stack = ", ".join(f"'{v}', CAST(`{v}` AS DOUBLE)" for v in var_cols)
    more = [pred_col, order_col] if pred_col else []
    long = df.select(source_col, prompt_col, *more,
                     F.expr(f"stack({len(var_cols)}, {stack}) AS (var, value)"))
    keys = [source_col, prompt_col, "var"]
    basic = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"), F.avg("value").alias("m"),
                                    F.stddev_pop("value").alias("sd"))
    basic = basic.select(*keys, F.explode(F.array(
        F.struct(F.concat(F.lit("mean@"), F.col("N").cast("string")).alias("metric"), F.col("m").alias("value")),
        F.struct(F.concat(F.lit("std@"), F.col("N").cast("string")).alias("metric"), F.col("sd").alias("value")),
    )).alias("kv")).select(*keys, "kv.metric", "kv.value")
    bw = best_worst_at_n(long, keys, "value")
    s = F.col("s").cast("string")
    bw = bw.select(*keys, F.explode(F.array(*[
        F.struct(F.concat(F.lit(f"{kind}@"), s, F.lit(f"/{stat}")).alias("metric"),
                 F.col(f"{kind}_{stat}").alias("value"))
        for kind in ("best", "worst") for stat in ("mean", "std")])).alias("kv")
    ).select(*keys, "kv.metric", "kv.value")
    per_prompt = basic.unionByName(bw)
    if pred_col:
        maj = (plurality_at_n(long, keys, pred_col, "value") if majority == "exact"
               else majority_at_n_bootstrap(long, keys, pred_col, "value", order_col))
        n = F.col("n").cast("string")
        per_prompt = per_prompt.unionByName(maj.select(*keys, F.explode(F.array(*[
            F.struct(F.concat(F.lit("maj@"), n, F.lit(f"/{stat}")).alias("metric"), F.col(f"maj_{stat}").alias("value"))
            for stat in ("mean", "std")])).alias("kv")).select(*keys, "kv.metric", "kv.value"))
    return per_prompt.groupBy(source_col, "var", "metric").agg(F.avg("value").alias("value"))


# ---------------------------------------------------------------------------
# Shares and reports
# ---------------------------------------------------------------------------
def reward_type_share(df: DataFrame, class_col: str = "reward_type", source_col: str = "data_source") -> DataFrame:
    """Share of each class overall and per source in one ``GROUPING SETS`` aggregation;
    list-valued classes are exploded first.  Output ``(data_source or NULL, class, share)``."""
    d = df
    if dict(df.dtypes)[class_col].startswith("array"):
        d = df.withColumn(class_col, F.explode(class_col))
    g = (d.groupingSets([[class_col], [source_col, class_col]], class_col, source_col)
         .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__gid")))
    tot = F.sum("n").over(Window.partitionBy("__gid", source_col))
    return g.select(source_col, class_col, (F.col("n") / tot).alias("share"))


def fail_reason_share(df: DataFrame, reason_col: str = "fail_reason") -> DataFrame:
    """Share of each non-null reason among non-null reasons (list columns exploded)."""
    d = df
    if dict(df.dtypes)[reason_col].startswith("array"):
        d = df.withColumn(reason_col, F.explode(reason_col))
    g = d.filter(F.col(reason_col).isNotNull() & (F.col(reason_col) != "None")).groupBy(reason_col).agg(
        F.count(F.lit(1)).alias("n"))
    return g.select(reason_col, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


GOOD_INPUT = ["GoodInputFailGood", "GoodInputPassGoodPassBad", "PassGoodFailBad"]
FAIL_GOOD = ["FailGood", "GoodInputFailGood"]
SUMMARY_CLASSES = ["PassGoodFailBad", "FailGood", "GoodInputFailGood", "PassGoodPassBad",
                   "GoodInputPassGoodPassBad", "FormatError"]


def seeded_outcome_summary(df: DataFrame, pos_col: str, class_col: str = "reward_type",
                           num_inputs_col: str | None = None) -> DataFrame:
    """With ``num_inputs_col``, also the mean number of inputs over responses that have one (0 or
    more), as metric ``num_inputs``.

    Per seed position: percentage of items in each class; then mean and population std
    over positions, plus the derived good_input and fail_good groups."""
    per = df.groupBy(pos_col).agg(
        *[(F.avg(F.when(F.col(class_col) == c, 100.0).otherwise(0.0))).alias(c) for c in SUMMARY_CLASSES],
        F.avg(F.when(F.col(class_col).isin(*GOOD_INPUT), 100.0).otherwise(0.0)).alias("good_input"),
        F.avg(F.when(F.col(class_col).isin(*FAIL_GOOD), 100.0).otherwise(0.0)).alias("fail_good"),
        *([F.avg(F.when(F.col(num_inputs_col) >= 0, F.col(num_inputs_col).cast("double"))).alias("num_inputs")] if num_inputs_col else []))
    names = SUMMARY_CLASSES + ["good_input", "fail_good"] + (["num_inputs"] if num_inputs_col else [])
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    long = per.select(pos_col, F.expr(f"stack({len(names)}, {stack}) AS (metric, pct)"))
    return long.groupBy("metric").agg(F.avg("pct").alias("mean"), F.stddev_pop("pct").alias("std"))


def batch_data_metrics(df: DataFrame, score_col: str = "seq_score", reward_col: str = "seq_reward",
                       adv_col: str = "advantages", ret_col: str = "returns", val_col: str | None = "values",
                       mask_col: str = "response_mask", max_response_length: int | None = None,
                       prompt_mask_col: str | None = None, max_prompt_length: int | None = None) -> DataFrame:
    """One-row batch report: score/reward mean-max-min, masked advantage/return/value
    mean-max-min, ``vf_explained_var`` = 1 - var(ret - val)/(var(ret) + 1e-5) over valid
    tokens (sample variance), response- and prompt-length mean-max-min and clip ratio.  Token
    statistics come from per-row aggregates combined globally (no explode)."""
    from rollframe.functions import arrays as AR
    m = F.col(mask_col)
    valid = lambda c: F.filter(F.zip_with(c, m, lambda v, k: F.when(k > 0, v)), lambda x: x.isNotNull())
    rl = AR.arr_isum(mask_col)
    aggs = [F.avg(score_col).alias("score_mean"), F.max(score_col).alias("score_max"), F.min(score_col).alias("score_min"),
            F.avg(reward_col).alias("reward_mean"), F.max(reward_col).alias("reward_max"), F.min(reward_col).alias("reward_min"),
            F.avg(rl).alias("response_length_mean"), F.max(rl).alias("response_length_max"),
            F.min(rl).alias("response_length_min")]
    if max_response_length is not None:
        aggs.append(F.avg(F.when(rl == max_response_length, 1.0).otherwise(0.0)).alias("response_length_clip_ratio"))
    if prompt_mask_col is not None:
        pl = AR.arr_isum(prompt_mask_col)
        aggs += [F.avg(pl).alias("prompt_length_mean"), F.max(pl).alias("prompt_length_max"), F.min(pl).alias("prompt_length_min")]
        if max_prompt_length is not None:
            aggs.append(F.avg(F.when(pl == max_prompt_length, 1.0).otherwise(0.0)).alias("prompt_length_clip_ratio"))
    cols = {"adv": adv_col, "ret": ret_col}
    if val_col:
        cols["val"] = val_col
    d = df
    for k, c in cols.items():
        d = d.withColumn(f"__{k}", valid(F.col(c)))
        aggs += [(F.sum(AR.arr_sum(f"__{k}")) / F.sum(F.size(f"__{k}"))).alias(f"{k}_mean"),
                 F.max(F.array_max(f"__{k}")).alias(f"{k}_max"), F.min(F.array_min(f"__{k}")).alias(f"{k}_min")]
    if val_col:
        d = d.withColumn("__diff", F.zip_with("__ret", "__val", lambda a, b: a - b))
        # moments around each row's own mean; rows are then weighed around the batch's
        for k in ("ret", "diff"):
            d = d.withColumn(f"__n_{k}", F.size(f"__{k}").cast("double"))
            d = d.withColumn(f"__mu_{k}", F.when(F.col(f"__n_{k}") > 0, AR.arr_sum(f"__{k}") / F.col(f"__n_{k}")).otherwise(F.lit(0.0)))
            mu = F.col(f"__mu_{k}")
            d = d.withColumn(f"__m2_{k}", AR.arr_sum(F.transform(f"__{k}", lambda x: (x - mu) * (x - mu))))
        mid = d.agg(*[(F.sum(F.col(f"__n_{k}") * F.col(f"__mu_{k}")) / F.sum(f"__n_{k}")).alias(k) for k in ("ret", "diff")]).first()

        def var(k):
            away = F.col(f"__mu_{k}") - F.lit(mid[k])
            return F.sum(F.col(f"__m2_{k}") + F.col(f"__n_{k}") * away * away) / (F.sum(f"__n_{k}") - 1)
        aggs.append((1 - var("diff") / (var("ret") + 1e-5)).alias("vf_explained_var"))
    return d.agg(*aggs)


def timing_metrics(timings: DataFrame, tokens: DataFrame, step_col: str = "step") -> DataFrame:
    """ms per token per section: ``gen`` uses response tokens, other sections all tokens.
    ``timings``: (step, section, seconds); ``tokens``: (step, prompt_tokens, response_tokens)."""
    t = tokens.groupBy(step_col).agg(F.sum("prompt_tokens").alias("__p"), F.sum("response_tokens").alias("__r"))
    j = timings.join(t, step_col)
    denom = F.when(F.col("section") == "gen", F.col("__r")).otherwise(F.col("__p") + F.col("__r"))
    return j.select(step_col, "section", (F.col("seconds") * 1000 / denom).alias("ms_per_token"))


def throughput_metrics(df: DataFrame, n_gpus: int, step_col: str = "step") -> DataFrame:
    """tokens / (step time * n_gpus); input (step, total_tokens, step_seconds)."""
    return df.select(step_col, (F.col("total_tokens") / (F.col("step_seconds") * n_gpus)).alias("throughput"))


def reduce_metrics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean of every micro-batch value per metric name: input (.., metric, value)."""
    return df.groupBy(*(keys or []), "metric").agg(F.avg("value").alias("value"))


def core_vs_aux(df: DataFrame, source_col: str = "data_source") -> DataFrame:
    """Mark validation metrics as core: var ``acc`` when the source has it (else
    ``reward``), name starting mean/maj/best and containing ``@{n_max}``, the largest n of its
    (source, var)."""
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    d = df.withColumn("__n", n)
    d = d.withColumns({"__nmax": F.max("__n").over(Window.partitionBy(source_col, "var")),
                       "__has_acc": F.max(F.when(F.col("var") == "acc", 1).otherwise(0)).over(Window.partitionBy(source_col))})
    core_var = F.when(F.col("__has_acc") == 1, F.lit("acc")).otherwise(F.lit("reward"))
    core = ((F.col("var") == core_var) & F.col("metric").rlike("^(mean|maj|best)")
            & F.col("metric").contains(F.concat(F.lit("@"), F.col("__nmax").cast("string"))))
    return d.withColumn("metric_sec", F.when(core, "val-core").otherwise("val-aux")).drop("__n", "__nmax", "__has_acc")


def majority_vote(df: DataFrame, keys: list[str], pred_col: str, val_col: str, order_col: str) -> DataFrame:
    """Exact full-sample majority: the value of the first-seen row of the most frequent
    prediction (ties -> the prediction seen first).  Per-(key, pred) partial aggregates
    only, so a hot prompt is pre-reduced map-side."""
    g = df.groupBy(*keys, pred_col).agg(F.count(F.lit(1)).alias("__c"),
                                        F.min_by(val_col, order_col).alias("__v"), F.min(order_col).alias("__first"))
    w = Window.partitionBy(*keys).orderBy(F.col("__c").desc(), F.col("__first"))
    return (g.withColumn("__rk", F.row_number().over(w)).filter(F.col("__rk") == 1)
            .select(*keys, F.col(pred_col).alias("maj_pred"), F.col("__v").alias("maj_val"), F.col("__c").alias("maj_count")))


def plurality_chances(counts: list[int], n: int) -> list[float]:
    """Chance of each prediction to win a vote of ``n`` draws with replacement from predictions
    that stand ``counts`` times in the sample; of equally frequent ones each is as likely to come
    first.

    The draws are independent Poisson counts given that they add up to n.  For a winning count k
    all others are at most k, and t others that have k too leave the winner 1 / (t + 1): the
    integral of u^t over [0, 1], which Gauss-Legendre nodes give exactly.  Products over all other
    predictions come from products over those before and behind, by distinct count."""
    import numpy as np

    total, kinds = sum(counts), sorted(set(counts))
    rate = {c: n * c / total for c in kinds}
    many = {c: counts.count(c) for c in kinds}
    x = np.arange(n + 1)
    log_fact = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
    pmf = {c: np.exp(x * np.log(rate[c]) - rate[c] - log_fact) for c in kinds}
    whole = float(np.exp(n * np.log(n) - n - log_fact[n]))  # that they add up to n
    win = dict.fromkeys(kinds, 0.0)

    def times(a, b):
        return np.convolve(a, b)[:n + 1]

    def power(a, e):
        out = np.eye(1, n + 1)[0]
        while e:
            if e & 1:
                out = times(out, a)
            a, e = times(a, a), e >> 1
        return out

    # the fullest prediction has at least its share
    for k in range(max(1, -(-n // len(counts))), n + 1):
        ties = min(len(counts) - 1, n // k - 1)
        nodes, weights = np.polynomial.legendre.leggauss(max(1, -(-(ties + 1) // 2)))
        for u, w in zip((nodes + 1) / 2, weights / 2):
            upto = {}
            for c in kinds:
                f = np.where(x < k, pmf[c], 0.0)
                f[k] = u * pmf[c][k]
                upto[c] = f
            behind = [np.eye(1, n + 1)[0]]
            for c in reversed(kinds[1:]):
                behind.append(times(behind[-1], power(upto[c], many[c])))
            before = np.eye(1, n + 1)[0]
            for c, after in zip(kinds, reversed(behind)):
                before = times(before, power(upto[c], many[c] - 1))
                win[c] += w * pmf[c][k] * float(before[:n - k + 1] @ after[n - k::-1][:n - k + 1])
                before = times(before, upto[c])
    return [win[c] / whole for c in counts]


def plurality_at_n(df: DataFrame, keys: list[str], pred_col: str, val_col: str, sizes: list[int] | None = None) -> DataFrame:
    """Exact ``maj@n`` mean and standard deviation per group: what :func:`majority_at_n_bootstrap`
    estimates.

    The winner's value is that of a row drawn among its prediction's, so its moments are the
    prediction's.  Null is a prediction of its own; null values are left out of a prediction's
    moments.  ``sizes``: the votes' sizes; by default the powers of two below the group's rows, and
    their number.  Rows are counted per (group, prediction) before the shuffle, so a group is as
    many rows as it has different predictions, whatever its size."""
    import pandas as pd

    v = F.col(val_col).cast("double")
    g = df.groupBy(*keys, pred_col).agg(F.count("*").alias("__c"), F.avg(v).alias("__m"), F.avg(v * v).alias("__q"))

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = [int(c) for c in pdf["__c"]]
        total = sum(counts)
        rows = []
        for n in sizes or [2 ** i for i in range(1, 40) if 2 ** i < total] + [total]:
            chance = pd.Series(plurality_chances(counts, n), index=pdf.index)[pdf["__m"].notna()]
            share = chance / chance.sum() if chance.sum() else chance
            mean, square = float((share * pdf["__m"].dropna()).sum()), float((share * pdf["__q"].dropna()).sum())
            some = len(chance) > 0
            rows.append({**{k: pdf[k].iloc[0] for k in keys}, "n": n, "maj_mean": mean if some else None,
                         "maj_std": max(square - mean * mean, 0.0) ** 0.5 if some else None})
        return pd.DataFrame(rows)

    key_schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)
    return g.groupBy(*keys).applyInPandas(per_group, f"{key_schema}, n int, maj_mean double, maj_std double")


def majority_at_n_bootstrap(df: DataFrame, keys: list[str], pred_col: str, val_col: str, order_col: str,
                            n_bootstrap: int = 1000, seed: int = 42) -> DataFrame:
    """Reference-parity bootstrap of maj@n (seeded numpy per group) via ``applyInPandas``;
    one group = one prompt's responses (bounded by the sample count per prompt)."""
    import numpy as np
    import pandas as pd

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col)
        values = pdf[val_col].to_numpy(float)
        names = pd.factorize(pdf[pred_col], use_na_sentinel=False)[0]  # null is a prediction of its own
        n_resps, width = len(values), int(names.max()) + 1
        sizes = [2 ** i for i in range(1, 40) if 2 ** i < n_resps] + [n_resps]
        out = []
        for n in sizes:
            np.random.seed(seed)
            # one draw of all samples gives what as many single draws give
            draws = np.random.choice(n_resps, size=(n_bootstrap, n), replace=True)
            row = np.repeat(np.arange(n_bootstrap), n)
            drawn = names[draws].ravel()
            counts = np.bincount(row * width + drawn, minlength=n_bootstrap * width).reshape(n_bootstrap, width)
            # where each prediction first comes up in its draw; of equally frequent ones the earliest wins
            first = np.full(n_bootstrap * width, n, np.int64)
            np.minimum.at(first, row * width + drawn, np.tile(np.arange(n), n_bootstrap))
            first = first.reshape(n_bootstrap, width)
            rank = counts * (n + 1) - first
            best = rank.argmax(axis=1)
            each = np.arange(n_bootstrap)
            got = values[draws[each, first[each, best]]]
            out.append({**{k: pdf[k].iloc[0] for k in keys}, "n": n, "maj_mean": float(got.mean()), "maj_std": float(got.std())})
        return pd.DataFrame(out)

    key_schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)
    return df.groupBy(*keys).applyInPandas(per_group, f"{key_schema}, n int, maj_mean double, maj_std double")


# Words that mark a brute-force check, signs of a property check
BRUTE_FORCE_KEYWORDS = ["brute_", "brute-"]
PROPERTY_SIGNS = ["!=", ">", "<", "check", "valid"]


def testcase_style_share(df: DataFrame, response_col: str, source_col: str = "data_source",
                         complex_keywords: tuple[str, ...] = ()) -> DataFrame:
    """Shares, overall and per source, of responses whose last python block is of a style.

    ``brute_force``: a keyword, the word brute, or code that begins with a function whose name
    contains correct.  ``property``: a line with an assert that has a property sign before any
    ``#`` or ``"`` on it.  ``complex_input``: any of ``complex_keywords``, in lower case (none are
    known by default, so no response is).  Responses without a block are of no style."""
    code = F.coalesce(F.try_element_at(F.regexp_extract_all(F.col(response_col), F.lit(r"(?s)```python\n(.*?)\n```"), 1), F.lit(-1)), F.lit(""))
    d = df.select(source_col, code.alias("code")).withColumn("low", F.lower("code"))
    brute = F.col("low").rlike(r"\bbrute\b") | F.col("low").rlike(r"^\s*def\s+\w*correct\w*\s*\(")
    for word in BRUTE_FORCE_KEYWORDS:
        brute = brute | F.col("low").contains(word)

    def signed(line):
        head = F.regexp_replace(line, "[#\"].*$", "")
        has = F.lit(False)
        for sign in PROPERTY_SIGNS:
            has = has | head.contains(sign)
        return line.contains("assert") & has

    dense = F.lit(False)
    for word in complex_keywords:
        dense = dense | F.col("low").contains(word)
    d = d.select(source_col, brute.alias("brute"), F.exists(F.split("code", "\n"), signed).alias("prop"), dense.alias("dense"))
    share = lambda c: F.avg(F.col(c).cast("double"))
    return d.groupingSets([[], [source_col]], source_col).agg(
        share("brute").alias("brute_force_share"), share("prop").alias("property_share"), share("dense").alias("complex_input_share"))


def best_reward_from_logs(lines: DataFrame, text_col: str = "value", pattern: str = r"reward[:=]\s*(-?[0-9.]+)",
                          target: float | None = None) -> DataFrame:
    """Best reward printed in a text log (regex capture), compared with a target."""
    r = F.regexp_extract(F.col(text_col), pattern, 1)
    g = lines.filter(r != "").agg(F.max(r.cast("double")).alias("best_reward"))
    if target is not None:
        g = g.withColumn("reached", F.col("best_reward") >= F.lit(float(target)))
    return g


def pivot_samples_wide(df: DataFrame, step_col: str, sample_col: str, cols: list[str], n_samples: int) -> DataFrame:
    """One row per step with ``{col}_{i}`` for the logged samples i < n (fixed pivot values,
    so no distinct-value scan)."""
    g = df.filter(F.col(sample_col) < n_samples).groupBy(step_col).pivot(sample_col, list(range(n_samples)))
    out = g.agg(*[F.first(c).alias(c) for c in cols])
    ren = {}
    for i in range(n_samples):
        for c in cols:
            src = f"{i}_{c}" if len(cols) > 1 else str(i)
            ren[src] = f"{c}_{i}"
    return out.withColumnsRenamed({k: v for k, v in ren.items() if k in out.columns})
