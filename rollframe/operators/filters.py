"""Group filters, oversample-then-keep and seeded samples.

Group decisions come from one ``groupBy(uid)`` (map-side partial aggregation) joined back
or semi-joined; ranking of *groups* (not rows) uses a window over the per-group table only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollframe.operators.batch import shuffle_key
from rollframe.operators.indexing import running_total, with_row_index


def filter_zero_variance_groups(df: DataFrame, group_col: str = "uid", metric_col: str = "score") -> DataFrame:
    """Keep groups whose metric varies (population std > 0, tested exactly as max <> min)
    or that hold a single trajectory (left-semi join on the kept keys)."""
    keep = (df.groupBy(group_col)
            .agg(F.count(F.lit(1)).alias("n"), F.min(metric_col).alias("lo"), F.max(metric_col).alias("hi"))
            .filter((F.col("n") == 1) | (F.col("lo") != F.col("hi")))
            .select(group_col))
    return df.join(keep, group_col, "left_semi")


def group_flags(df: DataFrame, group_col: str = "uid", acc_col: str | None = "acc",
                acc_bounds: tuple[float, float] | None = None, length_col: str | None = None,
                max_response_length: int | None = None) -> DataFrame:
    """Per-group pass flag: accuracy mean inside ``[lo, hi]`` and/or longest response
    shorter than ``max_response_length - 1``.  Returns ``(group, pass_filter)``."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    cond = F.lit(True)
    if acc_bounds is not None:
        aggs.append(F.avg(acc_col).alias("__acc"))
        cond = cond & (F.col("__acc") >= acc_bounds[0]) & (F.col("__acc") <= acc_bounds[1])
    if max_response_length is not None:
        aggs.append(F.max(length_col).alias("__len"))
        cond = cond & (F.col("__len") < max_response_length - 1)
    return df.groupBy(group_col).agg(*aggs).select(group_col, cond.alias("pass_filter"))


def accuracy_band_filter(df: DataFrame, lo: float, hi: float, group_col: str = "uid",
                         acc_col: str = "acc") -> DataFrame:
    """Flag (not drop) groups whose mean accuracy leaves ``[lo, hi]``."""
    return df.join(group_flags(df, group_col, acc_col, (lo, hi)), group_col, "left")


def truncation_filter(df: DataFrame, max_response_length: int, group_col: str = "uid",
                      length_col: str = "response_len") -> DataFrame:
    """Flag groups whose longest response reaches ``max_response_length - 1``."""
    return df.join(group_flags(df, group_col, None, None, length_col, max_response_length),
                   group_col, "left")


def prioritized_downsample(df: DataFrame, keep_rows: int, group_col: str = "uid",
                           group_order_col: str = "group_pos", pass_col: str = "pass_filter",
                           row_order_col: str = "sample_idx") -> DataFrame:
    """Groups passing the filters first (ties by group order), then keep the first
    ``keep_rows`` rows of that order.  The reference's argsort is not stable; the group
    order is used as the tie-break."""
    groups = df.groupBy(group_col).agg(F.first(pass_col).alias("__p"), F.min(group_order_col).alias("__o"), F.count("*").alias("__n"))
    # positions come from row counts over the per-group table; rows are ordered in their group only
    ranked = running_total(groups, [~F.col("__p"), F.col("__o"), F.col(group_col)], F.col("__n"), "__first")
    ranked = ranked.filter(F.col("__first") < keep_rows).select(group_col, "__first")
    at = F.row_number().over(Window.partitionBy(group_col).orderBy(row_order_col)) - 1
    d = df.join(ranked, group_col).withColumn("new_pos", (F.col("__first") + at).cast("bigint"))
    return d.filter(F.col("new_pos") < keep_rows).drop("__first")


def accumulate_to_target(df: DataFrame, target_prompts: int, n_per_prompt: int, round_col: str = "gen_round",
                         group_col: str = "uid", metric_col: str = "score", order_col: str = "sample_idx",
                         max_rounds: int | None = None) -> DataFrame:
    """Dynamic sampling: per generation round keep the non-constant groups, append rounds
    in order until ``target_prompts`` groups are kept, then cut to ``target * n`` rows.
    Raises when even all rounds do not reach the target (``max_rounds`` exceeded)."""
    keys = [round_col, group_col]
    st = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(metric_col).alias("lo"),
                                F.max(metric_col).alias("hi"))
          .filter((F.col("n") == 1) | (F.col("lo") != F.col("hi"))))
    kept = df.join(st.select(*keys), keys, "left_semi")
    per_round = kept.groupBy(round_col).agg(F.countDistinct(group_col).alias("__kept"))
    cum = per_round.withColumn("__cum", F.sum("__kept").over(Window.orderBy(round_col)))
    last = cum.filter(F.col("__cum") >= target_prompts).agg(F.min(round_col)).first()[0]  # bounded scalar
    if last is None or (max_rounds is not None and last >= max_rounds):
        raise RuntimeError("too many generation rounds: target number of prompts not reached")
    kept = kept.filter(F.col(round_col) <= last)
    kept = with_row_index(kept, [round_col, group_col, order_col], out_col="batch_pos")
    return kept.filter(F.col("batch_pos") < target_prompts * n_per_prompt)


def single_score_group_share(df: DataFrame, source_col: str = "data_source", group_col: str = "uid",
                             score_col: str = "score") -> DataFrame:
    """Per source: for each score, the share of prompts whose responses all have that
    single score (count(distinct score) = 1)."""
    g = df.groupBy(source_col, group_col).agg(F.countDistinct(score_col).alias("nd"), F.min(score_col).alias("s"))
    tot = g.groupBy(source_col).agg(F.count(F.lit(1)).alias("__prompts"))
    single = g.filter(F.col("nd") == 1).groupBy(source_col, "s").agg(F.count(F.lit(1)).alias("__c"))
    return (single.join(tot, source_col)
            .select(source_col, F.col("s").alias("score"), (F.col("__c") / F.col("__prompts")).alias("share")))


def log_sample(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Seeded sample of ``n`` rows: order by ``md5(seed|id)`` and take the first ``n``
    (``TakeOrderedAndProject``: a bounded top-k per partition, then one merge)."""
    return df.withColumn("__k", shuffle_key(seed, None, id_col)).orderBy("__k", id_col).limit(n).drop("__k")
