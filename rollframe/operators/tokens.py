"""Token-sequence shaping on array columns: padding, truncation, masks, positions,
loss masks and turn assembly.

All per-row work is element-wise in the JVM (``transform``/``slice``/``concat``); the only
cross-row step is ``multiturn_loss_mask``/``assemble_turns``, a window or group partitioned
by conversation.  Prefix sums use the vectorised Arrow scan in
:mod:`rollframe.functions.arrays`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe.functions import arrays as AR
from rollframe.functions.answers import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# Column builders
# ---------------------------------------------------------------------------
def pad_or_truncate(a, max_length: int, pad, left_pad: bool = True, truncation: str = "error") -> Column:
    """Pad to ``max_length`` on the left/right; over-long arrays keep the tail
    (``left``), the head (``right``) or raise (``error``)."""
    a = _c(a)
    n = F.size(a)
    k = F.greatest(F.lit(max_length) - n, F.lit(0))
    fill = F.array_repeat(F.lit(pad), k)
    padded = F.concat(fill, a) if left_pad else F.concat(a, fill)
    if truncation == "left":
        cut = F.slice(a, -max_length, max_length)
    elif truncation == "right":
        cut = F.slice(a, 1, max_length)
    elif truncation == "error":
        cut = F.raise_error(F.concat(F.lit("sequence_length="), n.cast("string"),
                                     F.lit(f" exceeds the {max_length} that fit")))
    else:
        raise ValueError(f"no way to truncate is called {truncation}")
    return F.when(n > max_length, cut).otherwise(padded)


def position_ids(mask) -> Column:
    """``clip(cumsum(mask) - 1, 0)``."""
    return F.transform(AR.running_sum(mask), lambda c: F.greatest(c - 1, F.lit(0)).cast("int"))


def position_ids_multiturn(mask) -> Column:
    """``arange(L) * mask``."""
    return F.transform(_c(mask), lambda m, i: i * m)


def eos_response_mask(ids, eos) -> Column:
    """1 up to and including the first EOS token (``eos`` int or list), 0 after."""
    eos = [eos] if isinstance(eos, int) else list(eos)
    ids = _c(ids)
    hits = F.filter(F.transform(ids, lambda t, i: F.when(t.isin(*eos), i)), lambda x: x.isNotNull())
    first = F.coalesce(F.array_min(hits), F.size(ids))
    # bind the first-EOS index once: referencing it inside the element lambda would
    # re-scan the array for every element (quadratic in length)
    return let(first, lambda f: F.transform(ids, lambda _, i: F.when(i <= f, 1).otherwise(0)))


def remove_padding(ids, mask) -> Column:
    """Last ``sum(mask)`` ids (left-padding assumption)."""
    n = AR.arr_isum(mask).cast("int")
    return F.when(n > 0, F.slice(_c(ids), -n, n)).otherwise(F.array().cast("array<int>"))


def sft_loss_mask(attention_mask, prompt_len, response_len) -> Column:
    """Attention mask with the first ``min(prompt_len, L) - 1`` positions zeroed (when
    prompt_len > 1) and the last response token zeroed."""
    m = _c(attention_mask)
    p, r = _c(prompt_len), _c(response_len)
    L = F.size(m)
    last = F.least(p + r, L) - 1
    head = F.when(p > 1, F.least(p, L) - 1).otherwise(F.lit(0))
    return F.transform(m, lambda v, i: F.when((i < head) | (i == last), F.lit(0)).otherwise(v))


def response_mask_of(attention_mask, response_length: int) -> Column:
    return F.slice(_c(attention_mask), -response_length, response_length)


# ---------------------------------------------------------------------------
# DataFrame operators
# ---------------------------------------------------------------------------
def pad_truncate(df: DataFrame, ids_col: str, mask_col: str, max_length: int, pad_id: int,
                 left_pad: bool = True, truncation: str = "error") -> DataFrame:
    return df.withColumns({
        ids_col: pad_or_truncate(ids_col, max_length, pad_id, left_pad, truncation),
        mask_col: pad_or_truncate(mask_col, max_length, 0, left_pad, truncation),
    })


def pad_ragged(df: DataFrame, col: str, pad_id, max_length: int | None = None) -> DataFrame:
    """Right-pad every list to ``max(max_length, longest list)`` (the longest length is
    one bounded scalar)."""
    longest = df.agg(F.max(F.size(col))).first()[0] or 0
    target = max(longest, max_length or 0)
    a = F.col(col)
    return df.withColumn(col, F.concat(a, F.array_repeat(F.lit(pad_id), F.lit(target) - F.size(a))))


def lengths(df: DataFrame, attention_mask_col: str, prompt_width: int) -> DataFrame:
    """prompt_len / response_len = sums of the attention mask over the two parts."""
    m = F.col(attention_mask_col)
    return df.withColumns({
        "prompt_len": AR.arr_isum(F.slice(m, 1, prompt_width)),
        "response_len": AR.arr_isum(F.slice(m, prompt_width + 1, F.greatest(F.size(m) - prompt_width, F.lit(0)))),
    })


def multiturn_loss_mask(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", len_col: str = "n_tokens",
                        max_length: int | None = None, truncation: str = "right") -> DataFrame:
    """Token loss mask of a conversation: 1 on assistant spans, else 0, from per-turn
    token counts, concatenated in turn order per conversation (one bounded collect per
    conversation); right-padded with 0 to ``max_length``."""
    t = turns.withColumn("__flag", F.when(F.col(role_col) == "assistant", 1).otherwise(0))
    g = t.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct(turn_col, "__flag", len_col))).alias("__t"))
    mask = F.flatten(F.transform("__t", lambda s: F.array_repeat(s["__flag"], s[len_col].cast("int"))))
    out = g.select(conv_col, mask.alias("loss_mask"))
    if max_length is not None:
        out = out.withColumn("loss_mask", pad_or_truncate("loss_mask", max_length, 0, left_pad=False,
                                                          truncation=truncation))
    return out


def assemble_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text",
                   prefix: dict[str, str] | None = None, suffix: str = "\n") -> DataFrame:
    """Role-delimited transcript per conversation: ``prefix[role] + text + suffix`` for
    every turn in order (one collect per conversation, bounded by its turn count)."""
    prefix = prefix or {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}
    pre = F.lit("")
    for role, p in prefix.items():
        pre = F.when(F.col(role_col) == role, F.lit(p)).otherwise(pre)
    t = turns.withColumn("__piece", F.concat(pre, F.col(text_col), F.lit(suffix)))
    g = t.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct(turn_col, "__piece"))).alias("__p"),
                                F.count(F.lit(1)).alias("n_turns"))
    return g.select(conv_col, F.array_join(F.transform("__p", lambda s: s["__piece"]), "").alias("transcript"), "n_turns")


def append_response_turn(df: DataFrame, chat_col: str, response_col: str, eos: str | None = None) -> DataFrame:
    """Chat messages + ``{assistant, response without a trailing eos}``."""
    r = F.col(response_col)
    if eos:
        r = F.when(r.endswith(eos), F.expr(f"substring({response_col}, 1, length({response_col}) - {len(eos)})")).otherwise(r)
    return df.withColumn(chat_col, F.array_append(F.col(chat_col), F.struct(F.lit("assistant").alias("role"), r.alias("content"))))


def flatten_candidates(df: DataFrame, prompt_col: str, candidates_col: str) -> DataFrame:
    """Prompt x n candidate transcripts -> n rows; response = transcript minus the prompt
    prefix."""
    d = df.select("*", F.posexplode(candidates_col).alias("candidate_idx", "__full"))
    return d.withColumn("response", F.expr(f"substring(__full, length({prompt_col}) + 1)")).drop("__full", candidates_col)


def assemble_sequence(df: DataFrame, prompt_ids: str, prompt_mask: str, response_ids: str,
                      response_length: int, pad_id: int, eos) -> DataFrame:
    """Left-padded prompt || right-padded response; response positions continue after the
    last prompt position; the response mask comes from the first EOS."""
    resp = pad_or_truncate(response_ids, response_length, pad_id, left_pad=False, truncation="right")
    d = df.withColumn("__resp", resp)
    d = d.withColumn("__rmask", eos_response_mask("__resp", eos))
    ppos = position_ids(prompt_mask)
    d = d.withColumn("__ppos", ppos)
    last = F.try_element_at(F.col("__ppos"), F.lit(-1))
    return d.select("*",
                    F.concat(F.col(prompt_ids), F.col("__resp")).alias("input_ids"),
                    F.concat(F.col(prompt_mask), F.col("__rmask")).alias("attention_mask"),
                    F.concat(F.col("__ppos"), F.transform("__resp", lambda _, i: last + i + 1)).alias("position_ids"),
                    ).drop("__resp", "__rmask", "__ppos")


def strip_left_padding(ids, pad_id) -> Column:
    """Drop leading pad ids (slice from the first non-pad)."""
    ids = _c(ids)
    firsts = F.filter(F.transform(ids, lambda t, i: F.when(t != pad_id, i)), lambda x: x.isNotNull())
    start = F.array_min(firsts)
    return F.when(start.isNull(), F.array().cast("array<int>")).otherwise(F.slice(ids, start + 1, F.size(ids) - start))


def unpadded_offsets(df: DataFrame, len_col: str, batch_col: str, order_col: str) -> DataFrame:
    """cu_seqlens: running sum of lengths inside each micro-batch (window partitioned by
    micro-batch), plus the batch maximum."""
    w = Window.partitionBy(batch_col).orderBy(order_col)
    return df.withColumns({
        "cu_seqlen_start": F.coalesce(F.sum(len_col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "cu_seqlen_end": F.sum(len_col).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "max_seqlen": F.max(len_col).over(Window.partitionBy(batch_col)),
    })


def preference_pair_arrays(df: DataFrame, prompt_ids: str, chosen_ids: str, rejected_ids: str,
                           eos_id: int, max_length: int, pad_id: int) -> DataFrame:
    """[prompt + chosen + eos] and [prompt + rejected + eos], right-padded / right-truncated,
    each with its own attention mask (the reference stacks the rejected ids as the chosen
    mask; not reproduced)."""
    def build(part):
        ids = F.concat(F.col(prompt_ids), F.col(part), F.array(F.lit(eos_id)))
        ones = F.transform(ids, lambda _: F.lit(1))
        return (pad_or_truncate(ids, max_length, pad_id, left_pad=False, truncation="right"),
                pad_or_truncate(ones, max_length, 0, left_pad=False, truncation="right"))
    ci, cm = build(chosen_ids)
    ri, rm = build(rejected_ids)
    return df.withColumns({"chosen_input_ids": ci, "chosen_attention_mask": cm,
                           "rejected_input_ids": ri, "rejected_attention_mask": rm})


def truncate_rollout(df: DataFrame, ids_col: str, mask_col: str, max_model_len: int,
                     response_col: str | None = None, max_response_len: int | None = None) -> DataFrame:
    d = df.withColumns({ids_col: F.slice(ids_col, 1, max_model_len), mask_col: F.slice(mask_col, 1, max_model_len)})
    if response_col and max_response_len:
        d = d.withColumn(response_col, F.slice(response_col, 1, max_response_len))
    return d
