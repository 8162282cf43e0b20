"""Registered token-shaping queries over ``documents`` (ids = word lengths of
the whole text) and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.functions import arrays as AR
from rollframe.operators import tokens as TK
from rollframe.plans import tables as T
from rollframe.plans.catalog import TOKENS_SQL, register, r6a, with_

DOC_IDS_SQL = """WITH docs AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM documents)
"""


def _docs(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.transform(F.split("text", " ", -1), lambda w: F.length(w)).alias("ids"))


@register("pad_truncate", DOC_IDS_SQL + """
SELECT doc_id,
  CASE WHEN len(ids) > 64 THEN ids[len(ids) - 63:] ELSE list_concat(list_transform(range(64 - len(ids)), lambda x: 0), ids) END AS ids,
  CASE WHEN len(ids) > 64 THEN list_transform(range(64), lambda x: 1)
       ELSE list_concat(list_transform(range(64 - len(ids)), lambda x: 0), list_transform(ids, lambda x: 1)) END AS mask
FROM docs""")
def q_pad_truncate(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("mask", F.transform("ids", lambda _: F.lit(1)))
    return TK.pad_truncate(d, "ids", "mask", 64, 0, left_pad=True, truncation="left")


@register("eos_response_mask", DOC_IDS_SQL + """
SELECT doc_id, list_transform(ids, lambda t, i: CASE WHEN i - 1 <= coalesce(list_min(list_filter(
    list_transform(ids, lambda u, j: CASE WHEN u IN (1, 2) THEN j - 1 END), lambda x: x IS NOT NULL)), len(ids)) THEN 1 ELSE 0 END) AS response_mask
FROM docs""")
def q_eos_response_mask(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", TK.eos_response_mask("ids", [1, 2]).alias("response_mask"))


def _left_padded(spark, sf_dir):
    """Whole documents with doc_id mod 5 pads on the left."""
    d = _docs(spark, sf_dir).withColumn("pads", (F.col("doc_id") % 5).cast("int"))
    pad = F.array_repeat(F.lit(0), F.col("pads"))
    return d.select("doc_id", F.concat(pad, "ids").alias("ids"), F.concat(pad, F.transform("ids", lambda _: F.lit(1))).alias("mask"))


@register("position_ids", DOC_IDS_SQL + """
SELECT doc_id, list_transform(range(len(ids) + doc_id % 5), lambda i: CAST(greatest(i - doc_id % 5, 0) AS INTEGER)) AS position_ids,
  list_transform(range(len(ids) + doc_id % 5), lambda i: CAST(CASE WHEN i < doc_id % 5 THEN 0 ELSE i END AS INTEGER)) AS position_ids_multiturn FROM docs""")
def q_position_ids(spark, sf_dir):
    d = _left_padded(spark, sf_dir)
    return d.select("doc_id", TK.position_ids("mask").alias("position_ids"),
                    TK.position_ids_multiturn("mask").alias("position_ids_multiturn"))


@register("remove_padding", DOC_IDS_SQL + "SELECT doc_id, ids FROM docs")
def q_remove_padding(spark, sf_dir):
    d = _left_padded(spark, sf_dir)
    return d.select("doc_id", TK.remove_padding("ids", "mask").alias("ids"))


@register("sft_loss_mask", DOC_IDS_SQL + """
, p AS (SELECT doc_id, CAST(doc_id % 20 AS INTEGER) + 1 AS pl, len(ids) AS n FROM docs)
SELECT doc_id, list_transform(range(n + 3), lambda i: CASE WHEN i >= n OR (pl > 1 AND i < least(pl, n + 3) - 1) OR i = greatest(n, pl) - 1 THEN 0 ELSE 1 END) AS loss_mask
FROM p""")
def q_sft_loss_mask(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("pl", (F.col("doc_id") % 20).cast("int") + 1)
    d = d.withColumn("rl", F.greatest(F.size("ids") - F.col("pl"), F.lit(0)))
    d = d.withColumn("m", F.concat(F.transform("ids", lambda _: F.lit(1)), F.array_repeat(F.lit(0), 3)))
    return d.select("doc_id", TK.sft_loss_mask("m", "pl", "rl").alias("loss_mask"))


@register("multiturn_loss_mask", """
SELECT conv_id, flatten(list(list_transform(range(len(string_split(text, ' '))), lambda x: CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)
   ORDER BY turn)) AS loss_mask
FROM conversations GROUP BY conv_id""")
def q_multiturn_loss_mask(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations").withColumn("n_tokens", F.size(F.split("text", " ", -1)))
    return TK.multiturn_loss_mask(c)


@register("assemble_turns", """
SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '<|system|>' || chr(10) WHEN 'user' THEN '<|user|>' || chr(10)
     WHEN 'assistant' THEN '<|assistant|>' || chr(10) ELSE '' END || text || chr(10), '' ORDER BY turn) AS transcript,
  count(*) AS n_turns
FROM conversations GROUP BY conv_id""")
def q_assemble_turns(spark, sf_dir):
    return TK.assemble_turns(T.table(spark, sf_dir, "conversations"))


@register("lengths", with_(TOKENS_SQL) + """
SELECT response_id, CAST(list_sum(response_mask[1:20]) AS BIGINT) AS prompt_len,
       CAST(list_sum(response_mask[21:]) AS BIGINT) AS response_len FROM tokens""")
def q_lengths(spark, sf_dir):
    d = TK.lengths(T.tokens(spark, sf_dir), "response_mask", 20)
    return d.select("response_id", "prompt_len", "response_len")


@register("discounted_suffix_sum", with_(TOKENS_SQL) + """
SELECT response_id, list_transform(list_reduce(list_reverse(token_level_rewards), lambda acc, x: list_prepend(x + 0.9 * coalesce(acc[1], 0.0), acc), []::DOUBLE[]),
   lambda v: round(v, 6)) AS disc,
  list_transform(token_level_rewards, lambda r, i: round(list_sum(token_level_rewards[i:]), 6)) AS undisc
FROM tokens""")
def q_discounted_suffix_sum(spark, sf_dir):
    d = T.tokens(spark, sf_dir)
    return d.select("response_id", r6a(AR.suffix_sum("token_level_rewards", 0.9)).alias("disc"),
                    r6a(AR.suffix_sum_sql("token_level_rewards")).alias("undisc"))


@register("unpadded_offsets", with_(TOKENS_SQL) + """
, t AS (SELECT response_id, batch_id, CAST(list_sum(response_mask) AS BIGINT) AS len FROM tokens)
SELECT response_id, batch_id, len,
  CAST(coalesce(sum(len) OVER (PARTITION BY batch_id ORDER BY response_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cu_seqlen_start,
  CAST(sum(len) OVER (PARTITION BY batch_id ORDER BY response_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cu_seqlen_end,
  max(len) OVER (PARTITION BY batch_id) AS max_seqlen
FROM t""")
def q_unpadded_offsets(spark, sf_dir):
    t = T.tokens(spark, sf_dir).select("response_id", "batch_id", AR.arr_isum("response_mask").alias("len"))
    return TK.unpadded_offsets(t, "len", "batch_id", "response_id")


@register("preference_pair_arrays", DOC_IDS_SQL + """
, p AS (SELECT doc_id, len(ids) // 3 AS k, ids FROM docs)
, q AS (SELECT doc_id, list_concat(ids[1:2 * k], [50256]) AS c, list_concat(ids[1:k], ids[2 * k + 1:], [50256]) AS r FROM p)
SELECT doc_id,
  list_transform(range(256), lambda i: CASE WHEN i < len(c) THEN c[i + 1] ELSE 0 END) AS chosen_input_ids,
  list_transform(range(256), lambda i: CASE WHEN i < len(r) THEN r[i + 1] ELSE 0 END) AS rejected_input_ids,
  list_transform(range(256), lambda i: CASE WHEN i < len(c) THEN 1 ELSE 0 END) AS chosen_attention_mask,
  list_transform(range(256), lambda i: CASE WHEN i < len(r) THEN 1 ELSE 0 END) AS rejected_attention_mask
FROM q""")
def q_preference_pair_arrays(spark, sf_dir):
    """Whole documents in thirds: prompt, chosen, rejected; longer ones are truncated at 256."""
    k = F.floor(F.size("ids") / 3).cast("int")
    d = _docs(spark, sf_dir).withColumn("k", k).select(
        "doc_id", F.slice("ids", F.lit(1), F.col("k")).alias("p"), F.slice("ids", F.col("k") + 1, F.col("k")).alias("c"),
        F.slice("ids", F.col("k") * 2 + 1, F.size("ids") - F.col("k") * 2).alias("r"))
    d = TK.preference_pair_arrays(d, "p", "c", "r", 50256, 256, 0)
    return d.select("doc_id", "chosen_input_ids", "rejected_input_ids", "chosen_attention_mask", "rejected_attention_mask")
