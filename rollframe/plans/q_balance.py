"""Registered balancing queries over ``documents`` lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.operators import balance as BL
from rollframe.operators.indexing import with_row_index
from rollframe.plans import tables as T
from rollframe.plans.catalog import register, r6

_SNAKE = """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY -n_chars, doc_id) - 1 AS r FROM documents)
, p AS (SELECT doc_id, n_chars, CAST(CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 8 - 1 - r % 8 END AS INTEGER) AS part FROM r)
"""


@register("balance_partitions", _SNAKE + "SELECT doc_id, part FROM p")
def q_balance_partitions(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return BL.balance_partitions(d, 8, "n_chars", "doc_id", equal_size=False).select("doc_id", "part")


@register("balance_report", _SNAKE + """
, s AS (SELECT part, sum(n_chars) AS s FROM p GROUP BY part)
, b AS (SELECT n_chars, least((row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil((SELECT count(*) FROM documents) / 8.0) AS BIGINT), 7) AS part FROM documents)
, t AS (SELECT part, sum(n_chars) AS s FROM b GROUP BY part)
SELECT 'balanced' AS side, min(s) AS min_sum, max(s) AS max_sum, max(s) - min(s) AS spread, round(avg(s), 6) AS mean_sum FROM s
UNION ALL SELECT 'contiguous', min(s), max(s), max(s) - min(s), round(avg(s), 6) FROM t""")
def q_balance_report(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    parts = BL.balance_partitions(d, 8, "n_chars", "doc_id", equal_size=False)
    chunks = BL.contiguous_partitions(d, 8, "doc_id")
    sides = [BL.balance_report(p, "part", "n_chars").withColumn("side", F.lit(s)) for p, s in ((parts, "balanced"), (chunks, "contiguous"))]
    r = sides[0].unionByName(sides[1])
    return r.select("side", "min_sum", "max_sum", "spread", r6("mean_sum").alias("mean_sum"))


@register("restore_order", """SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents""")
def q_restore_order(spark, sf_dir):
    d = with_row_index(T.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", out_col="pos")
    parts = BL.balance_partitions(d, 8, "n_chars", "doc_id", equal_size=False)
    return BL.restore_order(parts, "pos").select("doc_id", "n_chars", "pos")


@register("token_budget_batches", """WITH d AS (SELECT n_chars, doc_id // 2048 AS batch, CAST(doc_id % 4 AS INTEGER) AS rank FROM documents)
, b AS (SELECT 2 * max(n_chars) AS budget FROM d)
, r AS (SELECT batch, rank, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS tokens, max(n_chars) AS longest FROM d GROUP BY batch, rank)
, k AS (SELECT batch, greatest(max(CAST(ceil(CAST(tokens AS DOUBLE) / budget) AS INTEGER)), 1) AS n_micro_batches FROM r, b GROUP BY batch)
SELECT batch, rank, n_rows, tokens, n_micro_batches, n_micro_batches AS n_used, true AS within_longest FROM r JOIN k USING (batch)""")
def q_token_budget_batches(spark, sf_dir):
    """Micro-batches of every rank: the number all ranks share, how many a rank uses, and whether
    their sums differ by the rank's longest row at most."""
    d = T.table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", F.floor(F.col("doc_id") / 2048).alias("batch"), (F.col("doc_id") % 4).cast("int").alias("rank"))
    budget = 2 * (d.agg(F.max("n_chars")).first()[0] or 1)
    cut = BL.token_budget_batches(d, budget, "n_chars", "doc_id", "batch", "rank")
    parts = cut.groupBy("batch", "rank", "n_micro_batches", "micro_batch").agg(
        F.count("*").alias("rows"), F.sum("n_chars").alias("tokens"), F.max("n_chars").alias("longest"))
    spread = F.max("tokens") - F.min("tokens")
    return parts.groupBy("batch", "rank").agg(
        F.sum("rows").alias("n_rows"), F.sum("tokens").alias("tokens"), F.max("n_micro_batches").alias("n_micro_batches"),
        F.count("*").cast("int").alias("n_used"), (spread <= F.max("longest")).alias("within_longest"))


@register("differencing_partitions", """WITH d AS (SELECT coalesce(n_chars, 0) AS n_chars, (SELECT count(*) FROM documents) AS n FROM documents)
, s AS (SELECT unnest([true, false]) AS equal_size)
SELECT equal_size, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS tokens, 8 AS n_parts, true AS within_longest, true AS sizes_right, true AS below_snake
FROM d, s GROUP BY equal_size""")
def q_differencing_partitions(spark, sf_dir):
    """Whole-table differencing into 8 parts, of equal size (if 8 does not divide the rows: to one row)
    or not: all rows placed, sums within the longest row of each other and never further apart than
    the snake draft's."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    snake = BL.balance_report(BL.balance_partitions(d, 8, "n_chars", "doc_id", equal_size=False), "part", "n_chars")
    out = None
    for equal in (True, False):
        parts = BL.differencing_partitions(d, 8, "n_chars", "doc_id", equal, block_rows=256, divisible=False)
        s = parts.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("tokens"), F.max("n_chars").alias("longest"))
        spread = F.max("tokens") - F.min("tokens")
        one = s.agg(F.sum("rows").alias("n_rows"), F.sum("tokens").alias("tokens"), F.count("*").cast("int").alias("n_parts"),
                    (spread <= F.max("longest")).alias("within_longest"),
                    ((F.max("rows") - F.min("rows") <= F.least(F.sum("rows") % 8, F.lit(1))) | F.lit(not equal)).alias("sizes_right"), spread.alias("gap"))
        one = one.join(F.broadcast(snake.select("spread"))).select(F.lit(equal).alias("equal_size"), "n_rows", "tokens", "n_parts",
                                                                   "within_longest", "sizes_right", (F.col("gap") <= F.col("spread")).alias("below_snake"))
        out = one if out is None else out.unionByName(one)
    return out


@register("balance_in_batches", """WITH RECURSIVE d AS (
  SELECT doc_id, n_chars, doc_id // 256 AS batch, row_number() OVER (PARTITION BY doc_id // 256 ORDER BY n_chars DESC, doc_id) AS i,
    CAST(ceil(count(*) OVER (PARTITION BY doc_id // 256) / 4.0) AS BIGINT) AS cap FROM documents),
go AS (
  SELECT batch, 0::BIGINT AS i, NULL::BIGINT AS doc_id, [0::BIGINT, 0, 0, 0] AS sums, [0::BIGINT, 0, 0, 0] AS ns, NULL::INTEGER AS part
  FROM (SELECT DISTINCT batch FROM d)
  UNION ALL
  SELECT batch, i, doc_id, list_transform(sums, lambda s, j: CASE WHEN j = p THEN s + n_chars ELSE s END),
    list_transform(ns, lambda s, j: CASE WHEN j = p THEN s + 1 ELSE s END), p - 1
  FROM (
    SELECT go.batch, d.i, d.doc_id, d.n_chars, sums, ns,
      CAST(list_position(list_transform(sums, lambda s, j: CASE WHEN ns[j] < cap THEN s ELSE 9000000000000000000 END),
        list_min(list_transform(sums, lambda s, j: CASE WHEN ns[j] < cap THEN s ELSE 9000000000000000000 END))) AS INTEGER) AS p
    FROM go JOIN d ON go.batch = d.batch AND d.i = go.i + 1))
SELECT doc_id, batch, part FROM go WHERE i > 0""")
def q_balance_in_batches(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 256).cast("bigint").alias("batch"))
    return BL.balance_in_batches(d, 4, "n_chars", "doc_id", "batch").select("doc_id", "batch", "part")
