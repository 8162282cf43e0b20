"""Registered batch-algebra queries over ``customer`` / ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.operators import batch as B
from rollframe.operators import cursor as CU
from rollframe.operators.indexing import with_row_index
from rollframe.plans import tables as T
from rollframe.plans.catalog import TOKENS_SQL, register, with_
from rollframe.sources import io as IO

_CUST = """WITH cust AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx FROM customer)
"""


def _cust(spark, sf_dir):
    return with_row_index(T.table(spark, sf_dir, "customer"), "c_custkey")


@register("with_row_index", _CUST + "SELECT c_custkey, row_idx FROM cust")
def q_with_row_index(spark, sf_dir):
    return _cust(spark, sf_dir).select("c_custkey", "row_idx")


@register("select_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_select_columns(spark, sf_dir):
    return B.select_columns(T.table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"], key="c_custkey")


@register("pop_columns", """SELECT c_custkey, c_mktsegment, c_name, c_acctbal FROM customer""")
def q_pop_columns(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    popped, rest = B.pop_columns(c, ["c_mktsegment"], key="c_custkey")
    return popped.join(rest, "c_custkey")


@register("rename_columns", "SELECT c_custkey, c_name AS name, c_acctbal AS balance FROM customer")
def q_rename_columns(spark, sf_dir):
    d = B.rename_columns(T.table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"], ["name", "balance"])
    return d.select("c_custkey", "name", "balance")


@register("union_columns", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def q_union_columns(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    return B.union_columns(c.select("c_custkey", "c_name", "c_nationkey"), c.select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")


@register("concat_rows", """SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL""")
def q_concat_rows(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    seg = F.col("c_mktsegment") == "BUILDING"
    return B.concat_rows([c.filter(seg), c.filter(~seg | F.col("c_mktsegment").isNull())])


@register("take_rows", _CUST + """SELECT o.o_orderkey AS take_pos, cust.row_idx, cust.c_custkey
FROM orders o JOIN cust ON cust.row_idx = o.o_custkey % (SELECT count(*) FROM customer)""")
def q_take_rows(spark, sf_dir):
    n = T.table(spark, sf_dir, "customer").count()
    idx = T.table(spark, sf_dir, "orders").select((F.col("o_custkey") % n).alias("take_idx"),
                                                  F.col("o_orderkey").alias("take_pos"))
    return B.take_rows(_cust(spark, sf_dir), idx).select("take_pos", "row_idx", "c_custkey")


@register("slice_rows", _CUST + """SELECT row_idx, c_custkey FROM cust
WHERE row_idx >= 10 AND row_idx < (SELECT count(*) FROM customer) - 5 AND (row_idx - 10) % 3 = 0""")
def q_slice_rows(spark, sf_dir):
    return B.slice_rows(_cust(spark, sf_dir), 10, -5, 3).select("row_idx", "c_custkey")


@register("reorder_rows", _CUST + """SELECT (SELECT count(*) FROM customer) - 1 - row_idx AS row_idx, c_custkey FROM cust""")
def q_reorder_rows(spark, sf_dir):
    c = _cust(spark, sf_dir)
    n = c.count()
    perm = c.select(F.col("row_idx").alias("old_idx"), (F.lit(n - 1) - F.col("row_idx")).alias("new_idx"))
    return B.reorder_rows(c, perm).select("row_idx", "c_custkey")


@register("repeat_rows", _CUST + """SELECT row_idx * 2 + r AS row_idx, c_custkey, 'interleave' AS mode FROM cust, range(2) t(r)
UNION ALL SELECT r * (SELECT count(*) FROM customer) + row_idx, c_custkey, 'tile' FROM cust, range(2) t(r)""")
def q_repeat_rows(spark, sf_dir):
    c = _cust(spark, sf_dir).select("row_idx", "c_custkey")
    a = B.repeat_rows(c, 2, interleave=True).withColumn("mode", F.lit("interleave"))
    b = B.repeat_rows(c, 2, interleave=False).withColumn("mode", F.lit("tile"))
    return a.unionByName(b)


@register("chunk_rows", _CUST + """SELECT row_idx, c_custkey, CAST(row_idx // ((SELECT count(*) + (3 - count(*) % 3) % 3 FROM customer) // 3) AS BIGINT) AS chunk_id FROM cust""")
def q_chunk_rows(spark, sf_dir):
    # padded first, so that the chunk count divides any table
    padded, _ = B.pad_to_divisor(_cust(spark, sf_dir), 3)
    return B.unpad(B.chunk_rows(padded, 3)).select("row_idx", "c_custkey", "chunk_id")


@register("pad_to_divisor", _CUST + """, n AS (SELECT count(*) AS n FROM customer)
, p AS (SELECT CASE WHEN n % 7 = 0 THEN 0 ELSE 7 - n % 7 END AS pad, n FROM n)
SELECT row_idx, c_custkey, false AS is_pad FROM cust
UNION ALL SELECT n + j, (SELECT c_custkey FROM cust WHERE row_idx = j % n), true
FROM p, range(CAST((SELECT pad FROM p) AS BIGINT)) t(j)""")
def q_pad_to_divisor(spark, sf_dir):
    padded, _ = B.pad_to_divisor(_cust(spark, sf_dir), 7)
    return padded.select("row_idx", "c_custkey", "is_pad")


@register("unpad", _CUST + "SELECT row_idx, c_custkey FROM cust")
def q_unpad(spark, sf_dir):
    padded, _ = B.pad_to_divisor(_cust(spark, sf_dir), 7)
    return B.unpad(padded).select("row_idx", "c_custkey")


@register("fold_groups", _CUST + """SELECT CAST(row_idx // 3 AS BIGINT) AS group_idx, list(c_custkey ORDER BY row_idx) AS keys
FROM cust GROUP BY 1""")
def q_fold_groups(spark, sf_dir):
    f = B.fold_groups(_cust(spark, sf_dir).select("row_idx", "c_custkey"), 3)
    return f.select("group_idx", F.transform("items", lambda s: s["c_custkey"]).alias("keys"))


@register("unfold_groups", _CUST + """SELECT CAST(row_idx // 3 AS BIGINT) AS group_idx, row_idx % 3 AS pos, row_idx, c_custkey FROM cust""")
def q_unfold_groups(spark, sf_dir):
    f = B.fold_groups(_cust(spark, sf_dir).select("row_idx", "c_custkey"), 3)
    u = B.unfold_groups(f)
    return u.select("group_idx", F.col("__pos").cast("bigint").alias("pos"), "row_idx", "c_custkey")


@register("rows_to_columns", """SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS o_orderkey,
  list(o_totalprice ORDER BY o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey""")
def q_rows_to_columns(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").withColumn("ord", F.col("o_orderkey"))
    return B.rows_to_columns(o, "o_custkey", ["o_orderkey", "o_totalprice"], order_col="ord")


@register("columns_to_rows", """SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos,
  o_orderkey, o_totalprice FROM orders""")
def q_columns_to_rows(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").withColumn("ord", F.col("o_orderkey"))
    cols = B.rows_to_columns(o, "o_custkey", ["o_orderkey", "o_totalprice"], order_col="ord")
    return B.columns_to_rows(cols, ["o_orderkey", "o_totalprice"], keep=["o_custkey"])


@register("minibatch_ids", """SELECT c_custkey, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', '0', '0', CAST(c_custkey AS VARCHAR))), c_custkey) - 1) // (SELECT count(*) // (SELECT max(k) FROM range(1, 11) t(k) WHERE (SELECT count(*) FROM customer) % k = 0) FROM customer) AS BIGINT) AS minibatch
FROM customer""")
def q_minibatch_ids(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    # the batch size must divide the rows: up to 10 batches, as many as do
    n = c.count()
    size = n // max(k for k in range(1, 11) if n % k == 0)
    d = B.minibatch_ids(c, size, "c_custkey", seed=0, epoch=0, n=n)
    return d.select("c_custkey", "minibatch")


@register("epoch_batches", """SELECT * FROM (SELECT c_custkey, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', '1', CAST(c_custkey AS VARCHAR))), c_custkey) - 1) // 128 AS BIGINT) AS batch
FROM customer) WHERE batch < (SELECT count(*) FROM customer) // 128""")
def q_epoch_batches(spark, sf_dir):
    d = B.epoch_batches(T.table(spark, sf_dir, "customer"), 128, "c_custkey", seed=1)
    return d.select("c_custkey", "batch")


@register("rank_shards", _CUST + """SELECT row_idx, c_custkey, CAST(row_idx % 8 AS INTEGER) AS rank FROM cust
WHERE row_idx < (SELECT count(*) FROM customer) // 8 * 8""")
def q_rank_shards(spark, sf_dir):
    return B.rank_shards(_cust(spark, sf_dir), 8).select("row_idx", "c_custkey", "rank")


@register("split_batches", _CUST + "SELECT row_idx, CAST(row_idx // 100 AS BIGINT) AS split_id FROM cust")
def q_split_batches(spark, sf_dir):
    return B.split_batches(_cust(spark, sf_dir), 100).select("row_idx", "split_id")


@register("batch_size_report", with_(TOKENS_SQL) + """
SELECT CAST(sum(8) AS BIGINT) AS response_id_bytes, CAST(sum(8) AS BIGINT) AS uid_bytes, CAST(sum(8) AS BIGINT) AS batch_id_bytes,
  CAST(sum(len(response_mask) * 4) AS BIGINT) AS response_mask_bytes,
  CAST(sum(len(log_probs) * 8) AS BIGINT) AS log_probs_bytes, CAST(sum(len(old_log_probs) * 8) AS BIGINT) AS old_log_probs_bytes,
  CAST(sum(len(ref_log_probs) * 8) AS BIGINT) AS ref_log_probs_bytes, CAST(sum(len("values") * 8) AS BIGINT) AS values_bytes,
  CAST(sum(len(token_level_rewards) * 8) AS BIGINT) AS token_level_rewards_bytes,
  CAST(sum(len(token_level_scores) * 8) AS BIGINT) AS token_level_scores_bytes FROM tokens""")
def q_batch_size_report(spark, sf_dir):
    return B.batch_size_report(T.tokens(spark, sf_dir))


def _permuted_sql(src: str) -> str:
    """SQL of the keyed permutation over ``src(x, n, k0 ... k5)``: all its columns and y, walked
    until y is below n."""
    def network(rows: str) -> str:
        q = f"SELECT *, x // b AS l0, x % b AS r0 FROM {rows}"
        for i in range(6):
            t = f"((r{i} + k{i}) % 2147483647)"
            q = (f"SELECT *, r{i} AS l{i + 1}, (l{i} + ({t} * {t} % 2147483647) * {t} % 2147483647) % {'ab'[i % 2]} AS r{i + 1} "
                 f"FROM ({q})")
        return f"SELECT id, a, b, n, {keys}, l6 * b + r6 AS x FROM ({q})"

    keys = ", ".join(f"k{i}" for i in range(6))
    return f"""radix AS (SELECT *, greatest(CAST(ceil(n / a) AS BIGINT), 1) AS b FROM (
    SELECT *, greatest(CAST(ceil(sqrt(n)) AS BIGINT), 1) AS a FROM {src})),
walk AS (SELECT * FROM ({network("radix")}) UNION ALL SELECT * FROM ({network("(SELECT * FROM walk WHERE x >= n)")})),
placed AS (SELECT id, x AS y FROM walk WHERE x < n)"""


def _key_sql(seed: int, epoch: int) -> str:
    """The round keys, hashed in SQL as the operator hashes them."""
    return ", ".join(f"CAST('0x' || substr(md5('{seed}|{epoch}|{r}'), 1, 15) AS BIGINT) % 2147483647 AS k{r}" for r in range(6))


@register("minibatch_ids_by_index", f"""WITH RECURSIVE idx AS (
  SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS x, (SELECT count(*) FROM orders) AS n, {_key_sql(3, 2)} FROM orders),
{_permuted_sql("idx")}
SELECT id AS o_orderkey, y AS perm_idx, y // (SELECT count(*) // (SELECT max(k) FROM range(1, 11) t(k) WHERE (SELECT count(*) FROM orders) % k = 0) FROM orders) AS minibatch
FROM placed""")
def q_minibatch_ids_by_index(spark, sf_dir):
    """An epoch's mini-batches over a table that has a row index: each row computes its place."""
    o = with_row_index(T.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "row_idx")
    n = o.count()
    size = n // max(k for k in range(1, 11) if n % k == 0)
    return B.minibatch_ids(o, size, "o_orderkey", seed=3, epoch=2, n=n, index_col="row_idx").select("o_orderkey", "perm_idx", "minibatch")


@register("resume_batches", f"""WITH RECURSIVE idx AS (
  SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS x, (SELECT count(*) FROM orders) AS n, {_key_sql(5, 1)} FROM orders),
{_permuted_sql("idx")}
SELECT id AS o_orderkey, y // 64 AS batch FROM placed
WHERE y // 64 < (SELECT count(*) // 64 FROM orders) AND y // 64 >= (SELECT (count(*) // 64) // 2 FROM orders)""")
def q_resume_batches(spark, sf_dir):
    """A run that stopped in the middle of its second epoch, gone on with from its saved position."""
    o = with_row_index(T.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "row_idx")
    n = o.count()
    folder, per_epoch = IO.scratch_path(spark, "cursor"), max(n // 64, 1)
    CU.save_cursor(spark, folder, CU.BatchCursor(5))
    CU.save_cursor(spark, folder, CU.load_cursor(spark, folder).advanced(per_epoch, per_epoch + per_epoch // 2))
    return CU.remaining_batches(o, CU.load_cursor(spark, folder), 64, "row_idx", n).select("o_orderkey", "batch")
