"""Batch algebra: select / pop / rename / column-union / concat / take / slice / reorder /
repeat / chunk / pad / fold / minibatches, re-expressed over a positional index column.

Positional semantics need an explicit order key; ``with_row_index`` supplies a global
0-based ``row_idx`` (see :mod:`rollframe.operators.indexing`).  Everything else is a
projection, a filter on the index, an ``explode`` or a join on the index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe.functions.permute import permuted, round_keys
from rollframe.operators.indexing import row_count, with_row_index

IDX = "row_idx"


def select_columns(df: DataFrame, cols: list[str], key: str | None = None) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    keep = ([key] if key and key not in cols else []) + list(cols)
    return df.select(*keep)


def pop_columns(df: DataFrame, cols: list[str], key: str = IDX) -> tuple[DataFrame, DataFrame]:
    """Split into (popped, rest); the row key stays in both.  A missing key raises."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(key, *cols), df.drop(*cols)


def rename_columns(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"rename needs equal-length lists, got {len(old)} and {len(new)}")
    return df.withColumnsRenamed(dict(zip(old, new)))


def union_columns(a: DataFrame, b: DataFrame, key: str = IDX) -> DataFrame:
    """Horizontal union of two equal-length batches on the row key.  Shared columns must
    be equal (null-safe; Spark compares NaN equal to NaN) or the job fails.  The check is
    folded into the key column so column pruning cannot drop it."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    bb = b.select(key, *[F.col(c).alias(f"__b_{c}") if c in shared else F.col(c)
                         for c in b.columns if c != key], F.lit(True).alias("__pb"))
    j = a.withColumn("__pa", F.lit(True)).join(bb, key, "full_outer")
    k = F.when(F.col("__pa").isNull() | F.col("__pb").isNull(),
               F.raise_error(F.lit("union_columns: batches differ in length")))
    for c in shared:
        k = k.when(~F.col(c).eqNullSafe(F.col(f"__b_{c}")),
                   F.raise_error(F.lit(f"union_columns: conflicting values in column {c}")))
    k = k.otherwise(F.col(key))
    return j.withColumn(key, k).drop("__pa", "__pb", *[f"__b_{c}" for c in shared])


def concat_rows(dfs: list[DataFrame]) -> DataFrame:
    """Vertical concat; every input must have the same columns."""
    cols = set(dfs[0].columns)
    for d in dfs[1:]:
        if set(d.columns) != cols:
            raise ValueError("concat_rows needs the same columns in every batch")
    return reduce(lambda x, y: x.unionByName(y), dfs)


def take_rows(df: DataFrame, index_df: DataFrame, index_col: str = "take_idx", key: str = IDX) -> DataFrame:
    """Rows at the given positions (duplicates allowed); ``take_pos`` keeps the request order.
    A position outside the batch fails the job; the check is part of the key column."""
    req = index_df.select(F.col(index_col).alias(key), F.col("take_pos"))
    found = req.join(df.withColumn("__has", F.lit(True)), key, "left")
    return found.withColumn(key, F.when(F.col("__has"), F.col(key)).otherwise(F.raise_error(F.concat(
        F.lit("take_rows: no row at position "), F.col(key).cast("string"))))).drop("__has")


def take_mask(df: DataFrame, mask_col: str) -> DataFrame:
    return df.filter(F.col(mask_col))


def slice_rows(df: DataFrame, start: int | None, stop: int | None, step: int | None = None,
               key: str = IDX, n: int | None = None) -> DataFrame:
    """Python ``[start:stop:step]`` on the row index (negative bounds resolved with the
    row count, a bounded scalar)."""
    if (start is not None and start < 0) or (stop is not None and stop < 0) or (step is not None and step < 0):
        n = row_count(df) if n is None else n
    s = slice(start, stop, step)
    if n is None:
        lo = start or 0
        st = step or 1
        cond = F.col(key) >= lo
        if stop is not None:
            cond &= F.col(key) < stop
        if st != 1:
            cond &= ((F.col(key) - lo) % st) == 0
        return df.filter(cond)
    lo, hi, st = s.indices(n)
    if st > 0:
        cond = (F.col(key) >= lo) & (F.col(key) < hi) & (((F.col(key) - lo) % st) == 0)
    else:
        cond = (F.col(key) <= lo) & (F.col(key) > hi) & (((F.lit(lo) - F.col(key)) % (-st)) == 0)
    return df.filter(cond)


def reorder_rows(df: DataFrame, perm: DataFrame, key: str = IDX) -> DataFrame:
    """Apply a permutation given as ``(new_idx, old_idx)``: row ``new_idx`` of the output
    is row ``old_idx`` of the input.  Both columns must be duplicate-free, and every row and
    every position must have its match, else the job fails (checked in the new key)."""
    n = perm.agg(F.count("*"), F.count_distinct("old_idx"), F.count_distinct("new_idx")).first()
    if len(set(n)) != 1:
        raise ValueError(f"reorder_rows: {n[0]} positions, {n[1]} different old and {n[2]} different new ones")
    p = perm.select(F.col("old_idx").alias(key), "new_idx", F.lit(True).alias("__p"))
    d = df.withColumn("__d", F.lit(True)).join(p, key, "full_outer")
    new = F.when(F.col("__d") & F.col("__p"), F.col("new_idx")).otherwise(
        F.raise_error(F.lit("reorder_rows: rows and positions don't match")))
    return d.withColumn(key, new).drop("new_idx", "__d", "__p")


def repeat_rows(df: DataFrame, repeat_times: int, interleave: bool = True, key: str = IDX,
                n: int | None = None) -> DataFrame:
    """Each row ``repeat_times`` times; new index ``i*r + k`` (interleaved: a a b b) or
    ``k*N + i`` (tiled: a b a b)."""
    r = F.explode(F.sequence(F.lit(0), F.lit(repeat_times - 1))).alias("__rep")
    d = df.select("*", r)
    if interleave:
        new = F.col(key) * repeat_times + F.col("__rep")
    else:
        n = row_count(df) if n is None else n
        new = F.col("__rep") * F.lit(n) + F.col(key)
    return d.withColumn(key, new).drop("__rep")


def chunk_rows(df: DataFrame, chunks: int, key: str = IDX, n: int | None = None) -> DataFrame:
    n = row_count(df) if n is None else n
    if n % chunks != 0:
        raise ValueError(f"{n} rows can't be cut into {chunks} chunks of one size")
    return df.withColumn("chunk_id", (F.col(key) / (n // chunks)).cast("bigint"))


def pad_to_divisor(df: DataFrame, divisor: int, key: str = IDX, n: int | None = None) -> tuple[DataFrame, int]:
    """Append copies of the first rows, cyclically, until the row count divides
    ``divisor``; padding rows carry ``is_pad``.  Returns (padded, pad_size)."""
    n = row_count(df) if n is None else n
    pad = 0 if n % divisor == 0 else divisor - n % divisor
    base = df.withColumn("is_pad", F.lit(False))
    if pad == 0:
        return base, 0
    reps = -(-pad // n)  # copies needed of the whole batch
    extra = (df.select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("__k"))
             .withColumn(key, F.col("__k") * n + F.col(key)).filter(F.col(key) < n + pad)
             .drop("__k").withColumn("is_pad", F.lit(True)))
    return base.unionByName(extra), pad


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def fold_groups(df: DataFrame, group_size: int, key: str = IDX) -> DataFrame:
    """``[bs]`` -> ``[bs/g, g]``: consecutive rows collected into one row (bounded by g)."""
    other = [c for c in df.columns if c != key]
    return (df.groupBy((F.col(key) / group_size).cast("bigint").alias("group_idx"))
            .agg(F.array_sort(F.collect_list(F.struct(key, *other))).alias("items")))


def unfold_groups(df: DataFrame, new_key: str = IDX) -> DataFrame:
    """Inverse of ``fold_groups`` following the current ``group_idx`` order."""
    return (df.select("group_idx", F.posexplode("items").alias("__pos", "__it"))
            .select("group_idx", "__pos", "__it.*"))


def rows_to_columns(df: DataFrame, group_col: str, cols: list[str], order_col: str = IDX) -> DataFrame:
    """List of records -> one record of lists per group (ordered by ``order_col``)."""
    g = df.groupBy(group_col).agg(F.array_sort(F.collect_list(F.struct(order_col, *cols))).alias("__r"))
    return g.select(group_col, *[F.transform("__r", (lambda c: lambda s: s[c])(c)).alias(c) for c in cols])


def columns_to_rows(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Record of equal-length lists -> list of records (``arrays_zip`` + ``inline``);
    unequal lengths raise."""
    keep = keep or []
    sizes = [F.size(c) for c in cols]
    check = F.assert_true(reduce(lambda a, b: a & b, [s == sizes[0] for s in sizes[1:]], F.lit(True)),
                          F.lit("columns_to_rows: lists differ in length"))
    d = df.select(*keep, F.posexplode(F.arrays_zip(*cols)).alias("pos", "__z"), check.alias("__chk"))
    return d.select(*keep, F.when(F.col("__chk").isNull(), F.col("pos")).alias("pos"), "__z.*")


def shuffle_key(seed: int, epoch: int | None, id_col: str):
    """Deterministic shuffle key ``md5(seed|epoch|id)`` (same value in every engine)."""
    parts = [F.lit(str(seed))] + ([F.lit(str(epoch))] if epoch is not None else []) + [F.col(id_col).cast("string")]
    return F.md5(F.concat_ws("|", *parts))


def permuted_index(index_col: str, n: int, seed: int, epoch: int):
    """Place of the row with this index in the order of (seed, epoch), without a sort."""
    return permuted(F.col(index_col).cast("bigint"), F.lit(max(n, 1)).cast("bigint"), [F.lit(k) for k in round_keys(seed, epoch)])


def minibatch_ids(df: DataFrame, batch_size: int, id_col: str, seed: int = 0, epoch: int = 0,
                  shuffle: bool = True, n: int | None = None, index_col: str | None = None) -> DataFrame:
    """Per-epoch seeded permutation cut into fixed-size mini-batches; the batch size
    must divide the row count.

    With ``index_col``, a row index from 0 to n - 1 that the table already has, every row computes
    its place by a keyed permutation (:func:`permuted`): no epoch sorts or moves a row."""
    n = row_count(df) if n is None else n
    if n % batch_size != 0:
        raise ValueError(f"batch size {batch_size} must divide the row count {n}")
    if index_col is not None:
        d = df.withColumn("perm_idx", permuted_index(index_col, n, seed, epoch) if shuffle else F.col(index_col).cast("bigint"))
        return d.withColumn("minibatch", F.floor(F.col("perm_idx") / batch_size))
    order = [shuffle_key(seed, epoch, id_col), F.col(id_col)] if shuffle else [F.col(id_col)]
    d = with_row_index(df.withColumn("__k", order[0]) if shuffle else df,
                       ["__k", id_col] if shuffle else [id_col], out_col="perm_idx")
    d = d.drop("__k") if shuffle else d
    return d.withColumn("minibatch", (F.col("perm_idx") / batch_size).cast("bigint"))


def epoch_batches(df: DataFrame, batch_size: int, id_col: str, seed: int = 1, shuffle: bool = True,
                  drop_last: bool = True, n: int | None = None, index_col: str | None = None, epoch: int = 0) -> DataFrame:
    """Seeded shuffle (or sequential) then consecutive batches; ``drop_last`` removes a
    final partial batch.  ``index_col`` as in :func:`minibatch_ids`: then each ``epoch`` has an
    order of its own."""
    n = row_count(df) if n is None else n
    if index_col is not None:
        d = df.withColumn("perm_idx", permuted_index(index_col, n, seed, epoch) if shuffle else F.col(index_col).cast("bigint"))
    elif shuffle:
        d = with_row_index(df.withColumn("__k", shuffle_key(seed, None, id_col)), ["__k", id_col],
                           out_col="perm_idx").drop("__k")
    else:
        d = with_row_index(df, [id_col], out_col="perm_idx")
    d = d.withColumn("batch", (F.col("perm_idx") / batch_size).cast("bigint"))
    if drop_last:
        d = d.filter(F.col("batch") < n // batch_size)
    return d


def rank_shards(df: DataFrame, world_size: int, key: str = IDX, drop_last: bool = True,
                n: int | None = None) -> DataFrame:
    """Distributed-sampler split: row i goes to rank ``i mod world``; with ``drop_last``
    the tail that does not fill every rank is removed."""
    d = df.withColumn("rank", (F.col(key) % world_size).cast("int"))
    if drop_last:
        n = row_count(df) if n is None else n
        d = d.filter(F.col(key) < (n // world_size) * world_size)
    return d


def split_batches(df: DataFrame, batch_size: int, key: str = IDX) -> DataFrame:
    return df.withColumn("split_id", (F.col(key) / batch_size).cast("bigint"))


_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1}


def batch_size_report(df: DataFrame) -> DataFrame:
    """Bytes per array column (elements x element width) and in total, one row."""
    aggs = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t.startswith("array<") and t[6:-1] in _WIDTH:
            aggs.append(F.sum(F.size(f.name).cast("bigint") * _WIDTH[t[6:-1]]).alias(f"{f.name}_bytes"))
        elif t in _WIDTH:
            aggs.append(F.sum(F.lit(_WIDTH[t])).cast("bigint").alias(f"{f.name}_bytes"))
    return df.agg(*aggs)
