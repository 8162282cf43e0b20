"""Length balancing: assign rows to k parts with near-equal token sums.

At scale the assignment is a *snake draft* over the global length rank (pure column math
on top of :func:`with_row_index`): rank r goes to part ``r mod k`` on even rounds and
``k-1 - r mod k`` on odd rounds, so every part gets the same number of rows (+-1), and
the sums of any two parts differ by the longest row's length at most.  When sums must be tight inside one training batch, ``balance_in_batches``
runs a greedy largest-first assignment per batch with ``applyInPandas`` (one batch = one
bounded group; batches run in parallel).

Tighter still is the largest differencing method (Karmarkar and Karp, 1982): partitions of few
rows are merged, the two with the widest spread first, the fullest part of one with the emptiest
of the other.  A merge never widens a spread, so the sums of any two parts differ by the longest
row at most, and by far less in practice.  Merging needs only the k sums of a partition, so a
whole table is solved in two levels: blocks of rows in parallel, then the blocks' sums.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rollframe.operators.indexing import row_count, with_row_index
from rollframe.sources.io import materialise


def balance_partitions(df: DataFrame, k: int, len_col: str, id_col: str, equal_size: bool = True,
                       out_col: str = "part") -> DataFrame:
    if equal_size:
        n = row_count(df)
        if n % k != 0:
            raise ValueError(f"equal-size balancing needs k | N, got N={n}, k={k}")
    d = with_row_index(df, [-F.col(len_col), F.col(id_col)], out_col="__r")
    r, kk = F.col("__r"), F.lit(k)
    rnd = (r / kk).cast("bigint")
    pos = r % kk
    part = F.when(rnd % 2 == 0, pos).otherwise(kk - 1 - pos).cast("int")
    return d.withColumn(out_col, part).drop("__r")


def contiguous_partitions(df: DataFrame, k: int, id_col: str, out_col: str = "part") -> DataFrame:
    """The rows in id order, cut into k runs of ceil(N / k) rows: what balancing is measured
    against."""
    size = -(-row_count(df) // k)
    d = with_row_index(df, id_col, out_col="__r")
    return d.withColumn(out_col, F.least((F.col("__r") / max(size, 1)).cast("int"), F.lit(k - 1))).drop("__r")


def greedy_parts(lengths: list[int], k: int, cap: int, full: int | None = None) -> list[int]:
    """Part of each row of falling length: the one with the smallest sum that has fewer than ``cap``;
    only ``full`` parts (any, if not given) get a last one."""
    heap = [(0, p) for p in range(k)]
    counts, parts = [0] * k, []
    for length in lengths:
        s, p = heapq.heappop(heap)  # full parts have left the heap
        if full is not None:
            while counts[p] == cap - 1 and not full:
                s, p = heapq.heappop(heap)
            full -= counts[p] == cap - 1
        parts.append(p)
        counts[p] += 1
        if counts[p] < cap:
            heapq.heappush(heap, (s + length, p))
    return parts


def balance_in_batches(df: DataFrame, k: int, len_col: str, id_col: str, batch_col: str,
                       out_col: str = "part", max_rows: int = 100_000) -> DataFrame:
    """Greedy largest-first per batch: each row (longest first) joins the part with the
    smallest token sum among parts that still have room (equal sizes when k | n).  A batch is
    one training step's rows; one of more than ``max_rows`` fails before it is grouped."""
    schema = StructType(df.schema.fields + [StructField(out_col, IntegerType())])

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([len_col, id_col], ascending=[False, True], kind="mergesort")
        return pdf.assign(**{out_col: greedy_parts([int(n) for n in pdf[len_col].tolist()], k, -(-len(pdf) // k))})

    size = df.groupBy(batch_col).agg(F.count("*").alias("__n"))
    most = size.agg(F.max("__n")).first()[0] or 0
    if most > max_rows:
        raise ValueError(f"a batch has {most} rows; more than {max_rows} are no training batch")
    return df.groupBy(batch_col).applyInPandas(per_batch, schema)


def balance_report(df: DataFrame, part_col: str, len_col: str, keys: list[str] | None = None) -> DataFrame:
    """min / max / spread / mean of per-part token sums."""
    keys = keys or []
    s = df.groupBy(*keys, part_col).agg(F.sum(len_col).alias("__s"))
    return s.groupBy(*keys).agg(F.min("__s").alias("min_sum"), F.max("__s").alias("max_sum"),
                                (F.max("__s") - F.min("__s")).alias("spread"), F.avg("__s").alias("mean_sum"))


class _Bags:
    """Sets of rows that are only ever joined in pairs: a join is one entry, not a copy."""

    def __init__(self, n: int):
        self.n, self.pairs = n, []

    def join(self, a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        self.pairs.append((a, b))
        return self.n + len(self.pairs) - 1

    def rows(self, bag: int | None) -> list[int]:
        out, todo = [], [] if bag is None else [bag]
        while todo:
            x = todo.pop()
            if x < self.n:
                out.append(x)
            else:
                todo.extend(self.pairs[x - self.n])
        return out


def differenced(states: list[list[tuple[int, int | None]]], bags: _Bags) -> list[tuple[int, int | None]]:
    """Merges partitions of k (sum, bag) each until one is left; equal spreads by the larger sum,
    then by age."""
    def entry(age: int, parts: list) -> tuple:
        parts = sorted(parts, key=lambda p: -p[0])
        return parts[-1][0] - parts[0][0], -parts[0][0], age, parts

    heap = [entry(i, parts) for i, parts in enumerate(states)]
    heapq.heapify(heap)
    age = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[3], heapq.heappop(heap)[3]
        heapq.heappush(heap, entry(age, [(x + y, bags.join(p, q)) for (x, p), (y, q) in zip(a, reversed(b))]))
        age += 1
    return heap[0][3]


def differencing_parts(lengths: list[int], k: int, equal_size: bool) -> list[int]:
    """Part of each row.  ``equal_size``: k rows of neighbouring lengths start as one partition, so
    all parts get as many; if k does not divide the rows, the shortest group is smaller."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    step = k if equal_size else 1
    bags = _Bags(len(lengths))
    states = []
    for at in range(0, len(order), step):
        group = [(lengths[i], i) for i in order[at:at + step]]
        states.append(group + [(0, None)] * (k - len(group)))
    out = [0] * len(lengths)
    if states:
        for part, (_, bag) in enumerate(differenced(states, bags)):
            for i in bags.rows(bag):
                out[i] = part
    return out


def tight_parts(lengths: list[int], k: int, equal_size: bool) -> list[int]:
    """The narrower of the differencing and the greedy partition.  With equal sizes the first
    fixes which rows are apart before it sees their sums, so it is not always the narrower."""
    def spread(parts: list[int]) -> int:
        sums = [0] * k
        for n, p in zip(lengths, parts):
            sums[p] += n
        return max(sums) - min(sums)

    first = differencing_parts(lengths, k, equal_size)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    second = [0] * len(lengths)
    cap = -(-len(lengths) // k) if equal_size else len(lengths)
    full = len(lengths) - k * (cap - 1) if equal_size else None
    for i, p in zip(order, greedy_parts([lengths[i] for i in order], k, cap, full)):
        second[i] = p
    return first if spread(first) <= spread(second) else second


def differencing_partitions(df: DataFrame, k: int, len_col: str, id_col: str, equal_size: bool = True,
                            out_col: str = "part", block_rows: int = 4096, divisible: bool = True) -> DataFrame:
    """``df`` with the part of each row by the largest differencing method in two levels.

    Blocks of ``block_rows`` neighbouring ranks by length are solved in parallel (or by the greedy
    rule, where that comes out narrower); then the
    blocks, as k sums each, are merged in one small task (one row per block).  Sums of two
    parts differ by the longest row at most.  ``equal_size`` needs k to divide the rows; if they
    need not be ``divisible``, the sizes of two parts differ by one at most.  Null
    lengths count as 0; ties go by ``id_col``."""
    if equal_size and divisible and row_count(df) % k:
        raise ValueError(f"equal-size balancing needs the rows to be a multiple of k={k}")
    length = F.coalesce(F.col(len_col), F.lit(0)).cast("bigint")
    d = with_row_index(df, [-length, F.col(id_col)], out_col="__r")
    size = max(1, block_rows // k) * k
    d = materialise(d.withColumn("__block", F.floor(F.col("__r") / size)).withColumn("__len", length), "blocks")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__r")
        return pd.DataFrame({"__r": pdf["__r"], "__block": pdf["__block"], "__len": pdf["__len"],
                             "__bag": tight_parts(pdf["__len"].tolist(), k, equal_size)})

    bags = materialise(d.select("__r", "__block", "__len").groupBy("__block").applyInPandas(
        solve, "__r bigint, __block bigint, __len bigint, __bag int"), "bags")
    sums = bags.groupBy("__block", "__bag").agg(F.sum("__len").alias("s"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__block", "__bag"])
        rows = list(zip(pdf["__block"].tolist(), pdf["__bag"].tolist()))
        of = {b: [(0, None)] * k for b in pdf["__block"].unique().tolist()}
        for i, ((block, bag), total) in enumerate(zip(rows, pdf["s"].tolist())):
            of[block][bag] = (total, i)
        tree = _Bags(len(rows))
        parts = [(i, part) for part, (_, bag) in enumerate(differenced(list(of.values()), tree)) for i in tree.rows(bag)]
        return pd.DataFrame([(*rows[i], part) for i, part in parts], columns=["__block", "__bag", out_col])

    # one row per block and part: what a driver would hold, in a task
    placed = sums.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(merge, f"__block bigint, __bag int, {out_col} int")
    parts = bags.select("__r", "__block", "__bag").join(placed, ["__block", "__bag"]).select("__r", out_col)
    return d.drop("__block", "__len", *([out_col] if out_col in df.columns else [])).join(parts, "__r").drop("__r")


def token_budget_batches(df: DataFrame, max_tokens: int, len_col: str, id_col: str, batch_col: str,
                         rank_col: str | None = None, out_col: str = "micro_batch", max_rows: int = 100_000) -> DataFrame:
    """``df`` with the micro-batch of each row and ``n_micro_batches``.

    A rank of a batch needs ceil(its tokens / ``max_tokens``) micro-batches; all ranks of the batch
    use the largest such number (1 at least, so lengths that are all 0 make one), since ranks
    step together.  Each rank then cuts its own rows into that many by the differencing method,
    not of equal size.  Without ``rank_col`` a batch has one rank.  Null lengths count as 0.

    Raises if a row is longer than ``max_tokens``, if a rank has fewer rows than the micro-batches
    its batch needs, or if a rank has more than ``max_rows`` rows (no training batch)."""
    d = df.withColumn("__len", F.coalesce(F.col(len_col), F.lit(0)).cast("bigint"))
    d = d.withColumn("__rank", F.col(rank_col) if rank_col else F.lit(0))
    per_rank = d.groupBy(batch_col, "__rank").agg(F.sum("__len").alias("tokens"), F.count("*").alias("rows"), F.max("__len").alias("longest"))
    need = per_rank.groupBy(F.col(batch_col).alias("__b")).agg(
        F.greatest(F.max(F.ceil(F.col("tokens") / F.lit(max_tokens))), F.lit(1)).cast("int").alias("n_micro_batches"),
        F.min("rows").alias("fewest"), F.max("rows").alias("most"), F.max("longest").alias("longest"))
    need = materialise(need, "micro-batches")
    worst = need.agg(F.max("longest").alias("longest"), F.max("most").alias("most"),
                     F.max(F.col("n_micro_batches") - F.col("fewest")).alias("short")).first()
    if (worst["longest"] or 0) > max_tokens:
        raise ValueError(f"a row of {worst['longest']} tokens is longer than max_tokens={max_tokens}")
    if (worst["most"] or 0) > max_rows:
        raise ValueError(f"a rank has {worst['most']} rows; more than {max_rows} are no training batch")
    if (worst["short"] or 0) > 0:
        raise ValueError("a rank has fewer rows than the micro-batches its batch needs")
    d = d.join(need.select("__b", "n_micro_batches"), F.col(batch_col).eqNullSafe(F.col("__b"))).drop("__b")
    schema = StructType([*d.schema.fields, StructField(out_col, IntegerType())])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_col], kind="mergesort")
        return pdf.assign(**{out_col: tight_parts(pdf["__len"].tolist(), int(pdf["n_micro_batches"].iloc[0]), False)})

    return d.groupBy(batch_col, "__rank").applyInPandas(cut, schema).drop("__len", "__rank")


def restore_order(df: DataFrame, original_idx_col: str) -> DataFrame:
    """Inverse of a balancing permutation: sort back by the original position."""
    return df.orderBy(original_idx_col)
