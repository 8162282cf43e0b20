"""Global positions and running totals without an unpartitioned window.

Rows are range-partitioned on an explicit (ascending) key and written once, with the number of
their partition, to the shared checkpoint folder.  Each partition's total is one row of a small
table; a window inside the partition does the rest.  What was written is what is numbered, so
retried tasks or lost executors cannot shift a position, and neither the plan nor the driver
grows with the number of partitions.

Rows tied on the whole key are numbered in arbitrary order, like any sort; pass a unique
tie-breaker as the last key when positions must be reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe.sources.io import materialise


def _cols(order_by) -> list[Column]:
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def running_totals(df: DataFrame, order_by, values: dict[str, Column]) -> DataFrame:
    """For each (name, integer column) of ``values``: its sum over all rows before this one in
    ``order_by`` order.  One pass, however many sums."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"__k{i}" for i in range(len(_cols(order_by)))]
    vals = {f"__v{i}": v.cast("bigint") for i, v in enumerate(values.values())}
    keyed = df.withColumns(dict(zip(names, _cols(order_by)))).withColumns(vals)
    dealt = materialise(keyed.repartitionByRange(n, *names).withColumn("__part", F.spark_partition_id()), "ranged")
    before = (Window.unboundedPreceding, -1)
    # one row per partition
    totals = dealt.groupBy("__part").agg(*[F.sum(v).alias(f"{v}t") for v in vals])
    earlier = Window.orderBy("__part").rowsBetween(*before)
    starts = totals.select("__part", *[F.coalesce(F.sum(f"{v}t").over(earlier), F.lit(0)).alias(f"{v}s") for v in vals])
    inside = Window.partitionBy("__part").orderBy(*names).rowsBetween(*before)
    out = dealt.withColumns({f"{v}i": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in vals}).join(F.broadcast(starts), "__part")
    out = out.withColumns({name: (F.col(f"{v}s") + F.col(f"{v}i")).cast("bigint") for name, v in zip(values, vals)})
    return out.drop("__part", *names, *[f"{v}{x}" for v in vals for x in ("", "s", "i")])


def running_total(df: DataFrame, order_by, value: Column, out_col: str) -> DataFrame:
    """Sum of ``value`` (an integer column) over all rows before this one in ``order_by`` order."""
    return running_totals(df, order_by, {out_col: value})


def with_row_index(df: DataFrame, order_by, out_col: str = "row_idx") -> DataFrame:
    """0-based position of every row in ascending ``order_by`` order."""
    return running_total(df, order_by, F.lit(1), out_col)


def row_count(df: DataFrame) -> int:
    """Bounded scalar to the driver (one number)."""
    return df.count()
