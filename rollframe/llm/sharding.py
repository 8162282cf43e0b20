"""Minimax contiguous sharding over ordered atomic groups.

Rows with equal texts form one atomic group; groups are ordered by the md5 of their text.
The smallest capacity for which a greedy left-to-right fill needs at most ``n_shards`` shards
is found by binary search, and the greedy fill at that capacity gives the cuts.

No group list reaches the driver.  The search runs over byte sums of key ranges: first
``16 ** HEAD`` ranges of the md5, then only the ranges that a cut can still fall into are
split ``16 ** STEP`` ways, until every such range is one group.  What the driver holds is
bounded by those two constants and the number of shards, whatever the table's size.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollframe.llm.work import written

#: Hex digits of the first split, of each further split, and of the per-row salt.
HEAD, STEP, SALT = 3, 2, 2
NULL_KEY = "0" * 32
BEFORE = (W.unboundedPreceding, -1)


class Ranges:
    """Ordered key ranges with byte sums; a range of one group is atomic."""

    def __init__(self, cells: list[tuple[str, int, bool]]):
        self.cells = sorted(cells)
        self.ends = list(accumulate(c[1] for c in self.cells))
        self.total = self.ends[-1] if self.ends else 0

    def fill(self, capacity: int, n_shards: int, whole: bool) -> list[int] | None:
        """Byte positions of the greedy cuts, or None if ``n_shards`` shards don't suffice.
        whole: no range may be split; else only atomic ones may not."""
        cuts, at = [], 0
        for _ in range(n_shards):
            to = at + capacity
            if to >= self.total:
                return cuts
            i = bisect_right(self.ends, to)  # the first range that ends after ``to``
            start = self.ends[i - 1] if i else 0
            if whole or self.cells[i][2]:
                to = start
            if to <= at:
                return None
            cuts.append(to)
            at = to
        return None

    def smallest(self, n_shards: int, whole: bool) -> int:
        lo, hi = 0, self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.fill(mid, n_shards, whole) is None:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def large(self, parts: int) -> list[int]:
        """Indices of the ranges, not yet atomic, with more than 1/parts of all bytes: fewer
        than ``parts``."""
        return [i for i, c in enumerate(self.cells) if not c[2] and c[1] * parts > self.total and len(self.cells) >= parts]

    def open_ranges(self, low: int, high: int, n_shards: int) -> list[int]:
        """Indices of the ranges, not yet atomic, that a cut at a capacity in [low, high] can
        fall into."""
        found: set[int] = set()
        for a, b in zip(self._reach(low, n_shards, False), self._reach(high, n_shards, True)):
            i, j = bisect_right(self.ends, max(0, a - 1)), bisect_right(self.ends, b)
            found.update(k for k in range(i, min(j + 1, len(self.cells))) if not self.cells[k][2])
        return sorted(found)

    def _reach(self, capacity: int, n_shards: int, far: bool) -> list[int]:
        """Earliest or latest places that the cuts can take, range by range."""
        out, at = [], 0
        for _ in range(n_shards - 1):
            to = min(at + capacity, self.total)
            if not far:
                i = bisect_right(self.ends, to)
                to = self.ends[i - 1] if i else 0
            out.append(to)
            at = to
        return out


def capacity_and_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[str]]:
    """Smallest feasible capacity and the first group key of each further shard, for
    ``groups(key, bytes)`` with one row per group."""

    def sums(df: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
        cell = F.substring("key", 1, digits)
        rows = df.groupBy(cell.alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("key")).collect()
        return [(r["key"] if r["n"] == 1 else r["cell"], r["bytes"], r["n"] == 1) for r in rows]

    ranges, digits = Ranges(sums(groups, HEAD)), HEAD
    while True:
        low, high = ranges.smallest(n_shards, False), ranges.smallest(n_shards, True)
        # a large range (a hot text among others) first, so that the rest stay narrow
        todo = ranges.large(16 * n_shards) or ranges.open_ranges(low, high, n_shards)
        if not todo:
            break
        split = [ranges.cells[i][0] for i in todo]
        depth = min(len(c) for c in split)
        split = [c for c in split if len(c) == depth]
        digits = min(32, depth + STEP)
        inside = sums(groups.where(F.substring("key", 1, depth).isin(split)), digits)
        ranges = Ranges([c for c in ranges.cells if c[2] or c[0] not in set(split)] + inside)
    cuts = ranges.fill(high, n_shards, True) or []
    return high, [ranges.cells[bisect_right(ranges.ends, c)][0] for c in cuts]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.md5(text), F.lit(NULL_KEY)).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("crc"))


def shard_of(key: Column, cuts: list[str]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(key >= F.lit(c), 1).otherwise(0)
    return out


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every input row; law ``bytes``.

    Size is the UTF-8 bytes of the text plus 1 (null text: 1, checksum 0; all null texts are
    one group, apart from empty ones).  Equal texts share a shard.  Shards are numbered in
    key order; a shard may stay empty when there are fewer groups.  ``slot`` numbers a
    shard's rows from 0 without gaps by (first key digits, salt of the id, key, id); equal
    rows get different slots.  Numbering is a window per (shard, key range, salt), so one
    text with a third of all rows is spread over ``16 ** SALT`` windows.  An empty table
    gives an empty result.  Extra input columns are not read.
    """
    rows = written(digests(docs, id_col, text_col).withColumn(
        "salt", F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, SALT)), "shards")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    _, cuts = capacity_and_cuts(groups, n_shards)
    rows = rows.withColumn("shard", shard_of(F.col("key"), cuts)).withColumn("range", F.substring("key", 1, HEAD))
    cell = ["shard", "range", "salt"]
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    # at most 16 ** HEAD + n_shards range totals; the salts are summed inside their own range
    of_range = (sizes.groupBy("shard", "range").agg(F.sum("n").alias("n"))
                .select("shard", "range", F.coalesce(
                    F.sum("n").over(W.partitionBy("shard").orderBy("range").rowsBetween(*BEFORE)), F.lit(0)).alias("a")))
    of_salt = sizes.select(*cell, F.coalesce(
        F.sum("n").over(W.partitionBy("shard", "range").orderBy("salt").rowsBetween(*BEFORE)), F.lit(0)).alias("b"))
    start = of_salt.join(of_range, ["shard", "range"]).select(*cell, (F.col("a") + F.col("b")).alias("start"))
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy(*cell).orderBy("key", "id")) - 1)
    return rows.join(start, cell).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("rn")).cast("long").alias("slot"))
