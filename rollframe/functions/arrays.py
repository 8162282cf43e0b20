"""Array (token-sequence) helpers as Column expressions, plus one Arrow-batched recurrence.

Element-wise work uses the JVM higher-order functions (``transform``, ``zip_with``,
``aggregate``); each is linear in the array length and needs no shuffle.  Reverse linear
recurrences (discounted returns, GAE) have no linear-time SQL form (building the output
array inside ``aggregate`` copies it at every step), so they run in an Arrow UDF on the flat
values of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def arr_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def arr_isum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint"))


def masked_sum(v, m) -> Column:
    return arr_sum(F.zip_with(_c(v), _c(m), lambda a, b: a * b))


def masked_sq_sum(v, m) -> Column:
    return arr_sum(F.zip_with(_c(v), _c(m), lambda a, b: a * a * b))


def mul_mask(v, m) -> Column:
    return F.zip_with(_c(v), _c(m), lambda a, b: a * b)


def scalar_times_mask(s, m) -> Column:
    s = _c(s)
    return F.transform(_c(m), lambda b: s * b)


# ---------------------------------------------------------------------------
# y_t = x_t + c_t * y_{t+1}, y_L = 0
# ---------------------------------------------------------------------------
def reverse_scan_ragged(x: np.ndarray, c: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The recurrence inside each [offsets[i], offsets[i+1]), on flat values.  All rows that
    are long enough take a step together; memory follows the number of values, not the longest
    row."""
    y = np.array(x, np.float64)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    last = offsets[1:][order] - 1
    longer = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
    for t in range(1, len(longer)):
        at = last[:longer[t]] - t
        y[at] += c[at] * y[at + 1]
    return y


def _reverse_scan_arrow(xs: pa.Array, cs: pa.Array) -> pa.Array:
    lists = xs.is_valid()
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(xs), 0), np.int64))
    x, c = (np.asarray(pc.fill_null(a.flatten(), 0.0)) for a in (xs, cs))
    if len(c) != len(x):
        raise ValueError("reverse_scan: the two arrays of a row differ in length")
    offsets = np.concatenate(([0], ends))
    out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(reverse_scan_ragged(x, c, offsets)))
    return pc.if_else(lists, out, pa.scalar(None, out.type)) if xs.null_count else out


reverse_scan_udf = F.arrow_udf(_reverse_scan_arrow, returnType=T.ArrayType(T.DoubleType()))


def reverse_scan(x, c) -> Column:
    """Reverse linear recurrence ``y_t = x_t + c_t * y_{t+1}`` (array<double>)."""
    return reverse_scan_udf(_c(x).cast("array<double>"), _c(c).cast("array<double>"))


def _running_sum_arrow(xs: pa.Array) -> pa.Array:
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(xs), 0), np.int64))
    offsets = np.concatenate(([0], ends))
    total = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(xs.flatten(), 0), np.int64))))
    out = total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))
    made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))
    return pc.if_else(xs.is_valid(), made, pa.scalar(None, made.type)) if xs.null_count else made


running_sum_udf = F.arrow_udf(_running_sum_arrow, returnType=T.ArrayType(T.LongType()))


def running_sum(x) -> Column:
    """Inclusive running sum of an integer array (array<bigint>)."""
    return running_sum_udf(_c(x).cast("array<bigint>"))


def suffix_sum(x, gamma: float = 1.0) -> Column:
    """Discounted reverse cumulative sum."""
    x = _c(x)
    return reverse_scan(x, F.transform(x, lambda _: F.lit(float(gamma))))


def suffix_sum_sql(x) -> Column:
    """gamma = 1 reverse cumulative sum as a pure JVM expression (quadratic in length;
    for short arrays)."""
    x = _c(x)
    return F.transform(x, lambda _, i: arr_sum(F.slice(x, i + 1, F.size(x) - i)))


def shift_left(a, fill: float = 0.0) -> Column:
    """a[t+1] at position t, ``fill`` past the end."""
    a = _c(a)
    return F.transform(a, lambda _, i: F.when(i + 1 < F.size(a), F.try_element_at(a, i + 2)).otherwise(F.lit(fill)))
