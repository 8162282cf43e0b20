"""Embedding whitening by shifted CholeskyQR over distributed Gram passes.

The distinct vectors are centred; one pass adds up their Gram matrix, whose shifted Cholesky
factor R1 exists however ill-conditioned the vectors are (Fukaya et al., "Shifted CholeskyQR for
computing the QR factorization of ill-conditioned matrices", 2020).  Each further pass sends the
rows through the triangular solves of the factors so far and factors the Gram matrix of what
comes out, until that is the identity; the product R of the factors then is the R of the
centred table's QR decomposition to double precision.  The singular value decomposition of
R gives the whitening components.

Only sums of d and d x d numbers leave the tasks (d: entries of a vector); rows stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.llm.work import written

ROUND_OFF = 2.0 ** -53
LONG = 2 ** 63 - 1


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors, their exact sums per entry, the components as columns of ``vectors`` in
    falling order of ``variances`` (positive ones only), their total variance, the composed
    factor ``r`` and the largest deviation of Q's Gram matrix from the identity that the last
    pass saw (0 for no vectors)."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    total: float
    r: np.ndarray
    orthogonality: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(0)


def fixed_point(embedding: Column, scale: float = 256.0) -> Column:
    """Entries as long floor(scale * entry); what a long cannot hold stops at its ends."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))


def usable(embedding: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return embedding.isNotNull() & F.coalesce(F.forall(embedding, fine), F.lit(False))


def _rows(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """The batch's vectors as an n x d long array, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(ends)
    if d and len(size) and size.min() == size.max() == d:
        return flat.reshape(-1, d)
    out = np.zeros((len(size), d), dtype=np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, with the whole part of the mean taken off exactly before rounding."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - part


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows * R1^-1 * R2^-1 ..., each by substitution along the columns of an upper triangle."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of ``fit(x)`` and the exact sums of their entries."""
    def partial(batches):
        n, high, low = 0, [0] * d, [0] * d
        for b in batches:
            x = _rows(b.column("x"), d)
            n += len(x)
            # 32-bit halves: no sum of a batch can overflow
            high = [a + int(v) for a, v in zip(high, (x >> 32).sum(axis=0))]
            low = [a + int(v) for a, v in zip(low, (x & 0xFFFFFFFF).sum(axis=0))]
        if n:
            from decimal import Decimal
            total = [n] + [(h << 32) + v for h, v in zip(high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))], ["i", "s"])

    found = {r["i"]: int(r["s"]) for r in fit.select("x").mapInArrow(partial, "i int, s decimal(38,0)")
             .groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def gram(fit: DataFrame, d: int, rows_of) -> np.ndarray:
    """Gram matrix of the rows that ``rows_of`` makes of a batch's vectors.  Each task sends
    the upper triangle of its sum; tasks' sums are added by a grouping, and the driver gets one
    triangle."""
    def partial(batches):
        total = None
        for b in batches:
            a = rows_of(_rows(b.column("x"), d))
            g = a.T @ a
            total = g if total is None else total + g
        if total is not None:
            i, j = np.triu_indices(total.shape[0])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    cells = fit.select("x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = 1 + max((c["j"] for c in cells), default=-1)
    g = np.zeros((k, k))
    for c in cells:
        g[c["i"], c["j"]] = g[c["j"], c["i"]] = c["v"]
    return g


def fit_whitening(fit: DataFrame, max_passes: int = 6) -> Whitening:
    """Whitening of ``fit(x array<bigint>)``: one row per vector of the fit list.

    The first factor is shifted by 11 (n d + d (d + 1)) u ||G||; later ones only where Cholesky
    fails.  Passes end when the Gram matrix is the identity to d u, or after ``max_passes``.
    Vectors that do not span all d entries (constant entries, fewer vectors than entries) have
    no orthonormal Q: the last Gram matrix's own square root is the last factor then, which
    is exact in any case, since G_A = R' G_Q R."""
    d = fit.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums = exact_sums(fit, d)
    if not n or not d:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, np.zeros((d, d)), 0.0)
    factors, total, rest = [], None, 0.0
    for turn in range(max_passes):
        done = list(factors)
        g = gram(fit, d, lambda x: solved(centred(x, n, sums), done))
        rest = float(np.abs(g - np.eye(d)).max())
        total = float(np.trace(g)) if total is None else total
        if turn and rest <= 4 * d * ROUND_OFF or total == 0.0 or turn == max_passes - 1:
            break
        shift = 11.0 * (n * d + d * (d + 1)) * ROUND_OFF * float(np.linalg.norm(g, 2))
        try:
            # a first factor without a shift would fail, or lose all small components, beyond a condition of 1e8
            r = np.linalg.cholesky(g + (shift if turn == 0 else 0.0) * np.eye(d)).T
        except np.linalg.LinAlgError:
            r = np.linalg.cholesky(g + max(shift, ROUND_OFF) * np.eye(d)).T
        factors.append(r)
    try:
        root = np.linalg.cholesky(g).T
    except np.linalg.LinAlgError:
        value, vector = np.linalg.eigh(g)
        root = (vector * np.sqrt(np.clip(value, 0.0, None))).T
    r = reduce(lambda a, b: a @ b, [root, *reversed(factors)], np.eye(d))
    _, s, v = np.linalg.svd(r)
    positive = s > (s.max(initial=0.0) * max(n, d) * ROUND_OFF)
    return Whitening(n, sums, v[positive].T, s[positive] ** 2 / n, total / n, r, rest)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """Exact sum over entries of (n x - sums)^2; null where a long cannot hold it."""
    if not x.size:
        return [0] * len(x)
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if most * most * len(sums) <= LONG:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    gaps = (n * x.astype(object) - np.array(sums, dtype=object)) ** 2
    return [v if v <= LONG else None for v in map(int, gaps.sum(axis=1))]


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4,
           scale: float = 256.0) -> DataFrame:
    """(id, whitened array<double>, deviation long, n long, explained array<double>,
    identity_error double), one row per usable row of ``embeddings``.

    Vectors are taken in fixed point (floor(scale * entry)); the fit list is every distinct
    one once, so copies change nothing but their own rows.  Rows whose vector is null or has a
    null or non-finite entry are left out.  ``whitened`` has an entry for each of the first
    ``components`` principal components that have variance: with fewer independent vectors it is
    shorter, with one distinct vector empty.  Shorter vectors count as filled with zeros.  Ids
    may be null or repeat.  An empty table gives an empty one.  ``deviation`` is null where it
    does not fit a long.  Other columns are left out, so their names cannot clash.

    ``identity_error`` is measured by a pass of its own: the largest absolute entry of
    (covariance of the whitened fit list - identity); null if there are no components."""
    base = written(embeddings.where(usable(F.col(vec_col))).select(
        F.col(id_col).alias("id"), fixed_point(F.col(vec_col), scale).alias("x")), "vectors")
    fit = written(base.select("x").distinct(), "fit-list")
    model = fit_whitening(fit)
    n, sums, d = model.n, model.sums, len(model.sums)
    kept = model.variances[:components]
    turn = model.vectors[:, :components] / np.sqrt(kept)
    k, error = len(kept), None
    if k:
        error = float(np.abs(gram(fit, d, lambda x: centred(x, n, sums) @ turn) / n - np.eye(k)).max())
    explained = (kept / model.total).tolist() if k else []

    def project(batches):
        for b in batches:
            x = _rows(b.column("x"), d)
            w = centred(x, n, sums) @ turn if len(x) else np.zeros((0, k))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.ListArray.from_arrays(ends, pa.array(w.ravel())), pa.array(_deviations(x, n, sums), pa.int64())],
                ["id", "whitened", "deviation"])

    out = base.mapInArrow(project, f"id {base.schema['id'].dataType.simpleString()}, whitened array<double>, deviation bigint")
    return out.select(F.col("id").alias(id_col), "whitened", "deviation", F.lit(n).cast("bigint").alias("n"),
                      F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def component_rows(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1."""
    cols = [id_col, "n", "deviation", "identity_error"]
    out = whitened.select(*cols, F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return out.select(id_col, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
                      F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
