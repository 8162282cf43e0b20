"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer
numpy network with temperature-calibrated probabilities.

A word type gets the sum of the sparse random index vectors of its neighbours' types (random
indexing: no counts matrix, no factorisation).  Frequent words are types of their own; the
others share the type of their shape (``Aa,``, ``A!``, ``a*``), so unseen words have vectors
too.  A document is the mean of its words' vectors, of their shapes' index vectors, and of a
few word-level rates.  Document frequencies and neighbours are counted over all documents on the
executors; the driver gets the bounded types, their summed vectors and the sample's features.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollframe.session import ship_package
from rollframe.llm.sentencepiece import in_slices
from rollframe.llm.work import written


@dataclass(frozen=True)
class ClassifierParams:
    """max_rows: the bound of the labelled sample whose features the network is fitted to.
    max_words, min_docs: word types, and at most as many shapes; max_name: bytes of a word type.
    dims, nonzero: of the vectors.  hidden, epochs, rate, decay: of the network.
    slice_bytes: text counted or pooled at a time."""

    max_rows: int = 2000
    max_words: int = 5000
    min_docs: int = 5
    max_name: int = 256
    dims: int = 64
    nonzero: int = 8
    hidden: int = 24
    epochs: int = 400
    rate: float = 0.02
    decay: float = 1e-3
    slice_bytes: int = 1 << 20


_SHAPE = [(r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{M}]+", "a"), (r"\p{N}+", "0"), (r"(\W)\W*", r"\1")]


def shapes(words: pa.Array) -> pa.Array:
    """The word with runs of capitals as A, other letters as a, digits as 0, and a run of other
    signs as its first."""
    out = pc.utf8_slice_codeunits(words, 0, 64)  # the shape, not the word, is cut
    for pattern, to in _SHAPE:
        out = pc.replace_substring_regex(out, pattern, to)
    return pc.utf8_slice_codeunits(out, 0, 8)


def index_vector(name: str, dims: int, nonzero: int) -> np.ndarray:
    rng = np.random.default_rng(int.from_bytes(hashlib.md5(name.encode("utf-8", "replace")).digest()[:8], "little"))
    out = np.zeros(dims, np.float32)
    out[rng.choice(dims, nonzero, replace=False)] = rng.choice((-1.0, 1.0), nonzero)
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(document of each word, distinct words, index of each word among them)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(parts)).astype(np.int64))
    coded = parts.flatten().dictionary_encode()
    index = np.asarray(coded.indices).astype(np.int64)
    real = (np.asarray(pc.binary_length(coded.dictionary)) > 0)[index]
    return doc[real], coded.dictionary, index[real]


COUNTS_DDL = "kind string, name string, n bigint"


def _count_types(p: ClassifierParams):
    """Over texts: (kind, name, documents) of the words (w) and shapes (s) of each slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in in_slices(batch.column(0), p.slice_bytes):
                doc, words, index = tokens(texts)
                if not len(doc):
                    continue
                names, sid = np.unique(np.array(shapes(words).to_pylist(), object).astype(str), return_inverse=True)
                for kind, name, of in (("w", words, index), ("s", pa.array(names.tolist(), pa.string()), sid[index])):
                    n = np.bincount(np.unique(doc * len(name) + of) % len(name), minlength=len(name))
                    some = pa.array(np.flatnonzero(n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(some), pa.string()), pc.cast(name.take(some), pa.string()), pa.array(n[n > 0], pa.int64())],
                        names=["kind", "name", "n"])

    return run


def frequent_types(texts: DataFrame, p: ClassifierParams) -> list[tuple[str, str]]:
    """The word types and shapes with the most documents, of all texts."""
    counts = texts.mapInArrow(_count_types(p), COUNTS_DDL).groupBy("kind", "name").agg(F.sum("n").alias("n"))
    is_type = (F.col("n") >= p.min_docs) & (F.octet_length("name") <= p.max_name)
    counts = written(counts.where((F.col("kind") == "s") | is_type), "types")
    return [(kind, r["name"]) for kind in "ws"
            for r in counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "name").limit(p.max_words).collect()]


class WordVectors:
    """Types and their vectors; row 0 is for words of no type."""

    def __init__(self, types: list[tuple[str, str]], p: ClassifierParams):
        self.p = p
        self.types = types
        self.row = {n: i + 1 for i, n in enumerate(types)}
        # every type has an index vector of its own; row 0 has none
        look = np.array([np.zeros(p.dims), *(index_vector("".join(n), p.dims, p.nonzero) for n in types)], np.float32)
        self.at = np.zeros((len(look), p.nonzero), np.int64)
        self.at[1:] = np.nonzero(look[1:])[1].reshape(-1, p.nonzero)
        self.sign = np.take_along_axis(look, self.at, axis=1)

    def context(self, texts: pa.Array) -> np.ndarray:
        """Sums of the index vectors next to each type in the texts: whole numbers, in any order."""
        p, kinds = self.p, len(self.at)
        doc, words, index = tokens(texts)
        kind = self.rows(words)[index]
        same = index_vector("same", p.dims, p.nonzero).astype(np.int64)
        out = np.zeros((kinds, p.dims), np.int64)
        for step in (1, 2):
            ok = np.flatnonzero(doc[step:] == doc[:-step]) if len(doc) > step else np.zeros(0, int)
            again = ok[index[ok] == index[ok + step]]
            for at, other, turn, rep in ((ok + step, ok, step, again + step), (ok, ok + step, step + 8, again)):
                to = kind[at][:, None] * p.dims + ((self.at + turn) % p.dims)[kind[other]]
                out += np.bincount(to.ravel(), self.sign[kind[other]].ravel(), kinds * p.dims).astype(np.int64).reshape(kinds, -1)
                out += np.bincount(kind[rep], minlength=kinds)[:, None] * same
        return out

    def finish(self, context: np.ndarray) -> None:
        p = self.p
        context = context.astype(np.float32)
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        vectors = context / np.where(norm > 0, norm, 1)
        vectors[0] = vectors[1:].mean(axis=0) if len(self.row) else 0
        shape = shapes(pa.array([n for k, n in self.types], pa.string())).to_pylist()
        own = np.zeros_like(vectors)
        for i, ((kind, name), s) in enumerate(zip(self.types, shape)):
            own[i + 1] = index_vector("s" + (s if kind == "w" else name), p.dims, p.nonzero)
        self.vectors = np.concatenate((vectors, own), axis=1)

    def rows(self, words: pa.Array) -> np.ndarray:
        """The type of each word: its own, else its shape's, else 0."""
        own, shaped = (pa.array([n for k, n in self.types if k == kind], words.type) for kind in "ws")
        out = np.asarray(pc.fill_null(pc.index_in(words, own), -1)).astype(np.int64) + 1
        rest = np.flatnonzero(out == 0)
        at = np.asarray(pc.fill_null(pc.index_in(shapes(words.take(pa.array(rest))), shaped), -1)).astype(np.int64)
        out[rest] = np.where(at >= 0, at + len(own) + 1, 0)
        return out

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """One row per text, whole texts: mean vectors and rates; zeros for a text without words."""
        n = len(texts)
        doc, words, index = tokens(texts)
        out = np.zeros((n, 2 * self.p.dims + 4), np.float32)
        count = np.bincount(doc, minlength=n)
        if len(doc):
            row = self.rows(words)[index]
            some = np.flatnonzero(count)
            first = (np.cumsum(count) - count)[some]
            # a document's words of one type are counted before its vectors are added
            pair, times = np.unique(doc * len(self.vectors) + row, return_counts=True)
            head = np.searchsorted(pair, some * len(self.vectors))
            total = np.add.reduceat(self.vectors[pair % len(self.vectors)] * times[:, None].astype(np.float32), head, axis=0)
            out[some, :2 * self.p.dims] = total / count[some][:, None]
            again = np.zeros(len(doc), np.float32)
            again[1:] = (index[1:] == index[:-1]) & (doc[1:] == doc[:-1])
            distinct = np.bincount(np.unique(doc * len(words) + index) // len(words), minlength=n)
            chars = np.bincount(doc, np.asarray(pc.utf8_length(words))[index], n)
            out[some, -4] = np.add.reduceat(again, first) / count[some]
            out[some, -3] = distinct[some] / np.sqrt(count[some])
            out[some, -2] = chars[some] / count[some] / 8
        out[:, -1] = np.log1p(count) / 8
        return out


class Network:
    """x -> tanh layer -> logit, fitted by full-batch Adam; then one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hold: np.ndarray, p: ClassifierParams):
        self.rate = float(y.mean()) if len(y) else 0.5
        self.fitted = len(np.unique(y)) == 2
        if not self.fitted:
            return
        rng = np.random.default_rng(0)
        fit = ~hold if len(np.unique(y[~hold])) == 2 else np.ones(len(y), bool)
        self.mean, self.scale = x[fit].mean(axis=0), np.maximum(x[fit].std(axis=0), 0.02)
        z, t = self._scaled(x[fit]), y[fit].astype(float)
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], p.hidden)), np.zeros(p.hidden),
             rng.normal(0, 1 / np.sqrt(p.hidden), p.hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for i in range(1, p.epochs + 1):
            h = np.tanh(z @ w[0] + w[1])
            g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - t) / len(t)
            gh = np.outer(g, w[2]) * (1 - h * h)
            grads = [z.T @ gh + p.decay * w[0], gh.sum(axis=0), h.T @ g + p.decay * w[2], np.array([g.sum()])]
            for j, d in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * d
                v[j] = 0.999 * v[j] + 0.001 * d * d
                w[j] = w[j] - p.rate * (m[j] / (1 - 0.9 ** i)) / (np.sqrt(v[j] / (1 - 0.999 ** i)) + 1e-8)
        self.w, self.temperature = w, 1.0
        check = hold if hold.any() else fit
        logit, t = self._logit(x[check]), y[check].astype(float)
        grid = np.exp(np.linspace(0, 2.5, 51))  # never sharper than the network itself
        loss = [np.mean(np.logaddexp(0, logit / s) - t * logit / s) for s in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(float)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def word_vectors(texts: DataFrame, p: ClassifierParams) -> WordVectors:
    """Vectors of the frequent types from all ``texts``: a task adds its own up and sends one row
    per type that it met."""
    out = WordVectors(frequent_types(texts, p), p)
    shared = texts.sparkSession.sparkContext.broadcast(out)
    dims = [f"v{i}" for i in range(p.dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        total = np.zeros((len(vectors.at), p.dims), np.int64)
        for batch in batches:
            for part in in_slices(batch.column(0), p.slice_bytes):
                total += vectors.context(part)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, i]) for i in range(p.dims))], names=["kind", *dims])

    sums = (texts.mapInArrow(run, "kind bigint, " + ", ".join(f"{c} bigint" for c in dims))
            .groupBy("kind").agg(*[F.sum(c).alias(c) for c in dims]).toArrow())
    shared.destroy()
    context = np.zeros((len(out.at), p.dims), np.int64)
    context[np.asarray(sums.column("kind"))] = np.stack([np.asarray(sums.column(c)) for c in dims], axis=1)
    out.finish(context)
    return out


def fold(id_: Column) -> Column:
    """crc32 of the id as text, mod 5 (null: of the empty text)."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
        p: ClassifierParams) -> tuple[WordVectors, Network]:
    """Vectors from all documents; the network from at most ``p.max_rows`` labelled rows outside
    the held-out fold, chosen by the md5 of their id, of any length.  Only their features reach
    the driver."""
    own = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    own = own.where(F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & (fold(F.col("__id")) != 0))
    own = own.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z")
    own = own.withColumn("__k", F.md5(F.col("__id").cast("string"))).orderBy("__k").limit(p.max_rows)
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).where("__t <> ''")
    vectors = word_vectors(text.select("__t"), p)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_slices(batch.column("t"), p.slice_bytes):
                x = shared.value.pooled(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").slice(at, len(part)), batch.column("y").slice(at, len(part)),
                     pa.array(x.astype(np.float64).tolist(), pa.list_(pa.float64()))], names=["k", "y", "x"])
                at += len(part)

    sample = text.join(F.broadcast(own), "__id").groupBy("__id").agg(
        F.min("__t").alias("t"), F.first("__y").alias("y"), F.first("__k").alias("k"))
    rows = sample.mapInArrow(features, "k string, y int, x array<double>").toArrow().sort_by("k")
    k, y = rows.column("k").to_pylist(), np.asarray(rows.column("y")).astype(np.int64)
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(len(k), 2 * p.dims + 4).astype(np.float32)
    hold = np.array([int(h[-1], 16) % 5 == 0 for h in k], bool)
    network = Network(x, y, hold, p)
    shared.destroy()
    # the driver keeps the model, not the sample
    del rows, x
    gc.collect()
    pa.default_memory_pool().release_unused()
    return vectors, network


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", params: ClassifierParams = ClassifierParams()) -> Column:
    """A column with the score of ``docs``' text: the calibrated probability of label 1."""
    p = params
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, p))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        vectors, network = shared.value
        out = [network.score(vectors.pooled(s)) for s in in_slices(texts, p.slice_bytes)]
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return score(F.col(text_col))


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       label_col: str = "quality", threshold: float = 0.3,
                       params: ClassifierParams = ClassifierParams()) -> DataFrame:
    """``docs`` plus ``held_out``, ``score`` and ``predicted`` (1 at or above ``threshold``).

    Whole texts are scored, one at a time whatever its length; null and empty texts get the
    score of a text without words.  Labels are used by id, only outside the held-out fold;
    ids with contradicting labels are not learned from.  Without labels of both classes the
    score is the rate of label 1 (0.5 without any).  Repeated rows give repeated results;
    input columns named like the new ones are replaced, others pass through.
    """
    out = docs.withColumn("score", quality_scores(docs, labels, id_col, text_col, label_col, params))
    return (out.withColumn("held_out", fold(F.col(id_col)) == 0)
            .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)))
