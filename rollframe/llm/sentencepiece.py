"""Piece encoding and decoding with a batched numpy Viterbi.

A text is cut at spaces; each part with its leading space mark is one unit, solved once per
distinct spelling.  Units are cut further wherever no piece spans two neighbouring characters,
and segments of equal length advance together: hashes of all substrings up to the longest
piece probe the sorted piece keys, and one vectorised maximum per end position stores the
backpointers.  The model file is read by the driver and broadcast (well under a megabyte).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollframe.session import ship_package

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581  # the model's space mark
LITERAL_MARK = 0x110000  # stands for a space mark that is in the text itself: no piece has it
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
RUNS = re.compile(" +[^ ]*")
TOP_SHIFT = np.uint64(64 - 18)
#: Characters solved at a time, bytes of text tokenised at a time, spellings remembered.
CHUNK_CHARS, SLICE_BYTES, MAX_UNITS = 1 << 16, 8 << 20, 300_000


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    h = h ^ (np.uint64(0xD6E8FEB86659FD93) * np.asarray(length, np.uint64))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


class PieceModel:
    """Pieces, scores and the sorted keys that substring hashes probe.

    No piece may have a space mark after another character; else cutting before spaces would
    not be exact.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        normal = [(i, p.piece, p.score) for i, p in enumerate(m.pieces) if p.type in (1, 4)]
        self.n_bytes = 256
        self.byte_id = np.zeros(256, np.int32)
        self.out = [b""] * len(m.pieces)
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.out[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (1, 4):
                self.out[i] = p.piece.replace("▁", " ").encode()
        if any("▁" in p.lstrip("▁") for _, p, _ in normal):
            raise ValueError("a piece spans two words: this model can't be cut at spaces")
        self.unk = min(s for _, _, s in normal) - 10.0
        self.longest = max(len(p) for _, p, _ in normal)
        flat = np.concatenate([_points(p) for _, p, _ in normal]).astype(np.uint64)
        ends = np.cumsum([len(p) for _, p, _ in normal])
        lens = np.array([len(p) for _, p, _ in normal])
        keys = _mix(self._hash(self._prefix(flat), ends - lens, ends), lens)
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.ids = np.array([i for i, _, _ in normal], np.int32)[order]
        self.scores = np.array([s for _, _, s in normal], np.float64)[order]
        # where the keys with the same top bits start; a probe looks at a few neighbours
        top = (self.keys >> TOP_SHIFT).astype(np.int64)
        self.bucket = np.full(1 << (64 - int(TOP_SHIFT)), len(top), np.int32)
        self.bucket[top[::-1]] = np.arange(len(top))[::-1]
        self.deepest = int(np.bincount(top).max())
        self.keys = np.append(self.keys, np.full(self.deepest + 1, self.keys[-1] + np.uint64(1)))
        # may any piece have these two neighbours?  A wrong yes only leaves a segment longer.
        pairs = np.array(sorted({(ord(a) << 21) | ord(b) for _, p, _ in normal for a, b in zip(p, p[1:])}), np.uint64)
        self.joined = np.zeros(1 << (64 - int(TOP_SHIFT)), bool)
        self.joined[((pairs * BASE) >> TOP_SHIFT).astype(np.int64)] = True
        self.out_len = np.array([len(b) for b in self.out], np.int64)
        self.out_at = np.concatenate(([0], np.cumsum(self.out_len)))
        self.out_blob = np.frombuffer(b"".join(self.out), np.uint8)

    @staticmethod
    def _prefix(points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * _powers(BASE, len(points)), out=out[1:])
        return out

    @staticmethod
    def _hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * _powers(BASE_INV, len(prefix))[start]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all units in a row, number of tokens of each).  A unit is given without
        its first space."""
        done, lens = [], []
        at = 0
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + 1)
        while at < len(units):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_CHARS, "right")))
            ids, n = self._solve(units[at:to])
            done.append(ids)
            lens.append(n)
            at = to
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(done), np.concatenate(lens)

    def _solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        k = self.longest
        points = _points("\0" + "\0".join(units)).astype(np.int64)
        unit_len = np.fromiter(map(len, units), np.int64, len(units)) + 1
        unit_end = np.cumsum(unit_len)
        first = unit_end - unit_len
        points[points == SPACE] = LITERAL_MARK
        points[points == 32] = SPACE
        points[first] = SPACE
        n = len(points)
        # segments: no piece spans their borders
        pair = ((points[:-1] << 21) | points[1:]).astype(np.uint64)
        cut = np.ones(n, bool)
        cut[1:] = ~self.joined[((pair * BASE) >> TOP_SHIFT).astype(np.int64)]
        cut[first] = True
        start = np.flatnonzero(cut)
        seg_len = np.diff(np.append(start, n))
        inside = np.arange(n) - np.repeat(start, seg_len)  # place in the segment
        # column c: the piece of k - c characters that ends here
        prefix, back_power = self._prefix(points.astype(np.uint64)), _powers(BASE_INV, n + 1)
        score = np.full((n, k), -np.inf)
        piece = np.full((n, k), -1, np.int32)
        end = np.arange(n)
        for length in range(1, min(k, int(seg_len.max())) + 1):
            end = end[inside[end] >= length - 1]
            at = end + 1 - length
            key = _mix((prefix[end + 1] - prefix[at]) * back_power[at], length)
            hit = self.bucket[(key >> TOP_SHIFT).astype(np.int64)]
            some = np.flatnonzero(hit < len(self.ids))
            key, hit, to = key[some], hit[some], end[some]
            for _ in range(self.deepest):
                ok = np.flatnonzero(self.keys[hit] == key)
                score[to[ok], k - length] = self.scores[hit[ok]]
                piece[to[ok], k - length] = self.ids[hit[ok]]
                hit = hit + 1
        score[piece[:, k - 1] < 0, k - 1] = self.unk
        back = np.zeros(n, np.int64)
        for length in np.unique(seg_len):
            rows = start[seg_len == length]
            best = np.zeros((len(rows), length + 1))
            each = np.arange(len(rows))
            for e in range(length):
                w = min(k, e + 1)
                cand = score[rows + e, k - w:] + best[:, e + 1 - w:e + 1]
                c = cand.argmax(axis=1)  # of equal sums the one with the longest last piece
                best[:, e + 1] = cand[each, c]
                back[rows + e] = w - c
        is_end, token = np.zeros(n, bool), np.zeros(n, np.int32)
        at, low = start + seg_len - 1, start
        while len(at):
            is_end[at] = True
            token[at] = piece[at, k - back[at]]
            at = at - back[at]
            ok = at >= low
            at, low = at[ok], low[ok]
        # a character without a piece becomes its UTF-8 bytes
        width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        width[points == LITERAL_MARK] = 3
        count = np.where(is_end, np.where(token < 0, width, 1), 0)
        ids = np.repeat(token, count)
        total = np.concatenate(([0], np.cumsum(count)))
        for p in np.flatnonzero(is_end & (token < 0)):
            cp = SPACE if points[p] == LITERAL_MARK else int(points[p])
            raw = chr(cp).encode("utf-8", "replace")
            ids[total[p]:total[p] + len(raw)] = self.byte_id[list(raw)]
        return ids, total[unit_end] - total[first]

    def decode_ids(self, ids: np.ndarray) -> str:
        """The text of token ids; the space before the first word goes."""
        return gather(self.out_blob, self.out_at[ids], self.out_len[ids]).tobytes()[1:].decode("utf-8", "replace")


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start[0]:start[0]+count[0]] and so on, in a row."""
    shift = np.cumsum(count)
    total = int(shift[-1]) if len(shift) else 0
    return flat[np.repeat(start - (shift - count), count) + np.arange(total)]


class Encoder:
    """Encodes arrays of texts, remembering a bounded number of spellings."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        """Start over, but remember what was known for one more round."""
        self.old = getattr(self, "now", None)
        self.now = ({}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _learn(self, units: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        known, flat, start, counts = self.now
        base = len(known)
        known.update(zip(units, range(base, base + len(units))))
        self.now = (known, np.concatenate((flat, ids)), np.concatenate((start, len(flat) + np.cumsum(count) - count)),
                    np.concatenate((counts, count)))

    def _spelled(self, units: list[str]) -> np.ndarray:
        """Places of the units among the known ones; those that aren't are solved."""
        known = self.now[0]
        at = list(map(known.get, units))
        if None in at:
            new = [u for u, i in zip(units, at) if i is None]
            if self.old is not None:
                had = [u for u in new if u in self.old[0]]
                if had:
                    was = np.array([self.old[0][u] for u in had])
                    self._learn(had, gather(self.old[1], self.old[2][was], self.old[3][was]), self.old[3][was])
                    new = [u for u in new if u not in known]
            if new:
                self._learn(new, *self.model.encode_units(new))
            at = list(map(known.get, units))
        return np.array(at, np.int64)

    def encode(self, texts: pa.Array) -> pa.Array:
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        some = texts.filter(pa.array(size > 0))
        if pc.any(pc.match_substring_regex(some, "^ |  | $")).as_py():
            # a run of spaces stays with the word after it
            units = [[u[1:] for u in RUNS.findall(" " + t)] for t in some.to_pylist()]
            parts = pa.array(units, pa.list_(pa.string()))
        else:
            parts = pc.split_pattern(some, " ")
        words = parts.flatten()
        n_words = np.zeros(len(texts), np.int64)
        n_words[size > 0] = np.asarray(pc.list_value_length(parts))
        coded = words.dictionary_encode()
        if len(self.now[0]) > MAX_UNITS:
            self.forget()
        unit = self._spelled(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        _, flat, start, counts = self.now
        count = counts[unit]
        ids = gather(flat, start[unit], count)
        total = np.concatenate(([0], np.cumsum(count)))
        ends = np.concatenate(([0], total[np.cumsum(n_words)]))
        out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        return pc.if_else(texts.is_valid(), out, pa.scalar(None, out.type)) if texts.null_count else out


def in_slices(texts: pa.Array, size: int = SLICE_BYTES):
    """Consecutive slices of about ``size`` bytes at most (a longer text alone)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, to - at)
        at = to


def model_bytes(path: str = MODEL_PATH, max_bytes: int = 32 << 20) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(max_bytes + 1)
    if len(raw) > max_bytes:
        raise ValueError("the piece model is too large to broadcast")
    return raw


def codecs(spark: SparkSession, path: str = MODEL_PATH) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """(encode, decode) column functions for the model at ``path`` on the driver."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model_bytes(path))
    kept: dict[str, Encoder] = {}

    def encoder() -> Encoder:
        if "e" not in kept:
            kept["e"] = Encoder(PieceModel(shared.value))
        return kept["e"]

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        done = [encoder().encode(x) for x in in_slices(texts)]
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        model, out = encoder().model, []
        for x in ids:
            out.append(model.decode_ids(np.asarray(x.values)) if x.is_valid else None)
        return pa.array(out, pa.string())

    return encode, decode


def piece_encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str = MODEL_PATH) -> DataFrame:
    """``docs`` plus token ids: the segmentation with the highest sum of piece scores, of equal
    sums the one whose last pieces are longest.

    The model's space rules hold: one space is put before the text, other spaces become the
    space mark.  A character without a piece becomes its UTF-8 byte tokens, as does a space
    mark that is in the text, so decoding gives back the text.  Null text: null ids; empty
    text: no ids; repeated rows give repeated results; an input column named like ``ids_col``
    is replaced, all others pass through.
    """
    encode, _ = codecs(docs.sparkSession, path)
    return docs.withColumn(ids_col, encode(F.col(text_col)))


def piece_decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str = MODEL_PATH) -> DataFrame:
    """``rows`` plus the text of their token ids (control tokens have no text; null stays null;
    bytes that are no UTF-8 become U+FFFD)."""
    _, decode = codecs(rows.sparkSession, path)
    return rows.withColumn(text_col, decode(F.col(ids_col)))
