"""Exact removal of long byte strings that occur earlier, by sorted windows in levels.

A 100-byte window always contains the same minimal k-gram, its anchor, wherever it occurs.
So documents are read once and cut into runs of windows with one anchor; runs meet their
equals by the anchor's hash.  Runs that are whole copies are settled by a 64-bit fingerprint
next to the anchor's, most of them before any shuffle.  The runs that share an anchor but not
all of their bytes (the edges of copied passages) are fetched from the texts and settled byte
for byte: within a key range, batches in text order are sorted arrays of 100-byte windows, each
is probed against the levels that are there, and levels of equal size merge geometrically.  These
stand in for suffix arrays; runs settled by fingerprint are not compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe.session import ship_package
from rollframe.llm.work import written

#: Bytes of text hashed at a time; the low bits of an anchor's sort key hold its place there.
PIECE, PLACE_BITS = 1 << 20, 21
BASE = 0x9E3779B97F4A7C15 | 1
#: A position in a text: offset, windows of the run, anchor's place in it.
AT_SHIFT, N_SHIFT = 14, 7
NULL_ID = -(1 << 63)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    n = 1 << PLACE_BITS
    power, inverse = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return (rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1),
            np.multiply.accumulate(power), np.multiply.accumulate(inverse))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _prefix(raw: np.ndarray) -> np.ndarray:
    value, power, _ = _tables()
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value[raw] * power[:len(raw)], out=out[1:])
    return out


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    m, size = key, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:len(key) - width + 1], m[width - size:]) if size < width else m


def anchored_runs(raw: np.ndarray, length: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in pieces of the given lengths that lie in a row:
    (piece, offset in it, windows, anchor's place in the run, anchor hash, run hash)."""
    end = np.cumsum(length)
    empty = np.zeros(0, np.int64)
    if len(raw) < window:
        return empty, empty, empty, empty, empty, empty
    s, inverse = _prefix(raw), _tables()[2]
    n = len(raw) - k + 1
    gram = _mix((s[k:] - s[:-k]) * inverse[:n])
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = _sliding_min((gram & ~low) | np.arange(n, dtype=np.uint64), window - k + 1)
    piece = np.repeat(np.arange(len(length)), np.maximum(length - window + 1, 0))
    first = np.cumsum(np.maximum(length - window + 1, 0)) - np.maximum(length - window + 1, 0)
    offset = np.arange(len(piece)) - first[piece]
    start = offset + (end - length)[piece]
    anchor = (best[start] & low).astype(np.int64)
    head = np.ones(len(start), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    head = np.flatnonzero(head)
    count = np.diff(np.append(head, len(start)))
    lo, at = start[head], anchor[head]
    shape = (count * 128 + (at - lo)).astype(np.uint64)
    run = _mix((s[lo + count + window - 1] - s[lo]) * inverse[lo] + _mix(shape))
    return piece[head], offset[head], count, at - lo, gram[at].view(np.int64), run.view(np.int64)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of touching [start, end) within each document, in order."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    # ends grow within a document once documents are set apart
    base = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1]))) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + base[1:] > reach[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], start[head], (reach - base)[last]


def _pieces(texts: pa.Array, window: int, longest: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row, offset, length) of pieces in slices of about ``longest`` bytes; neighbouring
    pieces of a text overlap by a window less one byte."""
    texts = pc.cast(texts, pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    if texts.null_count:
        size = np.where(np.asarray(texts.is_valid()), size, 0)
    rows = np.flatnonzero(size >= window)
    parts = np.maximum(1, -(-(size[rows] - window + 1) // longest))
    row = np.repeat(rows, parts)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * longest
    length = np.minimum(size[row] - at, longest + window - 1)
    ends, i = np.cumsum(length), 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + longest, "right")))
        raw = np.concatenate([data[o:o + n] for o, n in zip(offsets[row[i:j]] + at[i:j], length[i:j])])
        yield raw, row[i:j], at[i:j], length[i:j]
        i = j


def _greater(ids: np.ndarray, sub: np.ndarray, pos: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Is the position after that of row ``first``?  The run's shape is not part of it."""
    a, b = pos >> AT_SHIFT, pos[first] >> AT_SHIFT
    late = (sub > sub[first]) | ((sub == sub[first]) & (a > b))
    return (ids > ids[first]) | ((ids == ids[first]) & late)


#: id and sub name a text: sub is its hash if some id has several texts, else 0.
FOUND = pa.schema([("kind", pa.int8()), ("k", pa.int64()), ("h", pa.int64()), ("id", pa.int64()), ("sub", pa.int64()), ("pos", pa.int64())])
FOUND_DDL = "kind tinyint, k bigint, h bigint, id bigint, sub bigint, pos bigint"


CONTEXT = pa.schema([("k", pa.int64()), ("id", pa.int64()), ("sub", pa.int64()), ("pos", pa.int64()), ("body", pa.binary())])
CONTEXT_DDL = "k bigint, id bigint, sub bigint, pos bigint, body binary"


def _rows(kind: int, k, h, ids, sub, pos) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int8)), *(pa.array(x) for x in (k, h, ids, sub, pos))], schema=FOUND)


def _spans(ids: np.ndarray, sub: np.ndarray, pos: np.ndarray, window: int) -> pa.RecordBatch:
    """Span rows (kind 1), merged: k spreads them, pos has the start, h the end."""
    start = pos >> AT_SHIFT
    end = start + ((pos >> N_SHIFT) & 127) + window - 1
    order = np.lexsort((start, sub, ids))
    ids, sub, start, end = ids[order], sub[order], start[order], end[order]
    doc = np.cumsum(np.concatenate(([False], (ids[1:] != ids[:-1]) | (sub[1:] != sub[:-1])))) if len(ids) else ids
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(ids) else ids
    doc, start, end = merged(doc, start, end)
    ids, sub = ids[first][doc], sub[first][doc]
    k = _mix((ids ^ sub ^ (start << 20)).view(np.uint64)).view(np.int64)
    return _rows(1, k, end, ids, sub, start << AT_SHIFT)


def _read_runs(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple[np.ndarray, ...]] = []
            ids, sub = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for raw, row, at, length in _pieces(batch.column(2), window):
                piece, offset, count, place, gram, whole = anchored_runs(raw, length, window, k)
                r = row[piece]
                got.append((gram, whole, ids[r], sub[r], ((at[piece] + offset) << AT_SHIFT) | (count << N_SHIFT) | place))
            if not got:
                continue
            gram, whole, ids, sub, pos = (np.concatenate(x) for x in zip(*got))
            # of equal runs the first goes on; later ones are copies already
            order = np.lexsort((pos, sub, ids, whole, gram))
            gram, whole, ids, sub, pos = gram[order], whole[order], ids[order], sub[order], pos[order]
            head = np.ones(len(gram), bool)
            head[1:] = (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = _greater(ids, sub, pos, first)
            yield _spans(ids[later], sub[later], pos[later], window)
            yield _rows(0, gram[head], whole[head], ids[head], sub[head], pos[head])

    return run


def _match_runs(window: int):
    """Over rows sorted by (k, h, id, sub, pos): spans pass; later rows of one (k, h) are copies;
    the first ones go on (kind 2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (k, h, id, sub, pos) of the latest first row
        for batch in batches:
            kind = np.asarray(batch.column(0))
            if (kind == 1).any():
                yield batch.filter(pa.array(kind == 1))
            k, h, ids, sub, pos = (np.asarray(batch.column(i))[kind == 0] for i in range(1, 6))
            if not len(k):
                continue
            if last is not None:
                k, h, ids, sub, pos = (np.concatenate(([a], b)) for a, b in zip(last, (k, h, ids, sub, pos)))
            head = np.ones(len(k), bool)
            head[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
            heads = np.flatnonzero(head)
            later = _greater(ids, sub, pos, heads[np.cumsum(head) - 1])
            if later.any():
                yield _spans(ids[later], sub[later], pos[later], window)
            new = heads[1:] if last is not None else heads
            yield _rows(2, k[new], h[new], ids[new], sub[new], pos[new])
            i = heads[-1]
            last = (k[i], h[i], ids[i], sub[i], pos[i])

    return run


class SuffixFamily:
    """Suffix arrays of the texts added so far, in levels of geometrically growing size.

    A level is an array of starts in ``data``, one per distinct string, sorted by the ``window``
    bytes from there on: a suffix array as deep as a match must be long.  Strings are cut from the
    data while arrays are compared and not kept."""

    def __init__(self, data: np.ndarray, window: int):
        self.data, self.window, self.levels = data, window, []
        self.view = np.lib.stride_tricks.sliding_window_view(data, window) if len(data) >= window else None

    def strings(self, starts: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.view[starts]).view(f"S{self.window}").ravel()

    def _scan(self, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge scan of two suffix arrays: the merged array, old before new among equals, and which
        entries of ``new`` match one of ``old``.  A stable sort of two sorted runs is a merge."""
        strings = np.concatenate((self.strings(old), self.strings(new)))
        order = np.argsort(strings, kind="stable")
        merged = strings[order]
        match = np.zeros(len(order), bool)
        match[1:] = (merged[1:] == merged[:-1]) & (order[1:] >= len(old)) & (order[:-1] < len(old))
        known = np.zeros(len(new), bool)
        known[order[match] - len(old)] = True
        return np.concatenate((old, new))[order], known

    def add(self, starts: np.ndarray) -> np.ndarray:
        """Which suffixes of a batch (starts in text order) match an earlier one over the whole
        window, in the batch or in a level."""
        out = np.zeros(len(starts), bool)
        if not len(starts):
            return out
        strings = self.strings(starts)
        order = np.argsort(strings, kind="stable")
        strings = strings[order]
        again = np.zeros(len(order), bool)
        again[1:] = strings[1:] == strings[:-1]
        out[order[again]] = True
        first = order[~again]
        for level in self.levels:
            known = self._scan(level, starts[first])[1]
            out[first[known]] = True
            first = first[~known]
            if not len(first):
                return out
        self.levels.append(starts[first])
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels[-2:] = [self._scan(*self.levels[-2:])[0]]
        return out


def _windows(body: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of some contexts, in order: (context, place in it, start in the bytes, hash),
    and the bytes."""
    body = pc.cast(body, pa.large_binary())
    offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset:body.offset + len(body) + 1]
    data = np.frombuffer(body.buffers()[2], np.uint8)
    count = np.diff(offsets) - window + 1
    ctx = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][ctx] + place
    inverse = _tables()[2]
    hashes = np.empty(len(ctx), np.uint64)
    step = (1 << PLACE_BITS) // (127 + window)  # contexts hashed at a time
    for a in range(0, len(count), step):
        b = min(a + step, len(count))
        s = _prefix(data[offsets[a]:offsets[b]])
        w = slice(*np.searchsorted(ctx, (a, b)))
        p = start[w] - offsets[a]
        hashes[w] = (s[p + window] - s[p]) * inverse[p]
    return ctx, place, start, hashes, data


def _place(pos: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Positions of single windows of the runs at ``pos``."""
    return ((pos >> AT_SHIFT) + place) << AT_SHIFT | (1 << N_SHIFT)


def _settle(window: int, batch_windows: int = 1 << 16):
    """Over contexts (k, id, sub, pos, bytes) sorted by position: spans of windows that occur earlier.
    Batches of suffixes in text order are merge-scanned against the family's levels and join it.
    Windows whose 64-bit hash no other window of the key range has are left out first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables).combine_chunks()
        ids, sub, pos = (np.asarray(t.column(c)) for c in ("id", "sub", "pos"))
        once = np.ones(len(ids), bool)  # a repeated input row is one place
        once[1:] = (ids[1:] != ids[:-1]) | (sub[1:] != sub[:-1]) | (pos[1:] != pos[:-1])
        if not once.all():
            t, ids, sub, pos = t.filter(pa.array(once)).combine_chunks(), ids[once], sub[once], pos[once]
        ctx, place, start, hashes, data = _windows(t.column("body").combine_chunks(), window)
        _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[back] > 1)
        family, dup = SuffixFamily(data, window), np.zeros(len(ctx), bool)
        for a in range(0, len(some), batch_windows):
            w = some[a:a + batch_windows]
            dup[w] = family.add(start[w])
        hit = np.flatnonzero(dup)
        if len(hit):
            yield _spans(ids[ctx[hit]], sub[ctx[hit]], _place(pos[ctx[hit]], place[hit]), window)

    return run


def _hash_windows(window: int, compared: int = 1 << 16):
    """Over contexts (id, sub, pos, body) in any order: the windows (kind 3, k is their hash, h the
    context's position) without those that are, byte for byte, later copies in the batch; these
    are spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ctx, place, start, hashes, data = _windows(batch.column("body"), window)
            own, sub, runs = (np.asarray(batch.column(c))[ctx] for c in ("id", "sub", "pos"))
            pos = _place(runs, place)
            order = np.lexsort((pos, sub, own, hashes))
            own, sub, runs, pos, start, hashes = (x[order] for x in (own, sub, runs, pos, start, hashes))
            head = np.ones(len(order), bool)
            head[1:] = hashes[1:] != hashes[:-1]
            view = np.lib.stride_tricks.sliding_window_view(data, window)
            same = np.flatnonzero(~head)
            for a in range(0, len(same), compared):
                i = same[a:a + compared]
                head[i] = (view[start[i]] != view[start[i - 1]]).any(axis=1)
            later = _greater(own, sub, pos, np.flatnonzero(head)[np.cumsum(head) - 1])
            if later.any():
                yield _spans(own[later], sub[later], pos[later], window)
            yield _rows(3, hashes[head].view(np.int64), runs[head], own[head], sub[head], pos[head])

    return run


def _cut_windows(window: int):
    """(id, sub, pos, body, asked) rows to (k, id, sub, pos, body): the bytes of each asked-for window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(asked)).astype(np.int64))
            k, pos = (np.asarray(asked.flatten().field(c)) for c in ("k", "pos"))
            at = (pos >> AT_SHIFT) - (np.asarray(batch.column("pos")) >> AT_SHIFT)[row]
            bodies = [b.as_buffer() for b in batch.column("body")]
            ids, sub = (np.asarray(batch.column(c))[row] for c in ("id", "sub"))
            for a in range(0, len(k), 10_000):
                s = slice(a, a + 10_000)
                cut = [bytes(memoryview(bodies[r])[o:o + window]) for r, o in zip(row[s].tolist(), at[s].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[s]) for x in (k, ids, sub, pos)), pa.array(cut, pa.binary())], schema=CONTEXT)

    return run


def _match_windows(window: int):
    """Over windows sorted by (k, body, id, sub, pos): spans of those that are not the first with their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the first window with the latest bytes
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(CONTEXT.names)
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            ids, sub, pos = (np.asarray(batch.column(c)) for c in ("id", "sub", "pos"))
            head = np.ones(len(ids), bool)
            head[1:] = np.asarray(pc.not_equal(batch.column("body")[1:], batch.column("body")[:-1]))
            heads = np.flatnonzero(head)
            later = _greater(ids, sub, pos, heads[np.cumsum(head) - 1])
            if later.any():
                yield _spans(ids[later], sub[later], pos[later], window)
            last = batch.take(pa.array([heads[-1]]))

    return run


def _settle_hot(contexts: DataFrame, window: int) -> DataFrame:
    """Spans from the contexts (k, id, sub, pos, body) of anchors that are too frequent for one task.

    Equal windows meet by their own hash: first without their bytes, which are then cut only for
    windows whose hash another one has.  Both steps stream, so no task holds an anchor's or a
    window's occurrences at once."""
    contexts = written(contexts.select("id", "sub", "pos", "body").distinct(), "hot")
    windows = written(contexts.mapInArrow(_hash_windows(window), FOUND_DDL), "windows")
    often = windows.where("kind = 3").groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    asked = (windows.where("kind = 3").join(often, "k").groupBy("id", "sub", "h")
             .agg(F.collect_list(F.struct("k", "pos")).alias("asked")).withColumnRenamed("h", "pos"))
    cut = contexts.join(asked, ["id", "sub", "pos"]).mapInArrow(_cut_windows(window), CONTEXT_DDL)
    found = cut.repartition("k").sortWithinPartitions("k", "body", "id", "sub", "pos").mapInArrow(_match_windows(window), FOUND_DDL)
    return windows.where("kind = 1").unionByName(found)


def _cut_contexts(window: int):
    """(id, sub, text, asked) rows to (k, id, sub, pos, body): the bytes of each asked-for run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("body")[i].as_buffer()
                asked = batch.column("asked")[i].values
                k, pos = np.asarray(asked.field("k")), np.asarray(asked.field("pos"))
                at = pos >> AT_SHIFT
                n = ((pos >> N_SHIFT) & 127) + window - 1
                view = memoryview(raw)
                own = (pa.array(np.full(len(k), batch.column(c)[i].as_py(), np.int64)) for c in ("id", "sub"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k), *own, pa.array(pos),
                     pa.array([bytes(view[a:a + m]) for a, m in zip(at.tolist(), n.tolist())], pa.binary())], schema=CONTEXT)

    return run


KEPT_DDL = "n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _keep():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            for body, found in zip(batch.column("body"), batch.column("found")):
                raw = body.as_buffer().to_pybytes() if body.is_valid else b""
                n_bytes.append(len(raw))
                if not found.is_valid:
                    spans.append([])
                    kept.append(raw)
                    continue
                start, end = (np.asarray(found.values.field(c)) for c in ("start", "end"))
                _, start, end = merged(np.zeros(len(start), np.int64), start, end)
                spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), pa.array(n_bytes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["row_id", "n_bytes", "spans", "kept"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100,
                 k: int = 24, contexts_per_task: int = 20_000) -> DataFrame:
    """(id, n_bytes, spans, kept) for every input row: ``spans`` are the maximal runs of bytes
    covered by a ``window``-byte string that also starts earlier (a smaller id, or the same
    document at a smaller offset), judged on the input; ``kept`` is the rest.

    Ids are integers; null comes before all.  Repeated rows are one document and share a
    result.  Different texts with one id are taken as documents in the order of their hash.
    Null text: no bytes.  Texts shorter than a window keep all.  Extra columns are not read.

    Shuffled are 48-byte rows, one per run of windows (about 2.5 per 100 bytes of text), the
    texts by id to fetch the edges of copied passages and to cut the spans, and those edges.
    A task of the last step gets about ``contexts_per_task`` edges, so its suffix arrays fit
    in memory at any size; an anchor with more of them is settled window by window.
    """
    if not 2 * k <= window or window - k + 1 > 127:
        raise ValueError("the anchor must be at most half a window, and a run at most 127 windows")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.col(text_col).cast("binary").alias("body"))
    mark = F.xxhash64(F.coalesce("body", F.lit(b"")))
    several = rows.groupBy("id").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b").limit(1).count()
    rows = rows.select("row_id", "id", (mark if several else F.lit(0)).cast("long").alias("sub"), "body")
    runs = rows.select("id", "sub", "body").mapInArrow(_read_runs(window, k), FOUND_DDL)
    # equal runs meet by anchor and fingerprint: a frequent anchor is as many keys as it has runs
    found = written(runs.repartition("k", "h").sortWithinPartitions("k", "h", "id", "sub", "pos")
                    .mapInArrow(_match_runs(window), FOUND_DDL), "runs")
    heads = found.where("kind = 2")
    # an anchor with several runs: their windows may be equal in part
    parted = written(heads.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "parted-anchors")
    asked = written(heads.join(parted.select("k"), "k").select("id", "sub", "k", "pos"), "asked")
    n_asked = asked.count()
    spans = found.where("kind = 1")
    if n_asked:
        per_doc = asked.groupBy("id", "sub").agg(F.collect_list(F.struct("k", "pos")).alias("asked"))
        texts = rows.select("id", "sub", "body").join(per_doc, ["id", "sub"])
        contexts = texts.mapInArrow(_cut_contexts(window), CONTEXT_DDL)
        # an anchor with more edges than a task takes is split by the windows themselves
        hot = written(parted.where(F.col("n") > contexts_per_task).select("k"), "hot-anchors")
        if not hot.isEmpty():
            spans = spans.unionByName(written(_settle_hot(contexts.join(F.broadcast(hot), "k"), window), "hot-edges"))
            contexts = contexts.join(F.broadcast(hot), "k", "left_anti")
        edges = (contexts.repartition(max(1, -(-n_asked // contexts_per_task)), "k").sortWithinPartitions("id", "sub", "pos")
                 .mapInArrow(_settle(window), FOUND_DDL))
        spans = spans.unionByName(written(edges, "edges"))
    start = F.shiftright("pos", AT_SHIFT)
    per_doc = spans.groupBy("id", "sub").agg(F.collect_list(F.struct(start.alias("start"), F.col("h").alias("end"))).alias("found"))
    out = rows.join(per_doc, ["id", "sub"], "left").select("row_id", "body", "found").mapInArrow(
        _keep(), f"row_id {docs.schema[id_col].dataType.simpleString()}, {KEPT_DDL}")
    return out.withColumnRenamed("row_id", id_col)
