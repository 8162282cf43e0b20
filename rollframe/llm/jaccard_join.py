"""N-gram Jaccard join on count vectors with an R-tree.

Shingles are hashed into groups; a document is the point of its group counts, and the summed
coordinate minima of two points bound the overlap of their sets from above.

*Cells.*  A tree over all points of a large corpus prunes too little (every pair of
equally long texts is near in most coordinates), so the points are first dealt out exactly:
the groups are cut into K blocks, K above the largest number of shingles in which two linked
documents of a size class can differ.  Then at least one block of a linked pair has the same
sub-vector: documents meet in the cell of that sub-vector, whatever their machine.

*Inside a cell* each document is paired with one hub; the bound prunes, survivors are verified
on their shingle sets, and components are formed.  Cells whose members are not yet one
component are settled by an R-tree over their members' count vectors: nodes hold coordinate
maxima, a node is skipped when even its maxima can't reach the needed overlap, and pairs that
pass are verified.  No pair within a known component is tested, none outside is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from rollframe.llm.components import components
from rollframe.llm.sentencepiece import in_slices
from rollframe.llm.suffix_dedup import _mix
from rollframe.llm.work import scratch, written
from rollframe.session import ship_package

#: Groups of the count vector: of GROUPS random counts the minima bound sets of up to some ten
#: thousand shingles well; leaf: rows of a tree's leaf.
GROUPS, LEAF, SLICE_BYTES = 256, 48, 1 << 20
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
C1, C2, C3 = (np.uint64(c) for c in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95))


class Threshold:
    """num / den, as integers: linked if den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def needed(self, total):
        """Smallest overlap that links sets whose sizes add up to ``total``."""
        return -(-self.num * total // (self.num + self.den))

    def differing(self, total):
        """Most shingles in just one of two linked sets with that many in all."""
        return (self.den - self.num) * total // (self.num + self.den)

    def partner(self, n):
        """Largest size of a set that can link with one of ``n``."""
        return n * self.den // self.num


@cache
def classes(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size of each size class, its number of blocks) up to sets of ``largest``."""
    t, lo, blocks = Threshold(num, den), [], []
    a = 1
    while a <= largest:
        b = max(a + 1, int(a * 1.6))
        d = t.differing(b - 1 + t.partner(b - 1))
        lo.append(a)
        # blocks to spare: linked pairs then agree on several, and hot ones can be done without
        blocks.append(d + 1 + (-(-d // 5) if d <= 20 else 4 + (d - 20) // 10))
        a = b
    return np.array(lo + [a], np.int64), np.array(blocks, np.int64)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, set sizes, distinct shingle hashes of all rows, sorted within each) for slices
    of the texts."""
    at = 0
    for part in in_slices(texts, SLICE_BYTES):
        yield at, *_slice_sets(part, words)
        at += len(part)


def _slice_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    raw = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)]
    offsets = texts.buffers()[1]
    lowered = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(raw)], offset=texts.offset)
    parts = pc.ascii_split_whitespace(lowered)
    doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(parts)).astype(np.int64))
    coded = parts.flatten().dictionary_encode()
    index, spelled = np.asarray(coded.indices).astype(np.int64), pc.cast(coded.dictionary, pa.large_binary())
    size = np.asarray(pc.binary_length(spelled)).astype(np.int64)
    word = _word_hashes(spelled)
    real = size[index] > 0
    doc, seq = doc[real], word[index[real]]
    count = np.bincount(doc, minlength=len(texts))
    out = np.zeros(0, np.uint64)
    if len(seq):
        h = np.zeros(len(seq), np.uint64)
        full = np.ones(len(seq), bool)
        first = np.cumsum(count) - count
        place = np.arange(len(seq)) - first[doc]
        for j in range(words):
            ok = np.flatnonzero(place + j < count[doc])
            h[ok] = _mix(h[ok] * C1 + seq[ok + j])
        full = (place + words <= count[doc]) | (place == 0)  # a short text is one shingle
        doc, out = doc[full], h[full]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            out[a:b].sort()
        fresh = np.ones(len(out), bool)
        fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
        doc, out = doc[fresh], out[fresh]
        count = np.bincount(doc, minlength=len(texts))
    return count, out


def _word_hashes(spelled: pa.LargeBinaryArray) -> np.ndarray:
    """64-bit hash of each distinct word.  A polynomial modulo 2^64 won't do: it gives some pairs
    of words (a Thue-Morse word and its complement) one value for every base."""
    return np.fromiter((xxh3_64_intdigest(w) for w in spelled.to_pylist()), np.uint64, len(spelled))


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(count), np.uint64), np.flatnonzero(count)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(count) - count)[some])
    return out


def cell_keys(count: np.ndarray, hashes: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell key) of every block sub-vector that the rows (with their set sizes) index, and
    of each row the number of indexed blocks on which it agrees at least with any set that it
    links with."""
    rows_out, keys_out = [], []
    agreed = np.full(len(count), 1 << 30, np.int64)
    if not count.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(count), np.int64)
    lo, blocks = classes(t.num, t.den, 1 << (int(count.max()) - 1).bit_length() + 1)
    own = np.searchsorted(lo, count, "right") - 1
    first = np.cumsum(count) - count
    place, fine = _mix(hashes ^ C2), _mix((hashes >> np.uint64(32)) * C3 + C1)
    down = 0
    while True:
        c = own - down
        # the own class, and lower ones whose sets can be partners
        rows = np.flatnonzero((count > 0) & (c >= 0) & ((down == 0) | (count <= t.partner(lo[np.maximum(c, 0) + 1] - 1))))
        if not len(rows):
            break
        k = blocks[c[rows]]
        n = count[rows]
        at = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start = np.cumsum(k) - k
        slot = (place[at] % np.repeat(k, n).astype(np.uint64)).astype(np.int64) + np.repeat(start, n)
        vector = np.zeros(int(k.sum()), np.uint64)  # fingerprint of the block's group counts
        np.add.at(vector, slot, fine[at])
        filled = np.bincount(slot, minlength=len(vector)) > 0
        block = np.arange(len(vector)) - np.repeat(start, k)
        row = np.repeat(rows, k)
        empty = np.add.reduceat(~filled, start)
        # an equal empty block only matters if all blocks that agree may be empty
        agree = k - t.differing(n + t.partner(n))
        matters = empty >= agree
        use = filled | np.repeat(matters, k)
        key = _mix(vector + _mix(np.repeat(c[rows], k).astype(np.uint64) * C3 + block.astype(np.uint64) * C1))
        rows_out.append(row[use])
        keys_out.append(key[use])
        # empty blocks that are left out may be among those that agree
        agreed[rows] = np.minimum(agreed[rows], np.where(matters, 1, np.maximum(agree - empty, 1)))
        down += 1
    return np.concatenate(rows_out), np.concatenate(keys_out).view(np.int64), np.where(count > 0, agreed, 0)


POINTS = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                    ("point", pa.binary()), ("agree", pa.int64())])
POINTS_DDL = "kind tinyint, id bigint, n bigint, s1 bigint, s2 bigint, point binary, agree bigint"


def _points(words: int, t: Threshold):
    """(id, text) to one row per document (kind 0: size, set digest, group counts) and one per
    indexed block (kind 1: s1 is the cell).  Of equal sets in a batch one is indexed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            seen: set[tuple[int, int]] = set()
            for at, count, hashes in shingle_sets(batch.column(1), words):
                part = ids.slice(at, len(count))
                s1, s2 = _sums(_mix(hashes ^ C1), count).view(np.int64), _sums(_mix(hashes ^ C3), count).view(np.int64)
                row = np.repeat(np.arange(len(count)), count)
                group = (hashes >> np.uint64(56)).astype(np.int64)
                points = np.bincount(row * GROUPS + group, minlength=len(count) * GROUPS).astype("<u4")
                size = 4 * GROUPS
                buffers = [None, pa.py_buffer((np.arange(len(count) + 1) * size).astype(np.int32)), pa.py_buffer(points)]
                r, key, agree = cell_keys(count, hashes, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(count), np.int8)), part, pa.array(count.astype(np.int64)), pa.array(s1), pa.array(s2),
                     pa.Array.from_buffers(pa.binary(), len(count), buffers), pa.array(agree)], schema=POINTS)
                new = np.zeros(len(count), bool)
                for i, both in enumerate(zip(s1.tolist(), s2.tolist())):
                    if count[i] and part[i].is_valid and both not in seen:
                        seen.add(both)
                        new[i] = True
                r, key = r[new[r]], key[new[r]]
                none = pa.nulls(len(r), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(r), np.int8)), part.take(pa.array(r)), none, pa.array(key), none,
                     pa.nulls(len(r), pa.binary()), none], schema=POINTS)

    return run


def _set_blocks(words: int, t: Threshold):
    """(id, text) to (cell, s1, s2): the indexed blocks of each row under its set's digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, count, hashes in shingle_sets(batch.column(1), words):
                s1, s2 = _sums(_mix(hashes ^ C1), count).view(np.int64), _sums(_mix(hashes ^ C3), count).view(np.int64)
                r, key, _ = cell_keys(count, hashes, t)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(s1[r]), pa.array(s2[r])], ["cell", "s1", "s2"])

    return run


def _sets(words: int):
    """(id, text) to (id, set): sorted shingle hashes as bytes."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count, hashes in shingle_sets(batch.column(1), words):
                ends = np.concatenate(([0], np.cumsum(count))) * 8
                body = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(hashes)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(count)), body], schema=schema)

    return run


def _counts(column: pa.Array) -> np.ndarray:
    out = [np.frombuffer(x.as_buffer(), "<u4") for x in column]
    return np.array(out, np.int32).reshape(-1, GROUPS)


def _bounded(t: Threshold):
    """Pairs (a, b, pa, pb) whose summed coordinate minima reach the needed overlap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                a, b = _counts(part.column("pa")), _counts(part.column("pb"))
                keep = np.minimum(a, b).sum(axis=1) >= t.needed(a.sum(axis=1) + b.sum(axis=1))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verify(t: Threshold):
    """Over (a, b, sa, sb): the pairs whose sets link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (sa, sb) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (sa, sb))
                if len(x) and len(y):
                    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    keep[i] = both >= t.needed(len(x) + len(y))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


class CountTree:
    """R-tree over count vectors: packed bottom-up after sorting by size, then by the coordinate
    that varies most; a node keeps coordinate maxima and the size range of its points."""

    def __init__(self, points: np.ndarray, t: Threshold, leaf: int = LEAF, fan: int = 8):
        self.t, self.points, self.size = t, points, points.sum(axis=1)
        spread = points[:, np.argsort(-points.var(axis=0), kind="stable")[:2]]
        # slabs of like sizes, tiled by the widest coordinates
        order = np.argsort(self.size, kind="stable")
        slab = max(leaf, int(np.sqrt(len(order) * leaf)))
        self.order = np.concatenate([o[np.lexsort(spread[o].T)] for o in (order[i:i + slab] for i in range(0, len(order), slab))])
        self.levels = []
        width, top, size = leaf, points[self.order], self.size[self.order]
        low, high = size, size
        while True:
            at = np.arange(0, len(top), width)
            top, low, high = (f.reduceat(x, at, axis=0) for f, x in ((np.maximum, top), (np.minimum, low), (np.maximum, high)))
            self.levels.append((width, top, low, high))
            if len(top) == 1:
                break
            width = fan

    def near(self, i: int) -> np.ndarray:
        """Rows whose bound with row i reaches the needed overlap (i among them)."""
        p, n = self.points[i], self.size[i]
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            width, top, low, high = self.levels[depth]
            bound = np.minimum(top[nodes], p).sum(axis=1)
            ok = (bound >= self.t.needed(n + low[nodes])) & (low[nodes] <= self.t.partner(n)) & (n <= self.t.partner(high[nodes]))
            nodes = nodes[ok]
            below = len(self.levels[depth - 1][1]) if depth else len(self.order)
            nodes = (nodes[:, None] * width + np.arange(width)).ravel()
            nodes = nodes[nodes < below]
        rows = self.order[nodes]
        return rows[np.minimum(self.points[rows], p).sum(axis=1) >= self.t.needed(n + self.size[rows])]


def _tree_pairs(t: Threshold):
    """Over (cell, part, id, component, point) sorted by cell and part: pairs in different
    components that the tree can't rule out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        ids, comp = np.asarray(rows.column("id")), np.asarray(rows.column("component"))
        counts = _counts(rows.column("point").combine_chunks())
        if len(ids) <= LEAF:  # one leaf: all its bounds at once
            size = counts.sum(axis=1)
            bound = np.minimum(counts[:, None], counts[None]).sum(axis=2)
            ok = (bound >= t.needed(size[:, None] + size[None])) & (ids[:, None] < ids[None]) & (comp[:, None] != comp[None])
            i, j = np.nonzero(ok)
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], schema=schema)
        tree, a, b = CountTree(counts, t), [], []
        for i in range(len(ids)):
            near = tree.near(i)
            near = near[(ids[near] > ids[i]) & (comp[near] != comp[i])]
            a.append(np.full(len(near), ids[i], np.int64))
            b.append(ids[near])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            cell, part = np.asarray(rows.column("cell")), np.asarray(rows.column("part"))
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = np.concatenate(([0], cut))
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                yield pairs(rows.slice(lo, hi - lo))
            held = rows.slice(bounds[-1])
        if held is not None and held.num_rows:
            yield pairs(held)

    return run


PAIR_DDL = "a bigint, b bigint"


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 90,
                    den: int = 100, tree_rows: int = 512, star_rounds: int = 1, hot_rows: int = 32) -> DataFrame:
    """(id, n_shingles, component_id) for every input row: two documents link when den *
    intersection >= num * union of their sets of distinct ``words``-word shingles (ASCII
    letters lowered; a shorter text is one shingle), and the component is named by its
    smallest id.

    Null, empty and wordless texts have an empty set and are alone.  Ids are integers; rows
    with a null id link with nothing and have a null component.  Repeated rows and different
    texts with one id are one node of the graph and each get a result row.  Shingles are
    compared as 64-bit hashes.  Extra columns are not read.  An empty table gives none.

    Shuffled are one 16-byte row per block, twice (about 0.2 blocks per shingle at 90 of 100), count vectors of
    documents that share a cell, the texts by id to fetch the sets of those in pairs that pass
    the bound (by merge joins, up to three: the list of those ids has no bound that a broadcast
    could rely on), and those sets once per pair.  Joins on a
    hub's id are split by the engine where the hub is hot.  A cell of more than ``hot_rows``
    members is often one common line's: members that meet all their partners elsewhere leave
    it, by a count of blocks that must agree, so nothing is lost.  A cell with more than ``tree_rows``
    unsettled members is split into parts that meet pairwise, so no task of the tree step
    holds more than two parts.
    """
    with scratch(docs.sparkSession) as step:  # some sixty tables; none is read after the result is written
        return written(_classes(docs, id_col, text_col, words, Threshold(num, den), tree_rows, star_rounds, hot_rows, step), "classes")


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, t: Threshold, tree_rows: int, star_rounds: int, hot_rows: int,
             step) -> DataFrame:
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = step(rows.mapInArrow(_points(words, t), POINTS_DDL), "points")
    points = table.where("kind = 0").select("id", "n", "s1", "s2", "point", "agree")
    blocks = table.where("kind = 1").select(F.col("s1").alias("cell"), "id")

    # equal sets: the smallest id stands for all, its copies follow it
    sets = points.where("n > 0 and id is not null")
    same = step(sets.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("point").alias("point"), F.min("agree").alias("agree")), "same")
    copies = step(sets.select("s1", "s2", F.col("id").alias("copy")).join(
        same.where("id <> last").select("s1", "s2", "id"), ["s1", "s2"]).where("copy <> id").select("copy", "id").distinct(), "copies")
    # an id with several texts may be a copy of one set and stand for another: then it is a node of its own
    both = copies.join(same.select(F.col("id").alias("copy")).distinct(), "copy", "left_semi")
    several = copies.groupBy("copy").count().where("count > 1").select("copy")
    nodes = step(both.select("copy").unionByName(several).distinct(), "nodes")
    links = copies.join(nodes, "copy", "left_semi").select(F.col("id").alias("a"), F.col("copy").alias("b"))
    to = copies.join(nodes, "copy", "left_anti").select("copy", F.col("id").alias("to"))

    # such an id's blocks may be of any of its sets: they are indexed anew, under each set's node
    spread = sets.groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("s1", "s2") for f in (F.min, F.max)])
    mixed = step(spread.where("min_s1 <> max_s1 or min_s2 <> max_s2").select("id"), "mixed")
    if not mixed.isEmpty():
        anew = rows.join(mixed, "id").mapInArrow(_set_blocks(words, t), "cell bigint, s1 bigint, s2 bigint").distinct()
        blocks = (blocks.join(mixed, "id", "left_anti").select("cell", "id")
                  .unionByName(anew.join(same.select("s1", "s2", "id"), ["s1", "s2"]).select("cell", "id")))

    # cells with more than one set; of cells with the same members one
    shared = blocks.groupBy("cell").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("cell")
    members = blocks.join(step(shared, "shared"), "cell").join(to, F.col("id") == F.col("copy"), "left")
    members = step(members.select("cell", F.coalesce("to", "id").alias("id")).distinct(), "members")
    # a member agrees with each of its partners on ``agree`` blocks at least: if fewer of its cells
    # than that are hot, it meets every partner in another one, and leaves the hot ones
    size = members.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1")
    sized = members.join(size, "cell")
    hot = sized.where(F.col("m") > hot_rows)
    agree = same.groupBy("id").agg(F.min("agree").alias("agree"))
    light = hot.groupBy("id").agg(F.count("*").alias("h")).join(agree, "id").where("h < agree").select("id")
    members = sized.where(F.col("m") <= hot_rows).unionByName(hot.join(light, "id", "left_anti")).select("cell", "id")
    who = [F.count("*").alias("m"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("w1"),
           F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("w2"), F.min("id").alias("hub")]
    cells = members.groupBy("cell").agg(*who).where("m > 1")
    cells = cells.groupBy("m", "w1", "w2", "hub").agg(F.min("cell").alias("cell")).select("cell", "m", "hub")
    members = step(members.join(cells, "cell"), "cells")

    point = same.select("id", "point")

    def bounded(pairs: DataFrame) -> DataFrame:
        wide = (pairs.join(point.select(F.col("id").alias("a"), F.col("point").alias("pa")), "a")
                .join(point.select(F.col("id").alias("b"), F.col("point").alias("pb")), "b"))
        return wide.select("a", "b", "pa", "pb").mapInArrow(_bounded(t), PAIR_DDL).distinct()

    fetched: list[DataFrame] = []

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        for had in fetched:
            ids = ids.join(had.select("id"), "id", "left_anti")
        fetched.append(step(rows.join(ids.hint("merge"), "id").mapInArrow(_sets(words), "id bigint, shingles binary"), "sets"))
        bodies = reduce(DataFrame.unionByName, fetched)
        near = (pairs.join(bodies.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
                .join(bodies.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a"))
        return step(near.select("a", "b", "sa", "sb").mapInArrow(_verify(t), PAIR_DDL), "links")

    # first each member with the smallest of its cells' hubs
    tested = step(members.where("id <> hub").groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a")).select("a", "b"), "pairs")
    found = components(links.unionByName(verified(step(bounded(tested), "near"))), step)
    left = members.select("cell", "id", "m")
    for turn in range(star_rounds + 1):
        # what is left: cells with members in several components
        named = left.select("cell", "id", "m").join(found, "id", "left").select(
            "cell", "id", "m", F.coalesce("component", "id").alias("component"))
        open_ = named.groupBy("cell").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("cell")
        left = step(named.join(open_, "cell"), "unsettled")
        if left.isEmpty():
            break
        if turn < star_rounds:
            # a hub by chance, and not the same one for all cells of a group
            order = F.xxhash64("id", F.expr("pmod(cell, 4)"), F.lit(turn))
            hubs = left.groupBy("cell").agg(F.min_by(F.struct("id", "component"), order).alias("h"))
            pairs = left.join(hubs, "cell").where("component <> h.component")
            pairs = pairs.select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).distinct()
        else:
            parts = F.ceil(F.col("m") / F.lit(tree_rows)).cast("int")
            dealt = left.join(same.select("id", "point"), "id").withColumn("parts", parts)
            dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
            dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
            part = F.least("own", "other").cast("long") * F.lit(1 << 20) + F.greatest("own", "other")
            pairs = (dealt.select("cell", part.alias("part"), "id", "component", "point").repartition("cell", "part")
                     .sortWithinPartitions("cell", "part").mapInArrow(_tree_pairs(t), PAIR_DDL).distinct())
        pairs = step(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        more = verified(step(bounded(pairs), "near") if turn < star_rounds else pairs)
        tested = tested.unionByName(pairs)
        if not more.isEmpty():
            # the stars found so far stand for the links that made them
            found = components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more), step)
    node = points.select("id", "n").join(to, F.col("id") == F.col("copy"), "left").withColumn("node", F.coalesce("to", "id"))
    out = node.join(found.select(F.col("id").alias("node"), "component"), "node", "left")
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"),
                      F.coalesce("component", "node").cast(kind).alias("component_id"))
