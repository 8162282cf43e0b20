"""Benchmark decontamination with one Aho-Corasick automaton over all item windows.

Texts are normalised byte for byte (A-Z lowered, other separators to spaces), so a word keeps
its offset and every hit maps back to the original.  Each document is scanned once; with a
benchmark too large for one automaton, once per block of items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe.llm.work import free_name, written
from rollframe.session import ship_package

#: Item words in a row that stay in one block.
PART_WORDS = 2048
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_windows(items: list[tuple[str | None, str]], window: int) -> dict[str, tuple[int, set[str]]]:
    """Window key -> (its words, ids of the items that have it).  Keys are words joined and
    framed by spaces, one character per UTF-8 byte."""
    out: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = text.encode().translate(TABLE).split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            w = words[i:i + window]
            entry = out.setdefault((b" " + b" ".join(w) + b" ").decode("latin-1"), (len(w), set()))
            if item is not None:
                entry[1].add(item)
    return out


def build_automaton(windows: dict[str, tuple[int, set[str]]]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, value in windows.items():
        automaton.add_word(key, value)
    automaton.make_automaton()
    return automaton


def scan_runs(text: str | None, automaton) -> tuple[int, list[dict], list[str]]:
    """(words, runs of hit words, items): a run has its words (first, end) and its span in
    characters of the original (start, end)."""
    if not text:
        return 0, [], []
    raw = text.encode()
    flat = raw.translate(TABLE)
    words = flat.split()
    norm = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = list(automaton.iter(norm)) if len(automaton) else []
    if not found:
        return len(words), [], []
    # a word starts after each space of the normalised text
    starts = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
    step, items = np.zeros(len(words) + 1, np.int64), set()
    for end, (n, ids) in found:
        last = int(np.searchsorted(starts, end)) - 1
        step[last - n + 1] += 1
        step[last + 1] -= 1
        items |= ids
    hit = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()
    word = np.frombuffer(flat, np.uint8) != 32
    bounds = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    runs = [{"a": a, "b": b, "start": len(raw[:bounds[2 * a]].decode()), "end": len(raw[:bounds[2 * b - 1]].decode())}
            for a, b in zip(edge[::2], edge[1::2])]
    return len(words), runs, sorted(items)


def scan(text: str | None, automaton) -> tuple[int, int, list[dict], list[str]]:
    """(words, hit words, hit spans in characters of the original, items)."""
    n, runs, items = scan_runs(text, automaton)
    return n, sum(r["b"] - r["a"] for r in runs), [{"start": r["start"], "end": r["end"]} for r in runs], items


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
FOUND_DDL = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
COLUMNS = ("n_words", "n_hit", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = 10, max_benchmark_bytes: int = 1 << 20,
                  pass_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_hit``, ``spans`` and ``items``.

    A window is ``window`` consecutive item words, or all of a shorter item.  Words inside any
    occurrence of a window are hit; ``spans`` are the runs of hit words in the original text
    (characters, end exclusive), ``items`` the sorted ids of items with an occurring window.
    Null and empty texts have no words; an empty benchmark hits nothing; benchmark rows
    without an id hit but are not listed; repeated rows of either side change nothing else.
    Input columns named like the four are replaced, all others pass through.

    An automaton is built of about ``max_benchmark_bytes`` of item texts, which are broadcast.  One block:
    the documents are read once and not shuffled.  More: a batch of documents goes through the
    blocks' automata one after the other, up to ``pass_bytes`` of items (the broadcast's bound) in
    one scan of the documents, and hits meet by the md5 of the text (:func:`block_hits`).  Spans
    and counts are the same for every bound.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    items = items.where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > max_benchmark_bytes:
        return decontaminate_in_blocks(docs, items, text_col, window, max_benchmark_bytes, pass_bytes)
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])
    kept: dict = {}

    @F.arrow_udf(FOUND_DDL)
    def found(texts: pa.Array) -> pa.Array:
        if "a" not in kept:
            kept["a"] = build_automaton(item_windows(shared.value, window))
        return pa.array([dict(zip(COLUMNS, scan(t.as_py(), kept["a"]))) for t in texts], FOUND)

    name = free_name("__found", docs.columns)
    out = docs.drop(*COLUMNS).withColumn(name, found(F.col(text_col)))
    return out.select("*", f"{name}.*").drop(name)


def item_parts(items: DataFrame, window: int) -> DataFrame:
    """(item, text) with texts of ``PART_WORDS`` windows at most: together they have the windows of
    the items and no others."""
    w = items.select("item", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({WORD})"), 1).alias("w"))
    last = F.greatest(F.size("w") - window, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last, F.lit(PART_WORDS)),
                      lambda i: F.array_join(F.slice("w", i + 1, PART_WORDS + window - 1), " "))
    return w.where(F.size("w") > 0).select("item", F.explode(cut).alias("text")).distinct()


RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("a", "b", "start", "end")]))
HITS_DDL = "key string, block int, runs array<struct<a:bigint,b:bigint,start:bigint,end:bigint>>, items array<string>"


def block_hits(texts: DataFrame, blocks: list[list[tuple[str | None, str]]], window: int) -> DataFrame:
    """(key, block, runs, items) of the texts (key, text) that a block's automaton hits: one scan of
    the texts, one automaton in memory at a time."""
    shared = texts.sparkSession.sparkContext.broadcast(blocks)

    def run(batches):
        alone = build_automaton(item_windows(shared.value[0], window)) if len(shared.value) == 1 else None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for b, block in enumerate(shared.value):
                automaton = alone or build_automaton(item_windows(block, window))
                found = [(k, *scan_runs(t.as_py(), automaton)[1:]) for k, t in zip(keys, batch.column(1))]
                found = [f for f in found if f[1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.string()), pa.array([b] * len(found), pa.int32()),
                     pa.array([f[1] for f in found], RUNS), pa.array([f[2] for f in found], pa.list_(pa.string()))],
                    names=["key", "block", "runs", "items"])

    # a repeated text has the same hits
    out = written(texts.mapInArrow(run, HITS_DDL).dropDuplicates(["key", "block"]), "hits")
    shared.destroy()
    return out


def decontaminate_in_blocks(docs: DataFrame, items: DataFrame, text_col: str, window: int, block_bytes: int,
                            pass_bytes: int) -> DataFrame:
    """The same for a benchmark of any size, ``items(item, text)``: the driver and a worker hold
    the items of one pass and one block's automaton."""
    ship_package(docs.sparkSession)
    parts = item_parts(items, window)
    weight = F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0))
    total = parts.agg(F.sum(weight).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-total // max(1, block_bytes)))
    a_pass = max(1, pass_bytes // max(1, block_bytes))
    parts = written(parts.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))), "item-parts")
    texts = docs.select(F.md5(F.col(text_col).cast("binary")).alias("key"), F.col(text_col).alias("text")).where("text <> ''")
    hits = None
    for first in range(0, n_blocks, a_pass):
        blocks: dict[int, list] = {}
        for r in parts.where(F.col("block").between(first, first + a_pass - 1)).collect():
            blocks.setdefault(r["block"], []).append((r["item"], r["text"]))
        if blocks:
            got = block_hits(texts, list(blocks.values()), window)
            hits = got if hits is None else hits.unionByName(got)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], HITS_DDL)
    # runs of several blocks overlap or touch in words
    runs = F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs"))))
    hits = hits.groupBy("key").agg(runs.alias("runs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("found_items"))

    @F.arrow_udf("array<struct<a:bigint,b:bigint,start:bigint,end:bigint>>")
    def union(all_runs: pa.Array) -> pa.Array:
        out = []
        for found in all_runs.to_pylist():
            whole: list[dict] = []
            for r in found:
                if whole and r["a"] <= whole[-1]["b"]:
                    if r["b"] > whole[-1]["b"]:
                        whole[-1] |= {"b": r["b"], "end": r["end"]}
                else:
                    whole.append(r)
            out.append(whole)
        return pa.array(out, RUNS)

    key, runs, listed = (free_name(c, docs.columns) for c in ("__key", "__runs", "__items"))
    hits = hits.select(F.col("key").alias(key), union("runs").alias(runs), F.col("found_items").alias(listed))
    out = docs.drop(*COLUMNS).withColumn(key, F.md5(F.col(text_col).cast("binary"))).join(hits, key, "left")
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    spans = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    words = F.size(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"({WORD})"), 1))
    return out.select(
        *[c for c in docs.columns if c not in COLUMNS], F.coalesce(F.when(F.col(text_col).isNotNull(), words), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(spans, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce(listed, F.array().cast("array<string>")).alias("items"))
