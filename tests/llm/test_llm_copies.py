"""Jaccard join, suffix dedup, components and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollframe.llm import jaccard_join as jj
from rollframe.llm import suffix_dedup as sd
from rollframe.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if x]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_classes(rows, n, num, den):
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    sets = [(i, shingles(t, n)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1:]:
            if s and t and i is not None and j is not None and den * len(s & t) >= num * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def varied(rng, n_base=12, copies=9):
    rows, i = [], 0
    for _ in range(n_base):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 3, 8, 20, 60, 150, 400]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"w{rng.randint(0, 400)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("n,num,den,hot", [(3, 90, 100, 32), (5, 80, 100, 2), (2, 60, 100, 3)])
def test_jaccard_classes_against_brute_force(spark, n, num, den, hot):
    rng = random.Random(num)
    line = "this line is on many pages "
    rows = varied(rng) + [(400 + i, line + " ".join(f"q{rng.randint(0, 900)}" for _ in range(rng.randint(3, 60)))) for i in range(40)] + [(500, None), (501, ""), (502, " \n"), (503, "One Two"), (504, "one  TWO"), (505, "one two three"),
                          (506, "é É"), (None, "one two"), (None, None), (503, "One Two"), (504, "quite another text of some words")]
    rows += [(600 + i, "hot text " * 40) for i in range(30)]
    rng.shuffle(rows)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n_shingles int, id string").repartition(7)
    got = jj.jaccard_classes(d, words=n, num=num, den=den, hot_rows=hot).collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows, n, num, den)


@pytest.mark.parametrize("rounds,tree_rows", [(0, 2048), (0, 5), (1, 5)])
def test_unsettled_cells_are_settled_by_the_tree(spark, rounds, tree_rows):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # chains and outliers around one base: hubs that link with few
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = jj.jaccard_classes(d, star_rounds=rounds, tree_rows=tree_rows).collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows, 3, 90, 100)


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_of_texts_of_ids_with_several(spark, seed):
    rng = random.Random(seed)
    texts = [t for _, t in varied(rng, 9, 6)]
    rows = [(rng.randint(1, 40), t) for t in texts + rng.sample(texts, 12)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1 + seed)
    assert sorted((tuple(r) for r in jj.jaccard_classes(d).collect()), key=str) == brute_classes(rows, 3, 90, 100)


def test_a_link_through_an_id_with_two_texts_in_one_batch(spark):
    w = [f"w{i}" for i in range(80)]
    y, other, z = " ".join(w), " ".join(f"v{i}" for i in range(60)), " ".join(w[:-1] + ["end"])
    rows = [(5, y), (5, other), (1, y), (9, z)]
    got = jj.jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 1), (1, 1), (9, 1)}


def test_words_that_a_polynomial_hash_confuses(spark):
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    got = jj.jaccard_classes(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 2), (3, 1)}


def test_jaccard_long_texts_and_empty_table(spark):
    long = " ".join(f"w{i % 5000} v{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "z" * 300_000), (4, "z" * 300_000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [tuple(r)[2] for r in jj.jaccard_classes(d).orderBy("doc_id").collect()] == [1, 1, 3, 3]
    assert jj.jaccard_classes(d.limit(0)).count() == 0


def test_a_linked_pair_shares_a_cell():
    t, rng = jj.Threshold(90, 100), np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        extra = [rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 9 + 1))), dtype=np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate((common, e))) for e in extra)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            row, key, _ = jj.cell_keys(np.array([len(a), len(b)]), np.concatenate((a, b)), t)
            assert set(key[row == 0]) & set(key[row == 1])


def test_tree_finds_what_the_bound_allows():
    rng, t = np.random.default_rng(4), jj.Threshold(90, 100)
    centres = rng.poisson(3, (12, jj.GROUPS))
    points = np.maximum(0, centres[rng.integers(0, 12, 400)] + rng.integers(-1, 2, (400, jj.GROUPS)) * (rng.random((400, jj.GROUPS)) < 0.1))
    tree, size = jj.CountTree(points, t), points.sum(axis=1)
    for i in range(0, 400, 7):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(axis=1) >= t.needed(size + size[i]))
        assert sorted(tree.near(i)) == sorted(want)


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(45)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    parent = {x: x for p in links if p[0] != p[1] for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_removed(rows, w):
    """rows: (id, text), null ids first, texts of one id by nothing else: ids differ here."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        m = bytearray(len(b))
        for o in range(len(b) - w + 1):
            if b[o:o + w] in seen:
                m[o:o + w] = b"\1" * w
            seen.add(b[o:o + w])
        edges = [o for o in range(len(b) + 1) if (o < len(b) and m[o]) != (o > 0 and bool(m[o - 1]))]
        out[i] = (len(b), list(zip(edges[::2], edges[1::2])), bytes(c for c, f in zip(b, m) if not f))
    return out


@pytest.mark.parametrize("k", [24, 50])
def test_suffix_dedup_against_brute_force(spark, k):
    rng = random.Random(k)
    prose = lambda n: "".join(rng.choice(["the ", "of ", "añe ", "ring ", "ston ", "日 "]) for _ in range(n))
    passages = [prose(40), "a" * 250, "ab" * 130, "\0" * 220, prose(25)]
    rows = [(None, prose(60) + passages[0])]
    for i in range(70):
        t = "".join(rng.choice([prose(rng.randint(0, 40)), *passages]) for _ in range(rng.randint(0, 5)))
        rows.append((i * 3 - 20, t))
    rows += [(1000, None), (1001, ""), (1002, rows[5][1]), (1003, rows[5][1][:-1] + "!"), (1004, "x" * 99), (1005, "x" * 99)]
    rows += [(1006, prose(3000)), (1006, None)][:1] + [rows[7], rows[8]]
    rng.shuffle(rows)
    d = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, kept int").repartition(6)
    want = brute_removed(rows, 100)
    got = sd.suffix_dedup(d, k=k, contexts_per_task=50).collect()
    assert len(got) == len(rows)
    for r in got:
        n, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) == (n, spans, kept), r["doc_id"]
    assert sd.suffix_dedup(d.limit(0)).count() == 0


def test_no_task_settles_a_hot_anchor(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    notice, passage = word(60), word(130)
    rows = [(i, word(90) + notice + word(rng.randint(60, 90))) for i in range(200)]
    rows += [(200 + i, word(30) + passage[:110] + notice + passage[rng.randint(0, 20):] + word(20)) for i in range(40)]
    rows += [(None, rows[-1][1] + "end"), rows[210], rows[3]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want, most, settle = brute_removed(rows, 100), spark.sparkContext.accumulator(0), sd._settle

    def watched(window):
        def run(batches):
            tables = list(batches)
            ks = pa.chunked_array([b.column("k") for b in tables]) if tables else pa.array([], pa.int64())
            if len(ks) and max(x["counts"].as_py() for x in ks.value_counts()) > 30:
                most.add(1)
            yield from settle(window)(iter(tables))
        return run

    monkeypatch.setattr(sd, "_settle", watched)
    got = sd.suffix_dedup(d, contexts_per_task=30).collect()
    assert most.value == 0 and len(got) == len(rows)
    for r in got:
        n, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) == (n, spans, kept), r["doc_id"]


def test_suffix_dedup_of_texts_over_several_pieces(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    texts = [long, long[3000:7000] + "new", "y" + long]
    want = brute_removed(list(enumerate(texts)), 100)
    got = []
    for piece in (700, 1 << 20):
        rows = []
        for raw, row, at, length in sd._pieces(pa.array(texts), 100, piece):
            p, offset, count, place, gram, whole = sd.anchored_runs(raw, length, 100, 24)
            rows += [(int(row[a]), int(at[a] + o) + j) for a, o, c in zip(p, offset, count) for j in range(int(c))]
        got.append(sorted(rows))
        assert got[-1] == [(i, o) for i, t in enumerate(texts) for o in range(len(t) - 99)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in sd.suffix_dedup(d).collect():
        assert bytes(r["kept"]) == want[r["doc_id"]][2]


def test_texts_with_one_id_are_ordered_documents(spark):
    a, b = "same passage of text " * 10, "other words in a row " * 10
    d = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a + b)], "doc_id bigint, text string")
    got = sd.suffix_dedup(d).collect()
    assert len(got) == 4
    assert sum(len(r["kept"]) for r in got if r["n_bytes"] > 300) < 110
    firsts = {bytes(r["kept"]) for r in got if r["n_bytes"] < 300}
    assert all(x for x in firsts)


def test_many_texts_with_one_id_need_no_rank(spark):
    n = 600_000  # more different texts under the null id than a 19-bit rank holds
    passage = "".join(random.Random(3).choices("abcdefgh ", k=120))
    d = spark.range(n, numPartitions=8).select(
        F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 150_000 == 0, F.concat(F.lit(passage), F.col("id").cast("string")))
        .otherwise(F.col("id").cast("string")).alias("text"))
    out = sd.suffix_dedup(d)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "rank" not in plan
    got = [bytes(r["kept"]) for r in out.where("n_bytes > 100").collect()]
    assert len(got) == 4 and sum(passage.encode() in x for x in got) == 1 and sum(len(x) < 10 for x in got) == 3


def test_suffix_family_keeps_few_levels():
    rng, seen = np.random.default_rng(1), set()
    data = rng.integers(0, 9, 64 * 40 + 2).astype(np.uint8)
    data[rng.integers(0, len(data), 200)] = 0  # zero bytes, also at a string's end
    family = sd.SuffixFamily(data, 3)
    for i in range(64):
        starts, want = np.arange(40 * i, 40 * i + 40), []
        for x in (bytes(data[a:a + 3]) for a in starts):
            want.append(x in seen)
            seen.add(x)
        assert family.add(starts).tolist() == want
        for level in family.levels:
            assert (lambda t: t == sorted(t) and len(t) == len(set(t)))([bytes(data[a:a + 3]) for a in level])
    sizes = [len(x) for x in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)


def test_a_large_group_of_copies_is_emptied_and_kept(spark):
    import corpus_pipeline as cp

    rows = [(i, "the same page" if i < 5 else f"page {i} alone", "en", "s", 13) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    cleaned = cp.lines(spark, docs, "")
    assert {r["doc_id"] for r in cleaned.where("text = ''").collect()} == set(range(5))
    assert cp.near_copies(spark, cleaned, "").where("text = ''").count() == 5


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp
    from rollframe.llm.quality_classifier import quality_classifier
    from rollframe.llm.sentencepiece import Encoder, PieceModel, model_bytes
    from tests_llm_brute import brute_hits, brute_lines

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r.asDict() for r in quality_classifier(docs, labels).where("predicted = 1").select(*docs.columns).collect()}
    for i, t in brute_lines([(i, r["source"], r["text"]) for i, r in rows.items()], 0.1, 3).items():
        if t != rows[i]["text"]:
            rows[i] |= {"text": t, "n_chars": len(t)}
    keep = {i for i, _, c in brute_classes([(i, r["text"]) for i, r in rows.items()], 5, 80, 100) if i == c}
    rows = {i: r for i, r in rows.items() if i in keep and not brute_hits(r["text"], items)}
    got = {r["doc_id"]: r.asDict() for r in cp.run(spark, sf).collect()}
    assert set(got) == set(rows) and len(cp.STAGES) == 5
    e = Encoder(PieceModel(model_bytes()))
    for i, r in rows.items():
        assert {k: got[i][k] for k in r} == r
        assert got[i]["ids"] == e.encode(pa.array([r["text"]])).to_pylist()[0]


def test_pipeline_stages_keep_columns_and_odd_rows(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (7, "w " * 50_000, "en", "s", 100_000)] * 2, docs.schema)
    both = docs.unionByName(odd)
    for name, stage in cp.STAGES:
        out = stage(spark, both, sf)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert name == cp.STAGES[-1][0] or len(out.columns) == len(docs.columns)
        out.collect()
        assert stage(spark, both.limit(0), sf).count() == 0
    copies = cp.near_copies(spark, both, sf).collect()
    assert sum(r["doc_id"] == 7 for r in copies) == 1 and sum(r["doc_id"] is None for r in copies) == 4


def test_scratch_tables_go_when_their_last_reader_ends(spark):
    import os

    from rollframe.session import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    d = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(20)], "doc_id bigint, text string")
    assert jj.jaccard_classes(d).count() == 20
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before if n.startswith("llm-")] == ["llm-classes"]
