"""Source mixing: targets, whole draws, pieces and texts, odd inputs."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rollframe.llm.mixing import MixParams, mix_sources, mixed_pieces, mixed_texts, source_targets, taken_words

WORD = re.compile("[^\x20\x09-\x0d]+")


def poured(sizes, weights, share, most):
    """Targets by rounds: share out, stop the sources above their limit, share the excess again."""
    total, left, out = share * sum(sizes), set(range(len(sizes))), {}
    while left:
        line = total / sum(weights[i] for i in left)
        above = [i for i in left if weights[i] * line > most * sizes[i]]
        if not above:
            return [out.get(i, weights[i] * line if i in left else 0) for i in range(len(sizes))]
        for i in above:
            out[i] = most * sizes[i]
            total -= out[i]
            left.discard(i)
    return [out[i] for i in range(len(sizes))]


def test_targets_against_rounds(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 7, 100, 5_000]) * rng.randint(1, 9) for _ in range(rng.randint(1, 12))]
        params = MixParams()
        s = spark.createDataFrame(list(enumerate(sizes)), "source_index bigint, size bigint")
        got = {r["source_index"]: r["target"] for r in source_targets(s, params).collect()}
        want = poured(sizes, [params.weights[i % 3] for i in range(len(sizes))], 1.5, 2)
        assert [got[i] for i in range(len(sizes))] == pytest.approx(want, rel=1e-9)


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        source = rng.choice(["hot"] * 4 + ["b", "é", "Z", None])
        rows.append((i, " ".join(f"w{i}x{j}" for j in range(rng.choice([0, 1, 5, 60, 200]))), source))
    rows += [(500, None, "b"), (501, "", None), (502, " \t\n", "hot"), (None, "a b c", "b"), (7, "again and again", "b"),
             (7, "again and again", "b"), (600, "long " * 5_000, "Z")]
    return rows


SCHEMA = "doc_id bigint, text string, source string"


def test_mix_is_whole_and_near_its_targets(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("row", "size", "source_index", "taken", "block")})
    params = MixParams(block_words=8, shard_slots=64)
    mix = mix_sources(docs, params=params)
    got = taken_words(mix).collect()
    assert Counter((r["id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(WORD.findall(t or ""))) for i, t, s in rows)
    taken, sizes, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * params.block_words
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    assert [target[s] for s in order] == pytest.approx(poured([sizes[s] for s in order], [5, 2, 1, 5, 2], 1.5, 2))
    assert all(r["source_size"] == sizes[r["source"]] for r in got)
    # every shard but the last is full, and no slot is taken twice
    slots = mix.slots.collect()
    shards = Counter(r["out_shard"] for r in slots)
    assert all(shards[k] == 64 for k in shards if k < max(shards))
    assert len({(r["source_index"], r["slot"]) for r in slots}) == len(slots)
    assert max(Counter((r["source_index"], r["block"]) for r in slots).values()) <= 2
    again = taken_words(mix_sources(docs.repartition(13), params=params)).collect()
    assert Counter((r["id"], r["taken"]) for r in again) == Counter((r["id"], r["taken"]) for r in got)


def test_texts_are_the_words_of_the_pieces(spark):
    docs = spark.createDataFrame(corpus(2), SCHEMA)
    mix = mix_sources(docs, params=MixParams(block_words=16, shard_slots=32))
    texts = mixed_texts(docs, mix).collect()
    n = {(r["source_index"], r["slot"]): r["n"] for r in mixed_pieces(mix).groupBy("source_index", "slot").agg(F.sum("n_words").alias("n")).collect()}
    assert {(r["source_index"], r["slot"]): len(r["words"]) for r in texts} == n
    counted = Counter(w for r in texts for w in r["words"] if w.startswith("w"))
    sizes = Counter(w for _, t, _ in corpus(2) for w in WORD.findall(t or "") if w.startswith("w"))
    assert max(counted.values()) <= 2 and set(counted) <= set(sizes)


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert taken_words(mix_sources(none)).count() == 0 and mix_sources(none).slots.count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], SCHEMA)
    rows = taken_words(mix_sources(blank)).collect()
    assert sorted((r["id"], r["size"], r["target"], r["taken"]) for r in rows) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    one = spark.createDataFrame([(1, "a b c", None)], SCHEMA)
    assert [(r["target"], r["taken"]) for r in taken_words(mix_sources(one)).collect()] == [(4.5, 6)]


def test_bad_parameters():
    for bad in ({"weights": ()}, {"share": 3.0}, {"block_words": 0}):
        with pytest.raises(ValueError):
            MixParams(**bad)
