"""Prefix trie of conversations against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollframe.llm.prefix_trie import TernaryTree, TrieParams, conversation_lengths, encoded_turns, ends_digests, prefix_trie, spliced

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(of) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(of), len(p), min(members[p[:-1]]) if p else -1, len(of), children[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(map(str, sorted(c for c in of if len(convs[c]) == len(p)))).encode()).hexdigest()) for p, of in members.items())


def rows_of(trie):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in ends_digests(trie).select(*cols).collect())


def conversations(seed, n, turns, words):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, turns)):
            rows.append((c * rng.choice([1, 1, 3]), t, rng.choice(["user", "assistant"]), rng.choice(words)))
    return [(c, i, r, x) for i, (c, _, r, x) in enumerate(rows)]


@pytest.mark.parametrize("params", [TrieParams(), TrieParams(segment=2, shard_turns=40, ends_run=3), TrieParams(segment=3, shard_turns=7, ends_run=1)])
def test_trie_against_prefixes(spark, params):
    rows = conversations(3, 80, 9, ["a", "b", "é", "", "long " * 30])
    rows += [(1000 + c, t, "user", "ab"[t % 2]) for c in range(60) for t in range(6)]       # copies, over many shards
    rows += [(2000 + c, t, "user", "ab"[t % 2]) for c in range(3) for t in range(6 + 6 * c)]  # their longer kin
    turns = encoded_turns(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(prefix_trie(turns, params=params)) == brute(ordered(rows))
    assert rows_of(prefix_trie(*spliced(turns), params)) == brute(rebuilt(ordered(rows)))


@pytest.mark.parametrize("seed", range(2))
def test_random_tables_in_small_shards(spark, seed):
    rows = conversations(seed, 60, 7, ["a", "b"])
    rng = random.Random(seed)
    turns = encoded_turns(spark.createDataFrame(rows, SCHEMA))
    params = TrieParams(segment=rng.randint(1, 4), shard_turns=rng.randint(5, 60), ends_run=rng.randint(1, 4))
    assert rows_of(prefix_trie(*spliced(turns), params)) == brute(rebuilt(ordered(rows)))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (5, None, "user", "first"), (5, 0, None, "a"), (5, 1, "user", None), (6, 3, "", ""), (-7, 0, "user", "a"),
            (11, 0, "us", "era"), (12, 0, "user", "a"), (13, 0, "", "3"), (9_223_372_036_854_775_807, 1, "user", "z" * 200_000)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("pos", "id", "bytes", "depth", "key", "ends", "conv")})
    turns = encoded_turns(d)
    assert rows_of(prefix_trie(turns)) == brute(ordered(rows))
    assert prefix_trie(encoded_turns(d.limit(0))).nodes.count() == 0
    assert rows_of(prefix_trie(*spliced(encoded_turns(d.limit(0))))) == []


def test_repeated_rows_are_turns_of_their_own(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    got = rows_of(prefix_trie(encoded_turns(spark.createDataFrame(rows, SCHEMA))))
    assert [r[:6] for r in got] == [(1, 0, -1, 2, 1, 1), (1, 1, 1, 2, 1, 1), (1, 2, 1, 1, 0, 1)]


def test_conversations_without_turns_are_members_of_the_root(spark):
    turns = encoded_turns(spark.createDataFrame([(3, 0, "user", "a")], SCHEMA))
    lengths = conversation_lengths(turns).unionByName(spark.createDataFrame([(1, 0), (2, 0)], "conv bigint, n bigint"))
    none = hashlib.sha256(b"1,2").hexdigest()
    assert rows_of(prefix_trie(turns, lengths))[0] == (1, 0, -1, 3, 1, 1, 0, none)


def test_one_conversation_of_very_many_turns(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(300)] + [(2, t, "user", f"t{t}") for t in range(150)]
    got = rows_of(prefix_trie(encoded_turns(spark.createDataFrame(rows, SCHEMA)), params=TrieParams(segment=50)))
    assert got == brute(ordered(rows))


def test_median_insertion_keeps_siblings_balanced():
    tree = TernaryTree()
    tree.insert_sorted([([i], [1]) for i in range(1023)])

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.lower[node]), height(tree.higher[node]))

    assert height(tree.inside[0]) == 10
