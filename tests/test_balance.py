"""Largest differencing method and token budgets."""

import random

import pytest
from pyspark.sql import functions as F

from rollframe.operators import balance as BL


def sums_of(lengths, parts, k):
    sums = [0] * k
    for n, p in zip(lengths, parts):
        sums[p] += n
    return sums


def greedy(lengths, k, cap):
    sums, counts = [0] * k, [0] * k
    for n in sorted(lengths, reverse=True):
        p = min((p for p in range(k) if counts[p] < cap), key=lambda p: (sums[p], p))
        sums[p] += n
        counts[p] += 1
    return max(sums) - min(sums)


@pytest.mark.parametrize("equal", [True, False])
def test_never_wider_than_greedy_on_200_batches(equal):
    rng, narrower = random.Random(11), 0
    for _ in range(200):
        k = rng.randint(2, 8)
        n = k * rng.randint(8, 40)
        lengths = [int(rng.lognormvariate(6, 1)) for _ in range(n)]
        own = sums_of(lengths, BL.differencing_parts(lengths, k, equal), k)
        parts = BL.tight_parts(lengths, k, equal)
        sums = sums_of(lengths, parts, k)
        assert sum(sums) == sum(own) == sum(lengths) and max(own) - min(own) <= max(lengths)
        bound = greedy(lengths, k, n // k if equal else n)
        assert max(sums) - min(sums) <= min(bound, max(own) - min(own))
        if equal:
            assert {parts.count(p) for p in range(k)} == {n // k}
        narrower += max(own) - min(own) < bound
    assert narrower > (20 if equal else 120)


def test_differencing_known_case_and_edges():
    # 8 7 6 5 4 in two parts: differencing leaves 16 and 14
    assert sorted(sums_of([8, 7, 6, 5, 4], BL.differencing_parts([8, 7, 6, 5, 4], 2, False), 2)) == [14, 16]
    assert BL.differencing_parts([], 3, False) == [] and BL.differencing_parts([5], 3, False) == [0]
    assert sorted(BL.differencing_parts([0, 0, 0], 3, True)) == [0, 1, 2]


def test_whole_table_in_two_levels(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 500)) for i in range(960)]
    d = spark.createDataFrame(rows, "i bigint, n bigint").repartition(5)
    for equal in (True, False):
        s = BL.differencing_partitions(d, 8, "n", "i", equal, block_rows=64).groupBy("part").agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()
        assert sum(r["c"] for r in s) == 960 and max(r["s"] for r in s) - min(r["s"] for r in s) <= 20
        assert not equal or {r["c"] for r in s} == {120}
    with pytest.raises(ValueError, match="multiple of k"):
        BL.differencing_partitions(d, 7, "n", "i")
    assert BL.differencing_partitions(d.limit(0), 8, "n", "i").count() == 0


def test_token_budget_is_one_number_for_all_ranks(spark):
    rows = [(i, 0, i % 2, 100 if i % 2 else 10) for i in range(20)] + [(100 + i, 1, 0, None if i else 0) for i in range(3)]
    d = spark.createDataFrame(rows, "i bigint, b int, r int, n bigint")
    got = BL.token_budget_batches(d, 250, "n", "i", "b", "r").collect()
    assert len(got) == 23
    assert {r["n_micro_batches"] for r in got if r["b"] == 0} == {4} and {r["n_micro_batches"] for r in got if r["b"] == 1} == {1}
    for rank in (0, 1):
        assert {r["micro_batch"] for r in got if r["b"] == 0 and r["r"] == rank} == {0, 1, 2, 3}
    with pytest.raises(ValueError, match="longer than max_tokens"):
        BL.token_budget_batches(d, 99, "n", "i", "b", "r")
    few = spark.createDataFrame([(1, 0, 0, 9), (2, 0, 0, 9), (3, 0, 1, 1)], "i bigint, b int, r int, n bigint")
    with pytest.raises(ValueError, match="fewer rows"):
        BL.token_budget_batches(few, 9, "n", "i", "b", "r")


def test_equal_sizes_to_one_row_when_k_does_not_divide(spark):
    rng = random.Random(5)
    for n in (1, 5, 8, 9, 13, 63):
        for lengths in ([rng.randint(0, 90) for _ in range(n)], [1000] + [0] * (n - 1)):
            parts = BL.tight_parts(lengths, 8, True)
            counts = [parts.count(p) for p in range(8)]
            assert max(counts) - min(counts) <= 1 and sum(counts) == n
    rows = [(i, rng.randint(0, 500)) for i in range(331)]
    d = spark.createDataFrame(rows, "i bigint, n bigint").repartition(5)
    s = BL.differencing_partitions(d, 8, "n", "i", True, block_rows=64, divisible=False).groupBy("part").agg(
        F.count("*").alias("c"), F.sum("n").alias("s")).collect()
    assert sorted(r["c"] for r in s) == [41] * 5 + [42] * 3 and max(r["s"] for r in s) - min(r["s"] for r in s) <= 500


def test_differencing_query_places_a_table_that_8_does_not_divide(spark, tmp_path):
    from rollframe.plans import catalog, q_balance  # noqa: F401

    rows = [(i, None if i % 50 == 0 else 7 * i % 301) for i in range(605)]
    spark.createDataFrame(rows, "doc_id bigint, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["equal_size"]: r.asDict() for r in catalog.QUERIES["differencing_partitions"](spark, str(tmp_path)).collect()}
    for equal in (True, False):
        assert got[equal] == {"equal_size": equal, "n_rows": 605, "tokens": sum(n or 0 for _, n in rows), "n_parts": 8,
                              "within_longest": True, "sizes_right": True, "below_snake": True}
