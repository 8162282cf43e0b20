"""Keyed permutations are bijections, the same in Spark and in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from rollframe.functions.permute import PRIME, permuted, round_key_columns, round_keys


def plain(x, n, keys):
    a = max(1, math.ceil(math.sqrt(n)))
    b = max(1, math.ceil(n / a))

    def network(x):
        left, right, radix = x // b, x % b, (a, b)
        for i, key in enumerate(keys):
            t = (right + key) % PRIME
            left, right = right, (left + (t * t % PRIME) * t % PRIME) % radix[i % 2]
        return left * b + right

    x = network(x)
    while x >= n:
        x = network(x)
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 101, 997, 4099, 20_011])
def test_permutation_is_a_bijection(spark, n):
    for seed in (3, 4):
        keys = round_keys(seed, "epoch")
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), [F.lit(k) for k in keys])).collect()]
        assert sorted(got) == list(range(n))
        assert got == [plain(x, n, keys) for x in range(n)]


def test_keys_and_sizes_may_be_columns(spark):
    d = spark.range(1, 60).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("x"))
    d = d.withColumn("keys", F.array(*round_key_columns(F.lit(9), F.col("n"))))
    rows = d.select("n", "x", permuted(F.col("x"), F.col("n"), F.col("keys")).alias("y")).collect()
    for n in range(1, 60):
        of = {r["x"]: r["y"] for r in rows if r["n"] == n}
        assert sorted(of.values()) == list(range(n))
        assert all(y == plain(x, n, round_keys(9, n)) for x, y in of.items())


def test_large_values_stay_exact(spark):
    n = 2 ** 51 + 12_345
    d = spark.createDataFrame([(x,) for x in (0, 1, n // 2, n - 1)], "x bigint")
    keys = round_keys("large")
    got = [r[0] for r in d.select(permuted(F.col("x"), F.lit(n), [F.lit(k) for k in keys])).collect()]
    assert got == [plain(x, n, keys) for x in (0, 1, n // 2, n - 1)]


def test_several_running_totals_in_one_pass(spark):
    from rollframe.operators.indexing import running_totals

    d = spark.createDataFrame([(i, i * i) for i in range(50)], "k bigint, v bigint").repartition(7)
    got = {r["k"]: (r["n"], r["s"]) for r in running_totals(d, "k", {"n": F.lit(1), "s": F.col("v")}).collect()}
    assert got == {i: (i, sum(j * j for j in range(i))) for i in range(50)}
