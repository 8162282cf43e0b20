"""Cases that once lost rows, cancelled digits or took the wrong branch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollframe.functions import answers as A
from rollframe.functions.arrays import reverse_scan_ragged
from rollframe.operators import balance as BL
from rollframe.operators import batch as B
from rollframe.operators import diagnostics as D
from rollframe.operators import groups as G
from rollframe.operators import metrics as M
from rollframe.operators import prep as P
from rollframe.operators import scoring as S
from rollframe.operators import testcases as C
from rollframe.operators.indexing import running_total, with_row_index
from rollframe.sources import io as IO


def test_take_outside_the_batch_fails(spark):
    d = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx long, x string")
    ok = spark.createDataFrame([(1, 0), (1, 1)], "take_idx long, take_pos long")
    assert [r["x"] for r in B.take_rows(d, ok).orderBy("take_pos").collect()] == ["b", "b"]
    with pytest.raises(Exception, match="no row at position"):
        B.take_rows(d, spark.createDataFrame([(0, 0), (9, 1)], "take_idx long, take_pos long")).collect()


def test_reorder_needs_a_permutation(spark):
    d = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx long, x string")
    perm = lambda *p: spark.createDataFrame(p, "old_idx long, new_idx long")
    assert [r["x"] for r in B.reorder_rows(d, perm((0, 1), (1, 0))).orderBy("row_idx").collect()] == ["b", "a"]
    for bad in (perm((0, 0)), perm((0, 0), (5, 1))):
        with pytest.raises(Exception, match="don't match"):
            B.reorder_rows(d, bad).collect()
    with pytest.raises(ValueError):
        B.reorder_rows(d, perm((0, 0), (0, 1)))


def test_running_total_and_index(spark):
    rows = [(i * 7 % 101, i % 5) for i in range(101)]
    d = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = {r["k"]: (r["t"], r["i"]) for r in with_row_index(running_total(d, "k", F.col("v"), "t"), "k", "i").collect()}
    total = 0
    for i, (k, v) in enumerate(sorted(rows)):
        assert got[k] == (total, i)
        total += v
    assert with_row_index(d.limit(0), "k").count() == 0


def test_masked_variance_keeps_its_digits(spark):
    rows = [(1, [1e8 + 1, 1e8 + 2], [1, 1]), (1, [1e8 + 3, 1e8 + 4, 0.0], [1, 1, 0])]
    r = G.masked_stats(spark.createDataFrame(rows, "batch_id long, v array<double>, m array<int>"), "v", "m").first()
    # the mean has the 1e-8 of its divisor, which at this size shifts it by a quarter
    assert r["var"] == pytest.approx(1.75, abs=0.01)
    with pytest.raises(Exception, match="empty mask"):
        G.masked_stats(spark.createDataFrame([(1, [1.0], [0])], "batch_id long, v array<double>, m array<int>"), "v", "m").collect()


def test_reverse_scan_of_ragged_rows():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 5, 16_000, 0, 3] + [4] * 50
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    x, c = rng.normal(size=offsets[-1]), rng.uniform(0, 1, offsets[-1])
    y = reverse_scan_ragged(x, c, offsets)
    for a, b in zip(offsets[:-1], offsets[1:]):
        carry = 0.0
        for t in range(b - 1, a - 1, -1):
            carry = x[t] + c[t] * carry
            assert y[t] == pytest.approx(carry)


def test_preference_loss_of_large_margins(spark):
    rows = [("g", [900.0], 0.0, [1]), ("g", [1.0], 1.0, [1])]
    d = spark.createDataFrame(rows, "uid string, s array<double>, acc double, m array<int>")
    assert D.dpo_group_loss(d, "s", "acc", "m", 1.0).first()[0] == pytest.approx(899.0)


def brute_pairs(rows):
    per = {}
    for g, o, s, a in rows:
        per.setdefault(g, []).append((o, s, a))
    out = []
    for items in per.values():
        items.sort()
        num = den = 0.0
        for i in range(len(items)):
            for j in range(i + 1, len(items)):
                (_, s, a), (_, t, b) = items[i], items[j]
                num += abs(a - b) * ((s - t > 0) == (a - b > 0))
                den += abs(a - b)
        if len(items) > 1:
            out.append(0.5 if den == 0 else num / den)
    return sum(out) / len(out)


@pytest.mark.parametrize("levels", [2, 500])
def test_pairwise_accuracy_of_any_accuracies(spark, levels):
    rng = np.random.default_rng(levels)
    rows = [(int(rng.integers(0, 9)), i, float(rng.normal()), int(rng.integers(0, levels)) / levels) for i in range(120)] + [(99, 999, 1.0, 1.0)]
    d = spark.createDataFrame([(g, o, [s], a, [1]) for g, o, s, a in rows], "uid long, o long, s array<double>, acc double, m array<int>")
    assert D.pairwise_accuracy(d, "s", "acc", "m", order_col="o").first()[0] == pytest.approx(brute_pairs(rows))


def test_choices_beyond_eight_have_letters(spark):
    d = spark.createDataFrame([(1, "gold", [f"d{i}" for i in range(20)])], "i long, g string, d array<string>")
    r = P.shuffled_choices(d, "i", "g", "d").first()
    assert r["choices"][ord(r["answer"]) - 65] == "gold"
    with pytest.raises(Exception, match="more choices than letters"):
        P.shuffled_choices(spark.createDataFrame([(1, "g", [f"d{i}" for i in range(30)])], "i long, g string, d array<string>"), "i", "g", "d").collect()


def test_log_reader_keeps_extra_columns(spark, tmp_path):
    d = spark.createDataFrame([("a", "b", 1.0, 3, "x"), ("c", "d", 0.0, 4, "y")], "input string, output string, score double, step int, more string")
    IO.write_generations_jsonl(d, str(tmp_path / "log"))
    back = IO.read_rollout_log(spark, str(tmp_path / "log"))
    assert sorted(r["more"] for r in back.collect()) == ["x", "y"]


def test_strict_box_and_route_order(spark):
    d = spark.createDataFrame([("math_testcase", "\\boxed{4}", "4", 1), ("math_x", "\\boxed x$ then \\boxed{4}", "4", 2),
                               ("numina_aops_forum", "so \\boxed{\\frac{1}{2}}.", "\\frac12", 3), ("Maxwell-Jia/AIME_2024", "\\boxed{7}", "7", 4),
                               ("apps", "code", "", 5)], "data_source string, response string, ground_truth string, response_id long")
    strict = [r[0]["pred"] for r in d.select(A.score_strict_box("response", F.col("ground_truth"))).collect()]
    assert strict[1] == "4"
    ran = spark.createDataFrame([(1, 0.25)], "response_id long, score double")
    got = {r["response_id"]: (r["scorer"], r["score"]) for r in S.score_by_source(d, executed=ran).collect()}
    assert got[1] == ("testcase", 0.25) and got[5] == ("code", 0.0)
    assert got[3] == ("prime_math", 1.0) and got[4] == ("contest_math", 1.0)


def test_harness_checks(spark):
    codes = ["", "def generate_input_1():\n    pass", "def generate_input_1():\n    pass\ndef check_output(a):\n    return 1 # assert",
             "def generate_input_1():\n    pass\ndef check_output(a):\n    assert a", "class X:\n    def generate_input_1(self):\n        pass"]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(codes)] + [(9, None)], "i long, c string")
    assert [r["ok"] for r in d.orderBy("i").select(C.validate_harness_text("c").alias("ok")).collect()] == [False, True, False, True, False, False]


def test_majority_bootstrap_of_a_certain_vote(spark):
    d = spark.createDataFrame([(1, i, "a" if i else "b", 1.0 if i else 0.0) for i in range(9)], "uid long, o long, p string, v double")
    rows = {r["n"]: r for r in M.majority_at_n_bootstrap(d, ["uid"], "p", "v", "o", n_bootstrap=300).collect()}
    assert sorted(rows) == [2, 4, 8, 9] and rows[9]["maj_mean"] > rows[2]["maj_mean"] - 0.05
    np.random.seed(42)
    draws = np.random.choice(9, size=(300, 2))
    want = np.mean([0.0 if x[0] == 0 else 1.0 for x in draws])
    assert rows[2]["maj_mean"] == pytest.approx(want)


def test_balance_spread_is_bounded(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(n)) for i, n in enumerate(rng.pareto(1.2, 400) * 50 + 1)]
    d = spark.createDataFrame(rows, "i long, n long")
    sums = [r["s"] for r in BL.balance_partitions(d, 8, "n", "i").groupBy("part").agg(F.sum("n").alias("s")).collect()]
    assert max(sums) - min(sums) <= max(n for _, n in rows)
    with pytest.raises(ValueError, match="no training batch"):
        BL.balance_in_batches(d.withColumn("b", F.lit(1)), 4, "n", "i", "b", max_rows=10)
