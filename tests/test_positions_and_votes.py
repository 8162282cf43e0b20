"""Resuming shuffled batches, exact votes, LaTeX as plain text, terminal rewards."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollframe.functions import answers as A
from rollframe.operators import batch as B
from rollframe.operators import cursor as CU
from rollframe.operators import metrics as M
from rollframe.operators import scoring as S


def test_a_run_may_stop_after_any_batch(spark, tmp_path):
    n, size = 103, 10
    d = spark.range(n).select(F.col("id").alias("row_idx"))
    folder, orders = str(tmp_path / "cursor"), {}
    assert CU.load_cursor(spark, folder) is None
    for epoch in (0, 1):
        rows = B.epoch_batches(d, size, "row_idx", 7, True, True, n, "row_idx", epoch).collect()
        orders[epoch] = {b: sorted(r["row_idx"] for r in rows if r["batch"] == b) for b in range(10)}
        assert sorted(Counter(len(v) for v in orders[epoch].values()).items()) == [(10, 10)]
    assert orders[0] != orders[1]
    cursor = CU.BatchCursor(7)
    for done in (0, 1, 9, 10, 13):
        at = cursor.advanced(10, done) if done else cursor
        CU.save_cursor(spark, folder, at)
        again = CU.load_cursor(spark, folder)
        assert again == at == CU.BatchCursor(7, done // 10, done % 10)
        left = CU.remaining_batches(d, again, size, "row_idx", n).collect()
        assert {b: sorted(r["row_idx"] for r in left if r["batch"] == b) for b in {r["batch"] for r in left}} == {
            b: v for b, v in orders[again.epoch].items() if b >= again.offset}
    (tmp_path / "cursor" / ".half.part").write_text("{")  # what an interrupted writer leaves
    assert CU.load_cursor(spark, folder) == CU.BatchCursor(7, 1, 3)
    assert len(list((tmp_path / "cursor").glob("cursor-*.json"))) == 2


def test_permuted_batches_need_no_exchange(spark):
    d = spark.range(1000).select(F.col("id").alias("row_idx"))
    out = B.minibatch_ids(d, 100, "row_idx", seed=1, epoch=4, n=1000, index_col="row_idx")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["perm_idx"] for r in out.collect()) == list(range(1000))


def brute_chances(counts, n):
    rows = [i for i, c in enumerate(counts) for _ in range(c)]
    win = Counter()
    for draw in itertools.product(rows, repeat=n):
        c = Counter(draw)
        win[min(c, key=lambda x: (-c[x], draw.index(x)))] += 1
    return [win[i] / len(rows) ** n for i in range(len(counts))]


@pytest.mark.parametrize("counts,n", [([1], 3), ([2, 1], 2), ([2, 1, 1], 3), ([3, 2, 1], 4), ([1, 1, 1, 1], 4), ([2, 2, 1], 5), ([4, 1], 6)])
def test_plurality_against_all_draws(counts, n):
    assert M.plurality_chances(counts, n) == pytest.approx(brute_chances(counts, n), abs=1e-10)


def test_plurality_against_the_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(u, i, str(p), float(p == 1)) for u in range(3) for i, p in enumerate(rng.choice(4, 40, p=[0.4, 0.35, 0.15, 0.1]))]
    d = spark.createDataFrame(rows, "uid int, o int, p string, v double")
    exact = {(r["uid"], r["n"]): r for r in M.plurality_at_n(d, ["uid"], "p", "v").collect()}
    drawn = M.majority_at_n_bootstrap(d, ["uid"], "p", "v", "o", n_bootstrap=4000).collect()
    assert {(r["uid"], r["n"]) for r in drawn} == set(exact)
    for r in drawn:
        e = exact[r["uid"], r["n"]]
        assert abs(r["maj_mean"] - e["maj_mean"]) < 5 * max(e["maj_std"], 0.02) / math.sqrt(4000) + 1e-9


def test_votes_with_null_predictions_and_large_groups(spark):
    rows = [(1, i, None if i % 2 else "a", 1.0 if i % 2 else 0.0) for i in range(9)] + [(2, i, None, None) for i in range(3)]
    d = spark.createDataFrame(rows, "uid int, o int, p string, v double")
    exact = {(r["uid"], r["n"]): r["maj_mean"] for r in M.plurality_at_n(d, ["uid"], "p", "v").collect()}
    assert exact[1, 2] == pytest.approx(4 / 9) and exact[2, 3] is None
    assert M.majority_at_n_bootstrap(d.where("uid = 1"), ["uid"], "p", "v", "o", n_bootstrap=50).count() == 4
    assert sum(M.plurality_chances([900, 60, 30, 10], 128)) == pytest.approx(1.0)


LATEX = [
    (r"\frac{\sqrt{2}}{3}", "sqrt(2)/3"), (r"\frac12", "1/2"), (r"\frac1{72}", "1/72"), (r"\frac{1}2", "1/2"), (r"\dfrac{a+1}{b}", "a+1/b"),
    (r"1\frac{1}{2}", "1 1/2"), (r"\sqrt[3]{\frac{x^{2}}{y}}", "sqrt( x^2/y)"), (r"\sqrt3", "sqrt(3)"), (r"\text{no \textbf{way}}", "no way"),
    (r"\left( 0,\infty \right)", "( 0,inf )"), (r"\frac\pi2", "pi/2"), (r"{{{x}}}", "x"), (r"x_{i_{j}}", "x_i_j"), (r"\frac{1}{", r"\frac{1}{"),
    (r"\unknown{x}", r"\unknown{x}"), (r"\{1,2\}", r"\{1,2\}"), ("", ""), (r"\frac{\frac{1}{2}}{\frac{3}{4}}", "1/2/ 3/4"),
]


def test_nested_latex(spark):
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(LATEX)], "i int, x string")
    got = {r["i"]: r["y"] for r in d.select("i", A.plain_latex(F.col("x")).alias("y")).collect()}
    assert got == {i: b for i, (_, b) in enumerate(LATEX)}


def test_deep_and_long_latex(spark):
    deep = "{" * 300 + "x" + "}" * 300
    long = r"\frac{1}{2} + " * 8000
    d = spark.createDataFrame([(0, deep), (1, long), (2, None)], "i int, x string")
    got = {r["i"]: r["y"] for r in d.select("i", A.plain_latex(F.col("x")).alias("y")).collect()}
    assert got[0] == "x" and got[1].count("1/2") == 8000 and got[2] is None


def test_nested_answers_are_the_same(spark):
    pairs = [(r"\frac{\sqrt{2}}{3}", r"\sqrt{2}/3", True), (r"(\frac12, 3)", "(1/2, 3)", True), (r"\frac{\sqrt{2}}{3}", r"\sqrt{3}/3", False)]
    d = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in d.select(A.score_tuple_answers(F.col("a"), F.col("b")), "want").collect())


def test_terminal_reward_of_empty_responses(spark):
    d = spark.createDataFrame([(0, 0), (0, 3), (2, 3), (5, 3), (None, 2), (1, None)], "response_len int, w int").withColumn("score", F.lit(1.5))
    got = [r[0] for r in S.place_terminal_reward(d, width_col="w").select("token_level_scores").collect()]
    assert got == [[], [1.5, 0.0, 0.0], [0.0, 1.5, 0.0], [0.0, 0.0, 1.5], [1.5, 0.0], []]
    assert S.place_terminal_reward(d.limit(1)).first()["token_level_scores"] == []


def test_rows_that_need_executed_results_raise_without_them(spark):
    d = spark.createDataFrame([(1, "codecontests", "x", "y"), (2, "openai/gsm8k", "#### 3", "3")],
                              "response_id int, data_source string, response string, ground_truth string")
    with pytest.raises(Exception, match="no executed results for source codecontests"):
        S.score_by_source(d).collect()
    assert {r["response_id"]: r["score"] for r in S.score_by_source(d, on_unknown="null").collect()} == {1: None, 2: 1.0}
    ran = spark.createDataFrame([(1, 0.5)], "response_id int, score double")
    assert {r["response_id"]: r["score"] for r in S.score_by_source(d, executed=ran).collect()} == {1: 0.5, 2: 1.0}
