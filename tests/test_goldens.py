"""Hand-computed goldens (reference test values quoted in FIXTURES.md) and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollframe.functions import answers as A
from rollframe.operators import batch as B
from rollframe.operators import groups as G
from rollframe.operators import outcomes as O
from rollframe.operators import tokens as TK
from rollframe.operators.indexing import with_row_index


def _labels(df, col="labels", key="row_idx"):
    return [r[col] for r in df.orderBy(key).collect()]


@pytest.fixture
def abc(spark):
    df = spark.createDataFrame([(1, [1, 2], "a"), (2, [3, 4], "b"), (3, [5, 6], "c")], "idx long, obs array<long>, labels string")
    return with_row_index(df, "idx")


def test_repeat_interleave_and_tile(abc):
    assert _labels(B.repeat_rows(abc, 2, interleave=True)) == list("aabbcc")
    assert _labels(B.repeat_rows(abc, 2, interleave=False)) == list("abcabc")


@pytest.mark.parametrize("d,expected", [(2, "abca"), (3, "abc"), (7, "abcabca")])
def test_pad_to_divisor(abc, d, expected):
    padded, pad = B.pad_to_divisor(abc, d)
    assert "".join(_labels(padded)) == expected
    assert pad == len(expected) - 3
    assert "".join(_labels(B.unpad(padded))) == "abc"


def test_fold_unfold(abc):
    rep = B.repeat_rows(abc, 2, interleave=True)
    folded = B.fold_groups(rep, 2)
    groups = [[it["labels"] for it in r["items"]] for r in folded.orderBy("group_idx").collect()]
    assert groups == [["a", "a"], ["b", "b"], ["c", "c"]]
    reordered = folded.withColumn("group_idx", F.when(F.col("group_idx") == 0, 2).otherwise(F.col("group_idx") - 1))
    un = B.unfold_groups(reordered)
    assert [r["labels"] for r in un.orderBy("group_idx", "__pos").collect()] == list("bbccaa")


def test_reorder(spark):
    df = with_row_index(spark.createDataFrame([(i + 1, c) for i, c in enumerate("abcdef")], "obs long, labels string"), "obs")
    idx = [3, 4, 2, 0, 1, 5]
    perm = spark.createDataFrame([(new, old) for new, old in enumerate(idx)], "new_idx long, old_idx long")
    out = B.reorder_rows(df, perm).orderBy("row_idx").collect()
    assert [r["obs"] for r in out] == [4, 5, 3, 1, 2, 6]
    assert "".join(r["labels"] for r in out) == "decabf"


def test_union_columns_conflict_fails(abc):
    other = abc.select("row_idx", F.when(F.col("labels") == "b", "x").otherwise(F.col("labels")).alias("labels"))
    with pytest.raises(Exception):
        B.union_columns(abc, other).collect()
    ok = B.union_columns(abc.select("row_idx", "labels"), abc.select("row_idx", "labels", "obs"))
    assert ok.count() == 3


def test_chunk_requires_divisor(abc):
    with pytest.raises(ValueError):
        B.chunk_rows(abc, 2)


def test_eos_mask_goldens(spark):
    df = spark.createDataFrame([([20, 10, 34, 1, 0, 0, 0],), ([78, 0, 76, 2, 1, 0, 0],), ([23, 98, 1, 0, 0, 0, 0],),
                                ([33, 3, 98, 45, 1, 0, 0],)], "ids array<int>")
    one = [r[0] for r in df.select(TK.eos_response_mask("ids", 1)).collect()]
    two = [r[0] for r in df.select(TK.eos_response_mask("ids", [1, 2])).collect()]
    assert one == [[1, 1, 1, 1, 0, 0, 0], [1, 1, 1, 1, 1, 0, 0], [1, 1, 1, 0, 0, 0, 0], [1, 1, 1, 1, 1, 0, 0]]
    assert two == [[1, 1, 1, 1, 0, 0, 0], [1, 1, 1, 1, 0, 0, 0], [1, 1, 1, 0, 0, 0, 0], [1, 1, 1, 1, 1, 0, 0]]


def test_gsm8k_extraction(spark):
    rows = [("so #### 1,234", "1234", 1.0), ("#### -5.", "-5.", 1.0), ("no marker 12", "12", 0.0),
            ("#### 7 and #### 8", "8", 0.0)]
    df = spark.createDataFrame(rows, "t string, g string, e double")
    got = [r[0] for r in df.select(A.score_hash_answer("t", "g")).collect()]
    assert got == [r[2] for r in rows]
    flex = [r[0] for r in spark.createDataFrame([("a 1 b 2.5 .",), ("...",), ("none",)], "t string")
            .select(A.hash_answer_flexible("t")).collect()]
    assert flex == ["2.5", "...", None]


def test_boxed_math(spark):
    rows = [("x \\boxed{\\frac{1}{2}} y", "\\frac12", 1.0), ("\\boxed{0.5}", "\\frac{1}{2}", 1.0),
            ("\\boxed{{a}{b}}", "{a}{b}", 1.0), ("\\fbox{3}", "3", 0.0), ("\\boxed 42$ tail", "42", 1.0),
            ("\\boxed{3/4}", "\\frac{3}{4}", 1.0), ("\\boxed{k = 5}", "5", 1.0), ("none", "1", 0.0)]
    df = spark.createDataFrame(rows, "t string, g string, e double")
    assert [r[0] for r in df.select(A.score_boxed_math("t", "g")).collect()] == [r[2] for r in rows]


def test_multiple_choice(spark):
    df = spark.createDataFrame([("Answer: B", "B"), ("answer :$c$", "C"), ("nothing", "A")], "t string, g string")
    assert [r[0] for r in df.select(A.score_multiple_choice("t", "g")).collect()] == [1.0, 0.0, 0.0]


def _exec(spark, rows):
    return spark.createDataFrame(rows, "uid long, response_id long, input_idx int, good_status string, good_output string, "
                                       "bad_status string, bad_output string, check_good boolean, check_bad boolean")


def test_outcome_ladder(spark):
    rows = [
        # r1: good errs on input 2 -> FailGood @2
        (1, 1, 1, "Correct", "1", "Correct", "1", True, True), (1, 1, 2, "RuntimeError", None, "Correct", "2", True, True),
        # r2: all equal, checks pass -> PassGoodPassBad
        (1, 2, 1, "Correct", "1", "Correct", " 1\n", True, True),
        # r3: all equal, a good check fails -> FailGood
        (1, 3, 1, "Correct", "1", "Correct", "1", False, True),
        # r4: diff, good check fails -> GoodInputFailGood
        (1, 4, 1, "Correct", "1", "Correct", "2", False, False),
        # r5: diff, bad fails on the differing input -> PassGoodFailBad
        (1, 5, 1, "Correct", "1", "Correct", "2", True, False), (1, 5, 2, "Correct", "3", "Correct", "3", True, True),
        # r6: diff via bad error, and bad passes? bad error always fails -> PassGoodFailBad
        (1, 6, 1, "Correct", "1", "TimeoutError", None, True, True),
        # r7: diff but bad passes the check on all non-equal inputs -> GoodInputPassGoodPassBad
        (1, 7, 1, "Correct", "1", "Correct", "2", True, True),
        # r8: good timeout only + undecidable -> no diff -> PassGoodPassBad
        (1, 8, 1, "TimeoutError", None, "Correct", "5", True, True), (1, 8, 2, "Correct", "1", "Correct", None, True, True),
    ]
    out = {r["response_id"]: (r["reward_type"], r["fail_index"])
           for r in O.classify_test_outcome(_exec(spark, rows)).collect()}
    assert out[1] == ("FailGood", 2)
    assert out[2][0] == "PassGoodPassBad"
    assert out[3] == ("FailGood", 1)
    assert out[4] == ("GoodInputFailGood", 1)
    assert out[5][0] == "PassGoodFailBad"
    assert out[6][0] == "PassGoodFailBad"
    assert out[7][0] == "GoodInputPassGoodPassBad"
    assert out[8][0] == "PassGoodPassBad"


def test_aggregate_ladder(spark):
    df = spark.createDataFrame([(1, "FormatError", -1.0), (1, "FormatError", -1.0), (2, "FailGood", 0.0), (2, "PassGoodPassBad", 0.0),
                                (3, "PassGoodFailBad", 1.0), (3, "FailGood", 0.0), (4, "PassGoodFailBad", 1.0),
                                (4, "GoodInputPassGoodPassBad", 0.1)], "k long, reward_type string, score double")
    out = {r["k"]: (r["reward_type"], r["score"]) for r in O.aggregate_outcomes(df, ["k"]).collect()}
    assert out == {1: ("FormatError", -1.0), 2: ("FailGood", 0.0), 3: ("GoodInputFailGood", 0.0), 4: ("PassGoodFailBad", 0.1)}


def test_grpo_singleton_and_centering(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1, 1]), (1, [0.0, 0.0], [1, 1]), (2, [3.0], [1])],
                               "uid long, token_level_rewards array<double>, response_mask array<int>")
    out = G.adv_grpo(df).collect()
    by = sorted((r["uid"], r["advantages"]) for r in out)
    std = math.sqrt(0.5)
    assert by[0][1][0] == pytest.approx(-0.5 / (std + 1e-6))
    assert by[1][1][0] == pytest.approx(0.5 / (std + 1e-6))
    assert by[2][1] == [pytest.approx(3.0 / (1 + 1e-6))]
    rloo = {r["uid"]: r["advantages"] for r in G.adv_rloo(df).collect() if r["uid"] == 2}
    assert rloo[2] == [3.0]


def test_gae_matches_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(6):
        L = int(rng.integers(3, 9))
        r = rng.normal(size=L).tolist()
        v = rng.normal(size=L).tolist()
        rows.append((i, 0, r, v, [1] * L))
    df = spark.createDataFrame(rows, "response_id long, batch_id long, token_level_rewards array<double>, values array<double>, response_mask array<int>")
    out = {r["response_id"]: r["returns"] for r in G.adv_gae(df, gamma=0.9, lam=0.8).collect()}
    for i, _, r, v, _ in rows:
        last, adv = 0.0, []
        for t in reversed(range(len(r))):
            nv = v[t + 1] if t + 1 < len(r) else 0.0
            last = r[t] + 0.9 * nv - v[t] + 0.9 * 0.8 * last
            adv.append(last)
        ret = [a + b for a, b in zip(reversed(adv), v)]
        assert out[i] == pytest.approx(ret)


def test_row_index_is_dense(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5000)
    idx = with_row_index(df, "k").select("row_idx", "k").collect()
    assert sorted(r["row_idx"] for r in idx) == list(range(5000))
    assert all(r["row_idx"] == r["k"] for r in idx)
