"""Registered queries of grading, test-case, token and metric operators that work on texts with
code blocks, test-case lists and free-text answers, which Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.functions import answers as A
from rollframe.operators import groups as G
from rollframe.operators import metrics as M
from rollframe.operators import prep as P
from rollframe.operators import scoring as S
from rollframe.operators import testcases as C
from rollframe.operators import tokens as TK
from rollframe.plans import tables as T
from rollframe.plans.catalog import ROLLOUTS_SQL, TOKENS_SQL, register, r6, r6a, with_
from rollframe.plans.q_groups import _rs, _whiten_sql

# ---------------------------------------------------------------------------
# Responses with code, from orders: the kind is o_orderkey mod 9
# ---------------------------------------------------------------------------
CODE_KINDS = T.CODE_KINDS


def _sql_text(t: str) -> str:
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in t.split("\\n"))


CODE_SQL = ("code_texts AS (SELECT o_orderkey AS response_id, o_orderpriority AS data_source, 'Answer to ' || CAST(o_orderkey AS VARCHAR) || ':' || chr(10) || "
            f"CASE CAST(o_orderkey % {len(CODE_KINDS)} AS INTEGER) " + " ".join(f"WHEN {i} THEN {_sql_text(t)}" for i, t in enumerate(CODE_KINDS))
            + " END AS response FROM orders)")


def _code_responses(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("response_id"), F.col("o_orderpriority").alias("data_source"),
                    T.code_text(F.col("o_orderkey")).alias("response"))


_BLOCK = r"coalesce(regexp_extract_all(response, '(?s)```python\n(.*?)\n\s*```', 1)[-1], '')"


@register("extract_code_block", with_(CODE_SQL) + f"""
SELECT response_id, {_BLOCK} AS code, coalesce(regexp_extract_all(response, '(?s)```json\\n(.*?)\\n\\s*```', 1)[-1], '') AS json FROM code_texts""")
def q_extract_code_block(spark, sf_dir):
    d = _code_responses(spark, sf_dir)
    return d.select("response_id", A.extract_code_block("response").alias("code"), A.extract_code_block("response", "json").alias("json"))


@register("validate_harness_text", with_(CODE_SQL) + f"""
, c AS (SELECT response_id, {_BLOCK} AS code FROM code_texts)
SELECT response_id, code <> '' AND NOT contains(code, 'def solve(')
  AND len(list_filter(string_split(code, chr(10)), lambda l: starts_with(l, 'def generate_input_'))) > 0
  AND (len(list_filter(string_split(code, chr(10)), lambda l: starts_with(l, 'def check_output('))) = 0
       OR len(list_filter(string_split(code, chr(10)), lambda l: contains(string_split(string_split(string_split(l, '#')[1], '"')[1], '''')[1], 'assert'))) > 0) AS ok
FROM c""")
def q_validate_harness_text(spark, sf_dir):
    d = _code_responses(spark, sf_dir)
    return d.select("response_id", C.validate_harness_text(A.extract_code_block("response"), "solve").alias("ok"))


@register("testcase_style_share", with_(CODE_SQL) + r"""
, c AS (SELECT data_source, coalesce(regexp_extract_all(response, '(?s)```python\n(.*?)\n```', 1)[-1], '') AS code FROM code_texts)
, f AS (SELECT data_source,
    CASE WHEN regexp_matches(lower(code), 'brute_|brute-|\bbrute\b') OR regexp_matches(lower(code), '^\s*def\s+\w*correct\w*\s*\(') THEN 1.0e0 ELSE 0.0e0 END AS b,
    CASE WHEN len(list_filter(string_split(code, chr(10)), lambda l: contains(l, 'assert')
       AND regexp_matches(string_split(string_split(l, '#')[1], '"')[1], '!=|>|<|check|valid'))) > 0 THEN 1.0e0 ELSE 0.0e0 END AS p FROM c)
SELECT data_source, round(avg(b), 6) AS brute_force_share, round(avg(p), 6) AS property_share, 0.0e0 AS complex_input_share
FROM f GROUP BY GROUPING SETS ((), (data_source))""")
def q_testcase_style_share(spark, sf_dir):
    d = M.testcase_style_share(_code_responses(spark, sf_dir), "response")
    return d.select("data_source", r6("brute_force_share").alias("brute_force_share"), r6("property_share").alias("property_share"), "complex_input_share")


# ---------------------------------------------------------------------------
# Test-case lists, from lineitem
# ---------------------------------------------------------------------------
def _case_lists(spark, sf_dir):
    """One JSON list per order, faulty in a way that o_orderkey mod 7 tells."""
    li = T.table(spark, sf_dir, "lineitem")
    q, p = F.col("l_quantity").cast("bigint").cast("string"), F.col("l_linenumber").cast("string")
    kind = F.col("l_orderkey") % 7
    case = (F.when(kind == 1, F.concat(F.lit('{"input_str": "'), q, F.lit('"}')))
            .when(kind == 5, F.concat(F.lit('{"input_str": "'), q, F.lit('", "expected_output": '), p, F.lit("}")))
            .when(kind == 6, F.concat(F.lit('{"input_args": {"x": '), q, F.lit('}, "expected_output": '), p, F.lit("}")))
            .otherwise(F.concat(F.lit('{"input_str": "'), q, F.lit('", "expected_output": "'), p, F.lit('"}'))))
    li = li.select("l_orderkey", F.struct("l_linenumber", case.alias("c")).alias("c"))
    g = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda s: s["c"]), ", ").alias("items"))
    kind = F.col("l_orderkey") % 7
    text = (F.when(kind == 2, F.concat(F.lit('{"a": ['), "items", F.lit("]}"))).when(kind == 3, F.lit("[]"))
            .when(kind == 4, F.concat(F.lit("["), "items")).otherwise(F.concat(F.lit("["), "items", F.lit("]"))))
    return g.select(F.col("l_orderkey").alias("response_id"), text.alias("testcase"))


@register("validate_io_testcases", """SELECT DISTINCT l_orderkey AS response_id, l_orderkey % 7 = 0 AS io_ok, l_orderkey % 7 = 6 AS call_ok FROM lineitem""")
def q_validate_io_testcases(spark, sf_dir):
    d = _case_lists(spark, sf_dir)
    return d.select("response_id", C.validate_io_testcases("testcase").alias("io_ok"), C.validate_io_testcases("testcase", "functional").alias("call_ok"))


@register("dedupe_testcases", """SELECT l_suppkey, pos, l_quantity, l_discount FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY pos) AS rn FROM (
    SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS pos, l_quantity, l_discount,
      row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem) WHERE k = 1) WHERE rn <= 5""")
def q_dedupe_testcases(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_quantity", "l_discount")
    return C.dedupe_testcases(li, "l_suppkey", "pos", "l_quantity", 5)


def _outputs(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    a, b = F.col("l_orderkey").cast("string"), F.col("l_extendedprice").cast("string")
    want = F.concat(a, F.lit("\n"), b)
    k = F.col("l_partkey") % 8
    near = (F.col("l_extendedprice") * (1 + 1e-7)).cast("string")
    got = (F.when(k == 0, want).when(k == 1, F.concat(F.lit(" "), a, F.lit(" \n"), b, F.lit(" "))).when(k == 2, F.concat(a, F.lit("\n\n"), b, F.lit("\n")))
           .when(k == 3, F.concat(a, F.lit("\n"), near)).when(k == 4, F.concat((F.col("l_orderkey") + 1).cast("string"), F.lit("\n"), b))
           .when(k == 5, a).when(k == 6, F.concat(a, F.lit("\nx"))))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", got.alias("got"), want.alias("want"))


@register("compare_test_outputs", """SELECT l_orderkey, l_linenumber, l_partkey % 8 <= 3 AS ok FROM lineitem""")
def q_compare_test_outputs(spark, sf_dir):
    return _outputs(spark, sf_dir).select("l_orderkey", "l_linenumber", C.compare_test_outputs("got", "want").alias("ok"))


# ---------------------------------------------------------------------------
# Free-text answers, from events: the kind is event_id mod 12
# ---------------------------------------------------------------------------
ANSWER_KINDS = [  # text before the number, text after it, what is extracted around it, matched
    ("We add both. The answer is ", ".", "", ".", True),
    ("Hence ", " is the answer", "Hence ", "", True),
    (r"So $\boxed{\frac{", r"}{2}}$ holds", r"\frac{", "}{2}", True),
    ("Total: x = ", " cm", "", " cm", True),
    ("nothing but ", " here", "nothing but ", " here", False),
    ("Answer: $", "$ dollars. Done now", "$", "$ dollars", True),
    ("We get 1,", "", "1,", "", True),
    (r"It is \boxed{ (1, ", r"] } or so", "(1, ", "]", True),
    (r"THE ANSWERS ARE \fbox{", "}", "", "}", True),
    ("so it must be ", "\nand no more", "", "\nand no more", True),
    (r"\boxed{a} \boxed{", r"", r"\boxed{a} \boxed{", "", False),
    ("it is ", " is answer to all", "", "", True),
]


def _answers(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events")
    a = F.floor("value").cast("bigint").cast("string")
    text = F.lit(None).cast("string")
    for i, (pre, post, *_) in enumerate(ANSWER_KINDS):
        text = F.when(F.col("event_id") % len(ANSWER_KINDS) == i, F.concat(F.lit(pre), a, F.lit(post))).otherwise(text)
    return ev.select("event_id", a.alias("a"), text.alias("text"))


def _answer_sql(cell) -> str:
    lit = lambda s: " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in s.split("\n"))
    return (f"CASE CAST(event_id % {len(ANSWER_KINDS)} AS INTEGER) "
            + " ".join(f"WHEN {i} THEN {cell(k, lit)}" for i, k in enumerate(ANSWER_KINDS)) + " END")


_BOXED_FBOX = 8  # braces after \fbox close: the content alone is left


@register("extract_final_answer", "WITH e AS (SELECT event_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS a FROM events) SELECT event_id, "
          + _answer_sql(lambda k, lit: f"{lit(k[2])} || a || {lit('' if k[0].startswith('THE ANSWERS') else k[3])}") + " AS answer, "
          + _answer_sql(lambda k, lit: "true" if k[4] else "false") + " AS matched FROM e")
def q_extract_final_answer(spark, sf_dir):
    d = _answers(spark, sf_dir).select("event_id", A.extract_final_answer("text").alias("x"))
    return d.select("event_id", "x.answer", "x.matched")


UNIT_KINDS = [  # text before the number, text after it, normal form before and after
    (r"\text{", " Apples}", "", " apples"), (r"\$", "", "", ""), ("", "%", "", ""), ("", " cm^2", "", ""), ("1 and ", "", "1 , ", ""),
    ("", " million", "", " *10^6"), ("{", "}", "", ""), ("", ".0", "", ""), ("2,", ",000", None, None), (r"\frac{", "}{7}", "", "/7"),
    ("- ", "", "-", ""), ("3 ", "/4", "3+", "/4"), (r"", r"^ \circ", "", ""), ("(", ", 5]", "(", ", 5]"),
]


def _unit_texts(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events")
    n = (F.floor("value").cast("bigint") % 900 + 100)
    text = F.lit(None).cast("string")
    for i, (pre, post, *_) in enumerate(UNIT_KINDS):
        text = F.when(F.col("event_id") % len(UNIT_KINDS) == i, F.concat(F.lit(pre), n.cast("string"), F.lit(post))).otherwise(text)
    return ev.select("event_id", n.alias("n"), text.alias("text"))


def _units_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for i, (_, _, a, b) in enumerate(UNIT_KINDS):
        rows.append(f"WHEN {i} THEN " + (f"CAST(2000000 + CAST(n AS BIGINT) * 1000 AS VARCHAR)" if a is None else f"{q(a)} || n || {q(b)}"))
    return f"CASE CAST(event_id % {len(UNIT_KINDS)} AS INTEGER) " + " ".join(rows) + " END"


@register("normalize_units_text", "WITH e AS (SELECT event_id, CAST(CAST(floor(value) AS BIGINT) % 900 + 100 AS VARCHAR) AS n FROM events) "
          f"SELECT event_id, {_units_sql()} AS normal FROM e")
def q_normalize_units_text(spark, sf_dir):
    return _unit_texts(spark, sf_dir).select("event_id", A.normalize_units_text("text").alias("normal"))


TUPLE_KINDS = [  # truth before and after the number, given before and after it, the same?
    ("(1, ", ")", "(1,", ".0 )", False), ("(1, ", ")", "(1,  ", ")", True), ("(1, ", ")", "[1, ", ")", False), ("(1, ", ")", "(1, ", ", 2)", False),
    ("", "", "", " degrees", True), ("1,", ",000", "1", "000", True), ("", ".5", "", ".50", True), (r"\frac{1}{", "}", r"\frac1{", "}", True),
    ("2/", "", "4/", "", False), ("", "", "", ".5", False),
]


@register("score_tuple_answers", "SELECT event_id, CASE CAST(event_id % " + str(len(TUPLE_KINDS)) + " AS INTEGER) "
          + " ".join(f"WHEN {i} THEN {'true' if k[4] else 'false'}" for i, k in enumerate(TUPLE_KINDS)) + " END AS same FROM events")
def q_score_tuple_answers(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events")
    n = (F.floor("value").cast("bigint") % 900 + 100).cast("string")
    truth, given = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (a, b, c, d, _) in enumerate(TUPLE_KINDS):
        k = F.col("event_id") % len(TUPLE_KINDS) == i
        truth, given = F.when(k, F.concat(F.lit(a), n, F.lit(b))).otherwise(truth), F.when(k, F.concat(F.lit(c), n, F.lit(d))).otherwise(given)
    return ev.select("event_id", A.score_tuple_answers(given, truth).alias("same"))


@register("score_strict_box", r"""
WITH e AS (SELECT event_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS a FROM events)
SELECT event_id, CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN NULL ELSE '{' || a || '}' END AS pred,
  CASE WHEN event_id % 4 < 2 THEN 1.0e0 ELSE -1.0e0 END AS score FROM e""")
def q_score_strict_box(spark, sf_dir):
    a, k = F.floor("value").cast("bigint").cast("string"), F.col("event_id") % 4
    text = (F.when(k == 0, F.concat(F.lit("so \\boxed{"), a, F.lit("}."))).when(k == 1, F.concat(F.lit("\\boxed x$ then \\boxed{"), a, F.lit("}")))
            .when(k == 2, F.concat(F.lit("\\boxed{"), a, F.lit("}"), F.lit(" and on" * 20))).otherwise(F.concat(F.lit("\\boxed{{"), a, F.lit("}}"))))
    d = T.table(spark, sf_dir, "events").select("event_id", A.score_strict_box(text, a).alias("s"))
    return d.select("event_id", "s.pred", "s.score")


@register("custom_scorer", with_(ROLLOUTS_SQL) + """
SELECT response_id, CASE WHEN step % 7 = 0 THEN 0.0e0 ELSE CAST(pred AS DOUBLE) / 10 END AS score,
  CASE WHEN step % 7 = 0 THEN 'ValueError: no grade on this day' END AS error FROM rollouts""")
def q_custom_scorer(spark, sf_dir):
    def grade(response, truth, weight):
        if truth % 7 == 0:
            raise ValueError("no grade on this day")
        return float(response) / weight

    d = S.custom_scorer(T.rollouts(spark, sf_dir), grade, "pred", "step", weight=10)
    return d.select("response_id", "score", "error")


@register("prefer_model_scores", with_(ROLLOUTS_SQL) + """
SELECT response_id, CASE WHEN step % 2 = 0 THEN acc ELSE score END AS final_score FROM rollouts""")
def q_prefer_model_scores(spark, sf_dir):
    r = T.rollouts(spark, sf_dir).withColumn("rm_scores", F.when(F.col("step") % 2 == 0, F.col("acc")))
    return S.prefer_model_scores(r).select("response_id", "final_score")


@register("score_minerva_math", with_(ROLLOUTS_SQL) + """
SELECT response_id, CASE WHEN ok THEN 1.0e0 ELSE -1.0e0 END AS score, ok AS acc, pred FROM (
  SELECT response_id, CASE CAST(response_id % 5 AS INTEGER) WHEN 3 THEN '[INVALID]' ELSE pred END AS pred, response_id % 5 NOT IN (2, 3) AS ok FROM rollouts)""")
def q_score_minerva_math(spark, sf_dir):
    r = T.rollouts(spark, sf_dir)
    k, p = F.col("response_id") % 5, F.col("pred")
    text = (F.when(k == 0, F.concat(F.lit("Work.\nAnswer: "), p)).when(k == 1, F.concat(F.lit("answer : $x = "), p, F.lit(" \\text{ units}$")))
            .when(k == 2, F.concat(F.lit("Answer: 1\nAnswer: "), p)).when(k == 3, F.concat(F.lit("It is "), p))
            .otherwise(F.concat(F.lit("Answer: \\boxed{"), p, F.lit("}^\\circ"))))
    truth = F.when(k == 2, F.lit("none")).otherwise(p)
    return r.select("response_id", A.score_minerva(text, truth).alias("m")).select("response_id", "m.score", "m.acc", "m.pred")


# ---------------------------------------------------------------------------
# Token and group operators
# ---------------------------------------------------------------------------
@register("response_mask", with_(TOKENS_SQL) + "SELECT response_id, response_mask[33:64] AS mask FROM tokens")
def q_response_mask(spark, sf_dir):
    return T.tokens(spark, sf_dir).select("response_id", TK.response_mask_of("response_mask", 32).alias("mask"))


def _word_ids(spark, sf_dir):
    """Documents as lists of word lengths."""
    d = T.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))


_IDS_SQL = "ids AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER)) AS ids FROM documents)"


@register("pad_ragged", with_(_IDS_SQL) + """
, m AS (SELECT max(len(ids)) AS n FROM ids)
SELECT doc_id, list_concat(ids, list_transform(range(n - len(ids)), lambda i: CAST(0 AS INTEGER))) AS ids FROM ids, m""")
def q_pad_ragged(spark, sf_dir):
    return TK.pad_ragged(_word_ids(spark, sf_dir), "ids", 0, 16)


@register("truncate_rollout", with_(_IDS_SQL) + "SELECT doc_id, ids[1:64] AS ids, list_transform(ids[1:64], lambda x: CAST(1 AS INTEGER)) AS mask, ids[1:16] AS response FROM ids")
def q_truncate_rollout(spark, sf_dir):
    d = _word_ids(spark, sf_dir).withColumns({"mask": F.transform("ids", lambda _: F.lit(1)), "response": F.col("ids")})
    return TK.truncate_rollout(d, "ids", "mask", 64, "response", 16)


@register("append_response_turn", """SELECT conv_id, turn, [{'role': role, 'content': text}, {'role': 'assistant', 'content': text}] AS chat FROM conversations""")
def q_append_response_turn(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    c = c.select("conv_id", "turn", F.array(F.struct("role", F.col("text").alias("content"))).alias("chat"), F.concat("text", F.lit("</s>")).alias("response"))
    return TK.append_response_turn(c, "chat", "response", "</s>").select("conv_id", "turn", "chat")


@register("flatten_candidates", """WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS i FROM conversations)
SELECT conv_id, CAST(i AS INTEGER) AS candidate_idx, ' ' || text AS response FROM t WHERE i >= 0""")
def q_flatten_candidates(spark, sf_dir):
    """A conversation's first turn as prompt, each later turn as a candidate's transcript."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    c = T.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t")).withColumn("prompt", F.col("t")[0])
    c = c.withColumn("c", F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: F.concat(F.col("prompt"), F.lit(" "), x)))
    return TK.flatten_candidates(c, "prompt", "c").select("conv_id", "candidate_idx", "response")


@register("assemble_sequence", with_(_IDS_SQL) + """
, p AS (SELECT doc_id, ids[1:1 + doc_id % 3] AS pr, ids[2 + doc_id % 3:] AS ids FROM ids)
, r AS (SELECT doc_id, len(pr) AS k, list_concat(list_transform(range(4 - len(pr)), lambda i: CAST(0 AS INTEGER)), pr) AS prompt,
    list_transform(range(4), lambda i: CASE WHEN i < 4 - len(pr) THEN 0 ELSE 1 END) AS pm,
    list_transform(range(32), lambda i: CASE WHEN i < len(ids) THEN ids[i + 1] ELSE 0 END) AS resp FROM p)
, s AS (SELECT *, list_transform(range(32), lambda i: CASE WHEN coalesce(list_position(resp, 9), 99) - 1 >= i THEN 1 ELSE 0 END) AS rm FROM r)
SELECT doc_id, list_transform(list_concat(prompt, resp), lambda x: CAST(x AS INTEGER)) AS input_ids,
  list_transform(list_concat(pm, rm), lambda x: CAST(x AS INTEGER)) AS attention_mask,
  list_transform(list_concat(list_transform(range(4), lambda i: greatest(i - (4 - k), 0)), list_transform(range(32), lambda i: i + k)), lambda x: CAST(x AS BIGINT)) AS position_ids FROM s""")
def q_assemble_sequence(spark, sf_dir):
    """The first one to three words of a document as prompt, padded to four, the rest as response."""
    d = _word_ids(spark, sf_dir)
    k = (F.col("doc_id") % 3 + 1).cast("int")
    d = d.withColumns({"p": F.slice("ids", F.lit(1), k), "ids": F.slice("ids", k + 1, F.size("ids"))})
    pad = F.array_repeat(F.lit(0), F.lit(4) - F.size("p"))
    d = d.withColumns({"prompt": F.concat(pad, "p"), "pm": F.concat(pad, F.transform("p", lambda _: F.lit(1)))})
    out = TK.assemble_sequence(d, "prompt", "pm", "ids", 32, 0, 9)
    return out.select("doc_id", *[F.col(c).cast("array<int>").alias(c) for c in ("input_ids", "attention_mask")],
                      F.col("position_ids").cast("array<bigint>").alias("position_ids"))


@register("position_ids_multiturn", with_(_IDS_SQL) + """
SELECT doc_id, list_transform(ids, lambda x, i: CASE WHEN x % 3 = 0 THEN 0 ELSE CAST(i - 1 AS INTEGER) END) AS position_ids FROM ids""")
def q_position_ids_multiturn(spark, sf_dir):
    """Positions where words of a length that 3 divides are masked."""
    mask = F.transform("ids", lambda x: F.when(x % 3 == 0, 0).otherwise(1))
    return _word_ids(spark, sf_dir).select("doc_id", TK.position_ids_multiturn(mask).alias("position_ids"))


@register("expand_reward_to_eos", with_(TOKENS_SQL) + """
SELECT response_id, list_transform(range(32, 64), lambda i: CASE WHEN i = 15 + response_id % 49 THEN CAST(response_id AS DOUBLE) ELSE 0.0e0 END) AS token_level_scores FROM tokens""")
def q_expand_reward_to_eos(spark, sf_dir):
    t = T.tokens(spark, sf_dir).withColumn("pos", F.transform("response_mask", lambda _, i: i))
    return S.expand_reward_to_eos(t, "response_id", "pos", "response_mask", 32).select("response_id", "token_level_scores")


@register("token_process_reward", with_(TOKENS_SQL) + """
, q AS (SELECT response_id, list_sum(response_mask) AS n,
    list_transform(list_zip(log_probs, ref_log_probs, response_mask), lambda e: (e[1] - e[2]) * 0.05 * e[3]) AS q FROM tokens)
, l AS (SELECT response_id, n, list_transform(q, lambda v, i: CASE WHEN i = n THEN CASE WHEN response_id % 3 = 0 THEN 1.0 ELSE 0.0 END
      - coalesce(list_sum(q[1:CAST(n - 1 AS BIGINT)]), 0.0) ELSE v END) AS q2, q FROM q)
, s AS (SELECT response_id, n, q, """ + _rs("q2", "list_transform(q2, lambda v: 0.9)") + """ AS r FROM l)
SELECT response_id, list_transform(q, lambda v, i: CASE WHEN i < n THEN round(v, 6) + 0.0 ELSE 0.0 END) AS plain,
  list_transform(r, lambda v, i: CASE WHEN i < n THEN round(v, 6) + 0.0 ELSE 0.0 END) AS carried FROM s""")
def q_token_process_reward(spark, sf_dir):
    t = T.tokens(spark, sf_dir).withColumn("acc", F.when(F.col("response_id") % 3 == 0, 1.0).otherwise(0.0))
    d = G.token_process_reward(t, 0.05, out_col="plain")
    d = G.token_process_reward(d, 0.05, 0.9, acc_col="acc", out_col="carried")
    return d.select("response_id", r6a("plain").alias("plain"), r6a("carried").alias("carried"))


@register("adv_rloo_multi_source", with_(TOKENS_SQL) + """
, m AS (SELECT *, list_sum(list_transform(list_zip(token_level_rewards, response_mask), lambda e: e[1] * e[2])) / list_sum(response_mask) AS mean FROM tokens)
, g AS (SELECT uid, sum(mean) AS gs, count(*) AS n FROM m GROUP BY uid)
, t AS (SELECT m.*, list_transform(list_zip(token_level_rewards, response_mask), lambda e: CASE WHEN e[2] > 0 THEN
      CASE WHEN n > 1 THEN e[1] * n / (n - 1) - gs / (n - 1) ELSE e[1] END * 2.0 ELSE 0.0 END) AS x FROM m JOIN g USING (uid))
, b AS (SELECT *, """ + _rs("list_transform(list_zip(x, response_mask), lambda e: e[1] * e[2])", "list_transform(x, lambda v: 1.0)") + """ AS ret FROM t)
""" + _whiten_sql("b", "ret") + """
SELECT b.response_id, list_transform(b.ret, lambda v: round((v - mv.mu) / sqrt(mv.var + 1e-8), 6)) AS advantages FROM b JOIN mv USING (batch_id)""")
def q_adv_rloo_multi_source(spark, sf_dir):
    d = G.adv_rloo_multi_source(T.tokens(spark, sf_dir), [("token_level_rewards", "response_mask", 2.0)])
    return d.select("response_id", r6a("advantages").alias("advantages"))


@register("compute_advantage", with_(TOKENS_SQL) + """
, st AS (SELECT uid, count(*) AS n, avg(list_sum(token_level_rewards)) AS mean FROM tokens GROUP BY uid)
SELECT response_id, list_transform(response_mask, lambda m: round(
   CASE WHEN n > 1 THEN (list_sum(token_level_rewards) - mean) * n / (n - 1) ELSE list_sum(token_level_rewards) END * m, 6) + 0.0) AS advantages
FROM tokens JOIN st USING (uid)""")
def q_compute_advantage(spark, sf_dir):
    return G.compute_advantage(T.tokens(spark, sf_dir), "rloo").select("response_id", r6a("advantages").alias("advantages"))


# ---------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------
@register("timing_metrics", with_(ROLLOUTS_SQL) + """
, t AS (SELECT step, sum(10) AS p, sum(sample_idx) AS r, count(*) AS n FROM rollouts GROUP BY step)
SELECT step, 'gen' AS section, round(n * 1000.0e0 / r, 6) AS ms_per_token FROM t UNION ALL SELECT step, 'update', round(n * 500.0e0 / (p + r), 6) FROM t""")
def q_timing_metrics(spark, sf_dir):
    r = T.rollouts(spark, sf_dir)
    tokens = r.select("step", F.lit(10).alias("prompt_tokens"), F.col("sample_idx").alias("response_tokens"))
    times = r.groupBy("step").agg(F.count("*").cast("double").alias("n")).select("step", F.explode(F.array(
        F.struct(F.lit("gen").alias("section"), F.col("n").alias("seconds")),
        F.struct(F.lit("update").alias("section"), (F.col("n") / 2).alias("seconds")))).alias("s")).select("step", "s.*")
    return M.timing_metrics(times, tokens).select("step", "section", r6("ms_per_token").alias("ms_per_token"))


@register("throughput_metrics", with_(ROLLOUTS_SQL) + """
SELECT step, round(sum(sample_idx) / (count(*) / 10.0e0 * 8), 6) AS throughput FROM rollouts GROUP BY step""")
def q_throughput_metrics(spark, sf_dir):
    s = T.rollouts(spark, sf_dir).groupBy("step").agg(F.sum("sample_idx").alias("total_tokens"), (F.count("*") / 10).alias("step_seconds"))
    return M.throughput_metrics(s, 8).select("step", r6("throughput").alias("throughput"))


@register("random_split", "SELECT doc_id, true AS has_split FROM documents")
def q_random_split(spark, sf_dir):
    d = P.random_split(T.table(spark, sf_dir, "documents"), "doc_id", 80, seed=3)
    return d.select("doc_id", F.col("split").isin("train", "test").alias("has_split"))


@register("extract_nested_field", "SELECT doc_id, lang AS inner_lang, source AS listed FROM documents")
def q_extract_nested_field(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.struct(F.struct("lang").alias("inner"), F.array(F.struct("source")).alias("one")).alias("outer"))
    d = P.extract_nested_field(P.extract_nested_field(d, "outer.inner.lang", "inner_lang"), "outer.one.source", "listed")
    return d.select("doc_id", "inner_lang", "listed")


@register("render_by_variant", """SELECT o_orderkey, CASE CAST(o_orderkey % 3 AS INTEGER)
  WHEN 0 THEN 'io: c' || o_orderkey WHEN 1 THEN 'fn: c' || o_orderkey || ' {other}' ELSE 'io: bad' END AS prompt_text FROM orders""")
def q_render_by_variant(spark, sf_dir):
    k = F.col("o_orderkey")
    gt = (F.when(k % 3 == 0, F.concat(F.lit('{"bad_code": {"code": "c'), k.cast("string"), F.lit('"}}')))
          .when(k % 3 == 1, F.concat(F.lit('{"code_type": "functional", "bad_code": "c'), k.cast("string"), F.lit('"}')))
          .otherwise(F.lit('{"code_type": "input/output", "bad_code": "bad"}')))
    d = T.table(spark, sf_dir, "orders").withColumn("gt", gt)
    out = P.render_by_variant(d, "gt", {"input/output": "io: {testing_code}", "functional": "fn: {testing_code} {other}"}, {})
    return out.select("o_orderkey", "prompt_text")


@register("majority_at_n", with_(ROLLOUTS_SQL) + """
SELECT uid, CAST(unnest(list_concat(list_filter(list_transform(range(1, 40), lambda e: CAST(pow(2, e) AS BIGINT)), lambda p: p < n), [n])) AS INTEGER) AS n, true AS in_range
FROM (SELECT uid, count(*) AS n FROM rollouts GROUP BY uid)""")
def q_majority_at_n(spark, sf_dir):
    """The draws are seeded numpy, which SQL can't repeat: the sizes are compared, the values in
    the tests."""
    d = M.majority_at_n_bootstrap(T.rollouts(spark, sf_dir), ["uid"], "pred", "acc", "sample_idx", n_bootstrap=100)
    return d.select("uid", "n", ((F.col("maj_mean") >= 0) & (F.col("maj_mean") <= 1) & (F.col("maj_std") <= 0.5)).alias("in_range"))


@register("core_vs_aux", with_(ROLLOUTS_SQL) + """
, v AS (SELECT data_source, 'reward' AS var, 'mean@' || n AS metric, n FROM (SELECT DISTINCT data_source, step + 1 AS n FROM rollouts)
  UNION ALL SELECT data_source, 'acc', 'best@' || n || '/mean', n FROM (SELECT DISTINCT data_source, step + 1 AS n FROM rollouts WHERE step < 10 AND data_source <> 'view'))
, m AS (SELECT *, max(n) OVER (PARTITION BY data_source, var) AS top, max(CASE WHEN var = 'acc' THEN 1 ELSE 0 END) OVER (PARTITION BY data_source) AS has FROM v)
SELECT data_source, var, metric, CASE WHEN var = CASE WHEN has = 1 THEN 'acc' ELSE 'reward' END AND contains(metric, '@' || top) THEN 'val-core' ELSE 'val-aux' END AS metric_sec FROM m""")
def q_core_vs_aux(spark, sf_dir):
    r = T.rollouts(spark, sf_dir).select("data_source", (F.col("step") + 1).alias("n")).distinct()
    n = F.col("n").cast("string")
    v = r.select("data_source", F.lit("reward").alias("var"), F.concat(F.lit("mean@"), n).alias("metric"))
    v = v.unionByName(r.where("n <= 10 and data_source <> 'view'").select("data_source", F.lit("acc").alias("var"), F.concat(F.lit("best@"), n, F.lit("/mean")).alias("metric")))
    return M.core_vs_aux(v)


_VALID = lambda c: f"list_transform(list_filter(list_zip({c}, response_mask), lambda e: e[2] > 0), lambda e: e[1])"


@register("batch_data_metrics", with_(TOKENS_SQL) + f"""
, st AS (SELECT uid, count(*) AS n, avg(list_sum(token_level_rewards)) AS mean FROM tokens GROUP BY uid)
, a AS (SELECT t.*, list_sum(token_level_rewards) AS s, list_sum(response_mask) AS rl,
    list_transform(response_mask, lambda m: (list_sum(token_level_rewards) - CASE WHEN n = 1 THEN 0.0 ELSE mean END) * m) AS adv FROM tokens t JOIN st USING (uid))
, u AS (SELECT unnest({_VALID('adv')}) AS adv, unnest({_VALID('"values"')}) AS val FROM a)
, tok AS (SELECT avg(adv) AS am, max(adv) AS ax, min(adv) AS an, avg(val) AS vm, max(val) AS vx, min(val) AS vn,
    1 - var_samp(adv - val) / (var_samp(adv) + 1e-5) AS ev FROM u)
SELECT round(avg(s), 6) AS score_mean, round(max(s), 6) AS score_max, round(min(s), 6) AS score_min,
  round(avg(rl), 6) AS response_length_mean, CAST(max(rl) AS BIGINT) AS response_length_max, CAST(min(rl) AS BIGINT) AS response_length_min,
  round(avg(CASE WHEN rl = 64 THEN 1.0e0 ELSE 0.0e0 END), 6) AS response_length_clip_ratio,
  round(avg(64 - rl), 6) AS prompt_length_mean, CAST(max(64 - rl) AS BIGINT) AS prompt_length_max, CAST(min(64 - rl) AS BIGINT) AS prompt_length_min,
  round(avg(CASE WHEN 64 - rl = 48 THEN 1.0e0 ELSE 0.0e0 END), 6) AS prompt_length_clip_ratio,
  round(any_value(am), 6) AS adv_mean, round(any_value(ax), 6) AS adv_max, round(any_value(an), 6) AS adv_min,
  round(any_value(vm), 6) AS val_mean, round(any_value(vx), 6) AS val_max, round(any_value(vn), 6) AS val_min, round(any_value(ev), 6) AS vf_explained_var
FROM a, tok""")
def q_batch_data_metrics(spark, sf_dir):
    t = G.adv_grpo_centered(T.tokens(spark, sf_dir))
    t = G.sequence_scores(G.sequence_scores(t, "token_level_scores", "seq_score"), "token_level_rewards", "seq_reward")
    t = t.withColumn("prompt_mask", F.transform("response_mask", lambda m: 1 - m))
    m = M.batch_data_metrics(t, max_response_length=64, prompt_mask_col="prompt_mask", max_prompt_length=48)
    keep = [c for c in m.columns if not c.startswith(("reward_", "ret_"))]
    return m.select(*[c if c.endswith(("length_max", "length_min")) else r6(c).alias(c) for c in keep])


# ---------------------------------------------------------------------------
# Spellings of boxed answers, from events: the kind is event_id mod 16
# ---------------------------------------------------------------------------
BOXED_KINDS = [  # response with N for the number, truth, score
    (r"so \boxed{\frac{1}{N}}.", r"\frac{1}{N}", 1.0), (r"\boxed{\dfrac{1}{N}}", r"\frac{1}{N}", 1.0), (r"\boxed{N\text{ cm}}", "N", 1.0),
    (r"\boxed{N\%}", "N", 1.0), (r"\boxed{x=N}", "N", 1.0), (r"\boxed{\sqrt3 + N}", r"\sqrt{3}+N", 1.0), (r"N: \boxed{.5}", r"\frac{1}{2}", 1.0),
    (r"\boxed{1/N}", r"\frac{1}{N}", 1.0), (r"\boxed{\left(N, 1\right)}", "(N,1)", 1.0), (r"\boxed N$ as said", "N", 1.0), (r"\boxed{N", "N", 0.0),
    (r"\boxed{a{b}N}", "a{b}N", 1.0), (r"\boxed{N^\circ}", "N", 1.0), (r"\boxed{1} then \boxed{N}", "1", 0.0), (r"\fbox{N}", "N", 0.0),
    ("it is N", "N", 0.0),
]


@register("score_boxed_math_forms", "SELECT event_id, CASE CAST(event_id % " + str(len(BOXED_KINDS)) + " AS INTEGER) "
          + " ".join(f"WHEN {i} THEN {k[2]}e0" for i, k in enumerate(BOXED_KINDS)) + " END AS score FROM events")
def q_score_boxed_math_forms(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events")
    n = (F.floor("value").cast("bigint") % 900 + 100).cast("string")
    text, truth = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (a, b, _) in enumerate(BOXED_KINDS):
        k = F.col("event_id") % len(BOXED_KINDS) == i
        text, truth = F.when(k, F.lit(a)).otherwise(text), F.when(k, F.lit(b)).otherwise(truth)
    return ev.select("event_id", A.score_boxed_math(F.replace(text, F.lit("N"), n), F.replace(truth, F.lit("N"), n)).alias("score"))


@register("plain_latex", r"""WITH l AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS q, l_linenumber AS n FROM lineitem)
SELECT q, n, 'sqrt(' || q || ')/' || n AS nested, q || '/' || n AS bare, 'x^' || q || ' m' || n AS grouped, 'sqrt(' || q || '/sqrt(' || n || '))' AS deep, true AS same FROM l""")
def q_plain_latex(spark, sf_dir):
    """Nested fractions and roots, arguments without braces, text commands and groups."""
    d = T.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("bigint").alias("q"), F.col("l_linenumber").alias("n")).distinct()
    q, n = F.col("q").cast("string"), F.col("n").cast("string")
    lit = F.lit
    nested = F.concat(lit("\\frac{\\sqrt{"), q, lit("}}{"), n, lit("}"))
    other = F.concat(lit("\\sqrt{"), q, lit("}/"), n)
    forms = {
        "nested": nested, "bare": F.concat(lit("\\dfrac{"), q, lit("}"), n),
        "grouped": F.concat(lit("{x}^{{"), q, lit("}} \\text{m}{"), n, lit("}")),
        "deep": F.concat(lit("\\left\\sqrt[3]{\\tfrac{{"), q, lit("}}{\\sqrt{"), n, lit("}}}\\right")),
    }
    d = d.select("q", "n", *[A.plain_latex(x).alias(k) for k, x in forms.items()], A.score_tuple_answers(nested, other).alias("same"))
    return d.select("q", "n", "nested", "bare", "grouped", F.regexp_replace("deep", r"\( ", "(").alias("deep"), "same")


@register("validate_harness_strings", """SELECT o_orderkey, o_orderkey % 5 IN (0, 4) AS ok FROM orders""")
def q_validate_harness_strings(spark, sf_dir):
    """Harness programs whose functions stand in the program, in a string of several lines (after
    a comment with a quote), and in both."""
    k = F.col("o_orderkey").cast("string")
    real = F.concat(F.lit("def generate_input_"), k, F.lit("():\n    return [1]\n"))
    hidden = F.concat(F.lit("# it's no string\ndoc = \"\"\"\n"), real, F.lit("\"\"\"\n"))
    check = F.lit("def check_output(a, b):\n    return a == b\n")
    code = F.element_at(F.array(real, hidden, F.concat(real, check), F.concat(hidden, F.lit("x = 1\n")),
                                F.concat(real, F.lit("'''\n"), check, F.lit("'''\n"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", C.validate_harness_text(code).alias("ok"))
