"""Registered dataset-preparation queries over ``documents``, ``labels``,
``events`` and ``benchmark`` (whole texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.operators import prep as P
from rollframe.plans import tables as T
from rollframe.plans.catalog import register

_CLEAN = r"replace(regexp_replace(replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ')"


def clean_sql(x: str) -> str:
    return _CLEAN.format(x=x)


@register("clean_wikihow_text", "SELECT doc_id, " + clean_sql("text") + " AS text FROM documents")
def q_clean_wikihow_text(spark, sf_dir):
    return P.clean_wikihow_text(T.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@register("to_prompt_schema", """SELECT 'docs/' || source AS data_source, 'user' AS role, text || ' Answer in one word.' AS content,
  'nlp' AS ability, 'rule' AS style, CAST(n_chars AS VARCHAR) AS ground_truth, 'train' AS split,
  row_number() OVER (ORDER BY doc_id) - 1 AS index, text AS question FROM documents""")
def q_to_prompt_schema(spark, sf_dir):
    from rollframe.operators.indexing import with_row_index
    d = with_row_index(T.table(spark, sf_dir, "documents"), "doc_id", out_col="idx")
    rec = P.to_prompt_schema(d, "text", F.concat(F.lit("docs/"), F.col("source")), "nlp", "n_chars", "train", "idx", suffix=" Answer in one word.")
    return rec.select("data_source", F.col("extra_info.index").alias("index"), F.col("prompt")[0]["role"].alias("role"),
                      F.col("prompt")[0]["content"].alias("content"), "ability",
                      F.col("reward_model.style").alias("style"), F.col("reward_model.ground_truth").alias("ground_truth"),
                      F.col("extra_info.split").alias("split"), F.col("extra_info.question").alias("question"))


@register("index_within_split", """SELECT doc_id, lang AS split, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS index FROM documents""")
def q_index_within_split(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split"))
    return P.index_within(d, "split", "doc_id").select("doc_id", "split", "index")


@register("append_instruction", "SELECT doc_id, concat_ws(' ', text, 'Let''s think step by step.') AS question FROM documents")
def q_append_instruction(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"))
    return P.append_instruction(d, "question", "Let's think step by step.")


@register("multiple_choice_records", """SELECT doc_id, """ + clean_sql(
    "source || ': ' || lang || ' ' || upper(substr(text, 1, 1)) || lower(substr(text, 2))") + """ AS query,
  list_transform(string_split(text, chr(10)), lambda e: """ + clean_sql("e") + """) AS choices, CAST(doc_id % 4 AS INTEGER) AS gold
FROM documents""")
def q_multiple_choice_records(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").withColumns({"endings": F.split("text", "\n", -1), "g": F.col("doc_id") % 4})
    return P.multiple_choice_records(d, "source", "lang", "text", "endings", "g").select("doc_id", "query", "choices", "gold")


@register("filter_labeled", """SELECT l.doc_id FROM documents d JOIN labels l USING (doc_id)
WHERE length(CASE WHEN l.quality = 1 THEN d.source ELSE '' END) > 0""")
def q_filter_labeled(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id")
    d = d.withColumn("label", F.when(F.col("quality") == 1, F.col("source")).otherwise(F.lit("")))
    return P.filter_labeled(d, "label").select("doc_id")


@register("filter_date_window", """SELECT event_id FROM events
WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-10T00:00:00' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') < '2024-01-20T00:00:00'""")
def q_filter_date_window(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return P.filter_date_window(e, "iso", "2024-01-10T00:00:00", "2024-01-20T00:00:00").select("event_id")


@register("shuffled_choices", """, x AS (SELECT item_id, string_split(text, '. ') AS w FROM benchmark)
, y AS (SELECT item_id, w, list_transform(list_sort(list_transform(w, lambda c: struct_pack(k := md5(concat_ws('|', '0', CAST(item_id AS VARCHAR), c)), c := c))), lambda s: s.c) AS choices
FROM x)
SELECT item_id, choices, chr(CAST(64 + list_position(choices, w[1]) AS INTEGER)) AS answer FROM y""".lstrip(", ").replace("x AS (", "WITH x AS (", 1))
def q_shuffled_choices(spark, sf_dir):
    b = T.table(spark, sf_dir, "benchmark").withColumn("w", F.split("text", r"\. ", -1))
    b = b.withColumns({"gold": F.try_element_at("w", F.lit(1)), "dis": F.slice("w", F.lit(2), F.size("w") - 1)})
    return P.shuffled_choices(b, "item_id", "gold", "dis").select("item_id", "choices", "answer")


@register("union_sources", """SELECT doc_id AS id, text, NULL AS quality FROM documents
UNION ALL SELECT item_id AS id, text, NULL FROM benchmark
UNION ALL SELECT doc_id AS id, NULL, quality FROM labels""")
def q_union_sources(spark, sf_dir):
    dfs = {"documents": T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"),
           "benchmark": T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"),
           "labels": T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")}
    return P.union_sources(dfs, ["documents", "benchmark", "labels"]).select("id", "text", "quality")


@register("sft_pairs_from_preferences", """SELECT doc_id, 0 AS pair_pos, text AS response FROM documents
UNION ALL SELECT doc_id, 1, source FROM documents""")
def q_sft_pairs(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chosen"), F.col("source").alias("rejected"))
    return P.sft_pairs_from_preferences(d, "doc_id", "chosen", "rejected")


@register("preference_split", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < CAST(floor((SELECT count(*) FROM documents) * 0.75) AS BIGINT)
  THEN 'train' ELSE 'test' END AS split FROM documents""")
def q_preference_split(spark, sf_dir):
    return P.preference_split(T.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@register("render_prompt", """SELECT doc_id, 'Source ' || source || ' in ' || lang || ': ' || text || ' {unknown} {{x}}' AS prompt_text FROM documents""")
def q_render_prompt(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    out = P.render_prompt(d, "Source {source} in {lang}: {text} {unknown} {{x}}",
                          {"source": "source", "lang": "lang", "text": "text"})
    return out.select("doc_id", "prompt_text")


@register("render_code_question", """SELECT item_id, 'You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests.' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) ||
  CASE WHEN item_id % 2 = 0 THEN 'You will use the following starter code to write the solution to the problem and enclose your code within delimiters.' || chr(10) || '```python' || chr(10) || 'def f' || CAST(item_id AS VARCHAR) || '():' || chr(10) || '```'
       ELSE 'Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT.```python' || chr(10) || '# YOUR CODE HERE' || chr(10) || '```' END AS question_text
FROM benchmark""")
def q_render_code_question(spark, sf_dir):
    b = T.table(spark, sf_dir, "benchmark").withColumn(
        "starter", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("def f"), F.col("item_id").cast("string"), F.lit("():"))).otherwise(F.lit("")))
    return P.render_code_question(b, "text", "starter").select("item_id", "question_text")


@register("filter_overlong_prompts", """SELECT doc_id FROM documents WHERE len(regexp_split_to_array(trim(text), '\\s+')) <= 500""")
def q_filter_overlong_prompts(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    return P.filter_overlong_prompts(d, "text", 500).select("doc_id")


@register("filter_valid_testcases", """SELECT doc_id FROM documents WHERE len(string_split(text, chr(10))) > 0
  AND list_bool_and(list_transform(string_split(text, chr(10)), lambda x: x <> ''))""")
def q_filter_valid_testcases(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").withColumn("tc", F.split("text", "\n", -1))
    return P.filter_valid_testcases(d, "tc").select("doc_id")


@register("select_row_range", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE p >= 100 AND p < 300""")
def q_select_row_range(spark, sf_dir):
    return P.select_row_range(T.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 300)


@register("split_media_segments", """SELECT doc_id, list_transform(string_split(regexp_replace(replace(text, chr(10), '<image>'), '(<image>|<video>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)),
   lambda p: CASE WHEN p = '<image>' THEN 'image' WHEN p = '<video>' THEN 'video' ELSE 'text' END) AS types
FROM documents""")
def q_split_media_segments(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").withColumn("content", F.replace(F.col("text"), F.lit("\n"), F.lit("<image>")))
    return d.select("doc_id", F.transform(P.split_media_segments("content"), lambda s: s["type"]).alias("types"))


@register("merge_test_cases", """SELECT event_id, [CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR)] AS inputs,
  [event_type, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)] AS outputs FROM events""")
def q_merge_test_cases(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    pub = F.to_json(F.array(F.struct(F.col("event_id").cast("string").alias("input"), F.col("event_type").alias("output"))))
    prv = F.to_json(F.array(F.struct(F.col("user_id").cast("string").alias("input"),
                                     F.floor("value").cast("bigint").cast("string").alias("output"))))
    d = e.withColumns({"public": pub, "private": prv})
    return P.merge_test_cases(d, "public", "private").select("event_id", "inputs", "outputs")
