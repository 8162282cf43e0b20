"""Dataset preparation: canonical prompt records, templating, cleaning, splits and
predicates - all projections and filters that Catalyst pushes down to the scan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.operators.batch import shuffle_key
from rollframe.operators.indexing import row_count, with_row_index

PLACEHOLDER = re.compile(r"\{([A-Za-z0-9_]+)\}")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_prompt_schema(df: DataFrame, question, data_source: str | Column, ability: str, ground_truth,
                     split: str, index_col: str, style: str = "rule", suffix: str = "",
                     answer=None) -> DataFrame:
    """Raw rows -> canonical record (data_source, prompt[{role, content}], ability,
    reward_model{style, ground_truth}, extra_info{split, index, answer, question})."""
    q = _c(question)
    content = F.concat(q, F.lit(suffix)) if suffix else q
    return df.select(
        (data_source if isinstance(data_source, Column) else F.lit(data_source)).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), _c(ground_truth).cast("string").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index_col).cast("bigint").alias("index"),
                 (_c(answer) if answer is not None else F.lit(None).cast("string")).alias("answer"),
                 q.alias("question")).alias("extra_info"),
    )


def index_within(df: DataFrame, partition_col: str, order_by, out_col: str = "index") -> DataFrame:
    """Row position inside each ``partition_col`` value (e.g. split): the global index over
    (partition, order) minus the partition's first index (a small per-partition table)."""
    keys = [partition_col] + ([order_by] if isinstance(order_by, (str, Column)) else list(order_by))
    d = with_row_index(df, keys, out_col="__g")
    first = d.groupBy(partition_col).agg(F.min("__g").alias("__f"))
    return d.join(first, partition_col).withColumn(out_col, F.col("__g") - F.col("__f")).drop("__g", "__f")


def append_instruction(df: DataFrame, question_col: str, instruction: str, out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or question_col, F.concat_ws(" ", F.col(question_col), F.lit(instruction)))


def clean_wikihow(c) -> Column:
    """strip; " [title]" -> ". "; drop ``[...]`` (non-greedy); one pass of double -> single space."""
    x = F.regexp_replace(_c(c), r"^\s+|\s+$", "")
    x = F.replace(x, F.lit(" [title]"), F.lit(". "))
    x = F.regexp_replace(x, r"\[.*?\]", "")
    return F.replace(x, F.lit("  "), F.lit(" "))


def clean_wikihow_text(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or col, clean_wikihow(col))


def capitalize(c) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, (1 << 31) - 1)))


def multiple_choice_records(df: DataFrame, label_col: str, ctx_a: str, ctx_b: str, endings_col: str,
                            gold_col: str) -> DataFrame:
    query = clean_wikihow(F.concat(F.col(label_col), F.lit(": "), F.col(ctx_a), F.lit(" "), capitalize(ctx_b)))
    return df.select("*", query.alias("query"),
                     F.transform(endings_col, clean_wikihow).alias("choices"),
                     F.col(gold_col).cast("int").alias("gold"))


def filter_labeled(df: DataFrame, label_col: str) -> DataFrame:
    return df.filter(F.length(F.col(label_col)) > 0)


def filter_date_window(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    """Lexical ``lo <= s < hi`` (bounds such as "2024-08-00T..." are not valid dates)."""
    return df.filter((F.col(col) >= lo) & (F.col(col) < hi))


def shuffled_choices(df: DataFrame, id_col: str, gold_col: str, distractors_col: str, seed: int = 0) -> DataFrame:
    """Gold + distractors ordered by ``md5(seed|id|choice)``; ``answer`` = letter of the
    gold position (a row with more than 26 choices fails)."""
    allc = F.concat(F.array(F.col(gold_col)), F.col(distractors_col))
    keyed = F.transform(allc, lambda ch: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), ch)).alias("k"),
                                                 ch.alias("c")))
    ordered = F.transform(F.array_sort(keyed), lambda s: s["c"])
    pos = F.array_position(ordered, F.col(gold_col))
    letter = F.when(F.size(ordered) > 26, F.raise_error(F.lit("shuffled_choices: more choices than letters"))).otherwise(
        F.char(F.lit(64) + pos))
    return df.withColumns({"choices": ordered, "answer": letter})


def union_sources(dfs: dict[str, DataFrame], tasks: list[str]) -> DataFrame:
    unknown = [t for t in tasks if t not in dfs]
    if unknown:
        raise NotImplementedError(f"unknown task(s): {unknown}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [dfs[t] for t in tasks])


def sft_pairs_from_preferences(df: DataFrame, prompt_col: str = "prompt", chosen_col: str = "chosen",
                               rejected_col: str = "rejected") -> DataFrame:
    """Every preference row becomes two SFT rows (chosen, then rejected)."""
    return df.select(prompt_col, F.posexplode(F.array(chosen_col, rejected_col)).alias("pair_pos", "response"))


def preference_split(df: DataFrame, order_by, train_frac: float = 0.75) -> DataFrame:
    """First ``train_frac`` of the rows (by position) is train, the rest test."""
    n = row_count(df)
    cut = int(n * train_frac)
    d = with_row_index(df, order_by, out_col="__pos")
    return d.withColumn("split", F.when(F.col("__pos") < cut, "train").otherwise("test")).drop("__pos")


def random_split(df: DataFrame, id_col: str, train_pct: int = 80, seed: int = 0) -> DataFrame:
    """Hash-bucket split, stable under repartitioning."""
    b = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(100))
    return df.withColumn("split", F.when(b < train_pct, "train").otherwise("test"))


def extract_nested_field(df: DataFrame, path: str, out_col: str) -> DataFrame:
    """Follow a dotted path; a single-element array met on the way is unwrapped (more
    elements raise), as the reference does for nested dataset keys."""
    from pyspark.sql.types import ArrayType, StructType
    c, t = None, df.schema
    for part in path.split("."):
        if isinstance(t, ArrayType):
            c = F.when(F.size(c) == 1, F.try_element_at(c, F.lit(1))).otherwise(
                F.raise_error(F.lit(f"expected a single-element list before '{part}'")))
            t = t.elementType
        if not isinstance(t, StructType):
            raise KeyError(f"{part} is not reachable in {path}")
        c = F.col(part) if c is None else c.getField(part)
        t = t[part].dataType
    return df.withColumn(out_col, c)


def render_template(template: str, mapping: dict[str, Column | str]) -> Column:
    """Single-pass ``{name}`` substitution: the template is split once on the driver into
    literal and column parts; names not in ``mapping`` stay verbatim (so a value that
    itself contains ``{x}`` is never re-substituted)."""
    parts, pos = [], 0
    for m in PLACEHOLDER.finditer(template):
        if m.group(1) in mapping:
            parts.append(F.lit(template[pos:m.start()]))
            v = mapping[m.group(1)]
            parts.append((F.col(v) if isinstance(v, str) else v).cast("string"))
            pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def render_prompt(df: DataFrame, template: str, mapping: dict[str, Column | str], out_col: str = "prompt_text",
                  required: list[str] | None = None) -> DataFrame:
    missing = [r for r in (required or []) if r not in mapping]
    if missing:
        raise KeyError(f"template needs values for {missing}")
    return df.withColumn(out_col, render_template(template, mapping))


def render_by_variant(df: DataFrame, ground_truth_col: str, templates: dict[str, str],
                      mapping: dict[str, Column | str], default_variant: str = "input/output",
                      out_col: str = "prompt_text") -> DataFrame:
    """Template chosen by ``ground_truth.code_type`` (default ``input/output``);
    ``testing_code`` = ``bad_code.code`` when the bad code is an object, else the string."""
    gt = F.col(ground_truth_col)
    variant = F.coalesce(F.get_json_object(gt, "$.code_type"), F.lit(default_variant))
    bad_obj = F.get_json_object(gt, "$.bad_code.code")
    testing = F.coalesce(bad_obj, F.get_json_object(gt, "$.bad_code"))
    m = dict(mapping)
    m.setdefault("testing_code", testing)
    out = None
    for name, tpl in templates.items():
        r = render_template(tpl, m)
        out = F.when(variant == name, r) if out is None else out.when(variant == name, r)
    out = out.otherwise(F.raise_error(F.concat(F.lit("unknown code_type "), variant)))
    return df.withColumn(out_col, out)


# Code-generation question wording
CODE_Q_HEAD = ("You will be given a question (problem specification) and will generate a correct Python program "
               "that matches the specification and passes all tests.\n\nQuestion: ")
CODE_Q_STARTER = ("You will use the following starter code to write the solution to the problem and enclose your "
                  "code within delimiters.\n```python\n")
CODE_Q_STDIN = ("Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test "
                "on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python "
                "program runs, it reads the inputs, runs the algorithm and writes output to STDOUT."
                "```python\n# YOUR CODE HERE\n```")


def render_code_question(df: DataFrame, question_col: str, starter_col: str, out_col: str = "question_text") -> DataFrame:
    """Question text with the starter-code branch (non-empty starter code) or the stdin branch."""
    st = F.col(starter_col)
    head = F.concat(F.lit(CODE_Q_HEAD), F.col(question_col), F.lit("\n\n"))
    with_starter = F.concat(head, F.lit(CODE_Q_STARTER), st, F.lit("\n```"))
    without = F.concat(head, F.lit(CODE_Q_STDIN))
    return df.withColumn(out_col, F.when(F.length(F.coalesce(st, F.lit(""))) > 0, with_starter).otherwise(without))


def merge_test_cases(df: DataFrame, public_col: str, private_col: str, fn_name_col: str | None = None) -> DataFrame:
    """Public + private JSON lists of ``{input, output}`` -> ``inputs[]``, ``outputs[]``."""
    schema = "array<struct<input:string,output:string>>"
    allc = F.concat(F.coalesce(F.from_json(F.col(public_col), schema), F.array()),
                    F.coalesce(F.from_json(F.col(private_col), schema), F.array()))
    return df.withColumns({
        "inputs": F.transform(allc, lambda s: s["input"]),
        "outputs": F.transform(allc, lambda s: s["output"]),
        "fn_name": F.col(fn_name_col) if fn_name_col else F.lit(None).cast("string"),
    })


def split_media_segments(c) -> Column:
    """Split on ``<image>``/``<video>`` keeping the markers and the empty text pieces
    that Python's ``re.split`` keeps; returns array<struct<type, text>>."""
    pieces = F.split(F.regexp_replace(_c(c), r"(<image>|<video>)", "\u0001$1\u0001"), "\u0001", -1)
    return F.transform(pieces, lambda p: F.struct(
        F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"),
        F.when(p.isin("<image>", "<video>"), F.lit(None).cast("string")).otherwise(p).alias("text")))


def whitespace_tokens(c) -> Column:
    return F.size(F.split(F.trim(_c(c)), r"\s+", -1))


def filter_overlong_prompts(df: DataFrame, text_col: str, max_len: int, length_expr: Column | None = None) -> DataFrame:
    n = length_expr if length_expr is not None else whitespace_tokens(text_col)
    return df.filter(n <= max_len)


def filter_valid_testcases(df: DataFrame, tc_col: str) -> DataFrame:
    tc = F.col(tc_col)
    return df.filter((F.size(tc) > 0) & F.forall(tc, lambda x: x != ""))


def select_row_range(df: DataFrame, order_by, start: int, end: int) -> DataFrame:
    d = with_row_index(df, order_by, out_col="__pos")
    return d.filter((F.col("__pos") >= start) & (F.col("__pos") < end)).drop("__pos")
