"""Checks and preparation of generated test cases, as column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rollframe.functions.answers import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Strings and comments of Python text, the first to begin wins; a triple-quoted one may span lines
_TOKENS = re.compile(r'''("""|\'\'\')(?:\\.|(?!\1).)*(?:\1|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|\#[^\n]*''', re.S)


@F.arrow_udf(StringType())
def without_strings(code: pa.Array) -> pa.Array:
    """Python text with its strings empty and its comments gone: what is left are the program's
    own words.  Null stays null."""
    return pa.array([None if c is None else _TOKENS.sub(lambda m: "" if m.group().startswith("#") else '""', c)
                     for c in code.to_pylist()], pa.string())


def has_assert(code) -> Column:
    """An ``assert`` on some line, before any comment or string on it starts."""
    return F.exists(F.split(_c(code), "\n"), lambda line: F.regexp_replace(line, "[#\"'].*$", "").contains("assert"))


def validate_harness_text(code, entry_point=None) -> Column:
    """Is a test-harness program usable: not empty, at least one top-level function called
    ``generate_input_...``, an assert if it defines ``check_output`` at the top level, and no
    definition of the entry point that it is to test.  Functions are those of the program: a
    ``def`` inside a string of several lines is none."""
    c = _c(code)
    bare = without_strings(c)
    ok = (F.length(c) > 0) & bare.rlike(r"(?m)^def\s+generate_input_\w*\s*\(")
    ok = ok & (~bare.rlike(r"(?m)^def\s+check_output\s*\(") | has_assert(c))
    if entry_point is not None:
        name = _c(entry_point) if isinstance(entry_point, Column) else F.lit(entry_point)
        ok = ok & ~F.coalesce(F.contains(c, F.concat(F.lit("def "), name, F.lit("("))), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def validate_io_testcases(text, code_type="input/output") -> Column:
    """Is a text a non-empty JSON list of objects that all have the keys of their kind: strings
    ``input_str`` and ``expected_output`` for ``input/output``; an object ``input_args`` and any
    ``expected_output`` else."""
    kind = _c(code_type) if isinstance(code_type, Column) else F.lit(code_type)

    def case(v):
        def field(name):
            return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        io = (field("input_str") == "STRING") & (field("expected_output") == "STRING")
        call = field("input_args").startswith("OBJECT<") & field("expected_output").isNotNull()
        return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<") & F.when(kind == "input/output", io).otherwise(call), F.lit(False))

    def whole(v):
        items = F.try_variant_get(v, "$", "array<variant>")
        return F.schema_of_variant(v).startswith("ARRAY<") & (F.size(items) > 0) & F.forall(items, case)

    return F.coalesce(let(F.try_parse_json(_c(text)), whole), F.lit(False))


def dedupe_testcases(cases: DataFrame, item_col: str, idx_col: str, input_col: str, num_testcases: int) -> DataFrame:
    """Per item the first row of each different input, at most ``num_testcases`` of them, in
    index order.  Repeats go in a grouping with map-side combine; the rest is numbered per item."""
    first = cases.groupBy(item_col, input_col).agg(F.min_by(F.struct(*cases.columns), idx_col).alias("__c")).select("__c.*")
    at = F.row_number().over(Window.partitionBy(item_col).orderBy(idx_col))
    return first.withColumn("__at", at).where(F.col("__at") <= num_testcases).drop("__at")


def compare_test_outputs(got, expected) -> Column:
    """Does a program's output pass: the first that holds of equal texts, equal lines once
    trimmed, equal lines without blank ones, or as many numbers, not all whole, that are close
    (1e-8 + 1e-5 of the expected).  Null never passes."""
    trim = lambda a: F.transform(F.split(a, "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    some = lambda a: F.filter(a, lambda x: x != "")

    def cascade(a, b):
        def numbers(x, y):
            pairs = F.zip_with(x, y, lambda p, q: F.struct(p.try_cast("double").alias("p"), q.try_cast("double").alias("q"),
                                                           (p.rlike(r"^-?\d+$") & q.rlike(r"^-?\d+$")).alias("whole")))
            close = lambda s: F.coalesce(F.abs(s["p"] - s["q"]) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(s["q"]), F.lit(False))
            return (F.size(x) == F.size(y)) & (F.size(x) > 0) & F.forall(pairs, close) & ~F.forall(pairs, lambda s: F.coalesce(s["whole"], F.lit(False)))
        return (a == b) | let(trim(a), lambda x: let(trim(b), lambda y: (x == y) | let(some(x), lambda u: let(
            some(y), lambda v: (u == v) | numbers(u, v)))))

    return F.coalesce(let(_c(got), lambda a: let(_c(expected), lambda b: cascade(a, b))), F.lit(False))
