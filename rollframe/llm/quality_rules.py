"""Line-first quality rules, all in built-in column functions.

Each line of a document is judged on its own (navigation, boilerplate, punctuation); failing
lines are removed, and a document that loses too much of its text is rejected.  Everything
is one projection per document: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words.
WORD_GAPS = " \t\n\x0b\x0c\r"
LINE_GAPS = " \t\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
TERMINAL_MARKS = ".!?:;)\"'…”’»"
BOILERPLATE = (r"(?i)(all rights reserved|licensed under|released under the|copyright|privacy policy|"
               r"terms of (use|service)|cookie|javascript|subscribe|click here|sign (in|up)|lorem ipsum)")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules.

    nav_share: a line fails as navigation when it has at least ``nav_min`` separators
        (``|``, ``>``, ``<``) and ``nav_share`` separators or more per 100 word gaps.
    mark_share: fails on punctuation with this many of ``!#*$%&`` or more per 100 word gaps
        (a line of ordinary sentences has few), once it has ``mark_min`` of them.
    short_chars: a line shorter than this without a terminal mark fails on punctuation.
    boiler_chars: only lines up to this length are matched against the boilerplate phrases.
    keep_share: the document stays if at least this many percent of its line characters stay.
    """

    nav_min: int = 3
    nav_share: int = 25
    mark_min: int = 4
    mark_share: int = 30
    short_chars: int = 20
    boiler_chars: int = 200
    keep_share: int = 50


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_passes(line: Column, rules: LineRules) -> Column:
    """True if a line with a word passes the navigation, punctuation and boilerplate rules."""
    gaps = _count_of(line, " ") + 1
    seps, marks = _count_of(line, "|<>"), _count_of(line, "!#*$%&")
    navigation = (seps >= rules.nav_min) & (seps * 100 >= gaps * rules.nav_share)
    noisy = (marks >= rules.mark_min) & (marks * 100 >= gaps * rules.mark_share)
    last = F.substring(F.rtrim(line, F.lit(LINE_GAPS)), -1, 1)
    stub = (F.length(line) < rules.short_chars) & (F.instr(F.lit(TERMINAL_MARKS), last) == 0)
    boilerplate = (F.length(line) <= rules.boiler_chars) & line.rlike(BOILERPLATE)
    return ~(navigation | noisy | stub | boilerplate)


def window_hashes(hashes: Column, window: int) -> Column:
    """Hash of every run of ``window`` words, from the words' hashes."""
    n = F.size(hashes)
    wins = F.when(n >= window, F.transform(
        F.sequence(F.lit(0), n - window),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)])))
    return F.coalesce(wins, F.array().cast("array<bigint>"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: LineRules = LineRules(), min_words: int = 10, max_repeat_pct: int = 20,
                  window: int = 5) -> DataFrame:
    """One row per input row: counts, ``base_failed``, line-rule figures, ``kept`` and the
    cleaned text.

    Null text: no words, all counts 0, ``base_failed`` true, cleaned text empty.  Empty and
    white-space texts are the same.  A null id passes through; repeated rows give repeated
    results; other input columns, whatever their names, are not read.  Equal windows are
    found by 64-bit hashes within one document.
    """
    d = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    d = d.withColumn("__w", F.array_remove(
        F.split(F.translate("__t", WORD_GAPS, " " * len(WORD_GAPS)), " "), ""))
    d = d.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    d = d.withColumn("__win", window_hashes(F.col("__h"), window))
    any_rep = F.size(F.array_distinct("__win")) < F.size("__win")
    # only documents with a repeated window pay for the sort
    d = d.withColumn("__s", F.when(any_rep, F.sort_array(F.transform(
        "__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("__s")
    d = d.withColumn("__p", F.when(s.isNotNull(), F.sort_array(F.transform(
        F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)))
                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"]))))
    p = F.col("__p")
    repeat = F.when(p.isNotNull(), F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))),
        F.lit(0), lambda a, x: a + x)).otherwise(0)
    d = d.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("__k", F.filter("__l", lambda x: line_passes(x, rules)))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x))
    d = d.select(
        F.col("__id").alias(id_col),
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", WORD_GAPS, "")).cast("long").alias("word_chars"),
        _count_of(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        chars("__l").cast("long").alias("line_chars"),
        chars("__k").cast("long").alias("kept_line_chars"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size("__k").cast("long").alias("n_kept_lines"),
        F.array_join("__k", "\n").alias("clean_text"))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    d = d.withColumn("base_failed", base)
    return d.withColumn("kept", ~F.col("base_failed") & (
        F.col("kept_line_chars") * 100 >= F.col("line_chars") * rules.keep_share))
