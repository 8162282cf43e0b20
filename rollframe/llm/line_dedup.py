"""Site-relative line deduplication, in built-in column functions.

A line is boilerplate on a host when the share of the host's pages that contain it exceeds a
ratio.  Only (host, 64-bit line hash) pairs are shuffled, counted with map-side combine; the
texts stay where they were read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.functions.answers import let
from rollframe.llm.work import free_name, written


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def line_hashes(text: Column) -> Column:
    """One hash per \\n-split line of a text; null for a line that is blank once trimmed."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(_trimmed(x) != "", F.xxhash64(_trimmed(x))))


def boilerplate_lines(docs: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, lines array<bigint>): hashes of the lines on more than ``max_ratio`` of a host's
    pages and on ``min_pages`` pages at least.  A host has at most (mean distinct lines per
    page / max_ratio) such lines."""
    d = docs.select(F.col(host_col).alias("host"), F.array_distinct(line_hashes(F.col(text_col))).alias("hs"))
    pages = d.groupBy("host").agg(F.count("*").alias("pages"))
    seen = (d.select("host", F.explode("hs").alias("h")).where(F.col("h").isNotNull())
            .groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    often = (seen.join(pages, seen["host"].eqNullSafe(pages["host"]))
             .where(F.col("n") > F.col("pages") * max_ratio).select(seen["host"], "h"))
    return often.groupBy("host").agg(F.collect_list("h").alias("lines"))


#: From this many boilerplate lines on a page, a line is looked up by halving their sorted list.
FEW = 32


def _member(hashes: Column, h: Column) -> Column:
    """Whether ``h`` is in the sorted array: a scan of a short one, else about log2 steps."""
    n = F.size(hashes)
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        return F.when(F.get(hashes, mid) < h, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int"))
    found = F.get(hashes, F.aggregate(steps, start, halve, lambda s: s["lo"])) == h
    return F.when(n < FEW, F.array_contains(hashes, h)).otherwise(F.coalesce(found, F.lit(False)))


def _kept(text: Column, boilerplate: Column) -> Column:
    """Lines of ``text`` whose hash is not among ``boilerplate`` (sorted, of this page)."""
    page = F.struct(F.split(text, "\n").alias("lines"), line_hashes(text).alias("hs"), boilerplate.alias("drop"))

    def of(p: Column) -> Column:
        return F.filter(p["lines"], lambda _, i: F.get(p["hs"], i).isNull()
                        | ~_member(p["drop"], F.coalesce(F.get(p["hs"], i), F.lit(0))))

    return let(page, of)


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text",
               max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """``docs`` with the text cleaned of its host's boilerplate lines, plus ``n_lines`` and
    ``n_dropped_lines``.

    Lines are compared trimmed; a line repeated inside one page counts once for the page, and
    all its occurrences are dropped.  Blank lines are never counted nor dropped.  Null text
    stays null with both counts 0, but its page counts for the host; a null host is a host of
    its own.  Repeated rows are separate pages.  A page may be left with an empty text.
    Input columns named like the two counts are replaced, all others pass through.

    The boilerplate table is written first, so the planner sees its size: it is broadcast if
    it is below the broadcast threshold, else it is a sort-merge join on the host, in which
    a hot host's pages are split.  The work on a page is its lines times the logarithm of its
    boilerplate lines.
    """
    lines = written(boilerplate_lines(docs, host_col, text_col, max_ratio, min_pages), "lines")
    host, drop, hit, keep = (free_name(c, docs.columns) for c in ("__host", "__drop", "__hit", "__keep"))
    lines = lines.select(F.col("host").alias(host), F.col("lines").alias(drop))
    out = docs.join(lines, F.col(host_col).eqNullSafe(F.col(host)), "left")
    # what of the page is boilerplate: a hashed intersection, mostly empty or tiny
    none = F.array().cast("array<bigint>")
    out = out.withColumn(hit, F.coalesce(F.array_intersect(line_hashes(F.col(text_col)), drop), none))
    out = out.withColumn(keep, F.when(F.size(hit) > 0, _kept(F.col(text_col), F.sort_array(hit))))
    n = F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(n)
    cols = [F.col(c) for c in docs.columns if c not in (text_col, "n_lines", "n_dropped_lines")]
    at = [c for c in docs.columns if c not in ("n_lines", "n_dropped_lines")].index(text_col)
    text = F.when(F.col(keep).isNull(), F.col(text_col)).otherwise(F.array_join(keep, "\n")).alias(text_col)
    cols.insert(at, text)
    return out.select(
        *cols, n.cast("long").alias("n_lines"),
        F.when(F.col(keep).isNull(), 0).otherwise(n - F.size(keep)).cast("long").alias("n_dropped_lines"))
