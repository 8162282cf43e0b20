"""URL filter: host/path rules, and a character language-model ratio for the rest.

URLs that a rule decides are the examples: one smoothed variable-order Markov model is
counted over the accepted ones and one over the rejected ones (all of them, no sample).
Every other URL is judged by its length-normalised log-likelihood difference against a
threshold calibrated on examples that the counts have not seen.  Built-in functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollframe.functions.answers import let
from rollframe.llm.work import written

#: (host, path prefix, verdict)
DEFAULT_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"))
ALPHABET = 95


@dataclass(frozen=True)
class MarkovParams:
    """order: longest context + 1 in characters; weight: pseudo-count by which each order
    falls back to the next shorter one; calibration: examples whose spelling's md5 starts
    with a hex digit below this one calibrate the threshold, the others are counted."""

    order: int = 5
    weight: float = 4.0
    calibration: str = "3"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lowered; path from
    there up to ``? #``.  Both empty without ``://`` or for null."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and the start
    of the path; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def spelling(host: Column, path: Column) -> Column:
    """What the models read: host and path in lower case, digits as 0, other than printable
    ASCII as ~, so that the alphabet is bounded and ids do not count."""
    s = F.lower(F.regexp_replace(F.concat(host, path), r"[^\x20-\x7e]", "~"))
    return F.regexp_replace(s, "[1-9]", "0")


def _grams(s: Column, order: int) -> Column:
    """All substrings of ``order`` characters of the padded spelling.  The characters are split
    once and bound: inside the inner lambda they would be split anew for every position."""
    padded = F.concat(F.lit("^" * (order - 1)), s, F.lit("$"))
    return let(F.split(padded, ""), lambda chars: F.transform(
        F.sequence(F.lit(0), F.length(s)), lambda i: F.concat(*[F.get(chars, i + k) for k in range(order)])))


def gram_ratios(top: DataFrame, params: MarkovParams) -> DataFrame:
    """(gram, ratio): log p_accepted - log p_rejected of a gram's last character after its
    context, for every gram of ``top(gram, acc, rej)``.

    p_n(c | ctx) = (N(ctx c) + weight * p_{n-1}(c | shorter ctx)) / (N(ctx) + weight), down
    to a uniform alphabet.  A context's followers are at most the alphabet, so the windows
    stay small; each order is one grouping of the same gram counts."""
    w, k = params.weight, params.order
    prob = None
    for n in range(1, k + 1):
        t = top.groupBy(F.substring("gram", k - n + 1, n).alias("gram")).agg(
            F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
        if n == 1:
            # one row per character of the bounded alphabet
            tot = t.agg(F.sum("acc"), F.sum("rej")).first()
            na, nr, pa, pr = F.lit(tot[0] or 0), F.lit(tot[1] or 0), F.lit(1.0 / ALPHABET), F.lit(1.0 / ALPHABET)
        else:
            ctx = W.partitionBy(F.substring("gram", 1, n - 1))
            t = (t.withColumn("na", F.sum("acc").over(ctx)).withColumn("nr", F.sum("rej").over(ctx))
                 .join(prob.select(F.col("gram").alias("tail"), "pa", "pr"), F.expr("substring(gram, 2)") == F.col("tail")))
            na, nr, pa, pr = F.col("na"), F.col("nr"), F.col("pa"), F.col("pr")
        prob = t.select("gram", ((F.col("acc") + F.lit(w) * pa) / (na + F.lit(w))).alias("pa"),
                        ((F.col("rej") + F.lit(w) * pr) / (nr + F.lit(w))).alias("pr"))
    return prob.select("gram", F.log(F.col("pa") / F.col("pr")).alias("ratio"))


def calibrated_threshold(scores: DataFrame) -> float:
    """Where accepted and rejected calibration examples of ``scores(score, cal_acc, cal_rej)``
    err equally, as two normal distributions: -inf if either class has no examples."""
    def moments(n: str) -> list[Column]:
        return [F.sum(n).alias(n), F.sum(F.col(n) * F.col("score")).alias(f"{n}_s"),
                F.sum(F.col(n) * F.col("score") * F.col("score")).alias(f"{n}_q")]

    r = scores.agg(*moments("cal_acc"), *moments("cal_rej")).first()
    if not r["cal_acc"] or not r["cal_rej"]:
        return -math.inf
    (ma, sa), (mr, sr) = [((s := r[f"{n}_s"] / r[n]), math.sqrt(max(r[f"{n}_q"] / r[n] - s * s, 0.0)))
                          for n in ("cal_acc", "cal_rej")]
    return round((ma * sr + mr * sa) / (sa + sr) if sa + sr > 0 else (ma + mr) / 2, 9)


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=DEFAULT_RULES,
               params: MarkovParams = MarkovParams()) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every input row.

    ``rule`` is the longest fitting rule or null, ``verdict`` (``allow``/``block``) the
    rule's, else the model's: allow at or above the calibrated threshold.  ``score`` is the
    mean log ratio per character (null where a rule decides).  Null and odd URLs have empty
    host and path and are judged like any other spelling; repeated rows give repeated
    results; without examples of both classes everything no rule blocks is allowed, and with
    examples that are all counted and none left to calibrate the likelier class is the verdict.

    Spellings are grouped before their characters are counted, so copies of a URL or a hot
    host cost one row each; scores go back to the pages by a join in which AQE may split a
    hot spelling.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"), spelling(F.col("host"), F.col("path")).alias("s"))
    cal = F.substring(F.md5("s"), 1, 1) < params.calibration
    count = lambda v: F.sum(F.when(F.col("said") == v, 1).otherwise(0))
    seen = rows.groupBy("s").agg(count("allow").alias("a"), count("block").alias("b"),
                                 F.max(F.col("rule").isNull()).alias("open"))
    zero = F.lit(0).cast("long")
    # a spelling goes by its digest from here on: its text on each of its grams would be its square
    seen = written(seen.select(
        F.md5("s").alias("key"), "s", "open", F.when(cal, zero).otherwise(F.col("a")).alias("acc"), F.when(cal, zero).otherwise(F.col("b")).alias("rej"),
        F.when(cal, F.col("a")).otherwise(zero).alias("cal_acc"), F.when(cal, F.col("b")).otherwise(zero).alias("cal_rej")),
        "spellings")
    grams = seen.select("key", "open", "acc", "rej", "cal_acc", "cal_rej", F.explode(_grams(F.col("s"), params.order)).alias("gram"))
    top = written(grams.groupBy("gram").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej")), "grams")
    ratios = written(gram_ratios(top, params), "ratios")
    scores = (grams.where(F.col("open") | (F.col("cal_acc") + F.col("cal_rej") > 0)).join(ratios, "gram")
              .groupBy("key").agg(F.round(F.avg("ratio"), 9).alias("score"), F.first("cal_acc").alias("cal_acc"),
                                F.first("cal_rej").alias("cal_rej")))
    scores = written(scores, "scores")
    limit = calibrated_threshold(scores)
    if limit == -math.inf:  # no spelling of a class fell to the calibration: both models may know the class all the same
        counted = seen.agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej")).first()
        limit = 0.0 if counted["acc"] and counted["rej"] else limit
    out = rows.withColumn("key", F.md5("s")).join(scores.select("key", "score"), "key", "left")
    said = F.coalesce("said", F.when(F.col("score") >= F.lit(limit), "allow").otherwise("block"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", said.alias("verdict"),
                      F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
