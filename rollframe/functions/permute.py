"""Keyed bijections of [0, n) as column expressions: every row computes its place in a
pseudorandom order by itself, so no order is ever sorted for.

A Feistel network over two digits of nearly equal radix (Black and Rogaway, "Ciphers with
arbitrary finite domains", 2002) permutes [0, a * b) with a * b - n < a; a value that lands at n
or beyond is sent through again (cycle walking), which gives a bijection of [0, n).  The round
function is arithmetic modulo the prime 2^31 - 1, so any SQL engine computes the same order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollframe.functions.answers import let

PRIME = 2_147_483_647
ROUNDS = 6
#: A value outside [0, n) is one of fewer than a; 64 walks are enough for every n up to 4096, and
#: beyond it a value that needs more has a chance below (1 / 64) ** 64: it raises.
WALKS = 64


def round_keys(*parts) -> list[int]:
    """One key below the prime per round, from the decimal spelling of ``parts``."""
    text = "|".join(str(p) for p in parts)
    return [int(hashlib.md5(f"{text}|{r}".encode()).hexdigest()[:15], 16) % PRIME for r in range(ROUNDS)]


def round_key_columns(*parts: Column) -> list[Column]:
    """:func:`round_keys` of columns."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return [F.conv(F.substring(F.md5(F.concat(text, F.lit(f"|{r}"))), 1, 15), 16, 10).cast("bigint") % F.lit(PRIME)
            for r in range(ROUNDS)]


def _mixed(value: Column, key: Column) -> Column:
    """A pseudorandom number below the prime: keyed, then cubed."""
    t = (value + key) % PRIME
    return (t * t % PRIME) * t % PRIME


def feistel(x: Column, a: Column, b: Column, keys: Column) -> Column:
    """Bijection of [0, a * b) on ``x``: a fold over the array of round keys.  The digits and
    their radices change places in each round; an even number of rounds puts them back."""
    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).alias("r"), a.alias("a"), b.alias("b"))
    return F.aggregate(
        keys, start,
        lambda s, key: F.struct(s["r"].alias("l"), ((s["l"] + _mixed(s["r"], key)) % s["a"]).alias("r"),
                                s["b"].alias("a"), s["a"].alias("b")),
        lambda s: s["l"] * s["b"] + s["r"])


def radices(n: Column) -> tuple[Column, Column]:
    """(a, b) with a = ceil(sqrt(n)) and b = ceil(n / a); both 1 at least."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    return a, F.greatest(F.ceil(n / a).cast("bigint"), F.lit(1).cast("bigint"))


def permuted(x: Column, n: Column, keys: Column | list[Column]) -> Column:
    """Place of ``x`` (0 <= x < n, bigint) in the pseudorandom order of [0, n) that ``keys`` (one
    array column, or a column per round) name.  n is up to 2^52: quotients are taken as doubles."""
    if isinstance(keys, list):
        keys = F.array(*[k.cast("bigint") for k in keys])
    a, b = radices(n)
    first = F.struct(x.cast("bigint").alias("x"), n.cast("bigint").alias("n"), a.alias("a"), b.alias("b"),
                     keys.alias("keys"))

    def walk(p: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(2), F.lit(WALKS)), feistel(p["x"], p["a"], p["b"], p["keys"]),
            lambda y, _: F.when(y < p["n"], y).otherwise(feistel(y, p["a"], p["b"], p["keys"])),
            lambda y: F.when(y < p["n"], y).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("bigint")))

    return let(first, walk)
