"""Connected components of links between integer ids, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe.llm.work import scratch, written


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, write=written) -> DataFrame:
    """(id, component) for every id in ``links(a, b)``: the smallest id reachable.

    Alternating stars: every id hands its larger neighbours to the smallest one it knows
    (large star), then its smaller ones (small star), until each component is one star around
    its smallest id.  The number of rounds grows with the logarithm of a component's size; each
    round is two grouped minima with map-side combine and two joins on the id, written to the
    shared folder, so no lineage grows and a hub's neighbours are never in one group.  The rounds'
    tables are deleted at the end; the result is written by ``write``.
    """
    with scratch(links.sparkSession) as step:
        return write(_components(links, step), "components")


def _components(links: DataFrame, written) -> DataFrame:
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "star")
    state = _state(edges)
    while True:
        # large star: of all neighbours of x, the larger ones move to the smallest of them and x
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = (both.where("y > x").join(least, "x").where("y <> m")
                 .select(F.col("y").alias("u"), F.col("m").alias("v")))
        large = written(large, "star")
        # small star: the smaller neighbours of x, and x, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u <> v").distinct(), "star")
        before, state = state, _state(edges)
        if state == before:
            break
    own = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    hubs = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return own.unionByName(hubs.join(own, "id", "left_anti"))
