"""Connected components of an edge table, by alternating large and small stars.

Each round links every node to the least node it knows of; degrees only matter
to partial aggregates and to joins that the optimiser may split. Built-in
expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import cut, once


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """directed(u, v). Large: v above u goes to the least neighbour of u or u
    itself. Small: neighbours below u and u itself go to the least of them."""
    low = directed.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        low = low.select("u", F.least("u", "m").alias("m"))
        return directed.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    to_low = directed.join(low, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_low.union(low.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    r = once(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")))).collect()[0]
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) in any direction -> (node, root): each node that is not the
    least of its component, and that least node. Nulls and loops are no edges."""
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = _star(both, True).distinct()
        edges = cut(_star(big, False).distinct())
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
