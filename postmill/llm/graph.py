"""Connected components of a graph given as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import written


def _least(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, keep) -> DataFrame:
    """(u, v) links -> (id, component): the smallest id that can be reached, for each id that has a link.

    Large-star and small-star steps in turn: every node hands its larger, then its
    smaller neighbours to the least of them, until each hangs on its root. Rows stay
    as many as links; a node with very many links is only joined to one row. ``keep``
    writes a table and reads it back (see ``session.scratch``).
    """
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), keep)
    before = _checksum(edges)
    while before[0]:
        sym = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = sym.join(_least(sym), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small = large.join(_least(large), "u")
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), keep)
        after = _checksum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
