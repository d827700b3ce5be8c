"""Connected components of a graph of long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmap.llm.common import materialize
from stallmap.storage import discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One pass. Large: every vertex links its larger neighbours to the least of it and its neighbours.
    Small: every vertex links itself and its smaller neighbours to the least of those. The minimum is a
    partial aggregate and the neighbours stay rows, so a vertex with many of them never is one group. The edges that
    went in, materialised, are deleted."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    else:
        both = both.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u"))
    least = materialize(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m")), "cc-least")
    linked = both.join(least, "v")
    if large:
        out = linked.where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    out = materialize(out.where("a != b").distinct(), "cc-edges")
    discard(edges, least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: the least node that each node with an edge can reach. Loops and repeated
    edges don't count. The number of passes grows with the logarithm of the largest component's size."""
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        edges = _star(_star(edges, True), False)
        now = mark(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = materialize(nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "cc-nodes")
    discard(edges)
    return out
