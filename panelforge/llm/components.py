"""Connected components of a distributed edge list: alternating large-star and small-star steps.

Every step is a grouped minimum and a join. The minimum is combined map-side; in the
join the edges of a hub share a key, which adaptive execution splits. Each round is written to the shared folder, which cuts the
lineage; rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or smaller (small) neighbours to the least of its neighbourhood."""
    if large:
        near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    links = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return links.unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the component is its least node."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = _mark(edges)
    while True:
        edges = written(_star(_star(edges, True), False))
        if (new := _mark(edges)) == mark:
            break
        mark = new
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
