"""Connected components of a graph that only tasks see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import park


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each vertex's larger (or smaller) neighbours to the least of its neighbours and itself."""
    if larger:
        around = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    if larger:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (its least vertex) of every vertex that has an edge (u, v, longs).

    Alternates large and small stars, until every component is a star around its least vertex.
    A vertex with very many edges costs partial minima and a join that may be split; no task
    gathers its neighbours. Self-loops and repeated edges are harmless; without edges the
    result is empty.
    """
    current = park(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    size = lambda frame: tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = size(current)
    while before[0]:
        current = park(_stars(_stars(current, larger=True), larger=False), "edges")
        now = size(current)
        if now == before:
            break
        before = now
    centres = current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(centres)
