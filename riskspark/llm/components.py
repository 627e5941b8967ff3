"""Connected components of a distributed edge list by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import keep


def _star(edges: DataFrame, up: bool) -> DataFrame:
    """Joins each node's larger (``up``) or not larger neighbours to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if up:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), "u")
    if up:
        return out.filter("a > u").select("a", "b")
    return out.filter("a != b").select("a", "b").union(low.filter("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every node with an edge and the smallest node it can reach; edges are (a, b).

    Each round writes its edges to the shared folder; rounds end when the edge set stays as it was,
    which is when every component is a star around its smallest node."""
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        edges = keep(_star(_star(edges, True), False).distinct(), "links")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
