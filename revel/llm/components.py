"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revel.llm.jobs import written


def _least(edges: DataFrame) -> DataFrame:
    """``a, m``: the smallest of a node and its neighbours."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges`` (columns ``a``, ``b``): the smallest node of its component.

    Large star links every larger neighbour of a node to the smallest one,
    small star the smaller ones; both keep the components, and together they
    end in stars.  A node with very many edges is a minimum taken by partial
    aggregation and a join that splits.  Each round is written to the shared
    folder."""
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        small = large.join(_least(large), "a")
        small = small.select("b", "m").unionByName(small.select(F.col("a").alias("b"), "m")).where("b != m")
        edges = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        last = now
