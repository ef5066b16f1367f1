"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import cut, salted_join


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches), for all nodes of ``edges`` (a, b).

    Every round replaces edges by edges to smaller nodes, until each node points at its smallest
    (Kiveris and others, 2014). Rounds grow with the logarithm of the longest path; the edge table never
    grows. Each round is written to the shared folder. The edges of a node with very many are spread over salts where they meet its
    smallest neighbour, so that no node gathers its edges in one task.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        above = both.filter("b > a")
        low = both.groupBy("a").agg(F.min("b").alias("low"), F.count_if(F.col("b") > F.col("a")).alias("n")).filter("n > 0").select("a", F.least("a", "low").alias("low"), "n")
        large = salted_join(above, cut(low), ["a"], "n", "b").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        large = cut(large.distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        joined = salted_join(large, cut(low), ["a"], "n", "b")
        edges = joined.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = cut(edges.filter("a <> b").distinct())
        if (new := _state(edges)) == state:
            break
        state = new
    lowest = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(lowest)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)
