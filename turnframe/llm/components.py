"""Connected components of a links table, without any driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; the component is its
    smallest node.

    Alternating large-star and small-star steps: every node hands its smaller
    or larger neighbours to the smallest one it knows, until the edges are
    stars.  Each step is one aggregate and one join over the edges and is
    written to the shared folder; the number of steps grows with the logarithm
    of the longest chain.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = materialize(small.where("u <> v").distinct(), "edges")
        # the edges are stars once every node has one smaller neighbour that has none itself
        several = new.groupBy("u").count().where("count > 1").select("u")
        deeper = new.join(new.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        edges = new
        if several.unionByName(deeper).isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
