"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked with the smallest of its neighbours and itself. Edges come and go as
    (u, v) with u > v; some may be there twice after it, but no more of them than before."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    near = edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    return near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars already: no node with two smaller neighbours, or with a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    degree = ends.groupBy("node").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    return degree.agg(F.count_if((F.col("below") > 1) | (F.col("below") > 0) & (F.col("above") > 0))).first()[0] == 0


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node that has a link, and the smallest node of its component.

    links has columns a and b. Each step of a round is a table in the shared folder, so that its plan stays small: plans
    are what the driver's memory goes to. A component's links come down to one star in a number of rounds that grows with
    the logarithm of its size; links that are stars already take none.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        edges = materialize(_small_star(materialize(_large_star(edges), "links")), "links")
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return materialize(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
