"""Connected components of a link table by alternating large and small stars: joins and minima only, no group is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rdspark.llm.tables import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v), u > v. Large: larger neighbours of u go to u's least neighbour; small: u and its smaller ones do."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    met = both.join(least, "x")
    met = met.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")) if large else met.select(
        F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return met.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each v is the root of its component. Each node's edges are counted once, as u and in all."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("as_u")), F.struct(F.col("v").alias("node"), F.lit(0).alias("as_u")))).alias("end"))
    return ends.groupBy("end.node").agg(F.sum("end.as_u").alias("ups"), F.count(F.lit(1)).alias("n")).where("ups > 1 or ups = 1 and n > 1").isEmpty()


def components(links: DataFrame, a: str, b: str, most: int = 40) -> DataFrame:
    """(node, root) for all nodes of the links: root is the least node of the component. Links are pairs of longs."""
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    for _ in range(most):
        if _is_forest_of_stars(edges):
            break
        edges = written(_star(_star(edges, True), False), "stars")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
