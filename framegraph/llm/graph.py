"""Connected components over edge tables too large for any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


#: Tasks that the edges of one vertex are spread over.
SALT = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with m, the least neighbour of a (least: a, m); a vertex with very many edges is spread out."""
    spread = least.select(F.col("a").alias("_a"), "m", F.explode(F.array(*(F.lit(k) for k in range(SALT)))).alias("_s"))
    salt = F.pmod(F.xxhash64("b"), F.lit(SALT))
    return edges.join(spread, (F.col("a") == F.col("_a")) & (salt == F.col("_s"))).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of edges (a, b); the component is its smallest vertex.

    Alternates large-star and small-star steps until edges are stars around the smallest vertices: each step is a
    map-side combined minimum per vertex and a salted join.
    """
    edges = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, _state(edges)
    while before != now:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _with_least(both.where(F.col("b") > F.col("a")), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = _with_least(large, small)
        moved = hung.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, _state(edges)
    roots = edges.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(roots)
