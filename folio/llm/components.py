"""Connected components of an edge list, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.llm.storage import store


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    Each round runs a large-star step (every larger neighbour of a node moves to the smallest
    node around it) and a small-star step (the same for the smaller neighbours). Both are a
    map-side combined minimum and an equi-join; no neighbour list is ever gathered, so a hub
    costs rows, not memory, and its join partition can be split. The number of rounds grows
    with the logarithm of the longest path. Self-edges, repeated edges and null ends are
    ignored; an empty list gives an empty result.
    """
    kept = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    stars = store(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(stars)
    while mark[0]:
        stars = store(_small_star(_large_star(stars)), "stars")
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
