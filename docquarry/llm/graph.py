"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Stored (node, component) of every node on an edge; component is the smallest node reachable.

    Each round only compares a node with the smallest of its neighbours, found by a partial aggregate, so a node with
    very many neighbours costs one joined row each and the planner may split it. Rounds are stored in the shared
    folder. Self-links are allowed; nulls must not occur; no edges give no rows.
    """
    links = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u > v").distinct()
    links = store(links, "links")
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        last, links = links, store(_small_star(_large_star(links)), "links")
        discard(last)
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # stars: v is the smallest node of u's component
    found = store(links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v")).distinct(), "components")
    discard(links)
    return found


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest neighbour (or the node itself)."""
    both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).union(links.select("v", "u"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
