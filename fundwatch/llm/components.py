"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _hooked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with the least neighbour ``m`` of ``u``. The minima are written first: between two plain shuffles Spark can split a node with very many links."""
    least = written(rows.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    return rows.join(least, "u"), least


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of the links (a, b); null ends are ignored.

    Each round sends every node's larger neighbours, then its smaller ones, to its least
    neighbour; the number of rounds grows with the logarithm of the longest path. All steps
    are joins and partial aggregates, each round is written, and the earlier one removed.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(pairs, "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, least = _hooked(both)
        large = written(joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "links")
        dropped(least)
        dropped(edges)
        joined, least = _hooked(large)
        stars = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(stars.filter("u <> v").distinct(), "links")
        dropped(least)
        dropped(large)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
