"""Distributed connected components: alternating large-star and small-star steps.

Links are (a, b) pairs of ids.  A step finds each node's least neighbour by an aggregation,
which combines before its shuffle, and joins it back to the links
by ``spread_join``, which deals a hub's links over many tasks.
Links that a step makes equal are merged before they are shuffled.  No
neighbourhood is held in memory and no link is collected.  A round's links are written to
the shared folder, so that no lineage grows.  A round in which no link moves is the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.shared import discard, materialize, spread_join


def _with_least(links: DataFrame, total: int) -> DataFrame:
    """``links`` with ``m``, the least ``b`` of their ``a``; the links of hubs are spread."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return spread_join(links, least, ["a"], "b", total).drop("n")


def _large(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node goes to the least of the node and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _with_least(both, total).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"), (F.col("m") < F.col("a")).alias("moved"))
    return near.groupBy("a", "b").agg(F.max("moved").alias("moved"))


def _small(links: DataFrame, total: int) -> DataFrame:
    """A node, and every smaller neighbour of it, goes to its least smaller neighbour; ``links`` are distinct."""
    low = _with_least(links, total).withColumn("other", F.col("b") != F.col("m"))
    # the row of the least neighbour keeps the node itself; each other row carries its neighbour on
    return low.select(F.when(F.col("other"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"), (F.col("moved") | F.col("other")).alias("moved")).filter("a <> b")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id`` and ``component_id`` (the least id it can reach) of each id that has a link.

    Self links and repeated links are allowed, no links at all give no rows; null ids must
    not occur.  Raises if links still move after ``rounds`` rounds (a few do: the number
    grows with the logarithm of the longest path).
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = materialize(links.withColumn("moved", F.lit(False)), "links")
    total = links.count()
    for _ in range(rounds if total else 0):
        before, links = links, materialize(_small(_large(links, total), total), "links")
        discard(before)
        state = links.agg(F.count("*").alias("n"), F.coalesce(F.max("moved"), F.lit(False)).alias("moved")).first()
        total = state["n"]
        if not state["moved"]:
            break
    else:
        if total:
            raise RuntimeError(f"links still move after {rounds} rounds")
    pairs = links.select("a", "b").distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
