"""Graphs as DataFrames keyed by ``graph_id``, with their shared path table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.plans.paths import path_table
from edgeloom.plans.storage import materialize


class Graphs:
    """Acyclic lineage graphs and their foreign keys.

    ``nodes(graph_id STRING, node_id INT, name STRING)``; ``edges(graph_id, src, dst)``;
    ``fk(graph_id, child, parent)``.  Edges are sets: repeated rows count once.  The path
    table and what derives from it are computed once and shared by all operators.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, fk: DataFrame | None = None):
        self.nodes = materialize(nodes.select("graph_id", "node_id", "name").distinct(), "nodes")
        self.edges = materialize(edges.select("graph_id", "src", "dst").distinct(), "edges")
        self.fk = materialize(fk.select("graph_id", "child", "parent").distinct(), "fk") if fk is not None else self.edges.select("graph_id", F.col("src").alias("child"), F.col("dst").alias("parent")).limit(0)

    @cached_property
    def reach0(self) -> DataFrame:
        """Path table with the reflexive pairs."""
        return path_table(self.nodes, self.edges)

    @cached_property
    def reach(self) -> DataFrame:
        return self.reach0.filter("src <> dst")

    @cached_property
    def levels(self) -> DataFrame:
        """Longest path that ends in each node."""
        return materialize(self.reach0.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.max("longest").alias("level")), "levels")

    @cached_property
    def sizes(self) -> DataFrame:
        """``graph_id, n, m, fk_edges, depth`` of each graph."""
        n = self.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
        m = self.edges.groupBy("graph_id").agg(F.count("*").alias("m"))
        f = self.fk.groupBy("graph_id").agg(F.count("*").alias("fk_edges"))
        d = self.levels.groupBy("graph_id").agg(F.max("level").alias("depth"))
        return materialize(n.join(m, "graph_id", "left").join(f, "graph_id", "left").join(d, "graph_id", "left").fillna(0, ["m", "fk_edges"]), "sizes")

    def named(self, df: DataFrame, **columns: str) -> DataFrame:
        """``df`` with name columns: ``named(df, anchor='src')`` adds ``anchor``, the name of node ``src``."""
        for out, column in columns.items():
            names = self.nodes.select(F.col("graph_id").alias("_g"), F.col("node_id").alias("_n"), F.col("name").alias(out))
            df = df.join(names, (df["graph_id"] == names["_g"]) & (df[column] == names["_n"]), "left").drop("_g", "_n")
        return df
