"""Path tables of many graphs at once, by doubling.

Every relation carries ``graph_id``, so a corpus of graphs, or thousands of null samples,
is one query over more rows.  Instead of one join per path length, walks of exactly
2^i edges are squared: a graph of depth d takes log2(d) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.plans.storage import discard, materialize


#: Two primes.  Path counts are kept modulo both, so that no count can overflow.
PRIMES = (2147483647, 2147483629)


def path_table(nodes: DataFrame, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """All connected pairs of acyclic graphs, the reflexive ones included.

    ``nodes(graph_id, node_id)``, ``edges(graph_id, src, dst)``, both distinct.  Returns
    ``graph_id, src, dst, paths, r1, r2, dist, sigma, longest``: the number of directed paths up to 2 (then
    it is 2), that number modulo the two ``PRIMES``, the length of a shortest path and how many are as short (a
    double), and the length of a longest one.  Counts grow with 2^depth, so none is held exactly; two
    counts of which one can't exceed the other differ, if they do, in a residue but for a chance of 2^-62.
    A cycle raises.
    """
    times = lambda x, y: [(F.col(f"{x}.{c}") * F.col(f"{y}.{c}") % q).alias(c) for c, q in zip(("r1", "r2"), PRIMES, strict=True)]
    added = [F.least(F.lit(2), F.sum("paths")).cast("int").alias("paths"), *((F.sum(c) % q).alias(c) for c, q in zip(("r1", "r2"), PRIMES, strict=True))]
    one_path = [F.lit(1).alias("paths"), F.lit(1).cast("long").alias("r1"), F.lit(1).cast("long").alias("r2")]
    steps = materialize(edges.select("graph_id", "src", "dst", *one_path, F.lit(1.0).alias("many")), "walks")
    table = nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), *one_path, F.lit(0).alias("dist"), F.lit(1.0).alias("sigma"), F.lit(0).alias("longest"))
    table = materialize(table, "paths")
    most = nodes.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    length = 1
    for _ in range(max_rounds):
        if steps.isEmpty():
            return table
        if length > most:
            raise ValueError("a graph has a cycle")
        head, tail = steps.alias("h"), table.alias("t")
        longer = head.join(tail, (F.col("h.graph_id") == F.col("t.graph_id")) & (F.col("h.dst") == F.col("t.src"))).select(
            "h.graph_id", "h.src", "t.dst", (F.col("h.paths") * F.col("t.paths")).alias("paths"), *times("h", "t"), (F.col("t.dist") + length).alias("dist"), (F.col("h.many") * F.col("t.sigma")).alias("sigma"), (F.col("t.longest") + length).alias("longest")
        )
        key = ("graph_id", "src", "dst")
        both = table.unionByName(longer).repartition(*key)  # both groupings below keep this partitioning
        by_dist = both.groupBy(*key, "dist").agg(*added, F.sum("sigma").alias("sigma"), F.max("longest").alias("longest"))
        grown = by_dist.groupBy(*key).agg(*added, F.min(F.struct("dist", "sigma")).alias("s"), F.max("longest").alias("longest"))
        before, table = table, materialize(grown.select(*key, "paths", "r1", "r2", "s.dist", "s.sigma", "longest"), "paths")
        one, two = steps.alias("a"), steps.alias("b")
        twice = one.join(two, (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.dst") == F.col("b.src"))).select("a.graph_id", "a.src", "b.dst", (F.col("a.paths") * F.col("b.paths")).alias("paths"), *times("a", "b"), (F.col("a.many") * F.col("b.many")).alias("many"))
        old, steps = steps, materialize(twice.groupBy(*key).agg(*added, F.sum("many").alias("many")), "walks")
        discard(before, old)
        length *= 2
    raise ValueError("a graph has a cycle")


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``graph_id, src, dst`` of every pair joined by one edge or more; cycles are allowed and show as src = dst."""
    pairs = materialize(edges.select("graph_id", "src", "dst").distinct(), "reach")
    size = pairs.count()
    for _ in range(max_rounds):
        a, b = pairs.alias("a"), pairs.alias("b")
        more = a.join(b, (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.dst") == F.col("b.src"))).select("a.graph_id", "a.src", "b.dst")
        pairs = materialize(pairs.unionByName(more).distinct(), "reach")
        new = pairs.count()
        if new == size:
            return pairs
        size = new
    raise RuntimeError(f"the closure still grows after {max_rounds} rounds")


def weak_labels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``graph_id, node_id, label``: the least node of each node's weak component.

    Labels spread over edges both ways, then jump to their label's label.
    """
    both = materialize(edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select("graph_id", F.col("dst").alias("a"), F.col("src").alias("b"))).distinct(), "links")
    labels = materialize(nodes.select("graph_id", "node_id", F.col("node_id").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.alias("e").join(labels.alias("l"), (F.col("e.graph_id") == F.col("l.graph_id")) & (F.col("e.a") == F.col("l.node_id"))).select("e.graph_id", F.col("e.b").alias("node_id"), "l.label")
        low = labels.unionByName(near).groupBy("graph_id", "node_id").agg(F.min("label").alias("label"))
        low = materialize(low, "labels")
        jump = low.alias("x").join(low.alias("y"), (F.col("x.graph_id") == F.col("y.graph_id")) & (F.col("x.label") == F.col("y.node_id"))).select("x.graph_id", "x.node_id", "y.label")
        new = materialize(jump, "labels")
        moved = new.alias("n").join(labels.alias("o"), ["graph_id", "node_id"]).filter("n.label <> o.label").isEmpty()
        labels = new
        if moved:
            return labels
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
