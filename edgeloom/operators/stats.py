"""Concentration, rank correlation, betweenness and corpus summaries over groups of rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.edits import deletion_severity, deletions, lost_pairs, through
from edgeloom.operators.graphs import Graphs
from edgeloom.plans.paths import closure

#: Betweenness is rounded to so many decimals before it is ranked: sums of fractions differ in their last bits by order.
RANK_DECIMALS = 12


def concentration(rows: DataFrame, group: str, value: str, fraction: float = 0.1) -> DataFrame:
    """Per group: ``items``, ``gini`` (negatives count as 0) and ``top_share``, the share of the largest ``fraction`` (one at least); 0.0 where all are 0.

    Equal values are counted before they are ordered, so only a group's distinct values meet.
    """
    each = rows.select(group, F.col(value).cast("double").alias("raw")).groupBy(group, "raw").agg(F.count("*").alias("c"))
    all_ = Window.partitionBy(group)
    up, down = (all_.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("raw"), F.desc("raw")))
    each = each.withColumns({"below": F.coalesce(F.sum("c").over(up), F.lit(0)), "above": F.coalesce(F.sum("c").over(down), F.lit(0)), "n": F.sum("c").over(all_)})
    x, c = F.greatest(F.col("raw"), F.lit(0.0)), F.col("c")
    k = F.greatest(F.lit(1), F.ceil(F.lit(float(fraction)) * F.col("n")))
    ranks = c * F.col("below") + c * (c + 1) / 2  # the sum of the ranks from 1 of the rows that share the value
    s = each.groupBy(group).agg(F.sum("c").alias("items"), F.sum(c * x).alias("total"), F.sum(c * F.col("raw")).alias("raw_total"), F.sum(ranks * x).alias("w"), F.sum(F.col("raw") * F.greatest(F.lit(0), F.least(c, k - F.col("above")))).alias("top"))
    n = F.col("items")
    gini = F.when(F.col("total") > 0, 2 * F.col("w") / (n * F.col("total")) - (n + 1) / n).otherwise(0.0)
    share = F.when(F.col("raw_total") > 0, F.col("top") / F.col("raw_total")).otherwise(0.0)
    return s.select(group, "items", gini.alias("gini"), share.alias("top_share"))


def average_rank(value: str, *group: str) -> Column:
    """Rank from 1; ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / F.lit(2.0)


def pearson(x: str, y: str) -> Column:
    """An aggregate; null for fewer than three rows or without variance."""
    return F.when(F.count("*") >= 3, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def spearman(rows: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """Per group: ``items`` and ``rho``."""
    r = rows.select(*group, average_rank(x, *group).alias("_x"), average_rank(y, *group).alias("_y"))
    return r.groupBy(*group).agg(F.count("*").alias("items"), pearson("_x", "_y").alias("rho"))


def percentile(value: str, q: float) -> Column:
    """Exact, linear between neighbours; 0.0 without rows."""
    return F.coalesce(F.percentile(F.col(value).cast("double"), q), F.lit(0.0))


def edge_betweenness(g: Graphs) -> DataFrame:
    """Per edge: the sum over pairs of the share of shortest paths through it, and that over n(n-1)."""
    pair = g.reach.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), "dist", "sigma")
    on = through(g, deletions(g)).join(pair, ["graph_id", "a", "b"]).filter("d = dist")
    raw = on.groupBy("graph_id", "u", "v").agg(F.sum(F.col("s") / F.col("sigma")).alias("betweenness"))
    every = deletions(g).select("graph_id", "u", "v").join(raw, ["graph_id", "u", "v"], "left").fillna(0.0, ["betweenness"]).join(g.sizes.select("graph_id", "n"), "graph_id")
    norm = F.when(F.col("n") > 1, F.col("betweenness") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return every.select("graph_id", "u", "v", F.round("betweenness", RANK_DECIMALS).alias("betweenness"), F.round(norm, RANK_DECIMALS).alias("normalised"))


def path_multiplicity(g: Graphs) -> DataFrame:
    """Per graph: connected pairs, those with two paths or more, and their fraction."""
    p = g.reach.groupBy("graph_id").agg(F.count("*").alias("pairs"), F.count_if(F.expr("paths >= 2")).alias("multi"))
    p = g.sizes.select("graph_id").join(p, "graph_id", "left").fillna(0)
    return p.select("graph_id", F.col("pairs").alias("reachable_pairs"), F.col("multi").alias("multi_path_pairs"), F.when(F.col("pairs") > 0, F.col("multi") / F.col("pairs")).otherwise(0.0).alias("multi_path_fraction"))


def multi_hop_anchors(g: Graphs) -> DataFrame:
    """Per graph: nodes with some node at a shortest distance of two or more."""
    far = g.reach.filter("dist >= 2").groupBy("graph_id").agg(F.countDistinct("src").alias("anchors"))
    return g.sizes.select("graph_id").join(far, "graph_id", "left").fillna(0)


def closure_severity(g: Graphs) -> DataFrame:
    """Severity again, by closing each graph without the edge: an independent, costlier way, for checks."""
    key = F.concat_ws("|", "e.graph_id", "d.u", "d.v")
    e, d = g.edges.alias("e"), deletions(g).alias("d")
    left = e.join(d, (F.col("e.graph_id") == F.col("d.graph_id")) & ~((F.col("src") == F.col("u")) & (F.col("dst") == F.col("v")))).select(key.alias("graph_id"), "src", "dst")
    still = closure(left).select(F.col("graph_id").alias("key"), F.col("src").alias("a"), F.col("dst").alias("b"))
    pair = g.reach.select(F.col("graph_id").alias("pg"), F.col("src").alias("a"), F.col("dst").alias("b"))
    every = deletions(g).withColumn("key", F.concat_ws("|", "graph_id", "u", "v"))
    lost = every.join(pair, F.col("graph_id") == F.col("pg")).join(still, ["key", "a", "b"], "left_anti")
    s = lost.groupBy("graph_id", "u", "v").agg(F.sum(F.when(F.col("a") != F.col("u"), 1).otherwise(0) + F.when(F.col("b") != F.col("v"), 1).otherwise(0)).alias("closure_severity"))
    return every.select("graph_id", "u", "v").join(s, ["graph_id", "u", "v"], "left").fillna(0)


def lemma_check(g: Graphs) -> DataFrame:
    """Per edge: lost pairs L, betweenness EB, multi-path pairs through it M; does 0 <= EB - L <= M hold, and severity = 2L - A - B?"""
    lost = lost_pairs(g).groupBy("graph_id", "u", "v").agg(F.count("*").alias("lost"), F.count_if(F.expr("a = u")).alias("from_u"), F.count_if(F.expr("b = v")).alias("to_v"))
    pair = g.reach.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), "paths")
    many = through(g, deletions(g)).join(pair, ["graph_id", "a", "b"]).filter("paths >= 2").groupBy("graph_id", "u", "v").agg(F.count("*").alias("multi"))
    key = ["graph_id", "u", "v"]
    r = deletions(g).select(*key).join(lost, key, "left").join(many, key, "left").fillna(0).join(edge_betweenness(g).select(*key, "betweenness"), key)
    r = r.join(deletion_severity(g).select(*key, "severity"), key)
    gap = F.col("betweenness") - F.col("lost")
    slack = 10.0 ** -(RANK_DECIMALS - 2)
    identity = 2 * F.col("lost") - F.col("from_u") - F.col("to_v") == F.col("severity")
    return r.select(*key, "lost", F.round("betweenness", 9).alias("betweenness"), "multi", "severity", ((gap >= -slack) & (gap <= F.col("multi") + slack)).alias("bounds_hold"), identity.alias("identity_holds"))


def impact_betweenness(g: Graphs) -> DataFrame:
    """Per graph: Spearman's rho of severity and betweenness over its edges, and the gap 1 - rho."""
    rows = deletion_severity(g).join(edge_betweenness(g), ["graph_id", "u", "v"])
    return spearman(rows, "severity", "normalised", "graph_id").select("graph_id", F.col("items").alias("edges"), F.round("rho", 9).alias("spearman"), F.round(1 - F.round("rho", 9), 9).alias("gap"))


def leave_one_out(rows: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Rho of the rows without each one of them; one row a left-out ``key``.

    Leaving a row out lowers the ranks above it by one and those of its ties by a half, so
    every rho follows from sums over the whole and the count of rows that are larger in both; that count is
    taken by one task over two numbers a row (``rows`` holds a row a graph), in n log n steps.
    """
    r = rows.select(F.col(key).alias("left_out"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null").withColumn("_one", F.lit(1))
    kind = dict(r.dtypes)["left_out"]
    return r.groupBy("_one").applyInPandas(lambda t: _left_out(t), f"left_out {kind}, items long, rho double")


def _left_out(t):
    import numpy as np

    x, y = t["x"].to_numpy(), t["y"].to_numpy()
    n = len(x)
    rank = [(np.searchsorted(np.sort(v), v) + np.searchsorted(np.sort(v), v, side="right") + 1) / 2 for v in (x, y)]

    def lowered(v, w):
        """Sum of w over the rows above each row in v, and half of it over its ties, itself left out."""
        order = np.argsort(v, kind="stable")
        run = np.concatenate([[0.0], np.cumsum(w[order])])
        low, high = np.searchsorted(v[order], v), np.searchsorted(v[order], v, side="right")
        return run[-1] - run[high] + (run[high] - run[low] - w) / 2

    p, q = rank
    above_x, above_y = lowered(x, np.ones(n)), lowered(y, np.ones(n))
    # how often both ranks fall: rows above in both count 1, above in one and tied in the other 1/2, tied in both 1/4
    both = np.zeros(n)
    order = np.lexsort((-y, -x))
    seen: list[float] = []
    at = 0
    while at < n:
        end = at
        while end < n and x[order[end]] == x[order[at]]:
            end += 1
        tied = np.sort(y[order[at:end]])
        for i in order[at:end]:
            over, same = len(seen) - bisect_right(seen, y[i]), bisect_right(seen, y[i]) - bisect_left(seen, y[i])
            t_over, t_same = len(tied) - np.searchsorted(tied, y[i], side="right"), np.searchsorted(tied, y[i], side="right") - np.searchsorted(tied, y[i]) - 1
            both[i] = over + same / 2 + t_over / 2 + t_same / 4
        for v in tied.tolist():
            insort(seen, v)
        at = end
    m = n - 1
    sum_pq = (p * q).sum() - p * q - lowered(x, q) - lowered(y, p) + both
    # squares: a rank that falls by d goes from p to p - d
    squares = [(r * r).sum() - r * r - 2 * lowered(v, r) + lowered(v, np.ones(n)) - ties / 4 for r, v, ties in ((p, x, _ties(x)), (q, y, _ties(y)))]
    sum_p, sum_q = p.sum() - p - above_x, q.sum() - q - above_y
    with np.errstate(divide="ignore", invalid="ignore"):
        va, vb = squares[0] - sum_p**2 / m, squares[1] - sum_q**2 / m
        out = np.where((m >= 3) & (va > 1e-9) & (vb > 1e-9), (sum_pq - sum_p * sum_q / m) / np.sqrt(va * vb), np.nan)
    import pandas as pd

    return pd.DataFrame({"left_out": t["left_out"], "items": m, "rho": [None if np.isnan(v) else float(v) for v in out]})


def _ties(v):
    """How many other rows share each row's value."""
    import numpy as np

    order = np.sort(v)
    return np.searchsorted(order, v, side="right") - np.searchsorted(order, v) - 1


def leave_one_out_range(rows: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """One row: the least and the largest rho of ``leave_one_out``; null if there is none."""
    return leave_one_out(rows, x, y, key).agg(F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"))


def severity_summary(g: Graphs) -> DataFrame:
    """Per graph: edges, severity's sum, mean, maximum, zero count, concentration, and redundant edges."""
    s = deletion_severity(g)
    agg = s.groupBy("graph_id").agg(F.count("*").alias("edges"), F.sum("severity").alias("total"), F.avg("severity").alias("mean"), F.max("severity").alias("max"), F.count_if(F.expr("severity = 0")).alias("zero"), F.count_if(F.expr("alternate_path")).alias("redundant"))
    c = concentration(s, "graph_id", "severity")
    return agg.join(c, "graph_id").select("graph_id", "edges", "total", F.round("mean", 9).alias("mean"), "max", "zero", "redundant", F.round("gini", 9).alias("gini"), F.round("top_share", 9).alias("top_share"))


def corpus_summary(g: Graphs) -> DataFrame:
    """One row: totals, depths, the pooled and the per-graph view of concentration, and the totals without the largest graph."""
    s = severity_summary(g).join(g.sizes.select("graph_id", "depth"), "graph_id")
    pooled = concentration(deletion_severity(g).withColumn("all", F.lit(1)), "all", "severity")
    macro = s.agg(
        F.count("*").alias("graphs"), F.sum("edges").alias("edges"), F.sum("total").alias("severity"), F.count_if(F.expr("depth >= 3")).alias("depth_3"), F.count_if(F.expr("depth >= 4")).alias("depth_4"),
        F.round(F.percentile("gini", 0.5), 7).alias("median_gini"), F.min("gini").alias("min_gini"), F.max("gini").alias("max_gini"), F.round(F.percentile("top_share", 0.5), 7).alias("median_top_share"),
    )
    largest = s.orderBy(F.desc("edges"), "graph_id").limit(1).select(F.col("graph_id").alias("largest"), F.col("edges").alias("largest_edges"), F.col("total").alias("largest_total"))
    out = macro.crossJoin(pooled.select(F.round("gini", 9).alias("pooled_gini"), F.round("top_share", 9).alias("pooled_top_share"))).crossJoin(largest)  # single rows
    return out.withColumn("edges_without_largest", F.col("edges") - F.col("largest_edges")).withColumn("severity_without_largest", F.col("severity") - F.col("largest_total")).drop("largest_edges", "largest_total")


def status(sizes: DataFrame) -> DataFrame:
    """Replication status of graphs with ``n, m, depth, unresolved_refs, duplicate_model_names``; the first that applies."""
    s = F.when(F.col("n") == 0, "no-models").when(F.col("duplicate_model_names") > 0, "duplicate-model-names").when(F.col("unresolved_refs") > 0, "unresolved-refs").when(F.col("depth").isNull(), "cycle").when(F.col("m") == 0, "direct-only-no-lineage").otherwise("eligible")
    return sizes.withColumn("status", s)


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    """Rows of each status."""
    return rows.groupBy(column).agg(F.count("*").alias("projects"))
