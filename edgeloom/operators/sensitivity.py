"""How the corpus findings change with the graphs that are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.edits import deletion_severity
from edgeloom.operators.graphs import Graphs
from edgeloom.operators.stats import edge_betweenness, impact_betweenness, path_multiplicity, spearman


def corpus_rows(g: Graphs) -> DataFrame:
    """A row a graph: edges, density, multi-path fraction, rank gap of severity and of lost pairs against betweenness."""
    lost = spearman(deletion_severity(g).join(edge_betweenness(g), ["graph_id", "u", "v"]), "lost", "normalised", "graph_id")
    lost = lost.select("graph_id", F.round(1 - F.round("rho", 9), 9).alias("lost_gap"))
    rows = path_multiplicity(g).join(impact_betweenness(g), "graph_id").join(lost, "graph_id").join(g.sizes.select("graph_id", "n", "m"), "graph_id")
    return rows.select("graph_id", F.col("m").alias("edges"), F.round(F.col("m") / F.col("n"), 12).alias("density"), F.round("multi_path_fraction", 12).alias("multiplicity"), "gap", "lost_gap")


def sensitivities(rows: DataFrame, least_edges: int = 6, drop_prefix: str = "workday", over: float = 0.05) -> DataFrame:
    """Rho of multiplicity and gap for each variant: all graphs, larger ones, without a name prefix, with many paths; of density; and of the lost-pair gap."""
    r = rows.filter("gap is not null")
    pick = lambda name, df, x="multiplicity", y="gap": df.select(F.lit(name).alias("variant"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    parts = [
        pick("all", r), pick("larger", r.filter(F.col("edges") >= least_edges)), pick("without_prefix", r.filter(~F.lower("graph_id").startswith(drop_prefix))),
        pick("many_paths", r.filter(F.col("multiplicity") > over)), pick("density", r, "density"), pick("lost_pairs", r.filter("lost_gap is not null"), y="lost_gap"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return spearman(out, "x", "y", "variant").select("variant", F.col("items").alias("graphs"), F.round("rho", 9).alias("rho"))


def null_exceedance(summary: DataFrame) -> DataFrame:
    """One row over a null summary: graphs above the nulls' mean and outside their interval, and the nulls' medians."""
    o = F.col("observed_gini")
    return summary.agg(
        F.count_if(o > F.col("null_gini_mean")).alias("above_mean"), F.count_if(o > F.col("null_gini_high")).alias("above_high"), F.count_if(o < F.col("null_gini_low")).alias("below_low"),
        F.round(F.percentile("null_gini_mean", 0.5), 7).alias("median_null_gini"), F.round(F.percentile("null_top_share_mean", 0.5), 7).alias("median_null_top_share"),
    )


def advantage(curves: DataFrame, scenario: str = "uniform_10pct", budget: str = "10pct", tolerance: float = 1e-10) -> DataFrame:
    """One row: percentage points by which ranking by impact beats ranking by betweenness at a budget, with wins and ties."""
    at = curves.filter((F.col("scenario") == scenario) & (F.col("budget") == budget))
    a = at.filter("strategy = 'impact'").select("graph_id", F.col("removed_risk").alias("x"))
    b = at.filter("strategy = 'edge_betweenness'").select("graph_id", F.col("removed_risk").alias("y"))
    d = 100 * (F.col("x") - F.col("y"))
    return a.join(b, "graph_id").agg(F.count("*").alias("projects"), F.count_if(F.abs(d) <= 100 * tolerance).alias("ties"), F.count_if(d > 100 * tolerance).alias("wins"), F.round(F.avg(d), 6).alias("mean_points"), F.round(F.max(d), 6).alias("max_points"))


def deepest(rows: DataFrame, limit: int = 15) -> DataFrame:
    """The ``limit`` deepest graphs, then those with most edges, then by name; rows with ``depth``, ``m``, ``graph_id``."""
    return rows.orderBy(F.desc_nulls_last("depth"), F.desc("m"), "graph_id").limit(limit)


def draft_status(sizes: DataFrame) -> DataFrame:
    """Status labels of the gap analysis; the first that applies."""
    s = F.when(F.col("n") == 0, "no-models").when(F.col("duplicate_model_names") > 0, "duplicate-model-names").when(F.col("unresolved_refs") > 0, "unresolved-refs").when(F.col("depth").isNull(), "cycle").when(F.col("m") == 0, "no-lineage").otherwise("eligible")
    return sizes.withColumn("status", s)
