"""Which edges to verify first: features, error scenarios, rankings, budget curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.edits import deletion_severity
from edgeloom.operators.graphs import Graphs
from edgeloom.operators.stats import edge_betweenness, spearman
from edgeloom.plans.storage import materialize

# Strategies, scenarios, budgets and the probability limits.
STRATEGIES = ("impact", "expected_risk", "edge_betweenness", "degree_product", "downstream_closure", "upstream_closure")
SCENARIOS = ("uniform_10pct", "anti_impact_degree", "pro_betweenness")
BUDGETS = (0.05, 0.10, 0.20, 0.30)
MEAN_ERROR, LEAST_ERROR, MOST_ERROR = 0.10, 0.001, 0.95


def priority_status(sizes: DataFrame) -> DataFrame:
    """``eligible`` graphs have five edges and depth two; cyclic, unresolved or ambiguous ones are ``excluded``."""
    out = F.when((F.col("n") == 0) | (F.col("unresolved_refs") > 0) | (F.col("duplicate_model_names") > 0) | F.col("depth").isNull(), "excluded").when((F.col("m") < 5) | (F.col("depth") < 2), "control-only").otherwise("eligible")
    return sizes.withColumn("status", out)


def eligible(g: Graphs) -> DataFrame:
    return g.sizes.filter("m >= 5 and depth >= 2").select("graph_id")


def edge_features(g: Graphs) -> DataFrame:
    """Per edge: impact (severity), betweenness, degree product, and sizes of the closures below and above."""
    out_ = g.edges.groupBy("graph_id", F.col("src").alias("u")).agg(F.count("*").alias("o"))
    in_ = g.edges.groupBy("graph_id", F.col("dst").alias("v")).agg(F.count("*").alias("i"))
    down = g.reach0.groupBy("graph_id", F.col("src").alias("v")).agg(F.count("*").alias("downstream_closure"))
    up = g.reach0.groupBy("graph_id", F.col("dst").alias("u")).agg(F.count("*").alias("upstream_closure"))
    key = ["graph_id", "u", "v"]
    r = deletion_severity(g).select(*key, F.col("severity").alias("impact")).join(edge_betweenness(g).select(*key, F.col("normalised").alias("edge_betweenness")), key)
    r = r.join(out_, ["graph_id", "u"]).join(in_, ["graph_id", "v"]).join(down, ["graph_id", "v"]).join(up, ["graph_id", "u"])
    return r.select(*key, "impact", "edge_betweenness", (F.col("o") * F.col("i")).alias("degree_product"), "downstream_closure", "upstream_closure")


def eligible_features(g: Graphs) -> DataFrame:
    return materialize(edge_features(g).join(eligible(g), "graph_id", "left_semi"), "features")


def with_errors(features: DataFrame) -> DataFrame:
    """``features`` of all edges of their graphs, for each scenario, with ``error_probability`` and ``expected_risk``.

    The means are taken over rows dealt by ``graph_id``, before the scenarios are written out.
    """
    one = Window.partitionBy("graph_id")
    scaled = lambda raw: F.least(F.lit(MOST_ERROR), F.greatest(F.lit(LEAST_ERROR), raw * (F.lit(MEAN_ERROR) / F.avg(raw).over(one))))
    odds = {"uniform_10pct": F.lit(MEAN_ERROR), "anti_impact_degree": scaled(1.0 / (1.0 + F.col("degree_product"))), "pro_betweenness": scaled(0.25 + F.col("edge_betweenness"))}
    each = features.withColumn("odds", F.array(*[F.struct(F.lit(s).alias("scenario"), odds[s].alias("error_probability")) for s in SCENARIOS]))
    each = each.withColumn("x", F.explode("odds")).select(*features.columns, "x.*")
    return each.withColumn("expected_risk", F.col("error_probability") * F.col("impact"))


def error_rows(g: Graphs) -> DataFrame:
    """Edge features of eligible graphs for each scenario, with ``error_probability`` and ``expected_risk``."""
    return with_errors(eligible_features(g))


def budget_curves(g: Graphs) -> DataFrame:
    """Per graph, scenario, strategy and budget: the share of expected risk that verifying the first edges removes.

    Ties go to the larger impact, then to the later source and target names.  Edges get their names and are dealt by
    ``graph_id`` once, before they are written out for scenarios and strategies; budgets are columns of one sum.
    """
    rows = with_errors(g.named(eligible_features(g), src_name="u", dst_name="v"))
    key = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.round(F.col(s).cast("double"), 12).alias("score")) for s in STRATEGIES])).alias("x")
    rows = rows.select("graph_id", "scenario", "impact", "expected_risk", "src_name", "dst_name", key).select("*", "x.strategy", "x.score")
    one = Window.partitionBy("graph_id", "scenario", "strategy")
    rows = rows.withColumns({"place": F.row_number().over(one.orderBy(F.desc("score"), F.desc("impact"), F.desc("src_name"), F.desc("dst_name"))), "n": F.count("*").over(one)})
    first = lambda budget: F.col("place") <= F.greatest(F.lit(1), F.ceil(F.lit(budget) * F.col("n")))
    tops = {f"{int(b * 100)}pct": F.sum(F.when(first(b), F.col("expected_risk")).otherwise(0.0)) for b in BUDGETS}
    sums = rows.groupBy("graph_id", "scenario", "strategy").agg(F.sum("expected_risk").alias("total"), *[top.alias(name) for name, top in tops.items()])
    share = lambda name: F.when(F.col("total") > 0, F.col(name) / F.col("total")).otherwise(0.0)
    curve = F.explode(F.array(*[F.struct(F.lit(name).alias("budget"), F.round(share(name), 9).alias("removed_risk")) for name in tops]))
    return sums.select("graph_id", "scenario", "strategy", curve.alias("x")).select("graph_id", "scenario", "strategy", "x.*")


def scenario_macro(curves: DataFrame) -> DataFrame:
    """Per scenario, strategy and budget: mean, median, least and most removed risk over graphs."""
    x = "removed_risk"
    return curves.groupBy("scenario", "strategy", "budget").agg(F.count("*").alias("projects"), F.round(F.avg(x), 8).alias("mean"), F.round(F.percentile(x, 0.5), 7).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"))


def pairwise_wins(curves: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Per scenario and budget: how often ranking by impact beats ranking by betweenness, ties and losses, and the mean difference."""
    a = curves.filter("strategy = 'impact'").select("graph_id", "scenario", "budget", F.col("removed_risk").alias("x"))
    b = curves.filter("strategy = 'edge_betweenness'").select("graph_id", "scenario", "budget", F.col("removed_risk").alias("y"))
    d = F.col("x") - F.col("y")
    return a.join(b, ["graph_id", "scenario", "budget"]).groupBy("scenario", "budget").agg(F.round(F.avg(d), 8).alias("mean_delta"), F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"))


def impact_rank_correlation(g: Graphs) -> DataFrame:
    """One row: median, least and most Spearman's rho of impact and betweenness over eligible graphs."""
    f = edge_features(g).join(eligible(g), "graph_id", "left_semi")
    r = spearman(f, "impact", "edge_betweenness", "graph_id").filter("rho is not null")
    return r.agg(F.count("*").alias("projects"), F.round(F.percentile("rho", 0.5), 9).alias("median"), F.round(F.min("rho"), 9).alias("min"), F.round(F.max("rho"), 9).alias("max"))
