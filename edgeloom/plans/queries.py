"""The registered lineage queries, over graphs derived from the order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import seeded
from edgeloom.operators import answers as A
from edgeloom.operators import edits as E
from edgeloom.operators import priority as P
from edgeloom.operators import sensitivity as N
from edgeloom.operators import stats as S
from edgeloom.operators.graphs import Graphs
from edgeloom.plans.storage import discard, materialize
from edgeloom.sources import projects as X

# Every row of orders, or of lineitem, is an edge of some graph: a block of 120 (60) keys and a remainder name the
# graph, other remainders its nodes, so the number of graphs grows with the input.
MULTI = "select distinct (o_orderkey - 1) - (o_orderkey - 1) % 120 + o_custkey % 10 as project, least(a, b) as src, greatest(a, b) as dst from (select o_orderkey, o_custkey, o_orderkey % 12 as a, (o_orderkey + 1 + o_custkey % 4) % 12 as b from orders) x where a <> b"
DENSE = "select distinct z as project, least(a, b) as src, greatest(a, b) as dst from (select (l_orderkey - 1) - (l_orderkey - 1) % 60 as z, l_partkey % 24 as a, l_suppkey % 24 as b from lineitem) x where a <> b"
FK = "select distinct (o_orderkey - 1) - (o_orderkey - 1) % 120 + o_custkey % 10 as project, (o_orderkey + 5) % 12 as child, (o_custkey * 7 + 3) % 12 as parent from orders where (o_orderkey + 5) % 12 <> (o_custkey * 7 + 3) % 12"

#: Table, edges, foreign keys and nodes a graph.
SHAPES = {"multi": ("orders", MULTI, FK, 12), "dense": ("lineitem", DENSE, None, 24)}

_GRAPHS: dict[tuple, Graphs] = {}


def graphs(spark: SparkSession, sf_dir: str, name: str = "multi") -> Graphs:
    """The graphs of a shape; their path tables are shared by all queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _GRAPHS:
        table, text, keys, size = SHAPES[name]
        view = f"edgeloom_{table}"
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(view)
        text = text.replace(f"from {table}", f"from {view}")
        graph = F.concat(F.lit("p"), F.col("project").cast("string")).alias("graph_id")
        edges = spark.sql(text).select(graph, F.col("src").cast("int"), F.col("dst").cast("int"))
        nodes = edges.select("graph_id").distinct().select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("node_id")).withColumn("name", F.concat(F.lit("t"), F.lpad(F.col("node_id").cast("string"), 2, "0")))
        fk = spark.sql(keys.replace(f"from {table}", f"from {view}")).select(graph, F.col("child").cast("int"), F.col("parent").cast("int")) if keys else None
        g = Graphs(nodes, edges, fk)
        if fk is not None:
            # written again: a join has neither the weight nor the rows of a table, and every query would make it anew
            # (graphs that have edges have nodes, and with them node 0)
            every, g.fk = g.fk, materialize(g.fk.join(g.nodes.filter("node_id = 0").select("graph_id"), "graph_id", "left_semi"), "fk")
            discard(every)
        _GRAPHS[key] = g
    return _GRAPHS[key]


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project text made from the multi graphs: a model a node, a reference an edge, some sources, unresolved references and tests."""
    g = graphs(spark, sf_dir)
    refs = g.named(g.edges, r="src").groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("{{ ref('"), "r", F.lit("') }}")))), " join ").alias("refs"))
    m = g.nodes.join(refs, ["graph_id", "node_id"], "left")
    lead = F.when(F.col("node_id") % 3 == 0, F.concat(F.lit("{{ source('raw', '"), "name", F.lit("') }} "))).otherwise("")
    lost = F.when((F.col("node_id") == 11) & F.col("graph_id").isin("p1", "p7"), "{{ ref('pkg', 'gone') }} ").otherwise("")
    models = m.select(F.col("graph_id").alias("project"), F.concat(F.lit("models/"), "name", F.lit(".sql")).alias("path"), F.concat(F.lit("select * from "), lead, lost, F.coalesce("refs", F.lit(""))).alias("text"))
    one = g.nodes.select("graph_id").distinct()
    top = one.select(F.col("graph_id").alias("project"), F.lit("dbt_project.yml").alias("path"), F.concat(F.lit("name: "), "graph_id").alias("text"))
    tests = one.filter("graph_id in ('p2', 'p3', 'p5')").select(F.col("graph_id").alias("project"), F.lit("models/schema.yml").alias("path"), F.lit("relationships:\n  to: ref('t01')\nrelationships:\n  to: ref('none')\n").alias("text"))
    return models.unionByName(top).unionByName(tests)


def manifest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests that know the edges out of even nodes, and one source a project."""
    g = graphs(spark, sf_dir)
    e = g.named(g.edges.filter("src % 2 = 0"), s="src").groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.collect_list(F.concat(F.lit("model.own."), "s")).alias("deps"))
    n = g.nodes.join(e, ["graph_id", "node_id"], "left")
    deps = F.concat(F.coalesce("deps", F.array().cast("array<string>")), F.when(F.col("node_id") == 0, F.array(F.lit("source.own.raw.t00"))).otherwise(F.array().cast("array<string>")))
    node = F.struct(F.lit("model").alias("resource_type"), F.lit("own").alias("package_name"), F.col("name"), F.struct(deps.alias("nodes")).alias("depends_on"))
    m = n.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("model.own."), "name"), node))).alias("nodes"))
    return m.select(F.col("graph_id").alias("project"), F.struct(F.lit("own").alias("project_name")).alias("metadata"), "nodes", F.create_map(F.lit("source.own.raw.t00"), F.struct(F.lit("raw").alias("source_name"), F.lit("t00").alias("name"))).alias("sources"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold questions: the generated ones without those whose text holds t07, and one extra a graph."""
    g = graphs(spark, sf_dir)
    q = A.questions(g).select("dataset", "subtype", "question", "answer").filter("question not like '%t07%'")
    extra = g.sizes.select(F.col("graph_id").alias("dataset"), F.lit("forward").alias("subtype"), F.lit("extra?").alias("question"), F.lit("t00").alias("answer"))
    return q.unionByName(extra)


def _relation(g: Graphs) -> DataFrame:
    """A row a graph: multi-path fraction against the rank gap."""
    return S.path_multiplicity(g).join(S.impact_betweenness(g), "graph_id").select("graph_id", "multi_path_fraction", "gap")


def _on(name: str, f: Callable[[Graphs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(graphs(spark, sf_dir, name))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _percentiles(g: Graphs) -> DataFrame:
    """Per graph: percentiles of the severity of its edges."""
    return E.deletion_severity(g).groupBy("graph_id").agg(*[F.round(S.percentile("severity", q), 9).alias(n) for n, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))])


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per graph: its status in the replication, in the gap analysis and in the priority study."""
    g = graphs(spark, sf_dir)
    lost = X.project_audit(project_files(spark, sf_dir)).select(F.col("project").alias("graph_id"), "unresolved_refs")
    sizes = g.sizes.join(lost, "graph_id").withColumn("duplicate_model_names", F.lit(0))
    out = S.status(sizes).withColumnRenamed("status", "replication")
    out = N.draft_status(out).withColumnRenamed("status", "draft")
    return P.priority_status(out).select("graph_id", "replication", "draft", F.col("status").alias("priority"))


def _direct_for_transitive(g: Graphs) -> DataFrame:
    """What is wrong where direct answers are given to transitive questions."""
    return E.set_distortion(A.elements(g, "transitive_downstream"), A.elements(g, "direct_downstream"), "graph_id", "anchor")


def _amplified(g: Graphs) -> DataFrame:
    """Per graph: incorrect elements of those answers for each edge that is missing from a graph without edges."""
    wrong = _direct_for_transitive(g).groupBy("graph_id").agg(F.sum("incorrect").alias("incorrect"))
    return wrong.join(g.sizes.select("graph_id", "m"), "graph_id").select("graph_id", "incorrect", "m", F.round(E.amplification(F.col("incorrect"), F.col("m")), 9).alias("amplification"))


def _sampled_check(g: Graphs) -> DataFrame:
    """Per graph and kind: edits drawn, different ones, and admissible ones."""
    every = E.admissible_additions(g).unionByName(E.deletions(g)).withColumn("ok", F.lit(1))
    drawn = seeded.sampled_edits(g, "add", 2, seed=7).unionByName(seeded.sampled_edits(g, "delete", 2, seed=7))
    return drawn.join(every, ["graph_id", "kind", "u", "v"], "left").groupBy("graph_id", "kind").agg(F.count("*").alias("drawn"), F.countDistinct("u", "v").alias("different"), F.count("ok").alias("admissible"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "deletion_severity": _on("multi", E.deletion_severity),
    "deletion_severity_dense": _on("dense", E.deletion_severity),
    **{op: _on("multi", lambda g, op=op: A.answers(g, op)) for op in A.OPERATIONS},
    "multi_source": _on("multi", A.multi_source),
    "frozen_cases": _on("multi", lambda g: A.joined_names(g.named(g.named(A.frozen_cases(g), elem_name="elem").withColumnRenamed("anchor", "a"), anchor="a"), "graph_id", "subtype", "anchor")),
    "probe_inventory": _on("multi", A.probe_inventory),
    "dag_levels": _on("multi", lambda g: g.levels.select("graph_id", "node_id", "level")),
    "graph_depth": _on("multi", lambda g: g.sizes.select("graph_id", "n", "m", "depth")),
    "multi_hop_anchors": _on("multi", S.multi_hop_anchors),
    "path_multiplicity": _on("multi", lambda g: _rounded(S.path_multiplicity(g), "multi_path_fraction")),
    "admissible_false_edges": _on("multi", lambda g: E.admissible_additions(g).select("graph_id", "u", "v")),
    "graph_diagnostics": _on("multi", E.diagnostics),
    "lost_pairs": _on("multi", lambda g: E.lost_pairs(g).select("graph_id", "u", "v", "a", "b")),
    "edit_damage_by_bucket": _on("multi", E.damage_by_bucket),
    "edit_damage_by_operation": _on("multi", E.damage_by_operation),
    "frozen_damage": _on("multi", E.frozen_damage),
    "edit_summary": _on("multi", E.edit_summary),
    "top_damage": _on("multi", E.top_damage),
    "exposure": _on("multi", E.exposure),
    "structural_features": _on("multi", E.structural_features),
    "edge_betweenness": _on("multi", lambda g: _rounded(S.edge_betweenness(g), "betweenness", "normalised")),
    "lemma_check": _on("multi", S.lemma_check),
    "severity_concentration": _on("multi", S.severity_summary),
    "corpus_summary": _on("multi", S.corpus_summary),
    "impact_betweenness_spearman": _on("multi", S.impact_betweenness),
    "leave_one_out_spearman": _on("multi", lambda g: _rounded(S.leave_one_out(_relation(g), "multi_path_fraction", "gap", "graph_id"), "rho")),
    "edge_features": _on("multi", lambda g: _rounded(P.edge_features(g), "edge_betweenness")),
    "error_scenarios": _on("multi", lambda g: _rounded(P.error_rows(g).select("graph_id", "scenario", "u", "v", "error_probability", "expected_risk"), "error_probability", "expected_risk")),
    "budget_curves": _on("multi", P.budget_curves),
    "scenario_macro": _on("multi", lambda g: P.scenario_macro(P.budget_curves(g))),
    "pairwise_wins": _on("multi", lambda g: P.pairwise_wins(P.budget_curves(g))),
    "priority_rank_correlation": _on("multi", P.impact_rank_correlation),
    "rank_sensitivities": _on("multi", lambda g: N.sensitivities(N.corpus_rows(g), drop_prefix="p1")),
    "priority_advantage": _on("multi", lambda g: N.advantage(P.budget_curves(g))),
    "deepest_graphs": _on("multi", lambda g: N.deepest(g.sizes.select("graph_id", "n", "m", "depth"), 5)),
    "lineage_questions": _on("multi", A.questions),
    "gold_parity": lambda spark, sf_dir: A.parity(graphs(spark, sf_dir), _gold(spark, sf_dir)),
    "ref_extraction": lambda spark, sf_dir: X.references(X.model_files(project_files(spark, sf_dir))).select("project", "model", "ref"),
    "source_extraction": lambda spark, sf_dir: X.source_references(X.model_files(project_files(spark, sf_dir))).select("project", "model", "source"),
    "project_census": lambda spark, sf_dir: X.census(project_files(spark, sf_dir)),
    "gate": lambda spark, sf_dir: X.gate(X.census(project_files(spark, sf_dir))),
    "relationship_audit": lambda spark, sf_dir: X.relationship_audit(project_files(spark, sf_dir)),
    "project_audit": lambda spark, sf_dir: X.project_audit(project_files(spark, sf_dir)),
    "manifest_diff": lambda spark, sf_dir: X.manifest_diff(X.static_edges(X.model_files(project_files(spark, sf_dir))), X.manifest_edges(manifest_table(spark, sf_dir))),
    "sampled_additions": _on("multi", lambda g: seeded.sampled_edits(g, "add", 2, seed=7)),
    "sampled_deletions": _on("multi", lambda g: seeded.sampled_edits(g, "delete", 2, seed=7)),
    "layered_null": _on("multi", seeded.layered_null),
    "null_summary": _on("multi", seeded.null_summary),
    "null_exceedance": _on("multi", lambda g: N.null_exceedance(seeded.null_summary(g))),
    "random_curve": _on("multi", seeded.random_curves),
    "permutation_and_bootstrap": _on("multi", lambda g: seeded.resampled(_relation(g), "multi_path_fraction", "gap", "graph_id")),
    "topology_classes": _on("multi", seeded.topology_classes),
    "closure_severity": _on("multi", S.closure_severity),
    "leave_one_out_range": _on("multi", lambda g: _rounded(S.leave_one_out_range(_relation(g), "multi_path_fraction", "gap", "graph_id"), "min_rho", "max_rho")),
    "severity_percentiles": _on("multi", _percentiles),
    "graph_statuses": _statuses,
    "status_counts": lambda spark, sf_dir: _statuses(spark, sf_dir).groupBy("replication").agg(F.count("*").alias("graphs")),
    "census_summary": lambda spark, sf_dir: X.census_summary(X.census(project_files(spark, sf_dir))),
    "group_audit": lambda spark, sf_dir: X.group_audit(X.project_audit(project_files(spark, sf_dir)), "unresolved_refs"),
    "set_distortion": _on("multi", lambda g: _rounded(_direct_for_transitive(g), "precision", "recall", "f1")),
    "error_amplification": _on("multi", _amplified),
    "normal_answers": _on("multi", lambda g: A.answers(g, "direct_downstream").select("graph_id", "anchor", F.to_json(F.reverse(F.split("answer", ","))).alias("raw")).select("graph_id", "anchor", X.normal_answer("raw").alias("answer"))),
    "gold_differences": lambda spark, sf_dir: A.differences(graphs(spark, sf_dir), _gold(spark, sf_dir)),
    "topology_groups": _on("multi", seeded.topology_groups),
    "sampled_edit_check": _on("multi", _sampled_check),
    "layered_null_check": _on("multi", seeded.null_check),
}
