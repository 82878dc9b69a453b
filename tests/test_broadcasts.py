"""Tables of packed columns are weighed by their rows: none is gathered on the driver because its files are short."""

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import answers, edits, priority, stats
from edgeloom.operators.graphs import Graphs
from edgeloom.plans import queries
from edgeloom.plans.queries import QUERIES
from edgeloom.plans.storage import materialize, written

DATA = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def threshold(spark):
    """A threshold over the files of the tables here and under their rows."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "100k")
    yield
    spark.conf.set(key, before)


@pytest.fixture(scope="module")
def many(spark):
    """20,000 chains of three nodes: ids and numbers pack to some KB a table."""
    nodes = spark.range(20_000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("graph_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("node_id")).withColumn("name", F.concat(F.lit("t0"), F.col("node_id").cast("string")))
    edges = nodes.filter("node_id < 2").select("graph_id", F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
    fk = nodes.filter("node_id = 2").select("graph_id", F.col("node_id").alias("child"), F.lit(0).alias("parent"))
    return nodes, edges, fk


def test_rows_count_and_not_files(spark, threshold):
    small, long = spark.range(50, numPartitions=1).select((F.col("id") * 0).alias("k")), spark.range(50_000, numPartitions=1).select((F.col("id") * 0).alias("k"))
    other = spark.range(10**9).select(F.col("id").alias("k"))
    assert "BroadcastHashJoin" in planned(other.join(written(long, "t"), "k"))  # what the files' length leads to
    assert "BroadcastHashJoin" not in planned(other.join(materialize(long, "t"), "k"))
    assert "BroadcastHashJoin" in planned(other.join(materialize(small, "t"), "k"))  # a small table still is broadcast


def test_nothing_is_broadcast_from_packed_tables(spark, many, threshold):
    g = Graphs(*many)
    made = {
        "answers": answers.answers(g, "combined_impact"), "admissible": edits.admissible_additions(g), "severity": edits.deletion_severity(g), "betweenness": stats.edge_betweenness(g), "features": priority.edge_features(g),
        "sizes": g.sizes.join(g.levels, "graph_id"), "questions": answers.questions(g), "diagnostics": edits.diagnostics(g), "operations": edits.damage_by_operation(g), "frozen": edits.frozen_damage(g), "summary": edits.edit_summary(g), "curves": priority.budget_curves(g),
    }
    assert [k for k, df in made.items() if "BroadcastHashJoin" in planned(df)] == []
    assert made["severity"].count() == 40_000 and made["answers"].count() == 60_000


@pytest.fixture
def packed(spark, threshold, monkeypatch):
    """Graphs of their own for the queries, made under a threshold over the files of sf0.01 and under their rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "48k")
    monkeypatch.setattr(queries, "_GRAPHS", {})
    return DATA.replace("0.001", "0.01")


def test_foreign_keys_of_the_queries_are_weighed(spark, packed):
    """They were a join over a weighed table: lighter than the threshold by their files, and joined to what has no weight."""
    other = spark.range(10**9).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("graph_id"))
    assert "BroadcastHashJoin" not in planned(other.join(queries.graphs(spark, packed).fk, "graph_id"))
    assert [k for k in ("edit_damage_by_operation", "frozen_damage") if "BroadcastHashJoin" in planned(QUERIES[k](spark, packed))] == []


def test_no_project_table_of_an_audit_is_broadcast(spark, packed):
    assert "BroadcastHashJoin" not in planned(QUERIES["group_audit"](spark, packed))


def test_no_table_of_questions_summaries_or_statuses_is_broadcast(spark, packed):
    names = ("frozen_cases", "gold_parity", "gold_differences", "corpus_summary", "graph_statuses", "budget_curves")
    assert [k for k in names if "BroadcastHashJoin" in planned(QUERIES[k](spark, packed))] == []


def test_questions_are_compared_with_gold_once(spark, packed):
    """Both sides of the differences come from one join; two anti joins made every question four times."""
    joins = {k: planned(QUERIES[k](spark, packed)).count("SortMergeJoin") for k in ("gold_parity", "gold_differences")}
    assert joins["gold_differences"] == joins["gold_parity"] > 0


def test_budget_curves_deal_edges_out_before_they_are_multiplied(spark, packed):
    """Each edge becomes 18 rows, for scenarios and strategies: none of them is joined or dealt out again."""
    plan = planned(QUERIES["budget_curves"](spark, packed))
    above = plan[: plan.rindex("Generate explode")]
    assert plan.count("Generate explode") == 3 and "Exchange hashpartitioning" not in above and "Join" not in above
