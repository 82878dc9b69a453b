"""The registered random procedures draw as often as their definitions say: 200 null graphs, 10,000 shuffles and resamples."""

import os

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import seeded
from edgeloom.plans.queries import QUERIES, _relation, graphs

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_200_null_graphs(spark):
    g = graphs(spark, DATA)
    rows = QUERIES["layered_null"](spark, DATA).groupBy("graph_id").agg(F.countDistinct("seed").alias("seeds"), F.count("*").alias("edges")).join(g.sizes, "graph_id").collect()
    assert rows and all((r.seeds, r.edges) == (200, 200 * r.m) for r in rows)
    assert {r.samples for r in QUERIES["null_summary"](spark, DATA).collect()} == {200}


def test_more_seeds_only_add_graphs(spark):
    g = graphs(spark, DATA)
    few, many = seeded.layered_null(g, 3), seeded.layered_null(g, 5).filter("seed < 3")
    assert sorted(few.collect()) == sorted(many.collect())


def test_10000_repetitions(spark):
    p = QUERIES["permutation_and_bootstrap"](spark, DATA).first().p_value
    assert p * 10_001 == pytest.approx(round(p * 10_001), abs=1e-6)
    rows = _relation(graphs(spark, DATA))
    assert p == seeded.resampled(rows, "multi_path_fraction", "gap", "graph_id", times=10_000).first().p_value
