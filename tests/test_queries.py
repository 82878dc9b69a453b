"""Every registered lineage query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from edgeloom.plans.oracles import ORACLES
from edgeloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
FAST = ["deletion_severity", "combined_impact", "frozen_cases", "lost_pairs", "edit_damage_by_bucket", "frozen_damage", "structural_features", "lemma_check", "corpus_summary", "budget_curves", "lineage_questions", "gold_parity", "gold_differences", "manifest_diff", "deletion_severity_dense", "graph_statuses", "set_distortion", "error_amplification", "topology_classes", "topology_groups", "leave_one_out_spearman", "sampled_edit_check", "layered_null_check"]


def plain(v):
    return v.item() if hasattr(v, "item") else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    a = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    b = sorted(tuple(plain(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall())
    assert a == b


def test_sql_and_queries_have_like_names():
    assert set(ORACLES) <= set(QUERIES)
