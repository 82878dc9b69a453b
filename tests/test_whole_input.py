"""The lineage queries read every row of the tables: against graphs made row by row."""

import os

import duckdb
import pytest

from edgeloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def below(edges, node):
    seen, todo = set(), [node]
    while todo:
        u = todo.pop()
        for a, b in edges:
            if a == u and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def pairs(edges):
    return {(a, b) for a in range(12) for b in below(edges, a)}


def test_every_order_is_in_a_graph_and_severity_is_that_of_closing_again(spark):
    graphs = {}
    for k, c in duckdb.sql(f"select o_orderkey, o_custkey from '{DATA}/orders.parquet'").fetchall():
        a, b = k % 12, (k + 1 + c % 4) % 12
        if a != b:
            graphs.setdefault(f"p{max(0, k - 1) // 120 * 120 + c % 10}", set()).add((min(a, b), max(a, b)))  # key 0 is in the first block
    want = {}
    for g, edges in graphs.items():
        every = pairs(edges)
        for u, v in edges:
            lost = every - pairs(edges - {(u, v)})
            want[g, u, v] = (len(lost), sum((a != u) + (b != v) for a, b in lost))
    got = {(r.graph_id, r.u, r.v): (r.lost, r.severity) for r in QUERIES["deletion_severity"](spark, DATA).collect()}
    assert got == want
    assert len(graphs) > 100
