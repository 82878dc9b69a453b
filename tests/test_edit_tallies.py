"""What edits change is summed where the path tables of a graph are: no changed element is a row, and only path rows are dealt out."""

import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from edgeloom.functions import damage
from edgeloom.operators import edits
from edgeloom.operators.graphs import Graphs
from edgeloom.plans import queries, storage
from edgeloom.plans.oracles import ORACLES
from edgeloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name,exchanges", [("edit_damage_by_operation", 1), ("edit_summary", 2), ("frozen_damage", 1)])
def test_only_path_rows_are_dealt_out(spark, name, exchanges):
    """Changed elements were joined and summed by shuffles of their own, which filled the disk; a summary shuffles its sums by graph too."""
    df = QUERIES[name](spark, DATA)
    plan = planned(df)
    assert plan.count("Exchange ") == exchanges and "Join" not in plan
    db = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = db.sql(ORACLES[name])
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert rows_of(df) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_graphs_of_unlike_sizes_and_foreign_keys_from_outside(spark, monkeypatch):
    """Node numbers below zero, a node without edges, a child that is no node, a parent that is none: in one stack or many, in one batch or many."""
    nodes = [("a", -5), ("a", 2), ("a", 7), ("a", 9), ("b", 0), ("c", 1), ("c", 3)]
    edges = [("a", -5, 2), ("a", 2, 7), ("a", -5, 7), ("c", 3, 1)]
    keys = [("a", 99, 7), ("a", 9, 2), ("a", 9, 77), ("c", 3, 1), (None, 1, 2)]
    made = lambda rows, *names: spark.createDataFrame(rows, f"graph_id string, {names[0]} int, {names[1]} int")
    g = Graphs(spark.createDataFrame([(*x, f"t{x[1]}") for x in nodes], "graph_id string, node_id int, name string"), made(edges, "src", "dst"), made(keys, "child", "parent"))
    got = {(r.kind, r.u, r.v, r.operation): (r.distorted, r.incorrect) for r in edits.damage_by_operation(g).filter("graph_id = 'a'").collect()}
    assert got["delete", 2, 7, "transitive_downstream"] == (1, 1)  # -5 keeps its own edge to 7
    assert got["delete", 2, 7, "combined_impact"] == (1, 2)  # 7 and its child 99
    assert got["delete", -5, 2, "combined_impact"] == (1, 2)  # 2 and its child 9; 99 stays, by 7
    assert got["add", 9, 2, "transitive_upstream"] == (2, 2)  # 2 and 7 have 9 above them
    assert got["add", 9, 2, "combined_impact"] == (1, 3)  # 2, 7 and 99; 9 is no answer to itself
    whole = [rows_of(edits.damage_by_bucket(g)), rows_of(edits.frozen_damage(g))]
    primes, groups = (2147483647, 2147483629), [("all", "all", ["combined_impact", "direct_upstream"])]
    table = g.reach0.select("graph_id", "src", "dst", "r1", "r2", "dist", "longest").orderBy("graph_id").toArrow()
    one = sorted(str(r) for b in damage.tally(groups, primes)(iter(table.to_batches())) for r in b.to_pylist())
    monkeypatch.setattr(damage, "CELLS", 1)
    monkeypatch.setattr(damage, "ROWS", 1)
    many = sorted(str(r) for b in damage.tally(groups, primes)(iter(table.to_batches(max_chunksize=2))) for r in b.to_pylist())
    assert one == many and one and all(whole)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["edit_summary", "frozen_damage"])
def test_no_path_table_is_written(spark, name, monkeypatch):
    """Path tables were made first, and their shuffles took more disk than all that follows."""
    monkeypatch.setattr(queries, "_GRAPHS", {})
    assert QUERIES[name](spark, DATA).count()
    assert "reach0" not in vars(queries.graphs(spark, DATA))


@pytest.mark.parametrize("edges,n", [([(i, j) for i in range(9) for j in range(i + 1, 9)], 9), ([(3, 1), (1, 0), (3, 0), (0, 4)], 6), ([(i + d, i + 2 + e) for i in range(0, 140, 2) for d in (0, 1) for e in (0, 1)], 142), ([], 1)])
def test_matrices_are_closed_as_by_counting_paths(edges, n):
    """The last graph but one has 2^70 paths, more than any number here holds."""
    primes = (2147483647, 2147483629)
    edge = np.zeros((2, n, n), bool)
    for u, v in edges:
        edge[0, u, v] = edge[1, n - 1 - u, n - 1 - v] = True  # the other is the same with its nodes numbered from the end
    real = np.ones((2, n), bool)
    paths, longest = [[0] * n for _ in range(n)], [0] * n
    into = {v: [a for a, b in edges if b == v] for v in range(n)}
    todo = list(range(n))
    while todo:
        v = next(x for x in todo if not set(into[x]) & set(todo))
        todo.remove(v)
        longest[v] = max((longest[u] + 1 for u in into[v]), default=0)
        for a in range(n):
            paths[a][v] = (a == v) + sum(paths[a][u] for u in into[v])
    reach, counts, level = damage.closed(edge, real, primes)
    for turned in (lambda x: x[0], lambda x: x[1][::-1, ::-1] if x.ndim == 3 else x[1][::-1]):
        assert turned(reach).tolist() == [[float(x > 0) for x in row] for row in paths]
        assert [turned(c).tolist() for c in counts] == [[[x % q for x in row] for row in paths] for q in primes]
        assert turned(level).tolist() == longest


@pytest.mark.parametrize("edges", [[(0, 1), (1, 0)], [(0, 1), (1, 1)], [(0, 1), (1, 2), (2, 3), (3, 1)]])
def test_a_cycle_raises(edges):
    edge = np.zeros((1, 5, 5), bool)
    for u, v in edges:
        edge[0, u, v] = True
    with pytest.raises(ValueError):
        damage.closed(edge, np.ones((1, 5), bool), (5, 7))


def test_rows_are_dealt_in_small_messages(spark):
    """A row for each node, edge and key took 12 to 13 bytes of shuffle files, which was the disk peak of frozen_damage."""
    rng = np.random.default_rng(3)
    names = [f"p{x}" for x in range(0, 240_000, 12)] + ["", "o'k\0x", "\u00e9\u4e16", "p1 "]
    graph = rng.permutation(np.repeat(np.arange(len(names)), 5))
    dist = rng.integers(-1, 2, len(graph))
    dist[:9] = -(2**31), *[2**31 - 1] * 8
    ids = rng.integers(0, 12, len(graph)).astype(np.int32)
    ids[:4] = -(2**31), 2**31 - 1, -1, 0
    t = pa.table({"graph_id": pa.array(np.array(names, object)[graph], pa.string()), "src": ids, "dst": ids[::-1].copy(), "dist": pa.array(dist.astype(np.int32), mask=dist == -1), "part": pa.array((graph % 7).astype(np.int32))})
    sent = list(damage.packed(iter(t.to_batches(max_chunksize=999))))
    parts = [x for b in sent for x in b.column("part").to_pylist()]
    assert sorted(parts) == sorted({*range(7)}) and sum(len(x.as_py()) for b in sent for x in b.column("rows")) < 6 * len(graph)
    back = pa.Table.from_batches(damage.unpacked(iter(sent)))
    want = t.drop_columns("part").set_column(3, "dist", t.column("dist").fill_null(-1))
    order = [(c, "ascending") for c in want.column_names]
    assert back.sort_by(order).equals(want.sort_by(order)) and back.column("graph_id").to_pylist() == sorted(back.column("graph_id").to_pylist())
    assert not list(damage.packed(iter([]))) and not list(damage.unpacked(iter([])))


def test_small_packs_make_the_same_rows(spark, monkeypatch):
    """Graphs whose rows are read by several tasks, and packed at several times."""
    made = lambda rows, *names: spark.createDataFrame(rows, f"graph_id string, {names[0]} int, {names[1]} int").repartition(5)
    nodes = spark.createDataFrame([(f"g{i}", j, f"t{j}") for i in range(9) for j in range(i)], "graph_id string, node_id int, name string")
    edges = made([(f"g{i}", j, k) for i in range(9) for j in range(i) for k in range(j + 1, i) if (i + j * k) % 3], "src", "dst")
    g = Graphs(nodes, edges, made([(f"g{i}", i % 4, i % 3) for i in range(9)], "child", "parent"))
    want = rows_of(edits.frozen_damage(g))
    rows = [pa.RecordBatch.from_pylist([{"graph_id": f"g{i}", "src": i, "dst": i, "dist": 0, "part": i % 2}]) for i in range(5)]
    monkeypatch.setattr(damage, "PACKED", 1)
    assert len(list(damage.packed(iter(rows)))) == 5
    monkeypatch.setattr(edits, "PART_ROWS", 10)
    assert rows_of(edits.frozen_damage(g)) == want and want


def test_no_shuffle_files_stay_after_a_table_is_written(spark):
    """They stayed until the driver happened to collect its garbage, beside those of all later tables."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = lambda: {x: os.path.getsize(x) for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x and os.path.exists(x)}
    before, was = found(), spark.conf.get(storage.CLEAN, "false")
    copy = storage.materialize(spark.range(100_000).selectExpr("id % 50023 as k", "id % 5 as j").distinct(), "t")
    left = sum(n for x, n in found().items() if x not in before)
    assert left < 10_000  # of the count of its rows; of the table there were 500,000 and more
    assert copy.count() == 100_000 and spark.conf.get(storage.CLEAN, "false") == was
