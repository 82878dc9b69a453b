"""Toy graphs with hand-worked answers, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import seeded
from edgeloom.operators import answers, edits, priority, stats
from edgeloom.operators.graphs import Graphs
from edgeloom.plans.paths import closure, path_table, weak_labels

TOYS = {
    "chain": (4, [(0, 1), (1, 2), (2, 3)], []),
    "diamond": (4, [(0, 1), (0, 2), (1, 3), (2, 3)], []),
    "redundant": (3, [(0, 1), (1, 2), (0, 2)], []),
    "fk": (4, [(0, 1), (1, 2)], [(3, 2)]),
    "lonely": (4, [(0, 1), (1, 2)], []),
    "uneven": (7, [(0, 1), (0, 3), (1, 3), (1, 4), (2, 4), (4, 5), (3, 6), (5, 6)], []),
}


@pytest.fixture(scope="module")
def toys(spark):
    nodes = [(g, i, "abcdefgh"[i]) for g, (n, _, _) in TOYS.items() for i in range(n)]
    edges = [(g, u, v) for g, (_, e, _) in TOYS.items() for u, v in e]
    fk = [(g, c, p) for g, (_, _, f) in TOYS.items() for c, p in f]
    return Graphs(spark.createDataFrame(nodes, "graph_id string, node_id int, name string"), spark.createDataFrame(edges + edges[:2], "graph_id string, src int, dst int"), spark.createDataFrame(fk, "graph_id string, child int, parent int"))


def one(df, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return df.collect()


def test_answers(toys):
    assert one(answers.answers(toys, "transitive_downstream"), graph_id="fk", anchor="a")[0].answer == "b,c"
    assert one(answers.answers(toys, "combined_impact"), graph_id="fk", anchor="a")[0].answer == "b,c,d"
    assert one(answers.answers(toys, "transitive_downstream"), graph_id="lonely", anchor="d")[0].n == 0
    assert sum(r.probes for r in one(answers.probe_inventory(toys), graph_id="lonely")) == 20
    with pytest.raises(ValueError):
        answers.elements(toys, "sideways")


def test_severity(toys):
    got = {(r.graph_id, r.u, r.v): (r.lost, r.severity, r.alternate_path) for r in edits.deletion_severity(toys).collect()}
    assert got["chain", 1, 2] == (4, 4, False)
    assert got["chain", 0, 1] == (3, 2, False)
    assert all(got["diamond", u, v] == (1, 0, False) for u, v in TOYS["diamond"][1])
    assert got["redundant", 0, 2] == (0, 0, True)
    again = {(r.graph_id, r.u, r.v): r.closure_severity for r in stats.closure_severity(toys).collect()}
    assert again == {k: v[1] for k, v in got.items()}


def test_levels_and_multiplicity(toys):
    levels = [r.level for r in sorted(one(toys.levels, graph_id="uneven"), key=lambda r: r.node_id)]
    assert levels == [0, 1, 0, 2, 2, 3, 4]
    m = {r.graph_id: (r.reachable_pairs, r.multi_path_pairs) for r in stats.path_multiplicity(toys).collect()}
    assert m["chain"] == (6, 0) and m["diamond"] == (5, 1)


def test_damage_buckets(toys):
    rows = edits.damage_by_bucket(toys).collect()
    n = {g: t[0] for g, t in TOYS.items()}
    for r in rows:
        assert r.fp == 0 if r.kind == "delete" else r.fn == 0  # answers are monotone in the edges
        if r.bucket == "local":
            assert (r.probes, r.distorted) == (2, 2)
        if r.bucket == "propagated":
            assert r.probes == 3 * n[r.graph_id] - 3
    null = [r for r in rows if (r.graph_id, r.kind, r.u, r.v, r.bucket) == ("lonely", "add", 0, 3, "null_gold")]
    assert not null or null[0].distorted > 0


def test_lemma(toys):
    rows = stats.lemma_check(toys).collect()
    assert len(rows) == sum(len(e) for _, e, _ in TOYS.values()) and all(r.bounds_hold and r.identity_holds for r in rows)


def test_gini_and_shares(spark):
    df = spark.createDataFrame([("z", 0), ("z", 0), ("z", 0), ("x", 1), ("x", 1), ("x", 8)], "g string, v long")
    got = {r.g: r for r in stats.concentration(df, "g", "v").collect()}
    assert (got["z"].gini, got["z"].top_share) == (0.0, 0.0)
    assert got["x"].top_share == 0.8 and 0 <= got["x"].gini <= 1


def test_rank_correlation(spark):
    df = spark.createDataFrame([("up", 1.0, 2.0), ("up", 2.0, 3.0), ("up", 3.0, 9.0), ("flat", 1.0, 1.0), ("flat", 2.0, 1.0), ("flat", 3.0, 1.0), ("two", 1.0, 2.0), ("two", 2.0, 1.0)], "g string, x double, y double")
    got = {r.g: r.rho for r in stats.spearman(df, "x", "y", "g").collect()}
    assert got["up"] == pytest.approx(1.0) and got["flat"] is None and got["two"] is None
    assert seeded.rho([1, 2, 3], [3, 2, 1]) == pytest.approx(-1.0)


def test_set_distortion_and_amplification(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, elem string")
    b = spark.createDataFrame([(1, "y"), (1, "z"), (2, "w")], "k int, elem string")
    got = {r.k: (r.fp, r.fn, r.f1) for r in edits.set_distortion(a, b, "k").collect()}
    assert got == {1: (1, 1, 0.5), 2: (1, 0, 0.0)}
    rows = spark.createDataFrame([(0, 0), (3, 0), (3, 2)], "a int, e int").select(edits.amplification(F.col("a"), F.col("e")).alias("x")).collect()
    assert [r.x for r in rows] == [0.0, float("inf"), 1.5]


def test_cycles_raise_and_show(spark):
    nodes = spark.createDataFrame([("c", 0), ("c", 1)], "graph_id string, node_id int")
    edges = spark.createDataFrame([("c", 0, 1), ("c", 1, 0)], "graph_id string, src int, dst int")
    with pytest.raises(ValueError):
        path_table(nodes, edges)
    assert closure(edges).filter("src = dst").count() == 2
    assert {r.label for r in weak_labels(nodes, edges).collect()} == {0}


def test_seeded_procedures(toys):
    assert seeded.sampled_edits(toys, "delete", 1, 3).collect() == seeded.sampled_edits(toys, "delete", 1, 3).collect()
    with pytest.raises(ValueError):
        seeded.sampled_edits(toys, "delete", -1)
    g = seeded.null_graphs(toys, 3)
    want = {r.graph_id: (r.n, r.m, r.depth) for r in toys.sizes.collect()}
    for r in g.sizes.collect():
        assert (r.n, r.m, r.depth) == want[r.graph_id.rsplit("-null-", 1)[0]]
    levels = {(r.graph_id, r.node_id): r.level for r in toys.levels.collect()}
    assert all(r.level == levels[r.graph_id.rsplit("-null-", 1)[0], r.node_id] for r in g.levels.collect())


def test_random_curve_is_a_shuffle_mean(toys):
    got = {(r.graph_id, r.budget): r.removed_risk for r in seeded.random_curves(toys, 5).filter("scenario = 'uniform_10pct'").collect()}
    risk = [0.1 * r.severity for r in sorted(one(edits.deletion_severity(toys), graph_id="uneven"), key=lambda r: (r.u, r.v))]
    total = 0.0
    for seed in range(5):
        order = list(range(len(risk)))
        random.Random(seed).shuffle(order)
        total += risk[order[0]] / sum(risk)
    assert got["uneven", "5pct"] == pytest.approx(total / 5, abs=1e-8)


def test_priority_beats_its_reverse(toys):
    rows = priority.budget_curves(toys).filter("scenario = 'uniform_10pct' and graph_id = 'uneven'").collect()
    got = {(r.strategy, r.budget): r.removed_risk for r in rows}
    assert got["impact", "30pct"] == got["expected_risk", "30pct"] >= got["degree_product", "5pct"]


def test_topology_classes(spark):
    nodes = spark.createDataFrame([(g, i, str(i)) for g in "abc" for i in range(3)], "graph_id string, node_id int, name string")
    edges = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 2, 1), ("b", 1, 0), ("c", 0, 1), ("c", 0, 2)], "graph_id string, src int, dst int")
    h = {r.graph_id: r.topology_hash for r in seeded.topology_classes(Graphs(nodes, edges)).collect()}
    assert h["a"] == h["b"] != h["c"]


def test_empty_graphs(spark):
    nodes = spark.createDataFrame([("e", 0, "x")], "graph_id string, node_id int, name string")
    edges = spark.createDataFrame([], "graph_id string, src int, dst int")
    g = Graphs(nodes, edges)
    assert edits.deletion_severity(g).count() == 0
    assert stats.path_multiplicity(g).first().multi_path_fraction == 0.0
    assert edits.diagnostics(g).first().mean_descendants == 0.0


def graphs_of(spark, **shapes):
    nodes = [(g, i, f"n{i}") for g, (n, _) in shapes.items() for i in range(n)]
    edges = [(g, u, v) for g, (_, e) in shapes.items() for u, v in e]
    return Graphs(spark.createDataFrame(nodes, "graph_id string, node_id int, name string"), spark.createDataFrame(edges, "graph_id string, src int, dst int"))


def test_topology_starts_from_both_degrees(spark):
    g = graphs_of(spark, joined=(4, [(0, 2), (1, 2)]), apart=(4, [(0, 2), (1, 3)]), again=(4, [(3, 0), (2, 1)]))
    got = {r.graph_id: r.topology_hash for r in seeded.topology_classes(g).collect()}
    assert got["joined"] != got["apart"] == got["again"]
    assert {(r.graph_id, r.members) for r in seeded.topology_groups(g).collect()} == {("apart", 2), ("again", 2)}


def test_path_counts_beyond_any_integer(spark):
    """Eighty diamonds in a row hold 2^80 paths; their waists are cuts and their sides are not."""
    edges, n = [], 80
    for i in range(n):
        a = 3 * i
        edges += [(a, a + 1), (a, a + 2), (a + 1, a + 3), (a + 2, a + 3)]
    g = graphs_of(spark, tower=(3 * n + 1, [*edges, (3 * n, 3 * n + 1)][: 4 * n]))
    ends = g.reach.filter(f"src = 0 and dst = {3 * n}").first()
    assert ends.paths == 2 and ends.dist == ends.longest == 2 * n and ends.sigma == pytest.approx(2.0**n)
    r = stats.path_multiplicity(g).first()
    assert r.multi_path_pairs > 10_000
    assert {(r.lost, r.alternate_path) for r in edits.deletion_severity(g).filter("u = 0").collect()} == {(1, False)}


def test_leave_one_out_equals_recomputing(spark):
    rng = random.Random(6)
    rows = [(f"k{i}", float(rng.randrange(6)), rng.choice([rng.random(), 0.5])) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, x double, y double")
    got = {r.left_out: (r["items"], r.rho) for r in stats.leave_one_out(df, "x", "y", "key").collect()}
    for k, _, _ in rows:
        rest = [(x, y) for q, x, y in rows if q != k]
        assert got[k] == (39, pytest.approx(seeded.rho([x for x, _ in rest], [y for _, y in rest]), abs=1e-9))
    r = stats.leave_one_out_range(df, "x", "y", "key").first()
    assert (r.min_rho, r.max_rho) == (min(v for _, v in got.values()), max(v for _, v in got.values()))
    same = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 3.0), ("d", 1.0, 4.0)], "key string, x double, y double")
    assert {r.rho for r in stats.leave_one_out(same, "x", "y", "key").collect()} == {None}


def test_seeded_addition_of_given_candidates(spark):
    g = graphs_of(spark, t=(5, [(0, 1), (1, 2)]))
    given = lambda *pairs: spark.createDataFrame([("t", u, v) for u, v in pairs], "graph_id string, src int, dst int")
    # a loop, an edge that is there and one that closes a cycle are no candidates
    out, added = seeded.seeded_addition(g, 2, seed=3, candidates=given((2, 2), (0, 1), (2, 0), (0, 2), (3, 4)))
    assert {(r.src, r.dst) for r in added.collect()} == {(0, 2), (3, 4)}
    assert {(r.src, r.dst) for r in out.edges.collect()} == {(0, 1), (1, 2), (0, 2), (3, 4)}
    with pytest.raises(ValueError):
        seeded.seeded_addition(g, 2, candidates=given((3, 4), (4, 3)))
