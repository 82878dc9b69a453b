"""Procedures whose results hang on Python's seeded generator, per graph in Arrow batches.

They call ``random.Random`` in a fixed order, so that a seed gives the same sample as any
other program that follows the same order.  Each group is one small graph or one seed.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.edits import admissible_additions, deletions
from edgeloom.operators.graphs import Graphs
from edgeloom.operators.priority import BUDGETS, error_rows
from edgeloom.operators.stats import percentile, severity_summary
from edgeloom.plans.storage import materialize


def sampled_edits(g: Graphs, kind: str, count: int, seed: int = 0, protected: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """``count`` edits of a kind for each graph, sampled from all in the text order of their pairs.

    ``protected`` edges (``graph_id, src, dst``) are never removed.  Given ``candidates`` (``graph_id, src, dst``) replace the
    admissible additions; those that are loops or edges, or close a cycle by themselves, are left out.  A negative
    count, or more than there are, raises.
    """
    if count < 0:
        raise ValueError("count must not be negative")
    every = admissible_additions(g) if kind == "add" else deletions(g)
    if candidates is not None and kind == "add":
        pair = candidates.select("graph_id", F.lit("add").alias("kind"), F.col("src").cast("int").alias("u"), F.col("dst").cast("int").alias("v")).distinct().filter("u <> v")
        back = g.reach.select("graph_id", F.col("src").alias("v"), F.col("dst").alias("u"))
        every = pair.join(deletions(g).drop("kind"), ["graph_id", "u", "v"], "left_anti").join(back, ["graph_id", "u", "v"], "left_anti").select("graph_id", "kind", "u", "v")
    if protected is not None and kind == "delete":
        every = every.join(protected.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v")), ["graph_id", "u", "v"], "left_anti").select("graph_id", "kind", "u", "v")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(zip(pdf.u.tolist(), pdf.v.tolist(), strict=True), key=repr)
        if count > len(pairs):
            raise ValueError(f"{count} edits wanted of {len(pairs)}")
        chosen = random.Random(seed).sample(pairs, count)
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "kind": kind, "u": [u for u, _ in chosen], "v": [v for _, v in chosen]}).astype({"u": "int32", "v": "int32"})

    return every.groupBy("graph_id").applyInPandas(draw, "graph_id string, kind string, u int, v int")


def seeded_addition(g: Graphs, count: int, seed: int = 0, candidates: DataFrame | None = None) -> tuple[Graphs, DataFrame]:
    """The graphs with ``count`` sampled edges more, and those edges; edges that close a cycle together raise."""
    added = materialize(sampled_edits(g, "add", count, seed, candidates=candidates), "added")
    out = Graphs(g.nodes, g.edges.unionByName(added.select("graph_id", F.col("u").alias("src"), F.col("v").alias("dst"))), g.fk)
    out.reach0.take(1)  # the path table raises at a cycle
    return out, added.select("graph_id", F.col("u").alias("src"), F.col("v").alias("dst"))


def layered_null(g: Graphs, seeds: int = 200) -> DataFrame:
    """Random graphs with each node's level and the number of edges kept: ``graph_id, seed, src, dst``.

    In node order each node above level 0 draws a parent from the level below; then the
    other edges are drawn from all pairs from a lower to a higher level.
    """
    rows = g.levels.join(g.sizes.select("graph_id", "m"), "graph_id").filter("m > 0")

    def sample(level: dict[int, int], members: dict[int, list[int]], m: int, seed: int) -> list[tuple[int, int]]:
        rng = random.Random(seed)
        edges = {(rng.choice(members[k - 1]), node) for node, k in level.items() if k > 0}
        open_ = [(u, v) for u in level for v in level if level[u] < level[v] and (u, v) not in edges]
        if not 0 <= m - len(edges) <= len(open_):
            raise ValueError("the levels do not fit the number of edges")
        edges.update(rng.sample(open_, m - len(edges)))
        return sorted(edges)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        level = dict(sorted(zip(pdf.node_id.tolist(), pdf.level.tolist(), strict=True)))
        members: dict[int, list[int]] = {}
        for node, k in level.items():
            members.setdefault(k, []).append(node)
        out = [(seed, u, v) for seed in range(seeds) for u, v in sample(level, members, int(pdf.m.iloc[0]), seed)]
        seed, src, dst = zip(*out, strict=True)
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "seed": seed, "src": src, "dst": dst}).astype({"seed": "int32", "src": "int32", "dst": "int32"})

    return rows.select("graph_id", "node_id", "level", "m").groupBy("graph_id").applyInPandas(draw, "graph_id string, seed int, src int, dst int")


def null_graphs(g: Graphs, seeds: int = 200) -> Graphs:
    """The null samples as graphs of their own, named ``<graph>-null-<seed>``; made once for each ``g`` and number of seeds."""
    made = g.__dict__.setdefault("_nulls", {})
    if seeds not in made:
        name = F.concat("graph_id", F.lit("-null-"), F.col("seed").cast("string"))
        edges = layered_null(g, seeds).select(name.alias("graph_id"), "src", "dst")
        nodes = g.nodes.join(g.sizes.filter("m > 0").select("graph_id"), "graph_id", "left_semi").select(F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"), "*").select(name.alias("graph_id"), "node_id", "name")
        made[seeds] = Graphs(nodes, edges)
    return made[seeds]


ORIGIN = r"^(.*)-null-\d+$"


def null_summary(g: Graphs, seeds: int = 200) -> DataFrame:
    """Per graph: observed concentration of severity against the nulls' mean and 2.5 to 97.5 percentiles; made once for each ``g`` and number of seeds."""
    made = g.__dict__.setdefault("_null_summaries", {})
    if seeds not in made:
        s = severity_summary(null_graphs(g, seeds)).withColumn("g", F.regexp_extract("graph_id", ORIGIN, 1))
        stats = []
        for x in ("gini", "top_share"):
            stats += [F.round(F.avg(x), 9).alias(f"null_{x}_mean"), F.round(percentile(x, 0.025), 9).alias(f"null_{x}_low"), F.round(percentile(x, 0.975), 9).alias(f"null_{x}_high")]
        nulls = s.groupBy("g").agg(F.count("*").alias("samples"), *stats)
        seen = severity_summary(g).select("graph_id", F.col("gini").alias("observed_gini"), F.col("top_share").alias("observed_top_share"))
        made[seeds] = materialize(seen.join(nulls, F.col("graph_id") == F.col("g")).drop("g"), "null-summary")
    return made[seeds]


def null_check(g: Graphs, seeds: int = 200) -> DataFrame:
    """Per graph: its null samples, their edges, and how many of their nodes have the level that they have in the graph."""
    nulls = null_graphs(g, seeds)
    origin = F.regexp_extract("graph_id", ORIGIN, 1).alias("g")
    edges = nulls.edges.groupBy(origin).agg(F.countDistinct("graph_id").alias("seeds"), F.count("*").alias("edges"))
    own = g.levels.select(F.col("graph_id").alias("g"), "node_id", F.col("level").alias("own"))
    kept = nulls.levels.select(origin, "node_id", "level").join(own, ["g", "node_id"]).groupBy("g").agg(F.count_if(F.expr("level = own")).alias("nodes_on_level"))
    return edges.join(kept, "g").withColumnRenamed("g", "graph_id")


def random_curves(g: Graphs, seeds: int = 100) -> DataFrame:
    """Per graph, scenario and budget: mean removed risk of ``seeds`` shuffled orders of the edges."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"])
        risk = pdf.expected_risk.tolist()
        total, n = sum(risk), len(risk)
        sums = dict.fromkeys(BUDGETS, 0.0)
        for seed in range(seeds):
            order = list(range(n))
            random.Random(seed).shuffle(order)
            for b in BUDGETS:
                k = max(1, -int(-(b * n) // 1))
                sums[b] += sum(risk[i] for i in order[:k]) / total if total > 0 else 0.0
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "scenario": pdf.scenario.iloc[0], "budget": [f"{int(b * 100)}pct" for b in BUDGETS], "removed_risk": [round(sums[b] / seeds, 9) for b in BUDGETS]})

    rows = error_rows(g).select("graph_id", "scenario", "u", "v", "expected_risk")
    return rows.groupBy("graph_id", "scenario").applyInPandas(draw, "graph_id string, scenario string, budget string, removed_risk double")


def _ranks(x: list[float]) -> list[float]:
    s = pd.Series(x)
    return s.rank(method="average").tolist()


def rho(x: list[float], y: list[float]) -> float | None:
    """Spearman's rho; None for fewer than three values or without variance."""
    if len(x) < 3 or len(set(x)) < 2 or len(set(y)) < 2:
        return None
    a, b = _ranks(x), _ranks(y)
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    return sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / (sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b)) ** 0.5


# The seeds of the permutations and of the bootstrap.
SHUFFLE_SEED, BOOTSTRAP_SEED = 20260928, 20260929


def resampled(rows: DataFrame, x: str, y: str, key: str, times: int = 10_000, shuffle_seed: int = SHUFFLE_SEED, bootstrap_seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """One row: rho, its two-sided permutation p-value and its bootstrap interval over a row a graph.

    One generator runs through all repetitions, so they are one sequence; ``rows`` holds a row a graph.
    """
    import numpy as np

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        a, b = pdf[x].tolist(), pdf[y].tolist()
        seen = rho(a, b)
        if seen is None:
            return pd.DataFrame({"items": [len(a)], "rho": [None], "p_value": [None], "low": [None], "high": [None]})
        ra, rb = np.array(_ranks(a)), np.array(_ranks(b))
        ca = (ra - ra.mean()) / np.sqrt(((ra - ra.mean()) ** 2).sum())
        cb = (rb - rb.mean()) / np.sqrt(((rb - rb.mean()) ** 2).sum())
        rng, order, most = random.Random(shuffle_seed), list(range(len(b))), 0
        for _ in range(times):
            rng.shuffle(order)  # each shuffle starts from the last one's order
            most += abs(float(ca @ cb[order])) >= abs(seen) - 1e-12
        rng, values = random.Random(bootstrap_seed), []
        for _ in range(times):
            i = [rng.randrange(len(a)) for _ in a]
            r = rho([a[k] for k in i], [b[k] for k in i])
            if r is not None:
                values.append(r)
        low, high = np.percentile(values, [2.5, 97.5]) if values else (0.0, 0.0)
        return pd.DataFrame({"items": [len(a)], "rho": [round(seen, 9)], "p_value": [(most + 1) / (times + 1)], "low": [float(low)], "high": [float(high)]})

    r = rows.select(key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).filter(f"{x} is not null and {y} is not null").withColumn("_one", F.lit(1))
    return r.groupBy("_one").applyInPandas(draw, "items long, rho double, p_value double, low double, high double")


def topology_classes(g: Graphs, rounds: int = 5) -> DataFrame:
    """``graph_id, topology_hash``: equal for graphs that Weisfeiler-Lehman refinement can't tell apart.

    A node's first label is its degree, in and out together; each round the label becomes the hash of
    its own and its successors' sorted labels.
    """
    ends = g.edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("graph_id", "node_id").count()
    labels = g.nodes.join(ends, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("count", F.lit(0)).cast("string").alias("label"))
    history = labels
    for _ in range(rounds):
        labels = materialize(labels, "wl")
        near = g.edges.withColumnsRenamed({"src": "x", "dst": "node_id"}).join(labels, ["graph_id", "node_id"]).groupBy("graph_id", F.col("x").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("label")), "|").alias("near"))
        labels = labels.join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.sha2(F.concat_ws("/", "label", F.coalesce("near", F.lit(""))), 256).alias("label"))
        history = history.unionByName(labels)
    counts = history.groupBy("graph_id", "label").count()
    return counts.groupBy("graph_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "label", "count"))), ","), 256), 1, 32).alias("topology_hash"))


def topology_groups(g: Graphs, rounds: int = 5) -> DataFrame:
    """``topology_hash, members, graph_id``: the graphs of each class that has more than one; a row a graph, since a class has no bound."""
    classes = materialize(topology_classes(g, rounds), "classes")
    size = classes.groupBy("topology_hash").agg(F.count("*").alias("members")).filter("members > 1")
    return classes.join(size, "topology_hash").select("topology_hash", "members", "graph_id")
