"""Single-edge edits and what they change, set at a time.

No edit is ever applied and traversed.  With P the path counts (P(x,x) = 1), deleting
u->v loses the pair (a,b) if all its paths run through the edge: P(a,u) * P(v,b) = P(a,b),
which is compared modulo two primes, since counts grow without bound.
Adding u->v gains (a,b) if a reaches u, v reaches b, and a did not reach b.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.damage import MESSAGE, packed, tally_packed
from edgeloom.operators.answers import OPERATIONS, frozen_cases
from edgeloom.operators.graphs import Graphs
from edgeloom.plans.paths import PRIMES, closure
from edgeloom.plans.storage import materialize

EDIT = ("graph_id", "kind", "u", "v")


def deletions(g: Graphs) -> DataFrame:
    return g.edges.select("graph_id", F.lit("delete").alias("kind"), F.col("src").alias("u"), F.col("dst").alias("v"))


def admissible_additions(g: Graphs) -> DataFrame:
    """Pairs from a lower to a higher level that are no edge; none can close a cycle."""
    a, b = g.levels.alias("a"), g.levels.alias("b")
    pairs = a.join(b, (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.level") < F.col("b.level"))).select("a.graph_id", F.lit("add").alias("kind"), F.col("a.node_id").alias("u"), F.col("b.node_id").alias("v"))
    e = g.edges.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    return pairs.join(e, ["graph_id", "u", "v"], "left_anti").select(*EDIT)


def edit_order():
    """Order of additions in reports: as the text of the pair."""
    return F.concat(F.lit("("), "u", F.lit(", "), "v", F.lit(")"))


def through(g: Graphs, edits: DataFrame) -> DataFrame:
    """``edits`` joined with the pairs (a, b) such that a reaches u and v reaches b: ``p1, p2`` are the paths through the edge modulo the ``PRIMES``."""
    head = g.reach0.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("u"), F.col("r1").alias("h1"), F.col("r2").alias("h2"), F.col("dist").alias("d1"), F.col("sigma").alias("s1"))
    tail = g.reach0.select("graph_id", F.col("src").alias("v"), F.col("dst").alias("b"), F.col("r1").alias("t1"), F.col("r2").alias("t2"), F.col("dist").alias("d2"), F.col("sigma").alias("s2"))
    counts = [(F.col(f"h{i}") * F.col(f"t{i}") % q).alias(f"p{i}") for i, q in enumerate(PRIMES, 1)]
    return edits.join(head, ["graph_id", "u"]).join(tail, ["graph_id", "v"]).select(*EDIT, "a", "b", *counts, (F.col("d1") + F.col("d2") + 1).alias("d"), (F.col("s1") * F.col("s2")).alias("s"))


def lost_pairs(g: Graphs) -> DataFrame:
    """``graph_id, kind, u, v, a, b``: pairs that deleting u->v disconnects."""
    pair = g.reach.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), "r1", "r2")
    return through(g, deletions(g)).join(pair, ["graph_id", "a", "b"]).filter("p1 = r1 and p2 = r2").select(*EDIT, "a", "b")


def gained_pairs(g: Graphs) -> DataFrame:
    """``graph_id, kind, u, v, a, b``: pairs that adding u->v connects."""
    pair = g.reach.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    return through(g, admissible_additions(g)).join(pair, ["graph_id", "a", "b"], "left_anti").select(*EDIT, "a", "b")


def deletion_severity(g: Graphs) -> DataFrame:
    """Per edge: lost pairs, those away from the edge's own ends (severity), and whether another path remains."""
    lost = lost_pairs(g).groupBy("graph_id", "u", "v").agg(F.count("*").alias("lost"), F.sum(F.when(F.col("a") != F.col("u"), 1).otherwise(0) + F.when(F.col("b") != F.col("v"), 1).otherwise(0)).alias("severity"))
    direct = g.reach.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"), "paths")
    return deletions(g).join(lost, ["graph_id", "u", "v"], "left").join(direct, ["graph_id", "u", "v"]).select("graph_id", "u", "v", F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("severity", F.lit(0)).alias("severity"), (F.col("paths") >= 2).alias("alternate_path"))


#: Nodes, edges and foreign keys in one part of ``tallies``.
PART_ROWS = 400_000


def tallies(g: Graphs, by: str, groups: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """``EDIT, by, probes, distorted, incorrect, f1`` of each edit and group of probes.

    ``groups`` has for each the rule of ``functions.damage`` that chooses probes, and their operations.  Unhit probes have F1 = 1, so ``f1``
    is the sum over hit ones.  Nodes, edges and foreign keys are dealt by ``graph_id`` once, in compressed messages, and an edit comes back as one
    row; neither what it changes nor a path is ever a row, and no path table is made.
    A graph's matrices (about 20 of 8 bytes a pair of nodes) are held by one task.
    """
    nodes = g.nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0).alias("dist"))
    edges = g.edges.select("graph_id", "src", "dst", F.lit(1).alias("dist"))
    keys = g.fk.select("graph_id", F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(None).cast("int").alias("dist"))
    rows = nodes.unionByName(edges).unionByName(keys).withColumns({c: F.col(c).cast("int") for c in ("src", "dst")})
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(x.count() for x in (nodes, edges, keys)) // PART_ROWS))
    rows = rows.dropna(subset=["graph_id", "src", "dst"]).withColumn("part", F.pmod(F.hash("graph_id"), F.lit(parts)))
    rows = rows.mapInArrow(packed, MESSAGE).repartitionById(parts, F.col("part"))
    numbers = ", ".join(f"p{i} long, d{i} long, k{i} long, f{i} double" for i in range(len(groups)))
    wide = rows.mapInArrow(tally_packed([(s, *x) for s, x in groups.items()], PRIMES), f"graph_id string, add boolean, u int, v int, {numbers}")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias(by), F.col(f"p{i}").alias("probes"), F.col(f"d{i}").alias("distorted"), F.col(f"k{i}").alias("incorrect"), F.col(f"f{i}").alias("f1")) for i, s in enumerate(groups)]))
    return wide.select("graph_id", F.when(F.col("add"), "add").otherwise("delete").alias("kind"), "u", "v", each.alias("x")).select(*EDIT, "x.*")


def damage_by_bucket(g: Graphs) -> DataFrame:
    """Per edit and bucket (local, propagated, null_gold): probes, distorted, adr, fp, fn, incorrect, mean_f1."""
    groups = {"local": ("own", ["direct_downstream", "direct_upstream"]), "propagated": ("away", ["transitive_downstream", "transitive_upstream", "combined_impact"]), "null_gold": ("empty", list(OPERATIONS))}
    return _damage(tallies(g, "bucket", groups), "bucket")


def damage_by_operation(g: Graphs) -> DataFrame:
    """Per edit and operation: the same measures over its n probes."""
    return _damage(tallies(g, "operation", {o: ("all", [o]) for o in OPERATIONS}), "operation")


def _damage(rows: DataFrame, by: str) -> DataFrame:
    many = F.col("probes") > 0
    return rows.select(
        *EDIT, by, "probes", "distorted",
        F.round(F.when(many, F.col("distorted") / F.col("probes")).otherwise(0.0), 9).alias("adr"),
        F.when(F.col("kind") == "add", F.col("incorrect")).otherwise(0).cast("long").alias("fp"),
        F.when(F.col("kind") == "delete", F.col("incorrect")).otherwise(0).cast("long").alias("fn"),
        "incorrect",
        F.round(F.when(many, (F.col("probes") - F.col("distorted") + F.col("f1")) / F.col("probes")).otherwise(1.0), 9).alias("mean_f1"),
    )


def frozen_damage(g: Graphs) -> DataFrame:
    """Per edit and question population: frozen cases, distorted ones, and changed elements.

    A multi-source answer is the direct sources, whatever their number after the edit.
    """
    populations = {"forward": "direct_downstream", "reverse": "direct_upstream", "transitive": "transitive_downstream", "combined_impact": "combined_impact", "multi_source": "direct_upstream"}
    rows = tallies(g, "subtype", {s: (s, [o]) for s, o in populations.items()}).filter("probes > 0")
    return rows.select(*EDIT, "subtype", F.col("probes").alias("cases"), "distorted", "incorrect", F.round((F.col("probes") - F.col("distorted") + F.col("f1")) / F.col("probes"), 9).alias("mean_f1"))


def exposure(g: Graphs) -> DataFrame:
    """Per edit: 2 * ancestors of u + descendants of v on the unedited graph, and propagated damage per unit of it."""
    up = g.reach.groupBy("graph_id", F.col("dst").alias("u")).agg(F.count("*").alias("up"))
    down = g.reach.groupBy("graph_id", F.col("src").alias("v")).agg(F.count("*").alias("down"))
    edits = deletions(g).unionByName(admissible_additions(g)).join(up, ["graph_id", "u"], "left").join(down, ["graph_id", "v"], "left").fillna(0, ["up", "down"])
    hits = damage_by_bucket(g).filter("bucket = 'propagated'").select(*EDIT, "distorted")
    size = 2 * F.col("up") + F.col("down")
    return edits.join(hits, list(EDIT)).select(*EDIT, size.alias("exposure"), F.round(F.when(size > 0, F.col("distorted") / size).otherwise(0.0), 9).alias("damage_per_exposure"))


def edit_summary(g: Graphs) -> DataFrame:
    """Per graph and edit kind: edits, those with propagated damage, and means and maxima of it."""
    rows, of = damage_by_bucket(g), lambda b, c: F.when(F.col("bucket") == b, F.col(c))
    hit = lambda b: F.count_if((F.col("bucket") == b) & (F.col("distorted") > 0))
    return rows.groupBy("graph_id", "kind").agg(
        F.count(of("propagated", "distorted")).alias("edits"), hit("propagated").alias("nonzero_propagated"), F.round(F.avg(of("propagated", "distorted")), 9).alias("mean_distorted"), F.max(of("propagated", "distorted")).alias("max_distorted"), F.round(F.avg(of("propagated", "incorrect")), 9).alias("mean_incorrect"), F.max(of("propagated", "incorrect")).alias("max_incorrect"), hit("null_gold").alias("distorting_null_gold")
    )


def top_damage(g: Graphs, limit: int = 10) -> DataFrame:
    """Per graph and kind the ``limit`` edits that change most frozen answers: by changed elements, then distorted cases, then edit order."""
    total = frozen_damage(g).groupBy(*EDIT).agg(F.sum("incorrect").alias("incorrect"), F.sum("distorted").alias("distorted"))
    order = Window.partitionBy("graph_id", "kind").orderBy(F.desc("incorrect"), F.desc("distorted"), F.when(F.col("kind") == "add", edit_order()), "u", "v")
    return total.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def structural_features(g: Graphs) -> DataFrame:
    """Per deletable edge: levels and gap of its ends, closure below it, cases above and at it, foreign-key fan-out."""
    e = deletions(g)
    lv = lambda end: g.levels.select("graph_id", F.col("node_id").alias(end), F.col("level").alias(f"{end}_level"))
    below = g.reach0.select("graph_id", F.col("src").alias("v"), F.col("dst").alias("b"))
    size = below.groupBy("graph_id", "v").agg(F.count("*").alias("downstream_closure_size"))
    hop = below.join(g.fk.withColumnRenamed("parent", "b"), ["graph_id", "b"]).select("graph_id", "v", F.col("child").alias("b")).distinct().join(below, ["graph_id", "v", "b"], "left_anti")
    fan = hop.groupBy("graph_id", "v").agg(F.count("*").alias("downstream_fk_fanout"))
    cases = frozen_cases(g).select("graph_id", "subtype", "anchor").distinct()
    ahead = F.col("subtype").isin("forward", "transitive", "combined_impact")
    above = cases.filter(ahead).join(g.reach0.select("graph_id", F.col("src").alias("anchor"), F.col("dst").alias("u")), ["graph_id", "anchor"]).groupBy("graph_id", "u").agg(F.count("*").alias("upstream_anchor_count"))
    at = cases.filter(~ahead).groupBy("graph_id", F.col("anchor").alias("v")).agg(F.count("*").alias("reverse_anchor_count"))
    out = e.join(lv("u"), ["graph_id", "u"]).join(lv("v"), ["graph_id", "v"]).join(size, ["graph_id", "v"]).join(above, ["graph_id", "u"], "left").join(at, ["graph_id", "v"], "left").join(fan, ["graph_id", "v"], "left")
    out = out.fillna(0, ["upstream_anchor_count", "reverse_anchor_count", "downstream_fk_fanout"])
    return out.select("graph_id", "u", "v", F.col("u_level").alias("source_level"), F.col("v_level").alias("target_level"), (F.col("v_level") - F.col("u_level")).alias("level_gap"), "downstream_closure_size", "upstream_anchor_count", "reverse_anchor_count", "downstream_fk_fanout")


def diagnostics(g: Graphs) -> DataFrame:
    """Per graph: sizes, depth, mean descendants, foreign-key density, admissible additions and the shortcuts among them."""
    adds = admissible_additions(g)
    pair = g.reach.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("there"))
    shortcuts = adds.join(pair, ["graph_id", "u", "v"], "left").groupBy("graph_id").agg(F.count("*").alias("additions"), F.count("there").alias("shortcuts"))
    reached = g.reach.groupBy("graph_id").agg(F.count("*").alias("pairs"))
    s = g.sizes.join(reached, "graph_id", "left").join(shortcuts, "graph_id", "left").fillna(0, ["pairs", "additions", "shortcuts"])
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 9)
    n = F.col("n")
    return s.select("graph_id", "n", "m", "fk_edges", "depth", ratio(F.col("pairs"), n).alias("mean_descendants"), ratio(F.col("fk_edges"), n * (n - 1)).alias("fk_density"), "additions", "shortcuts", ratio(F.col("shortcuts"), F.col("additions")).alias("shortcut_fraction"))


def set_distortion(gold: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """Per key: missing and spurious elements of ``observed`` against ``gold`` (both ``keys, elem``), precision, recall, F1."""
    a, b = gold.select(*keys, "elem").distinct().withColumn("g", F.lit(1)), observed.select(*keys, "elem").distinct().withColumn("o", F.lit(1))
    s = a.join(b, [*keys, "elem"], "full").groupBy(*keys).agg(F.count_if(F.expr("g is null")).alias("fp"), F.count_if(F.expr("o is null")).alias("fn"), F.count_if(F.expr("g is not null and o is not null")).alias("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).when(fn > 0, 0.0).otherwise(1.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    s = s.withColumns({"incorrect": fp + fn, "distorted": fp + fn > 0, "precision": p, "recall": r})
    return s.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def amplification(answers, edges):
    """Incorrect answer elements per incorrect edge: 0/0 is 0, x/0 is infinite; negative counts raise."""
    bad = F.raise_error(F.lit("counts must not be negative"))
    return F.when((answers < 0) | (edges < 0), bad.cast("double")).when(edges > 0, answers / edges).when(answers > 0, F.lit(float("inf"))).otherwise(0.0)


def oracle_check(g: Graphs) -> DataFrame:
    """Per graph and kind of edit: edits, and those whose lost or gained pairs differ from closing the edited graph again.

    A check for small graphs: every edit makes a copy of its graph.
    """
    key = F.concat_ws("|", "graph_id", "kind", "u", "v").alias("key")
    every = materialize(deletions(g).unionByName(admissible_additions(g)).select(key, *EDIT), "edits")
    kept = every.join(g.edges, "graph_id").filter("kind = 'add' or src <> u or dst <> v").select(F.col("key").alias("graph_id"), "src", "dst")
    copies = kept.unionByName(every.filter("kind = 'add'").select(F.col("key").alias("graph_id"), F.col("u").alias("src"), F.col("v").alias("dst")))
    after = closure(copies).groupBy(F.col("graph_id").alias("key")).agg(F.count("*").alias("after"))
    before = g.reach.groupBy("graph_id").agg(F.count("*").alias("before"))
    lost, gained = lost_pairs(g).groupBy(key).agg(F.count("*").alias("lost")), gained_pairs(g).groupBy(key).agg(F.count("*").alias("gained"))
    r = every.join(after, "key", "left").join(before, "graph_id", "left").join(lost, "key", "left").join(gained, "key", "left").fillna(0)
    return r.groupBy("graph_id", "kind").agg(F.count("*").alias("edits"), F.count_if(F.expr("after <> before - lost + gained")).alias("mismatches"))
