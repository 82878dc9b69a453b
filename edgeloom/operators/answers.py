"""Lineage questions: direct, transitive, combined (with foreign keys), multi-source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.graphs import Graphs

OPERATIONS = ("direct_downstream", "direct_upstream", "transitive_downstream", "transitive_upstream", "combined_impact")


def elements(g: Graphs, operation: str) -> DataFrame:
    """``graph_id, anchor, elem`` (node ids) of every answer to one operation; an unknown one raises ``ValueError``."""
    if operation == "direct_downstream":
        return g.edges.select("graph_id", F.col("src").alias("anchor"), F.col("dst").alias("elem"))
    if operation == "direct_upstream":
        return g.edges.select("graph_id", F.col("dst").alias("anchor"), F.col("src").alias("elem"))
    if operation == "transitive_downstream":
        return g.reach.select("graph_id", F.col("src").alias("anchor"), F.col("dst").alias("elem"))
    if operation == "transitive_upstream":
        return g.reach.select("graph_id", F.col("dst").alias("anchor"), F.col("src").alias("elem"))
    if operation == "combined_impact":
        # one foreign-key hop from what is reached, the anchor included
        hop = g.reach0.alias("r").join(g.fk.alias("f"), (F.col("r.graph_id") == F.col("f.graph_id")) & (F.col("r.dst") == F.col("f.parent"))).select("r.graph_id", F.col("r.src").alias("anchor"), F.col("f.child").alias("elem"))
        return elements(g, "transitive_downstream").unionByName(hop).filter("anchor <> elem").distinct()
    raise ValueError(f"unknown operation: {operation}")


def all_elements(g: Graphs) -> DataFrame:
    """``graph_id, operation, anchor, elem`` over the five operations."""
    out = None
    for op in OPERATIONS:
        part = elements(g, op).withColumn("operation", F.lit(op))
        out = part if out is None else out.unionByName(part)
    return out


def fk_reached(g: Graphs) -> DataFrame:
    """``graph_id, anchor`` of anchors whose combined impact goes beyond their lineage."""
    lineage = elements(g, "transitive_downstream")
    return elements(g, "combined_impact").join(lineage, ["graph_id", "anchor", "elem"], "left_anti").select("graph_id", "anchor").distinct()


def joined_names(df: DataFrame, *keys: str) -> DataFrame:
    """Answers as ``n`` and the sorted names, joined by commas."""
    return df.groupBy(*keys).agg(F.count("elem_name").alias("n"), F.array_join(F.array_sort(F.collect_list("elem_name")), ",").alias("answer"))


def answers(g: Graphs, operation: str) -> DataFrame:
    """``graph_id, anchor, n, answer`` for every node, empty answers included."""
    found = g.named(elements(g, operation), elem_name="elem").select(F.col("graph_id").alias("_g"), "anchor", "elem_name")
    every = g.nodes.join(found, (g.nodes["graph_id"] == found["_g"]) & (g.nodes["node_id"] == found["anchor"]), "left").select("graph_id", F.col("name").alias("anchor"), "elem_name")
    return joined_names(every, "graph_id", "anchor")


def multi_source(g: Graphs, least: int = 3) -> DataFrame:
    """Direct upstream answers of ``least`` sources or more."""
    return answers(g, "direct_upstream").filter(F.col("n") >= least)


def probe_inventory(g: Graphs) -> DataFrame:
    """Per graph and operation: the probes (one an anchor) and those with an empty answer."""
    held = all_elements(g).groupBy("graph_id", "operation").agg(F.countDistinct("anchor").alias("held"))
    ops = F.explode(F.array(*[F.lit(x) for x in OPERATIONS])).alias("operation")
    every = g.sizes.select("graph_id", "n", ops)
    return every.join(held, ["graph_id", "operation"], "left").select("graph_id", "operation", F.col("n").alias("probes"), (F.col("n") - F.coalesce("held", F.lit(0))).alias("empty_gold"))


def frozen_cases(g: Graphs) -> DataFrame:
    """``graph_id, subtype, anchor, elem`` of the five question populations over node ids.

    Forward and reverse for each node with edges; transitive only where something is reached
    indirectly; combined only where a foreign key adds something; multi-source from three sources.
    """
    down, up = elements(g, "direct_downstream"), elements(g, "direct_upstream")
    sources = down.select("graph_id", "anchor").distinct()
    far = elements(g, "transitive_downstream")
    indirect = far.join(down, ["graph_id", "anchor", "elem"], "left_anti").select("graph_id", "anchor").distinct()
    many = up.groupBy("graph_id", "anchor").agg(F.count("*").alias("k")).filter("k >= 3").select("graph_id", "anchor")
    combined = elements(g, "combined_impact").join(fk_reached(g).join(sources, ["graph_id", "anchor"], "left_semi"), ["graph_id", "anchor"], "left_semi")
    parts = {"forward": down, "reverse": up, "transitive": far.join(indirect, ["graph_id", "anchor"], "left_semi"), "combined_impact": combined, "multi_source": up.join(many, ["graph_id", "anchor"], "left_semi")}
    out = None
    for subtype, part in parts.items():
        part = part.withColumn("subtype", F.lit(subtype))
        out = part if out is None else out.unionByName(part)
    return out


# Question texts, id parts, order and difficulty of the five populations.
QUESTIONS = {
    "forward": ("fwd", "Which tables in the data warehouse are directly derived from %s?", "easy"),
    "reverse": ("rev", "What are all the source tables that %s is derived from?", "easy"),
    "transitive": ("trans", "If the schema of %s changes, which tables are directly or indirectly affected through data lineage?", "hard"),
    "combined_impact": ("combined", "If %s changes, which tables are affected either through direct/indirect data lineage OR because they have a foreign key dependency on an affected table?", "hard"),
    "multi_source": ("multisrc", "%s integrates data from multiple sources. List ALL source tables that feed into %s.", "hard"),
}


def questions(g: Graphs) -> DataFrame:
    """A row per frozen case, as a question: ``id, dataset, type, subtype, question, answer, answer_type, difficulty``.

    Ids are numbered through a graph in the order of populations, then anchors.
    """
    from pyspark.sql import Window

    cases = g.named(frozen_cases(g), elem_name="elem").groupBy("graph_id", "subtype", "anchor").agg(F.array_join(F.array_sort(F.collect_list("elem_name")), ",").alias("answer"))
    cases = g.named(cases, name="anchor")
    number = F.array_position(F.array(*[F.lit(x) for x in QUESTIONS]), F.col("subtype"))
    order = Window.partitionBy("graph_id").orderBy(number, "anchor")
    cases = cases.withColumn("k", F.row_number().over(order) - 1)
    part = text = hard = None
    for subtype, (tag, line, level) in QUESTIONS.items():
        filled = F.replace(F.lit(line), F.lit("%s"), F.col("name"))
        is_it = F.col("subtype") == subtype
        part = F.when(is_it, F.lit(tag)) if part is None else part.when(is_it, F.lit(tag))
        text = F.when(is_it, filled) if text is None else text.when(is_it, filled)
        hard = F.when(is_it, F.lit(level)) if hard is None else hard.when(is_it, F.lit(level))
    three = F.when(F.col("k") < 1000, F.lpad(F.col("k").cast("string"), 3, "0")).otherwise(F.col("k").cast("string"))
    return cases.select(
        F.concat("graph_id", F.lit("_lineage_"), part, F.lit("_"), three).alias("id"), F.col("graph_id").alias("dataset"), F.lit("lineage_impact").alias("type"), "subtype", text.alias("question"), "answer", F.lit("list").alias("answer_type"), hard.alias("difficulty")
    )


def signatures(rows: DataFrame) -> DataFrame:
    """Distinct ``dataset, subtype, question, answer`` of question rows of the five populations."""
    return rows.filter(F.col("subtype").isin(*QUESTIONS)).select("dataset", "subtype", "question", "answer").distinct()


def compared(g: Graphs, gold: DataFrame) -> DataFrame:
    """``dataset, subtype, question, answer`` of every signature of ``g`` or of ``gold``; ``made`` and ``given`` are null where that side lacks it."""
    made = signatures(questions(g)).withColumn("made", F.lit(1))
    given = signatures(gold).withColumn("given", F.lit(1))
    return made.join(given, ["dataset", "subtype", "question", "answer"], "full")


def parity(g: Graphs, gold: DataFrame) -> DataFrame:
    """Per graph and population: questions expected, given, missing from ``gold`` and extra in it."""
    both = compared(g, gold)
    return both.groupBy("dataset", "subtype").agg(F.count("made").alias("generated"), F.count("given").alias("gold"), F.count_if(F.expr("given is null")).alias("missing"), F.count_if(F.expr("made is null")).alias("extra"))


def differences(g: Graphs, gold: DataFrame, limit: int = 10) -> DataFrame:
    """``dataset, side, place, subtype, question, answer``: the first ``limit`` signatures of each graph that ``gold`` misses, and that it has too many."""
    side = F.when(F.col("given").isNull(), "missing").when(F.col("made").isNull(), "extra").alias("side")
    both = compared(g, gold).select("dataset", "subtype", "question", "answer", side).filter("side is not null")
    place = F.row_number().over(Window.partitionBy("dataset", "side").orderBy("subtype", "question", "answer"))
    return both.withColumn("place", place).filter(F.col("place") <= limit)
