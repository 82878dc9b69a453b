"""Report files and a command line.

Detail tables stay DataFrames and go to Parquet; a report is a small summary, a row a
graph at most, put together on the driver.

    python -m edgeloom.plans.reports census  <root> <report.json>     # 0, or 2 if there is no project
    python -m edgeloom.plans.reports gate    <root> <report.json>     # 0 if it is a go, else 1
    python -m edgeloom.plans.reports corpus  <root> <report.json>
    python -m edgeloom.plans.reports table   <root> <table.md>        # the deeper projects, and the headline figures
    python -m edgeloom.plans.reports compare <root> <report.json>     # static against manifest edges; manifests are <project>/[target/]manifest.json
    python -m edgeloom.plans.reports damage  <nodes+edges folder> <report.json>   # what single-edge edits do to answers
    python -m edgeloom.plans.reports priority <nodes+edges folder> <report.json>
    python -m edgeloom.plans.reports oracle  <nodes+edges folder> <report.json>   # 0 if every edit agrees with closing again, else 1
    python -m edgeloom.plans.reports parity  <nodes+edges folder> <gold.json[l]>   # 0 if nothing differs, else 1
"""

from __future__ import annotations

import json
import math
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import answers, edits, priority, stats
from edgeloom.operators.graphs import Graphs
from edgeloom.plans.paths import closure
from edgeloom.sources import projects


def rows(df: DataFrame, *order: str) -> list[dict]:
    """Rows of a summary as dictionaries, in a set order."""
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()] if order else [r.asDict(recursive=True) for r in df.collect()]


def write_json(payload, path: str) -> None:
    """Indented, keys sorted, with a newline at the end."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(payload, indent=2, sort_keys=True) + "\n")


def compact(payload) -> str:
    """One line for the console."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"))


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.1f}%"


def markdown_table(items: list[dict], columns: list[str], titles: list[str] | None = None) -> str:
    """A Markdown table of rows; missing cells are empty."""
    lines = ["| " + " | ".join(titles or columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if r.get(c) is None else str(r[c]) for c in columns) + " |" for r in items)]) + "\n"


def differences(want, got, at: str = "root") -> list[str]:
    """Where two payloads differ; types must agree, floats within 1e-10 relative or 1e-12 absolute."""
    if type(want) is not type(got):
        return [f"{at}: {type(want).__name__} and {type(got).__name__}"]
    if isinstance(want, dict):
        out = [f"{at}: keys {sorted(want.keys() ^ got.keys())}"] if want.keys() != got.keys() else []
        return out + [d for k in sorted(want.keys() & got.keys()) for d in differences(want[k], got[k], f"{at}.{k}")]
    if isinstance(want, list):
        if len(want) != len(got):
            return [f"{at}: {len(want)} and {len(got)} items"]
        return [d for i, (x, y) in enumerate(zip(want, got, strict=True)) for d in differences(x, y, f"{at}[{i}]")]
    same = math.isclose(want, got, rel_tol=1e-10, abs_tol=1e-12) if isinstance(want, float) else want == got
    return [] if same else [f"{at}: {want!r} and {got!r}"]


def census_report(spark: SparkSession, root: str) -> dict:
    found = projects.census(projects.scan(spark, root))
    items = rows(found, "project")
    classes = {r["classification"]: r["projects"] for r in rows(projects.census_summary(found))}
    return {"summary": {"projects": len(items), "classification_counts": classes}, "projects": items}


def gate_report(spark: SparkSession, root: str) -> dict:
    return rows(projects.gate(projects.census(projects.scan(spark, root))))[0]


def corpus_graphs(spark: SparkSession, root: str) -> tuple[Graphs, DataFrame]:
    """The acyclic projects' graphs, and every project with its counts and statuses."""
    nodes, edges, info = projects.model_graphs(projects.scan(spark, root))
    cyclic = closure(edges).filter("src = dst").select("graph_id").distinct()
    g = Graphs(nodes.join(cyclic, "graph_id", "left_anti"), edges.join(cyclic, "graph_id", "left_anti"))
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    sizes = info.join(n, "graph_id", "left").join(m, "graph_id", "left").fillna(0, ["n", "m"]).join(g.sizes.select("graph_id", "depth"), "graph_id", "left")
    return g, stats.status(sizes)


def corpus_report(spark: SparkSession, root: str) -> dict:
    g, sizes = corpus_graphs(spark, root)
    ok = sizes.filter("status = 'eligible'").select("graph_id")
    kept = Graphs(g.nodes.join(ok, "graph_id", "left_semi"), g.edges.join(ok, "graph_id", "left_semi"))
    curves = priority.budget_curves(kept)
    return {
        "projects": rows(sizes, "graph_id"),
        "summary": rows(stats.corpus_summary(kept))[0],
        "severity": rows(stats.severity_summary(kept), "graph_id"),
        "priority": rows(priority.scenario_macro(curves), "scenario", "strategy", "budget"),
        "wins": rows(priority.pairwise_wins(curves), "scenario", "budget"),
    }


def table_report(spark: SparkSession, root: str, least_depth: int = 3) -> str:
    """Markdown: a row for each eligible project of some depth, deepest first, and the headline figures."""
    g, sizes = corpus_graphs(spark, root)
    ok = sizes.filter("status = 'eligible'").select("graph_id")
    kept = Graphs(g.nodes.join(ok, "graph_id", "left_semi"), g.edges.join(ok, "graph_id", "left_semi"))
    deep = rows(stats.severity_summary(kept).join(kept.sizes.select("graph_id", "n", "depth"), "graph_id").filter(F.col("depth") >= least_depth).orderBy(F.desc("depth"), F.desc("edges"), "graph_id"))
    for r in deep:
        r.update(nonlocal_edges=r["edges"] - r["zero"], gini=f"{r['gini']:.3f}", top=percent(r["top_share"]))
    text = markdown_table(deep, ["graph_id", "n", "edges", "depth", "nonlocal_edges", "max", "gini", "top"], ["Project", "Models", "Edges", "Depth", "Edges with damage", "Largest severity", "Gini", "Share of the top 10 %"])
    found, total = rows(stats.corpus_summary(kept)), rows(stats.status_counts(sizes), "status")
    head = found[0] if found else {}
    figures = {"Projects by status": compact({r["status"]: r["projects"] for r in total}), **{k.replace("_", " "): head.get(k) for k in ("graphs", "edges", "severity", "depth_3", "depth_4", "median_gini", "pooled_gini", "pooled_top_share")}}
    return text + "\n" + "".join(f"- {k}: {v}\n" for k, v in figures.items())


def compare_report(spark: SparkSession, root: str) -> dict:
    found = projects.compare_projects(projects.scan(spark, root), projects.manifest_rows(spark, root))
    items = rows(found, "project")
    good = [r for r in items if r["parse_succeeded"]]
    exact = sum(r["static_only_edges"] == r["manifest_only_edges"] == 0 for r in good)
    return {"summary": {"projects_attempted": len(items), "parse_succeeded": len(good), "parse_failed": len(items) - len(good), "exact_edge_match_projects": exact, "projects_with_edge_mismatch": len(good) - exact}, "projects": items}


def graph_folder(spark: SparkSession, folder: str) -> Graphs:
    """Graphs of a folder's ``nodes.parquet``, ``edges.parquet`` and, if there is one, ``fk.parquet``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/fk.parquet")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return Graphs(spark.read.parquet(f"{folder}/nodes.parquet"), spark.read.parquet(f"{folder}/edges.parquet"), spark.read.parquet(f"{folder}/fk.parquet") if there else None)


def damage_report(spark: SparkSession, folder: str) -> dict:
    g = graph_folder(spark, folder)
    return {"buckets": rows(edits.edit_summary(g)), "frozen": rows(edits.frozen_damage(g)), "diagnostics": rows(edits.diagnostics(g), "graph_id")}


def priority_report(spark: SparkSession, folder: str) -> dict:
    curves = priority.budget_curves(graph_folder(spark, folder))
    return {"macro": rows(priority.scenario_macro(curves), "scenario", "strategy", "budget"), "wins": rows(priority.pairwise_wins(curves), "scenario", "budget")}


def oracle_report(spark: SparkSession, folder: str) -> dict:
    items = rows(edits.oracle_check(graph_folder(spark, folder)), "graph_id", "kind")
    return {"summary": {"edits": sum(r["edits"] for r in items), "mismatches": sum(r["mismatches"] for r in items)}, "graphs": items}


def parity_report(spark: SparkSession, folder: str, gold: str) -> dict:
    g, given = graph_folder(spark, folder), projects.question_rows(spark, gold)
    items = rows(answers.parity(g, given), "dataset", "subtype")
    return {"subtypes": items, "differences": rows(answers.differences(g, given), "dataset", "side", "place"), "exact": all(r["missing"] == 0 and r["extra"] == 0 for r in items)}


REPORTS = {"census": census_report, "gate": gate_report, "corpus": corpus_report, "compare": compare_report, "damage": damage_report, "priority": priority_report, "oracle": oracle_report}


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] not in (*REPORTS, "table", "parity"):
        print(__doc__, file=sys.stderr)
        return 64
    what, source, target = args
    spark = SparkSession.builder.getOrCreate()
    if what == "parity":
        report = parity_report(spark, source, target)
        print(compact(report))
        return 0 if report["exact"] else 1
    if what == "table":
        os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            f.write(table_report(spark, source))
        return 0
    report = REPORTS[what](spark, source)
    write_json(report, target)
    print(compact(report.get("summary", report)))
    if what == "census":
        return 0 if report["projects"] else 2
    if what == "oracle":
        return 0 if report["summary"]["mismatches"] == 0 else 1
    return 0 if report.get("go", True) else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
