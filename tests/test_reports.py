"""Report files, comparison of payloads and exit codes."""

import json

from edgeloom.plans import reports


def project(root, name, **models):
    d = root / name / "models"
    d.mkdir(parents=True)
    (root / name / "dbt_project.yml").write_text("name: x")
    for m, refs in models.items():
        (d / f"{m}.sql").write_text(" ".join("{{ ref('%s') }}" % r for r in refs))


def test_payloads(tmp_path):
    reports.write_json({"b": [1.0, None], "a": 1}, str(tmp_path / "x" / "r.json"))
    text = (tmp_path / "x" / "r.json").read_text()
    assert text.endswith("}\n") and text.index('"a"') < text.index('"b"') and json.loads(text) == {"a": 1, "b": [1.0, None]}
    assert reports.differences({"a": [1.0, "x"]}, {"a": [1.0 + 1e-13, "x"]}) == []
    assert reports.differences({"a": 1}, {"a": 1.0}) and reports.differences({"a": 1}, {"b": 1}) and reports.differences([1], [1, 2])
    assert reports.markdown_table([{"a": 1, "b": None}], ["a", "b"]).splitlines()[2] == "| 1 |  |"
    assert reports.percent(0.123) == "12.3%" and reports.percent(None) == "n/a"


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "root"
    project(root, "good", a=[], b=["a"], c=["b", "a"], d=["c"], e=["c"], f=["e"])
    project(root, "loop", x=["y"], y=["x"])
    out = str(tmp_path / "r.json")
    assert reports.main(["census", str(root), out]) == 0
    got = json.load(open(out))
    assert got["summary"]["projects"] == 2 and {p["project"]: p["max_depth"] for p in got["projects"]} == {"good": 4, "loop": None}
    assert reports.main(["gate", str(root), out]) == 1
    assert reports.main(["corpus", str(root), out]) == 0
    got = json.load(open(out))
    assert {p["graph_id"]: p["status"] for p in got["projects"]} == {"good": "eligible", "loop": "cycle"}
    assert got["summary"]["edges"] == 6
    assert reports.main(["nonsense"]) == 64
    assert reports.main(["table", str(root), out]) == 0
    text = open(out).read()
    assert "| good | 6 | 6 | 4 |" in text and "- edges: 6" in text
    (root / "good" / "profiles.yml").write_text("")
    (root / "good" / "target").mkdir()
    (root / "good" / "target" / "manifest.json").write_text("{")
    assert reports.main(["compare", str(root), out]) == 0
    assert json.load(open(out))["summary"] == {"projects_attempted": 1, "parse_succeeded": 0, "parse_failed": 1, "exact_edge_match_projects": 0, "projects_with_edge_mismatch": 0}


def test_graph_commands(spark, tmp_path):
    d, out = str(tmp_path / "g"), str(tmp_path / "r.json")
    edges = [(0, 1), (1, 2), (0, 3), (3, 4), (2, 5), (4, 5)]
    spark.createDataFrame([("g", i, f"t{i}") for i in range(6)], "graph_id string, node_id int, name string").write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([("g", u, v) for u, v in edges], "graph_id string, src int, dst int").write.parquet(f"{d}/edges.parquet")
    assert reports.main(["oracle", d, out]) == 0
    got = json.load(open(out))
    assert got["summary"]["mismatches"] == 0 and {r["kind"]: r["edits"] for r in got["graphs"]}["delete"] == 6
    assert reports.main(["damage", d, out]) == 0 and json.load(open(out))["buckets"]
    assert reports.main(["priority", d, out]) == 0 and json.load(open(out))["macro"]
    gold = tmp_path / "gold.jsonl"
    gold.write_text('{"dataset":"g","subtype":"forward","question":"q","answer":"a"}\n')
    assert reports.main(["parity", d, str(gold)]) == 1
