"""Manifests are compared for the folders that hold both project files, and for all of them."""

from edgeloom.sources import projects as P


def test_only_folders_with_both_files(spark, tmp_path):
    rows = []
    for project, marks in {"both": ["dbt_project.yml", "profiles.yml"], "unparsed": ["dbt_project.yml", "profiles.yml"], "torn": ["dbt_project.yml", "profiles.yml"], "empty": ["dbt_project.yml", "profiles.yml"], "one": ["dbt_project.yml"], "deep": ["dbt_project.yml", "x/profiles.yml"]}.items():
        rows += [(project, m, "") for m in marks]
        if project != "empty":
            rows += [(project, "models/a.sql", "select 1"), (project, "models/b.sql", "select * from {{ ref('a') }}")]
    files = spark.createDataFrame(rows, "project string, path string, text string")
    text = '{"metadata": {"project_name": "own"}, "nodes": {"model.own.a": {"resource_type": "model", "package_name": "own", "name": "a", "depends_on": {"nodes": []}}, "model.own.b": {"resource_type": "model", "package_name": "own", "name": "b", "depends_on": {"nodes": ["model.own.a"]}}}, "sources": {}}'
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "manifest.json").write_text("{ no manifest")
    for project in ("both", "one"):
        (tmp_path / project).mkdir()
        (tmp_path / project / "manifest.json").write_text(text)
    manifests = P.manifest_rows(spark, [str(tmp_path / p / "manifest.json") for p in ("both", "one", "torn")])
    got = {r.project: (r.parse_succeeded, r.static_edges, r.manifest_edges, r.shared_edges, r.static_only_edges, r.manifest_only_edges) for r in P.compare_projects(files, manifests).collect()}
    assert {r.project: r.error for r in P.compare_projects(files, manifests).collect()} == {"both": None, "unparsed": "no manifest", "torn": "the manifest can't be read", "empty": "no manifest"}
    assert got == {"both": (True, 1, 1, 1, 0, 0), "unparsed": (False, 1, 0, 0, 1, 0), "torn": (False, 1, 0, 0, 1, 0), "empty": (False, 0, 0, 0, 0, 0)}
