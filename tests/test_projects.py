"""Extraction, census, gate and manifest comparison on small project texts."""

import json

import pytest

from edgeloom.sources import projects as P

TEXTS = {"ref('a')": ["a"], "ref( 'p' , \"m\" )": ["m"], "ref('v', v=2)": [], "myref('z')": ["z"], "-- ref('c')": ["c"], "ref( 'n')": ["n"]}


def files(spark, rows):
    return spark.createDataFrame(rows, "project string, path string, text string")


def shop(project="shop"):
    """orders and items feed baskets; baskets and customers feed revenue; two sources; a test against customers and one against nothing."""
    return [
        (project, "dbt_project.yml", "name: shop"),
        (project, "models/stage/orders.sql", "select * from {{ source('till', 'orders') }}"),
        (project, "models/stage/items.sql", "select * from {{ source('till', 'items') }} where price > 0"),
        (project, "models/customers.sql", "select 1 as customer"),
        (project, "models/baskets.sql", "select * from {{ ref('orders') }} join {{ ref(\"items\") }} using (id)"),
        (project, "models/revenue.sql", "select * from {{ ref('baskets') }} join {{ ref('shop', 'customers') }} using (customer)"),
        (project, "models/stage/tests.yml", "relationships:\n  to: ref('customers')\nrelationships:\n  to: ref('nobody')\n"),
        (project, "models/dbt_packages/util.sql", "{{ ref('elsewhere') }}"),
    ]


def test_reference_patterns(spark):
    rows = [("p", f"models/m{i}.sql", t) for i, t in enumerate(TEXTS)]
    got = {}
    for r in P.references(P.model_files(files(spark, rows))).collect():
        got.setdefault(r.model, []).append(r.ref)
    assert [got.get(f"m{i}", []) for i in range(len(TEXTS))] == list(TEXTS.values())


def test_census_and_gate(spark):
    rows = shop() + [("torn", "dbt_project.yml", ""), ("torn", "models/m.sql", "{{ ref('away') }} {{ ref('away') }} {{ ref('out') }}")]
    rows += [("ring", "dbt_project.yml", ""), *(("ring", f"models/r{i}.sql", "{{ ref('r%d') }}" % ((i + 1) % 3)) for i in range(3)), ("plain", "models/q.sql", "")]
    census = P.census(files(spark, rows))
    got = {r.project: r for r in census.collect()}
    assert set(got) == {"shop", "torn", "ring"}
    d = got["shop"]
    assert (d.models, d.sources, d.lineage_edges, d.max_depth, d.weak_components, d.classification) == (5, 2, 6, 3, 1, "combined-impact-eligible")
    assert (got["torn"].unresolved_refs, got["torn"].classification) == (3, "excluded")
    assert got["ring"].max_depth is None and not got["ring"].acyclic
    g = P.gate(census).first()
    assert not g.go and g.some_combined and g.nonempty and g.multi_hop_projects == 1


def test_audits(spark):
    f = files(spark, shop() + [("shop", "dependencies.yml", "")])
    r = P.relationship_audit(f).first()
    assert (r.resolvable_relationship_targets, r.fk_capable, r.yaml_files, r.relationship_mentions) == (1, True, 3, 2)
    a = P.project_audit(f).first()
    assert (a.models, a.sql_files, a.has_package_file) == (5, 5, True)
    _, edges, graphs = P.model_graphs(f)
    assert edges.count() == 4 and graphs.first().unresolved_refs == 0


def node(name, package, *needs, kind="model"):
    return {"resource_type": kind, "package_name": package, "name": name, "depends_on": {"nodes": list(needs)}}


def test_manifest(spark, tmp_path):
    nodes = {
        "model.shop.orders": node("orders", "shop", "source.shop.till.orders", "source.shop.till.gone"),
        "model.shop.items": node("items", "shop"),
        "model.shop.baskets": node("baskets", "shop", "model.shop.orders", "model.other.items", "model.other.extra", "test.shop.t"),
        "model.other.items": node("items", "other"),
        "model.other.extra": node("extra", "other", "model.shop.orders"),
        "test.shop.t": node("t", "shop", "model.shop.baskets", kind="test"),
    }
    path = tmp_path / "shop" / "manifest.json"
    path.parent.mkdir()
    path.write_text(json.dumps({"metadata": {"project_name": "shop"}, "nodes": nodes, "sources": {"source.shop.till.orders": {"source_name": "till", "name": "orders"}}}))
    edges = P.manifest_edges(P.manifest_rows(spark, [str(path)]))
    # a foreign model counts only under the name of an own one
    assert {(r.project, r.src, r.dst) for r in edges.collect()} == {("shop", "source:till.orders", "model:orders"), ("shop", "model:orders", "model:baskets"), ("shop", "model:items", "model:baskets")}


def test_scan_and_questions(spark, tmp_path):
    for _, path, text in shop():
        to = tmp_path / "root" / "shop" / path
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(text)
    (tmp_path / "root" / "shop" / "models" / "odd.sql").write_bytes(b"\xff{{ ref('baskets') }}")
    (tmp_path / "root" / "shop" / "models" / "blank.sql").write_bytes(b"")
    f = P.scan(spark, str(tmp_path / "root"))
    assert {r.model for r in P.model_files(f).collect()} == {"orders", "items", "customers", "baskets", "revenue", "odd", "blank"}
    assert P.references(P.model_files(f).filter("model = 'odd'")).first().ref == "baskets"
    lines = tmp_path / "q.jsonl"
    lines.write_text('{"dataset":"d","subtype":"forward","question":"q","answer":["b","a"]}\n\n{"dataset":"d","subtype":"forward","question":"r","answer":"[\\"z\\", \\"y\\"]"}\n')
    assert sorted(r.answer for r in P.question_rows(spark, str(lines)).collect()) == ["a,b", "y,z"]
    whole = tmp_path / "q.json"
    whole.write_text('[{"dataset":"d","subtype":"forward","question":"q","answer":["b","a"]}]')
    assert P.question_rows(spark, str(whole)).first().answer == "a,b"
    whole.write_text('{"dataset":"d","subtype":"forward","question":"q","answer":["b","a"]}')
    with pytest.raises(ValueError):
        P.question_rows(spark, str(whole))
