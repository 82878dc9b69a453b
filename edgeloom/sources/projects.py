"""SQL project text: file scans, reference extraction, census, gate, manifest comparison.

Files are rows ``project, path, text`` with paths relative to the project.  Texts that are
not valid UTF-8 have their bad bytes replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.plans.paths import closure, path_table, weak_labels
from edgeloom.plans.storage import materialize

# The reference patterns; (?U) makes \s and \b know all of Unicode.
REF = r"""(?U)ref\s*\(\s*['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?\s*\)"""
SOURCE = r"""(?U)source\s*\(\s*['"]([^'"]+)['"]\s*,\s*['"]([^'"]+)['"]\s*\)"""
RELATIONSHIP = r"(?U)\brelationships\s*:"
RELATIONSHIP_TO_REF = r"(?U)\bto\s*:\s*ref\s*\("
RELATIONSHIP_WORD = r"(?iu)(?U)\brelationships\b"
RELATIONSHIP_TARGET = r"""(?iu)(?U)relationships[\s\S]{0,800}?to\s*:\s*[^\n]*?ref\(\s*['"]([^'"]+)['"]\s*\)"""

MANIFEST = "metadata struct<project_name: string>, nodes map<string, struct<resource_type: string, package_name: string, name: string, depends_on: struct<nodes: array<string>>>>, sources map<string, struct<source_name: string, name: string>>"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All SQL and YAML files under the project folders of ``root``; empty files are files too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{sql,yml,yaml,SQL,YML,YAML,Yml,Yaml}").load(root)
    full = files.select(F.url_decode("path").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    bare = spark.createDataFrame([(p, "") for p in empty_files(spark, root)], "path string, text string")
    inside = F.substring_index("path", root.rstrip("/").split("://")[-1].strip("/") + "/", -1)
    rows = full.unionByName(bare).withColumn("inside", inside)
    return rows.select(F.substring_index("inside", "/", 1).alias("project"), F.regexp_extract("inside", r"^[^/]+/(.*)$", 1).alias("path"), "text").filter("path <> ''")


def empty_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of the empty SQL and YAML files, which Spark's own listing leaves out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while listing.hasNext():
        file = listing.next()
        name = file.getPath().toString()
        if file.getLen() == 0 and name.lower().endswith((".sql", ".yml", ".yaml")):
            out.append(name)
    return out


def projects(files: DataFrame) -> DataFrame:
    """Projects: folders with a ``dbt_project.yml`` at their top."""
    return files.filter("path = 'dbt_project.yml'").select("project").distinct()


def outside_packages(files: DataFrame) -> DataFrame:
    return files.filter(~F.array_contains(F.split("path", "/"), "dbt_packages"))


def model_files(files: DataFrame) -> DataFrame:
    """SQL files under ``models/``, with the model's name."""
    return outside_packages(files).filter("path like 'models/%' and path like '%.sql'").withColumn("model", F.regexp_extract("path", r"([^/]+)\.sql$", 1))


def yaml_files(files: DataFrame, models_only: bool = True) -> DataFrame:
    out = outside_packages(files).filter(F.lower("path").rlike(r"\.ya?ml$"))
    return out.filter("path like 'models/%'") if models_only else out


def references(models: DataFrame) -> DataFrame:
    """``project, path, model, ref`` of every ``ref()``; of two arguments the second is the model."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(REF), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(REF), F.lit(2)).alias("b"))
    return models.select("project", "path", "model", F.explode(both).alias("x")).select("project", "path", "model", F.when(F.col("x.b") != "", F.col("x.b")).otherwise(F.col("x.a")).alias("ref"))


def source_references(models: DataFrame) -> DataFrame:
    """``project, path, model, source`` of every ``source()``, as ``source:<schema>.<table>``."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(SOURCE), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(SOURCE), F.lit(2)).alias("b"))
    return models.select("project", "path", "model", F.explode(both).alias("x")).select("project", "path", "model", F.concat(F.lit("source:"), "x.a", F.lit("."), "x.b").alias("source"))


def resolved(models: DataFrame) -> DataFrame:
    """References with ``found``: is it a model of the project?"""
    names = models.select("project", F.col("model").alias("ref")).distinct().withColumn("found", F.lit(True))
    return references(models).join(names, ["project", "ref"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def model_graphs(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes``, ``edges`` and ``graphs`` (unresolved references, duplicate names) of the projects' models."""
    from pyspark.sql import Window

    models = materialize(model_files(files).join(projects(files), "project", "left_semi"), "models")
    names = models.select("project", "model").distinct()
    nodes = materialize(names.select(F.col("project").alias("graph_id"), (F.row_number().over(Window.partitionBy("project").orderBy("model")) - 1).alias("node_id"), F.col("model").alias("name")), "nodes")
    refs = materialize(resolved(models), "refs")
    ids = lambda c: nodes.select(F.col("graph_id").alias("project"), F.col("name").alias(c), F.col("node_id").alias(f"{c}_id"))
    edges = refs.filter("found").join(ids("ref"), ["project", "ref"]).join(ids("model"), ["project", "model"]).select(F.col("project").alias("graph_id"), F.col("ref_id").alias("src"), F.col("model_id").alias("dst")).distinct()
    dup = models.groupBy("project").agg((F.count("*") - F.countDistinct("model")).alias("duplicate_model_names"))
    miss = refs.groupBy("project").agg(F.count_if(~F.col("found")).alias("unresolved_refs"))
    graphs = projects(files).join(dup, "project", "left").join(miss, "project", "left").fillna(0).select(F.col("project").alias("graph_id"), "unresolved_refs", "duplicate_model_names")
    return nodes, edges, graphs


def static_edges(models: DataFrame) -> DataFrame:
    """``project, src, dst`` with ``model:`` and ``source:`` names; unresolved references are left out."""
    m = resolved(models).filter("found").select("project", F.concat(F.lit("model:"), "ref").alias("src"), F.concat(F.lit("model:"), "model").alias("dst"))
    s = source_references(models).select("project", F.col("source").alias("src"), F.concat(F.lit("model:"), "model").alias("dst"))
    return m.unionByName(s).distinct()


def census(files: DataFrame) -> DataFrame:
    """Per project: models, sources, edges, depth (null if cyclic), components, multi-hop anchors, references, class.

    Sources are nodes here, and count for depth.
    """
    files = materialize(files, "files")
    every = projects(files)
    models = materialize(model_files(files).join(every, "project", "left_semi"), "models")
    edges = materialize(static_edges(models).withColumnsRenamed({"project": "graph_id"}), "edges")
    nodes = models.select(F.col("project").alias("graph_id"), F.concat(F.lit("model:"), "model").alias("node_id")).unionByName(edges.select("graph_id", F.col("src").alias("node_id"))).distinct()
    nodes = materialize(nodes, "nodes")
    cyclic = materialize(closure(edges).filter("src = dst").select("graph_id").distinct(), "cyclic")
    dag = path_table(nodes.join(cyclic, "graph_id", "left_anti"), edges.join(cyclic, "graph_id", "left_anti"))
    depth = dag.groupBy("graph_id").agg(F.max("longest").alias("max_depth"), F.count_distinct(F.when(F.col("dist") >= 2, F.col("src"))).alias("multi_hop_anchors"))
    parts = weak_labels(nodes, edges).groupBy("graph_id").agg(F.countDistinct("label").alias("weak_components"))
    refs = resolved(models).groupBy(F.col("project").alias("graph_id")).agg(F.count_if(~F.col("found")).alias("unresolved_refs"))
    sizes = models.groupBy(F.col("project").alias("graph_id")).agg(F.countDistinct("model").alias("models"))
    links = edges.groupBy("graph_id").agg(F.count("*").alias("lineage_edges"), F.count_distinct(F.when(F.col("src").startswith("source:"), F.col("src"))).alias("sources"))
    tests = yaml_files(files).groupBy(F.col("project").alias("graph_id")).agg(F.sum(F.regexp_count("text", F.lit(RELATIONSHIP))).alias("relationship_tests"), F.sum(F.regexp_count("text", F.lit(RELATIONSHIP_TO_REF))).alias("relationship_to_ref_tests"))
    out = every.withColumnRenamed("project", "graph_id")
    for part in (sizes, links, depth, parts, refs, tests, cyclic.withColumn("cyclic", F.lit(True))):
        out = out.join(part, "graph_id", "left")
    counts = ["models", "lineage_edges", "sources", "weak_components", "multi_hop_anchors", "unresolved_refs", "relationship_tests", "relationship_to_ref_tests"]
    out = out.fillna(0, counts).withColumn("acyclic", F.col("cyclic").isNull())
    out = out.withColumn("max_depth", F.when(F.col("acyclic"), F.coalesce("max_depth", F.lit(0))))
    return out.select(F.col("graph_id").alias("project"), *[F.col(c).cast("long") for c in counts], "max_depth", "acyclic", classification().alias("classification"))


def classification():
    """The census class; the first condition that applies."""
    bad = (F.col("models") == 0) | (F.col("lineage_edges") == 0) | (F.col("unresolved_refs") > 0) | F.col("max_depth").isNull()
    deep = F.col("max_depth") >= 2
    return F.when(bad, "excluded").when(deep & (F.col("relationship_tests") > 0), "combined-impact-eligible").when(deep, "lineage-only-eligible").otherwise("direct-only-control")


def census_summary(rows: DataFrame) -> DataFrame:
    """Projects by class."""
    return rows.groupBy("classification").agg(F.count("*").alias("projects"), F.sum("lineage_edges").alias("lineage_edges"))


def gate(rows: DataFrame, least_projects: int = 10, edges_over: int = 60) -> DataFrame:
    """One row of checks over a census; multi-hop projects count whatever their class."""
    ok = F.col("classification").isin("lineage-only-eligible", "combined-impact-eligible")
    m = rows.agg(
        F.count("*").alias("projects"), F.count_if(F.expr("max_depth >= 2")).alias("multi_hop_projects"), F.coalesce(F.sum(F.when(ok, F.col("lineage_edges"))), F.lit(0)).alias("eligible_lineage_edges"),
        F.count_if(F.expr("classification = 'combined-impact-eligible'")).alias("combined_impact_projects"), F.count_if(F.expr("unresolved_refs > 0")).alias("projects_with_unresolved_refs"),
    )
    checks = {"enough_multi_hop": F.col("multi_hop_projects") >= least_projects, "enough_edges": F.col("eligible_lineage_edges") > edges_over, "some_combined": F.col("combined_impact_projects") > 0, "nonempty": F.col("projects") > 0}
    go = None
    for c in checks.values():
        go = c if go is None else go & c
    return m.select("*", *[c.alias(n) for n, c in checks.items()], go.alias("go"))


def relationship_audit(files: DataFrame) -> DataFrame:
    """Per project, over all its YAML files: mentions of relationships, and their targets that are models."""
    every = projects(files)
    y = yaml_files(files, models_only=False)
    names = model_files(files).select("project", F.col("model").alias("target")).distinct()
    said = y.groupBy("project").agg(F.count("*").alias("yaml_files"), F.sum(F.regexp_count("text", F.lit(RELATIONSHIP_WORD))).alias("relationship_mentions"))
    hit = y.select("project", F.explode(F.regexp_extract_all("text", F.lit(RELATIONSHIP_TARGET), F.lit(1))).alias("target")).join(names, ["project", "target"], "left_semi").groupBy("project").agg(F.countDistinct("target").alias("resolvable_relationship_targets"))
    out = every.join(said, "project", "left").join(hit, "project", "left").fillna(0)
    return out.withColumn("fk_capable", F.col("resolvable_relationship_targets") > 0)


def project_audit(files: DataFrame) -> DataFrame:
    """Per project: models, SQL files anywhere, unresolved references, and whether it has a package file."""
    files = materialize(files, "files")  # read six times, and weighed
    _, _, graphs = model_graphs(files)
    models = model_files(files).groupBy("project").agg(F.countDistinct("model").alias("models"))
    sql = outside_packages(files).filter("path like '%.sql'").groupBy("project").agg(F.count("*").alias("sql_files"))
    packs = files.filter("path in ('packages.yml', 'dependencies.yml')").select("project").distinct().withColumn("has_package_file", F.lit(True))
    out = graphs.select(F.col("graph_id").alias("project"), "unresolved_refs").join(models, "project", "left").join(sql, "project", "left").fillna(0).join(packs, "project", "left")
    return out.withColumn("has_package_file", F.coalesce("has_package_file", F.lit(False)))


def group_audit(audits: DataFrame, by: str) -> DataFrame:
    """Medians and counts of project audits for each value of ``by``."""
    return audits.groupBy(by).agg(F.count("*").alias("projects"), F.percentile("models", 0.5).alias("median_models"), F.percentile("sql_files", 0.5).alias("median_sql_files"), F.count_if(F.expr("has_package_file")).alias("projects_with_package_file"), F.percentile("unresolved_refs", 0.5).alias("median_unresolved_refs"))


def manifest_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Manifests by project: of files, or of every ``<project>/manifest.json`` and ``<project>/target/manifest.json`` under folders; a broken one is a row of nulls."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(paths).withColumn("project", F.regexp_extract(F.input_file_name(), r"([^/]+)/(?:target/)?manifest\.json$", 1))


def manifest_edges(manifests: DataFrame) -> DataFrame:
    """``project, src, dst`` of manifests (``project, metadata, nodes, sources``).

    Models of other packages are dropped; a dependency on one counts if it has the name of a kept model.
    """
    nodes = manifests.select("project", F.col("metadata.project_name").alias("own"), F.explode_outer("nodes").alias("id", "n")).filter("n.resource_type = 'model'")
    kept = nodes.filter("own is null or n.package_name = own").select("project", "id", F.col("n.name").alias("name"), F.col("n.depends_on.nodes").alias("deps"))
    deps = kept.select("project", "name", F.explode("deps").alias("dep"))
    src = manifests.select("project", F.explode_outer("sources").alias("dep", "s")).filter("dep is not null").select("project", "dep", F.concat(F.lit("source:"), "s.source_name", F.lit("."), "s.name").alias("src"))
    names = kept.select("project", "name").distinct()
    # a kept model is found by its name too, so one semi-join by name serves own and foreign ones
    any_model = nodes.select("project", F.col("id").alias("dep"), F.col("n.name").alias("other")).join(names.withColumnRenamed("name", "other"), ["project", "other"], "left_semi").select("project", "dep", F.concat(F.lit("model:"), "other").alias("src"))
    return deps.join(src.unionByName(any_model), ["project", "dep"]).select("project", "src", F.concat(F.lit("model:"), "name").alias("dst")).distinct()


def manifest_diff(static: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per project: edges of either kind, shared ones, and those of one kind only."""
    a, b = static.withColumn("s", F.lit(1)), manifest.withColumn("m", F.lit(1))
    both = a.join(b, ["project", "src", "dst"], "full")
    return both.groupBy("project").agg(F.count("s").alias("static_edges"), F.count("m").alias("manifest_edges"), F.count_if(F.expr("s is not null and m is not null")).alias("shared_edges"), F.count_if(F.expr("m is null")).alias("static_only_edges"), F.count_if(F.expr("s is null")).alias("manifest_only_edges"))


def compare_projects(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """``manifest_diff`` of every project folder with both ``dbt_project.yml`` and ``profiles.yml``.

    A project without a manifest, or with one that can't be read, gets a row with its static edges, ``parse_succeeded``
    false and an ``error``.
    """
    marks = files.filter("path in ('dbt_project.yml', 'profiles.yml')").groupBy("project").agg(F.countDistinct("path").alias("marks"))
    scanned = marks.filter("marks = 2").select("project")
    own = manifests.join(scanned, "project", "left_semi")
    read = own.groupBy("project").agg(F.max(F.col("nodes").isNotNull()).alias("parse_succeeded"))
    diff = manifest_diff(static_edges(model_files(files.join(scanned, "project", "left_semi"))), manifest_edges(own.filter("nodes is not null")))
    out = scanned.join(read, "project", "left").join(diff, "project", "left").fillna(0)
    error = F.when(F.col("parse_succeeded").isNull(), "no manifest").when(~F.col("parse_succeeded"), "the manifest can't be read")
    return out.withColumn("error", error).withColumn("parse_succeeded", F.coalesce("parse_succeeded", F.lit(False)))


def question_rows(spark: SparkSession, path: str) -> DataFrame:
    """Question rows of a JSON-lines file, or of a file with one JSON array; answers become sorted names joined by commas.  A file with anything else raises ``ValueError``."""
    lines = path.endswith(".jsonl")
    if not lines and not spark.read.text(path, wholetext=True).filter(F.trim(F.regexp_replace(F.substring("value", 1, 1000), r"\s", " ")).startswith("[") == F.lit(False)).isEmpty():
        raise ValueError(f"{path} holds no JSON array")
    rows = spark.read.schema("dataset string, subtype string, question string, answer string").option("multiLine", str(not lines).lower()).json(path)
    return rows.withColumn("answer", normal_answer("answer")).filter("dataset is not null or question is not null")


def normal_answer(column: str):
    """A JSON list in text form as sorted names joined by commas; other text as it is, trimmed."""
    text = F.trim(F.col(column))
    return F.when(text.startswith("[") & text.endswith("]"), F.coalesce(F.array_join(F.array_sort(F.from_json(text, "array<string>")), ","), text)).otherwise(text)
