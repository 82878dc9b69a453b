"""The pipeline's stages on a small table with planted cases, and the whole run."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows, marks = [], []
    for i in range(300):
        t = prose(rng.randrange(60, 120))
        if i % 9 == 0:
            t += " grumf grumf you grumf"
        rows.append(t)
        marks.append((i, int(i % 9 == 0)))
    passage, item = prose(60), prose(14) + ". " + prose(10) + "."
    base = rows[1].split()
    near = " ".join([*base[:-1], "changed"])
    planted = {"exact": rows[2], "near": near, "passage_a": prose(40) + " " + passage + " " + prose(30), "passage_b": prose(50) + " " + passage, "leak": prose(40) + " " + item + " " + prose(20)}
    at = {name: len(rows) + k for k, name in enumerate(planted)}
    rows += planted.values()
    d = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in marks], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    kept, columns = spark.read.parquet(f"{d}/documents.parquet"), docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, d).write.parquet(f"{d}/{name}")
        kept = spark.read.parquet(f"{d}/{name}")
        seen[name] = {r.doc_id: r.text for r in kept.collect()}
        if name != "mixing":
            assert kept.columns == columns
    every = set(range(len(rows)))
    toxic = {i for i, x in marks if x}
    assert set(seen["toxicity"]) == every - toxic
    assert set(seen["minhash"]) == every - toxic - {at["exact"], at["near"]}
    assert set(seen["suffix_array"]) == set(seen["minhash"])
    assert passage in seen["suffix_array"][at["passage_a"]] and passage not in seen["suffix_array"][at["passage_b"]]
    changed = {i for i, t in seen["suffix_array"].items() if t != rows[i]}
    assert changed == {at["passage_b"]}
    assert set(seen["decontamination"]) == set(seen["minhash"]) - {at["leak"]}
    mixed = spark.read.parquet(f"{d}/mixing").collect()
    assert mixed and set(seen["mixing"]) <= set(seen["decontamination"]) and all(r.copies in (1, 2) and r.taken == r.copies * r["size"] for r in mixed)
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == set(seen["mixing"])
