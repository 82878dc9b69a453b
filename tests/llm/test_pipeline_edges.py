"""The pipeline's stages on odd rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import random

import corpus_pipeline
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", node long, rep long, g long, p long, taken long, size long, _text string, _doc string, component_id long"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def stages(spark, where, rows, schema, labels, items):
    """What each stage keeps, as rows."""
    spark.createDataFrame(rows, schema).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    kept = spark.read.parquet(f"{where}/documents.parquet")
    out, columns = {}, kept.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, where).write.parquet(f"{where}/{name}")
        kept = spark.read.parquet(f"{where}/{name}")
        out[name] = kept.collect()
        assert name == "mixing" or kept.columns == columns
    return out


def test_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    long_text = prose(rng, 60_000)
    same = prose(rng, 80)
    rows = [
        (None, None, None, None, None),
        (None, prose(rng, 50), None, None, 1),
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n", "en", None, 3),
        (4, long_text, "en", "a", len(long_text)),
        (5, long_text, None, "b", len(long_text)),  # an exact copy of a very long text
        (6, same, "en", "a", len(same)),
        (6, same, "en", "a", len(same)),  # a repeated row
        (7, prose(rng, 90), "en", None, 2),
    ]
    wide = [(*r, *[k if k % 2 else None for k in range(6)], "t", None, 9) for r in rows]
    labels = [(None, 1, 1), (1, None, 1), (2, 0, None), (4, 1, 0), (4, 1, 1), (99, 1, 1)]
    got = stages(spark, str(tmp_path), wide, DOCS + CLASHING, labels, [(0, None), (None, prose(rng, 20)), (1, ""), (1, "")])
    ids = {name: sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) for name, kept in got.items()}
    every = sorted((r[0] is not None, r[0] or 0) for r in rows)
    assert ids["toxicity"] == every
    assert ids["minhash"] == sorted(x for x in every if x != (True, 5))  # both rows of id 6 are the one document
    assert ids["suffix_array"] == ids["decontamination"] == ids["minhash"]
    cut = {r.doc_id: r for r in got["suffix_array"] if r.doc_id is not None}
    assert cut[1].text is None and cut[1].n_chars is None and cut[2].text == "" and cut[4].text == long_text
    assert [r.text for r in got["suffix_array"] if r.doc_id == 6] == [same, same]  # a passage is cut from larger ids only
    assert all(r._text == "t" and r.component_id == 9 for r in got["suffix_array"])
    assert all(r.copies in (1, 2) and r.taken == r.copies * r["size"] for r in got["mixing"])


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark", "all"])
def test_empty_tables(spark, tmp_path, empty):
    rng = random.Random(4)
    rows = [] if empty in ("documents", "all") else [(i, prose(rng, 40), "en", "a", 1) for i in range(12)]
    labels = [] if empty in ("labels", "all") else [(i, 1, 0) for i in range(12)]
    items = [] if empty in ("benchmark", "all") else [(0, prose(rng, 20))]
    got = stages(spark, str(tmp_path), rows, DOCS, labels, items)
    assert all(len(got[name]) == len(rows) for name in ("toxicity", "minhash", "suffix_array", "decontamination"))
    assert bool(got["mixing"]) == bool(rows)
