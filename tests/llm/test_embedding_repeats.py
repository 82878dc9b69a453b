"""Repeated ids of the embedding operator, against its SQL."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from edgeloom.llm import embedding_dedup, queries


def rows_of(seed, n=150):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, 8))
    rows = [(int(rng.integers(0, 60)), (base[rng.integers(12)] + rng.standard_normal(8) * 0.06).astype(np.float32).tolist(), int(rng.integers(2))) for _ in range(n)]
    a, b = base[0].tolist(), base[1].tolist()
    # one id with two vectors, with two labels, with a vector that can't link; equal rows
    rows += [(900, a, 0), (900, b, 0), (901, a, 1), (902, b, 1), (903, a, 0), (903, a, 1), (904, a, 0), (904, None, 0), (905, b, 1), (905, b, 1), (906, None, 1), (906, [0.0] * 8, None)]
    return rows


def expected(rows):
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"label": "Int32"})  # noqa: F841
    return sorted(duckdb.sql(queries.ORACLES["op1_embedding_dedup"]).fetchall())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_ids(spark, seed, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rows = rows_of(seed)
    want = expected(rows)
    for k in range(2):
        random.Random(k).shuffle(rows)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect()) == want


def test_null_ids_and_hubs(spark):
    """Null ids keep their rows; a class and a bucket with most of all rows are spread."""
    rng = np.random.default_rng(5)
    one = rng.standard_normal(8)
    rows = [(i, one.tolist(), 0) for i in range(200)] + [(300 + i, (one + rng.standard_normal(8) * 0.01).tolist(), 0) for i in range(150)] + [(None, one.tolist(), 0)] * 3
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None} == {(0, None, True)}
    assert {(r.n_links, r.component_id) for r in got if r.vec_id is not None} == {(349, 0)}
    assert sum(r.kept for r in got if r.vec_id is not None) == 1


def test_tables_follow_the_codes():
    for rows in (10, 1000, 50_000, 10**8):
        tables, bits = embedding_dedup.shape(rows, 0.98)
        agree = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - agree) ** tables <= embedding_dedup.MISS and bits <= 31
