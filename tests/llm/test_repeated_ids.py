"""An id with several texts is linked by each of them."""

import random

from edgeloom.llm import minhash_dedup


def test_each_text_of_a_repeated_id_links(spark):
    words = lambda t: [f"{t}{i}" for i in range(60)]
    texts = {t: " ".join(words(t)) for t in "abcdef"}
    near = {t: " ".join([*words(t)[:-1], "other"]) for t in "abcdef"}
    rows = [(1, texts[t]) for t in "abcdef"] + [(10 + i, near[t]) for i, t in enumerate("abcdef")] + [(5, "far " + " ".join(words("z"))), (1, texts["a"]), (None, near["a"]), (None, near["a"]), (20, None), (20, "short")]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = minhash_dedup.near_duplicates(docs).collect()
        assert len(got) == len(rows)
        want = {i: 1 for i in range(10, 16)} | {1: 1, 5: 5, 20: 20, None: None}
        assert all((r.component_id, r.kept) == (want[r.doc_id], r.doc_id is None or want[r.doc_id] == r.doc_id) for r in got)
        assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(i), len(set(minhash_dedup.shingles(t, 5).tolist()))) for i, t in rows)


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, id string, node string")
    assert minhash_dedup.near_duplicates(empty).count() == 0 and minhash_dedup.keep_one(empty).count() == 0
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    docs = spark.createDataFrame([(3, long), (1, long + " end"), (2, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(docs).collect()) == [(1, 1), (2, 2), (3, 1)]
