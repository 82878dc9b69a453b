"""Neither the sample nor the n-gram limit of the language operator drops a rare language."""

from edgeloom.llm import language_id

COMMON = ["the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs", "how vexingly quick daft zebras jump", "sphinx of black quartz judge my vow"]
RARE = "zażółć gęślą jaźń zażółć gęślą jaźń zażółć gęślą jaźń"


def docs(spark, common, rare):
    rows = [(f"c{i}", " ".join(COMMON[(i + j) % 4] for j in range(3)), "en") for i in range(common)] + [(f"r{i}", RARE, "pl") for i in range(rare)]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string")


def test_ngram_limit_is_for_each_language(spark):
    model = language_id.train(docs(spark, 200, 2), gram_limit=20)
    assert model.languages == ["en", "pl"]


def test_every_language_is_in_the_sample(spark):
    d = docs(spark, 1000, 1)
    model = language_id.train(d, sample_rows=5)
    assert model.languages == ["en", "pl"]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(d, model).collect()}
    assert got["r0"] == "pl" and got["c0"] == "en"


def test_language_whose_ngrams_are_all_rare(spark):
    rows = docs(spark, 50, 0).union(spark.createDataFrame([("r", "příliš žluťoučký kůň", "cs")], "doc_id string, text string, lang string"))
    assert language_id.train(rows).languages == ["cs", "en"]
