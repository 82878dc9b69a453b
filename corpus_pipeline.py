"""A training-corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows that go on; its result
is written as Parquet and read again as the next one's ``docs``.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import decontaminate, minhash_dedup, mixing, suffix_dedup, toxicity
from edgeloom.llm.shared import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject.

    Texts without a matched clause stay, null and empty ones among them; null and repeated ids
    keep their rows.  Without labels no term is learned and all documents stay.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The one with the least id stays.  Texts that are null or without words are no copies of each other; rows
    with a null id stay; an id is one document, so all rows of a repeated id stay or go together.
    """
    return minhash_dedup.keep_one(docs, n=5, threshold=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the stretches of 100 bytes or more that a document with a smaller id holds too.

    ``n_chars`` is counted again.  Null texts stay null, with a null ``n_chars``; rows with one id cut nothing
    from each other, and those with a null id count as one id.
    """
    out = suffix_dedup.remove_repeats(docs, threshold=100)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, null and empty items are held by none; each row is judged alone, so
    null and repeated ids keep their rows.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies and words taken of each.

    A null source is a source, the last; null texts have no words.  Equal rows are ties, of which as many
    are taken as fit.  A column named like one that the mix adds is kept as ``_own_<name>``.
    """
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Sketches, suffix sorting and learned grammars have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
