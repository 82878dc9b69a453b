"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: a slot is a
bitmask with one bit a language, and the AND of an n-gram's slots is the set of
languages that (probably) contain it.  A text's bits are counted per language,
the counts are corrected for each language's false-positive rate, and the largest
corrected count decides.

Text is lower-cased, and runs of other characters than letters become one space.
Null text or text without a letter gives ``und`` with score 0.  Whole texts are
read, however long.  Ties go to the language that sorts first.  Without any
labelled row every text is ``und``, and an empty table gives an empty result.  Rows are
independent: repeated rows and ids give repeated rows.  Columns that aren't named are not read, so their
names may clash with any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.shared import flat, fold, materialize, mix64, share_of, slices

GRAM = 5
PROBES = 3


def cleaned(texts: pa.Array) -> pa.Array:
    low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    return pc.binary_join_element_wise(" ", low, " ", "")


def grams(data: np.ndarray, at: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The n bytes at every place of a text, as a number, and the text's index; none crosses two texts."""
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(len(data) - n + 1, np.uint64)
    for i in range(n):
        value = (value << np.uint64(8)) | data[i : len(data) - n + 1 + i]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(value)]
    inside = np.arange(len(value)) + n <= at[doc + 1]
    return value[inside], doc[inside]


def slots(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    a = mix64(gram)
    b = mix64(gram ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return [((a + np.uint64(i) * b) >> np.uint64(64 - bits)).astype(np.int64) for i in range(PROBES)]


class LanguageFilters:
    def __init__(self, languages: list[str], members: list[np.ndarray], bits: int):
        self.languages, self.bits = languages, bits
        self.filters = np.zeros((1 << bits, (len(languages) + 7) // 8), np.uint8)
        for i, own in enumerate(members):
            for s in slots(own, bits):
                np.bitwise_or.at(self.filters[:, i // 8], s, np.uint8(1 << i % 8))
        self.false = np.array([np.mean(self.filters[:, i // 8] >> (i % 8) & 1) ** PROBES for i in range(len(languages))])

    def counts(self, gram: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected n-grams per text and language, and all n-grams per text."""
        hit = np.full((len(gram), self.filters.shape[1]), 255, np.uint8)
        for s in slots(gram, self.bits):
            hit &= self.filters[s]
        total = np.bincount(doc, minlength=n)[:n].astype(float)
        out = np.empty((n, len(self.languages)))
        for i in range(len(self.languages)):
            found = np.bincount(doc, weights=hit[:, i // 8] >> (i % 8) & 1, minlength=n)[:n]
            out[:, i] = np.maximum(0.0, (found - total * self.false[i]) / max(1e-9, 1 - self.false[i]))
        return out, total


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 8000, gram_limit: int = 400_000, min_count: int = 3, min_ratio: float = 0.2, bits: int = 21) -> LanguageFilters:
    """Fit on about ``sample_rows`` labelled rows of each language, chosen by a hash of key and text; all rows of a rarer one.

    An n-gram joins a language's filter if it occurs ``min_count`` times there (as often as
    the most frequent one, where none does) and its share of that language's n-grams is at
    least ``min_ratio`` of its largest share; ``gram_limit`` bounds the n-grams of each
    language, the most frequent first.
    """
    labelled = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang")).filter("_lang is not null and _text is not null")
    totals = labelled.groupBy("_lang").agg(F.count("*").alias("_total"))
    kept = share_of(["_key", "_text"]) < F.lit(float(sample_rows)) / F.col("_total")
    sample = labelled.join(F.broadcast(totals), "_lang").filter(kept).select("_key", "_text", "_lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                names = part.column("_lang").to_pylist()
                gram, doc = grams(*flat(cleaned(part.column("_text"))))
                known = sorted(set(names))
                of = np.array([known.index(x) for x in names])
                both, n = np.unique(np.stack([of[doc].astype(np.uint64), gram]), axis=1, return_counts=True) if len(gram) < 1000 else _pairs(of[doc], gram)
                yield pa.RecordBatch.from_arrays([pa.array([known[int(i)] for i in both[0]], pa.string()), pa.array(both[1].astype(np.int64)), pa.array(n.astype(np.int64))], names=["_lang", "gram", "n"])

    each = sample.mapInArrow(counted, "_lang string, gram long, n long").groupBy("gram", "_lang").agg(F.sum("n").alias("n"))
    each = materialize(each, "language-grams")
    least = each.groupBy("_lang").agg(F.least(F.lit(min_count), F.max("n")).alias("_least"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "gram"))
    kept = each.join(F.broadcast(least), "_lang").filter("n >= _least").withColumn("_place", place).filter(F.col("_place") <= gram_limit)
    rows = kept.select("_lang", "gram", "n").toArrow()
    languages = sorted(set(rows.column("_lang").to_pylist()))
    if not languages:
        return LanguageFilters([], [], 3)
    of = np.array([languages.index(x) for x in rows.column("_lang").to_pylist()])
    gram, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy().astype(float)
    share = n / np.bincount(of, weights=n)[of]
    distinct, back = np.unique(gram, return_inverse=True)
    top = np.zeros(len(distinct))
    np.maximum.at(top, back, share)
    good = share >= min_ratio * top[back]
    return LanguageFilters(languages, [gram[good & (of == i)].astype(np.uint64) for i in range(len(languages))], bits)


def _pairs(of: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((gram, of))
    a, g = of[order], gram[order]
    new = np.ones(len(g), bool)
    new[1:] = (a[1:] != a[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    return np.stack([a[at].astype(np.uint64), g[at]]), np.diff(np.append(at, len(g)))


def predict(docs: DataFrame, model: LanguageFilters, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (the winner's share of the corrected counts, 0 to 1) of each row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                n = part.num_rows
                texts = part.column("_text")
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if m.languages:
                    counts, _ = m.counts(*grams(*flat(cleaned(texts))), n)
                    best = counts.argmax(axis=1)
                    sums = counts.sum(axis=1)
                    score = np.where(letters & (sums > 0), counts.max(axis=1) / np.maximum(sums, 1e-12), 0.0)
                    names = [m.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                else:
                    names, score = ["und"] * n, np.zeros(n)
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(names, pa.string()), pa.array(score)], names=["_key", "lang_pred", "score"])

    rows = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, lang_pred string, score double").withColumnRenamed("_key", key)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, predict every row."""
    model = train(docs.filter(fold("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
