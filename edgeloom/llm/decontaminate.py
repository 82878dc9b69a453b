"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Every passage of every document is a query.  Items are numbered by length, and stand in
blocks of ``BLOCK`` of like length; for each block the passages are windows of words twice as
long as its longest item, moved by half their length, so each item-long stretch lies
whole in one of them.  Impacts are divided by the item's own best score, so a score is the
covered share of an item's weight and one threshold serves all.

The index is a posting list of (item, impact) for each term.  Two tables of maxima bound scores:
one for each term and block of items, one for each ``RUN`` postings of a list.

1. The most frequent terms, which together give no item more than ``WEAK_SHARE``, are
   set aside.  The block maxima of a text's other terms are summed by block; a block whose bound, with
   ``WEAK_SHARE`` added, stays under the threshold is skipped for the whole text, then for each passage.
2. Each passage and span of blocks that is left is searched by WAND over the posting lists of all the passage's
   terms: cursors in item order, the pivot where the lists' largest impacts first reach the threshold,
   a jump over the current runs where their maxima don't, a full score from the postings otherwise.

Every item above the threshold is found.  A found item counts as leaked if the passage holds
enough of its question's and of its answer's word n-grams.

Words are lower-cased and end at white space and ASCII punctuation.  An item's answer is its last
sentence, its question the rest; an item of one sentence is both.  Null and empty
texts and items without words match nothing; items with a null id are left out.  Copies of an
item are separate items.  Repeated rows give repeated results; a null doc_id is kept.  Of the
documents only the two named columns are read, so others may clash with any name; an empty table of documents
or of items gives no rows.  Long texts are read whole, a text at a time.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.shared import lean, slices

#: ASCII characters that are neither letters nor digits become spaces.
APART = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
SENTENCE = re.compile(r"(?<=[.!?])\s+")
K1, B = 1.2, 0.75
#: Items of a block, and postings of a run.
BLOCK, RUN = 8, 32
WEAK_SHARE = 0.3
#: A score this much under the threshold still counts, since sums differ in their last bits by order.
SLACK = 1e-9


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(APART).split() if text else []


def ngrams(w: list[int], n: int) -> set[tuple[int, ...]]:
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@dataclass
class Leak:
    question: float
    answer: float


class Cursor:
    """A place in a term's posting list; ``item`` is past all items at the end."""

    __slots__ = ("at", "end", "item", "items", "most", "runs")

    def __init__(self, items: list[int], at: int, end: int, most: float):
        self.items, self.at, self.end, self.most = items, at, end, most
        self.item = items[at] if at < end else PAST

    def advance(self, item: int) -> None:
        """To the first posting of ``item`` or a later one."""
        self.at = bisect_left(self.items, item, self.at, self.end)
        self.item = self.items[self.at] if self.at < self.end else PAST


PAST = 1 << 62


class ItemIndex:
    """The inverted index of a shard of test items."""

    def __init__(self, items: list[tuple[int, str]], n: int = 5):
        split = sorted(((len(w), i, w, t) for i, t in items if (w := words(t))), key=lambda x: x[:2])
        self.n = n
        self.ids = [i for _, i, _, _ in split]
        size = len(split)
        self.longest = [max(m for m, _, _, _ in split[b : b + BLOCK]) for b in range(0, size, BLOCK)]
        mean = sum(m for m, _, _, _ in split) / max(1, size)
        df = Counter(t for _, _, w, _ in split for t in set(w))
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        self.numbers = [np.array([self.terms[x] for x in w], np.int32) for _, _, w, _ in split]
        # where the answer begins in the item's words
        self.answer = [len(w) - len(words([x for x in SENTENCE.split(t) if words(x)][-1])) for _, _, w, t in split]

        idf = np.array([math.log(1 + (size - df[t] + 0.5) / (df[t] + 0.5)) for t in sorted(df)])
        term, item, impact = [], [], []
        for j, own in enumerate(self.numbers):
            t, f = np.unique(own, return_counts=True)
            w = idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(own) / mean))
            term.append(t)
            item.append(np.full(len(t), j))
            impact.append(w / w.sum())
        none = np.zeros(0, np.int64)
        term, item, impact = np.concatenate([none, *term]), np.concatenate([none, *item]), np.concatenate([none.astype(float), *impact])
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order]
        self.offset = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.item, self.impact = item.tolist(), impact
        begin = self.offset[:-1]
        self.most = np.maximum.reduceat(impact, begin) if len(impact) else impact
        # runs of postings: a list's first run begins with it
        head = np.flatnonzero((np.arange(len(term)) - self.offset[term]) % RUN == 0)
        self.run = np.cumsum(np.isin(np.arange(len(term)), head)) - 1
        self.run_most = np.maximum.reduceat(impact, head) if len(impact) else impact
        self.run_end = np.append(head[1:], len(term))

        # frequent terms are set aside while no item can get more than WEAK_SHARE from them
        share, self.weak, essential = np.zeros(size), 0.0, np.ones(len(self.terms), bool)
        for t in np.argsort(begin - self.offset[1:], kind="stable").tolist():
            own = slice(self.offset[t], self.offset[t + 1])
            more = share.copy()
            more[item[own]] += impact[own]
            if more.max() > WEAK_SHARE:
                break
            share, self.weak = more, float(more.max())
            essential[t] = False
        self.blocks = len(self.longest)
        strong = essential[term]
        key, at = np.unique(term[strong] * max(1, self.blocks) + item[strong] // BLOCK, return_index=True)
        self.block = (key % max(1, self.blocks)).astype(np.int32)
        self.block_most = np.maximum.reduceat(impact[strong], at) if len(at) else none.astype(float)
        # the last, empty list is for words of no item, number -1
        self.begin = np.searchsorted(key // max(1, self.blocks), np.arange(len(self.terms) + 1))
        self.count = np.append(np.diff(self.begin), 0)

    def passages(self, n_words: int, block: int) -> np.ndarray:
        """Where the windows of a text of ``n_words`` words begin."""
        return np.arange(0, max(1, n_words - self.longest[block]), self.longest[block])

    def retrieve(self, numbers: np.ndarray, threshold: float) -> set[tuple[int, int]]:
        """(window start, item) of all scores of at least ``threshold``; ``numbers`` holds the text's term numbers, -1 for words of no item."""
        found: set[tuple[int, int]] = set()
        need = threshold - self.weak - SLACK
        each = self.count[numbers]
        at = np.flatnonzero(each)
        if not len(at):
            return found
        each = each[at]
        ends = np.cumsum(each)
        entry = np.repeat(self.begin[numbers[at]] - ends + each, each) + np.arange(ends[-1])
        block, most, at = self.block[entry], self.block_most[entry], np.repeat(at, each)
        live = np.flatnonzero(np.bincount(block, weights=most, minlength=self.blocks) >= need)
        if not len(live):
            return found
        mine = np.zeros(self.blocks, bool)
        mine[live] = True
        mine = mine[block]
        block, most, at = block[mine], most[mine], at[mine]
        order = np.argsort(block, kind="stable")
        block, most, at = block[order], most[order], at[order]
        first, last = np.searchsorted(block, live), np.searchsorted(block, live, side="right")
        spans: dict[tuple[int, int], list[int]] = {}
        for b, i, j in zip(live.tolist(), first.tolist(), last.tolist(), strict=True):
            starts, width = self.passages(len(numbers), b), 2 * self.longest[b]
            place, total = at[i:j], np.concatenate([[0.0], np.cumsum(most[i:j])])
            bound = total[np.searchsorted(place, starts + width)] - total[np.searchsorted(place, starts)]
            for s in starts[bound >= need].tolist():
                spans.setdefault((s, width), []).append(b)
        for (s, width), live_blocks in spans.items():
            terms = np.unique(numbers[s : s + width])
            terms = terms[terms >= 0]
            k = 0
            while k < len(live_blocks):  # neighbouring blocks are searched as one span
                m = k + 1
                while m < len(live_blocks) and live_blocks[m] == live_blocks[m - 1] + 1:
                    m += 1
                found.update((s, item) for item in self.wand(terms, live_blocks[k] * BLOCK, (live_blocks[m - 1] + 1) * BLOCK, threshold))
                k = m
        return found

    def wand(self, terms: np.ndarray, low: int, high: int, threshold: float) -> list[int]:
        """The items from ``low`` to under ``high`` that the query of distinct ``terms`` scores at least ``threshold``, by block-max WAND."""
        need = threshold - SLACK
        lists = []
        for begin, end, most in zip(self.offset[terms].tolist(), self.offset[terms + 1].tolist(), self.most[terms].tolist(), strict=True):
            at = bisect_left(self.item, low, begin, end)
            if at < end and self.item[at] < high:
                lists.append(Cursor(self.item, at, end, most))
        found = []
        while True:
            lists.sort(key=lambda c: c.item)
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += c.most
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0 or (item := lists[pivot].item) >= high:
                return found
            while pivot + 1 < len(lists) and lists[pivot + 1].item == item:
                pivot += 1
            # the runs that hold the pivot item, or follow it, bound its score; before the first of them ends no other item can beat them
            bound, jump = 0.0, lists[pivot + 1].item if pivot + 1 < len(lists) else PAST
            for c in lists[: pivot + 1]:
                at = c.at if c.item == item else bisect_left(self.item, item, c.at, c.end)
                if at < c.end:
                    run = self.run[at]
                    bound += self.run_most[run]
                    jump = min(jump, self.item[self.run_end[run] - 1] + 1)
            if bound < need:
                jump = max(jump, item + 1)
                for c in lists[: pivot + 1]:
                    c.advance(jump)
            elif lists[0].item == item:
                own = lists[: pivot + 1]
                if sum(self.impact[c.at] for c in own) >= need:
                    found.append(item)
                for c in own:
                    c.advance(item + 1)
            else:
                for c in lists[:pivot]:
                    if c.item < item:
                        c.advance(item)

    def verify(self, numbers: np.ndarray, start: int, item: int) -> Leak:
        """Shares of the item's question and answer n-grams that the window holds."""
        own, cut = self.numbers[item].tolist(), self.answer[item]
        window = numbers[start : start + 2 * self.longest[item // BLOCK]].tolist()
        shares = []
        for part in (own[:cut] or own, own[cut:]):
            n = min(self.n, len(part))
            want = ngrams(part, n)
            shares.append(len(want & ngrams(window, n)) / len(want))
        return Leak(*shares)

    def leaks(self, text: str | None, threshold: float, overlap: float) -> dict[int, Leak]:
        w = words(text)
        if not w or not self.ids:
            return {}
        get = self.terms.get
        numbers = np.array([get(x, -1) for x in w], np.int64)
        best: dict[int, Leak] = {}
        for start, item in sorted(self.retrieve(numbers, threshold)):
            leak = self.verify(numbers, start, item)
            if leak.question >= overlap and leak.answer >= overlap and (item not in best or leak.question + leak.answer > best[item].question + best[item].answer):
                best[item] = leak
        return best


_BUILT: dict[tuple[str, int], ItemIndex] = {}


def index_of(shard: tuple[str, list[tuple[int, str]]], n: int) -> ItemIndex:
    """The shard's index; a Python worker keeps the last one between tasks."""
    if (shard[0], n) not in _BUILT:
        _BUILT.clear()
        _BUILT[shard[0], n] = ItemIndex(shard[1], n)
    return _BUILT[shard[0], n]


def shards(items: DataFrame, shard_bytes: int = 2 << 20) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """The test items in id order and their digest, as many at a time as hold about ``shard_bytes`` of text: what is sent to the executors at once has that bound."""
    part: list[tuple[int, str]] = []
    size, digest = 0, xxhash.xxh3_128()
    for r in items.select("item_id", F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        raw = r.text.encode()
        if part and size + len(raw) > shard_bytes:
            yield digest.hexdigest(), part
            part, size, digest = [], 0, xxhash.xxh3_128()
        part.append((r.item_id, r.text))
        size += len(raw)
        digest.update(f"{r.item_id} {len(raw)} ".encode() + raw)
    if part:
        yield digest.hexdigest(), part


def find_leaks(docs: DataFrame, items: DataFrame, *, threshold: float = 0.75, overlap: float = 0.6, n: int = 5, shard_bytes: int = 2 << 20) -> DataFrame:
    """One row for each document and leaked item: ``doc_id, item_id, question_overlap, answer_overlap``.

    No shuffle: documents are read once for each shard of items.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, question_overlap double, answer_overlap double"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for shard in shards(items, shard_bytes):
        index = spark.sparkContext.broadcast(shard)
        part = rows.mapInArrow(_finder(index, threshold, overlap, n), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _finder(index, threshold: float, overlap: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = index_of(index.value, n)
        for batch in batches:
            for part in slices(batch, "text"):
                row, item, question, answer = [], [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    for j, leak in sorted(ready.leaks(text, threshold, overlap).items()):
                        row.append(k)
                        item.append(ready.ids[j])
                        question.append(leak.question)
                        answer.append(leak.answer)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(question, pa.float64()), pa.array(answer, pa.float64())], names=["doc_id", "item_id", "question_overlap", "answer_overlap"])

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, *, threshold: float = 0.75, overlap: float = 0.6, n: int = 5, shard_bytes: int = 2 << 20) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; judged row by row, without a join."""
    at = docs.columns.index("text")
    for shard in shards(items, shard_bytes):
        index = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ready = index_of(index.value, n)
            for batch in batches:
                yield batch.filter(pa.array([not ready.leaks(t, threshold, overlap) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
