"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is compiled to a trie.  Every node has a failure link (where to go
on when the next byte does not fit) and the number of pieces that are popped on
the way.  Failure transitions are followed once, at build time: the automaton is
a table ``(state, byte) -> (state, popped pieces)``, so a word of n bytes takes n
table reads and no piece is ever built.  All words of a batch step together, one
byte position at a time.

A word is a run of bytes other than space and 0x09-0x0D; a leading space byte
stands before each word, as in the vocabulary.  Every single byte is a piece, so
every word has a greedy split and none is unknown.

The table takes 5 bytes a node and byte value in each Python worker (more if a piece has 255
bytes or more): 256 * 5 bytes times the distinct beginnings of pieces.

Null text: no words, no tokens.  Empty text: the same.  Rows are independent, so
repeated rows and ids give repeated rows, and an empty table an empty result.  Other columns are
not read, so their names may clash with any.  Texts are read whole, however long.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from edgeloom.llm.shared import flat, slices


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a ``.tiktoken`` file: a base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """The automaton of a vocabulary of byte strings."""

    def __init__(self, pieces: list[bytes]):
        words = sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})
        number, edges, token = {b"": 0}, [], []
        for w in words:
            for i in range(1, len(w) + 1):
                if w[:i] not in number:
                    number[w[:i]] = len(number)
                    edges.append((number[w[: i - 1]], w[i - 1], number[w[:i]], i))
        for w in words:
            token.append(number[w])
        n = len(number)
        table = np.array(edges, dtype=np.int64)
        is_token = np.zeros(n, bool)
        is_token[token] = True
        self.step = np.zeros((n, 256), np.int32)
        # a step pops no more pieces than its node's word has bytes
        count = np.min_scalar_type(max(map(len, words)) + 1)
        self.pops = np.zeros((n, 256), count)
        fail, popped = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at_end = np.zeros(n, np.int64)
        by_depth = [table[table[:, 3] == d] for d in range(1, int(table[:, 3].max()) + 1)]
        self.step[0, by_depth[0][:, 1]] = by_depth[0][:, 2]
        for d, rows in enumerate(by_depth):
            parent, byte, node = rows[:, 0], rows[:, 1], rows[:, 2]
            whole = is_token[node]
            fail[node] = np.where(whole, 0, self.step[fail[parent], byte])
            popped[node] = np.where(whole, 1, popped[parent] + self.pops[fail[parent], byte])
            at_end[node] = popped[node] + at_end[fail[node]]
            self.step[node] = self.step[fail[node]]
            self.pops[node] = self.pops[fail[node]] + popped[node][:, None].astype(count)
            if d + 1 < len(by_depth):
                after = by_depth[d + 1]
                self.step[after[:, 0], after[:, 1]] = after[:, 2]
                self.pops[after[:, 0], after[:, 1]] = 0
        self.at_end = at_end
        self.first = int(self.step[0, 32])

    def count(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:start+length] with a space before it."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = np.full(len(start), self.first, np.int64)
        count = np.zeros(len(start), np.int64)
        step, pops = self.step.reshape(-1), self.pops.reshape(-1)
        live, steps = len(start), int(length[0]) if len(length) else 0
        for i in range(steps):
            while live and length[live - 1] <= i:
                live = int(np.searchsorted(-length, -i, side="left"))
            cell = state[:live] * 256 + data[start[:live] + i]
            count[:live] += pops[cell]
            state[:live] = step[cell]
        count += self.at_end[state]
        out = np.empty_like(count)
        out[order] = count
        return out


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every word; words end at the ends of texts."""
    solid = ~SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    begins[edge] = solid[edge]
    ends[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) - start + 1


def token_counts(docs: DataFrame, pieces: list[bytes], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words`` and ``n_tokens`` of each row; the vocabulary goes out once, by broadcast (its size is the vocabulary's, not the data's)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(list(pieces))
    kind = docs.schema[key].dataType.simpleString()
    built: list[LongestMatch] = []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                if not built:
                    built.append(automaton(shared.value))
                data, at = flat(part.column("_text"))
                start, length = word_spans(data, at)
                tokens = built[0].count(data, start, length)
                doc = np.searchsorted(at, start, side="right") - 1
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.array(np.bincount(doc, minlength=n)[:n].astype(np.int64)), pa.array(np.bincount(doc, weights=tokens, minlength=n)[:n].astype(np.int64))],
                    names=["_key", "n_words", "n_tokens"],
                )

    rows = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    return rows.mapInArrow(count, f"_key {kind}, n_words long, n_tokens long").withColumnRenamed("_key", key)


_BUILT: dict[tuple[int, bytes], LongestMatch] = {}


def automaton(pieces: list[bytes]) -> LongestMatch:
    """One automaton a Python worker, kept between tasks."""
    at = (len(pieces), pieces[-1] if pieces else b"")
    if at not in _BUILT:
        _BUILT.clear()
        _BUILT[at] = LongestMatch(pieces)
    return _BUILT[at]
