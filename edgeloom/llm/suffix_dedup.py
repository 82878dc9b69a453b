"""Exact substring dedup by a depth-limited radix sort of suffixes.

A byte is removed if it lies in a window of ``threshold`` bytes that also starts in a
text with a smaller id.  Windows are compared whole, byte by byte: suffixes are ordered
by 8-byte digits, most significant first, through ``threshold`` bytes only, and a group
leaves the sort as soon as it has one member.  The groups that are left after the last
digit are exactly the repeated windows.

So that not every suffix travels, the work is dealt twice.  Texts are dealt into
*batches* by a hash of their id.  Each window has an anchor, the least hashed k-gram in
it; equal windows have equal anchors.

1. Each batch sends its distinct anchors (4-byte codes) to *buckets* by hash, and gets
   back one bit for each: does another text have it?
2. Of windows with such anchors, runs that share an anchor are sent as one string with
   the least id that has it in the batch.  Buckets sort their suffixes and answer one bit
   a window: does a smaller id have it?
3. Batches put the bits together and cut.

What a batch sends is distinct within the batch, so a passage that a third of all texts
hold costs a bucket one string a batch, never one a text.  Batches and buckets have a
set size; their numbers grow with the input.

Null text is empty.  Texts shorter than the threshold lose nothing.  Of equal texts the
one with the least id stays.  Rows with one and the same id count as one text's parts:
they do not remove each other's bytes.  Null ids sort first, as one id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.shared import flat, freed, mix64

NO_ID = -(1 << 63)


def least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by doubling."""
    out, have = x, 1
    while have < w:
        more = min(have, w - have)
        out = np.minimum(out[: len(out) - more], out[more:])
        have += more
    return out


def digits(data: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes at every place, as numbers; a view, nothing is copied."""
    return np.ndarray((max(0, len(data) - 7),), dtype=f"{order}u8", buffer=data, strides=(1,)) if len(data) > 7 else np.zeros(0, f"{order}u8")


def anchor_runs(data: np.ndarray, at: np.ndarray, threshold: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows in a row that share an anchor: first start, number of windows, hash of the anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < threshold:
        return none, none, none.astype(np.uint64)
    word = digits(data, "<")
    n = len(data) - k + 1
    gram = np.zeros(n, np.uint64)
    for i in [*range(0, k - 8, 8), k - 8]:
        gram *= np.uint64(0x9E3779B97F4A7C15)
        gram ^= word[i : i + n]
        gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xD6E8FEB86659FD93)
    gram ^= gram >> np.uint64(32)
    least = least_in_windows(gram, threshold - k + 1)
    inside = np.ones(len(least), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        inside[max(a, b - threshold + 1) : b] = False
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (least[1:] != least[:-1]) | ~inside[1:]
    start = np.flatnonzero(new)
    return start, np.flatnonzero(last) - start + 1, least[start]


def sort_windows(data: np.ndarray, start: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal windows, as (order, group number) of the members of groups of two or more."""
    word = digits(data, ">")
    live, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for digit in [*range(0, threshold - 8, 8), threshold - 8]:
        if not len(live):
            break
        value = word[start[live] + digit].astype(np.uint64)
        order = np.argsort(value)
        if digit:
            order = order[np.argsort(group[order], kind="stable")]
        live, group, value = live[order], group[order], value[order]
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        live, group = live[many], group[many]
    return live, group


class Batch:
    """The texts of one batch and what can be told of them without others."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, threshold: int, k: int, buckets: int):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.data, self.at = flat(texts.take(pa.array(order)))
        self.threshold = threshold
        self.start, self.windows, least = anchor_runs(self.data, self.at, threshold, k)
        self.doc = np.searchsorted(self.at, self.start, side="right") - 1
        self.codes, first, anchor = np.unique(least, return_index=True, return_inverse=True)
        self.anchor = anchor.reshape(-1)
        self.bucket = (mix64(self.codes) % np.uint64(buckets)).astype(np.int64)
        # does the batch itself have the anchor in two texts?
        owner = self.ids[self.doc]
        self.shared = np.zeros(len(self.codes), bool)
        self.shared[self.anchor[owner != owner[first][self.anchor]]] = True
        self.by_bucket = np.argsort(self.bucket, kind="stable")

    def cells(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, its anchors) in bucket order."""
        if len(self.by_bucket):
            b = self.bucket[self.by_bucket]
            cut = np.flatnonzero(np.diff(b)) + 1
            for own in np.split(self.by_bucket, cut):
                yield int(self.bucket[own[0]]), own

    def owned(self, chosen: np.ndarray):
        """What the batch sends in the second round: its runs with a chosen anchor, each one's string number, the distinct strings, their least ids and buckets."""
        run = np.flatnonzero(chosen[self.anchor])
        begin, end = self.start[run], self.start[run] + self.windows[run] + self.threshold - 1
        raw = self.data.tobytes() if len(run) else b""
        names: dict[bytes, int] = {}
        number = np.fromiter((names.setdefault(raw[a:b], len(names)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(run))
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, number, self.ids[self.doc[run]])
        bucket = np.zeros(len(names), np.int64)
        bucket[number] = self.bucket[self.anchor[run]]
        return run, number, list(names), least, bucket


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _cell(bucket: list[int], batch: int, payload: list[list[bytes]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([batch] * len(bucket), pa.int32()), *[pa.array(p, pa.large_binary()).cast(pa.binary()) for p in payload]], names=["bucket", "batch", *names])


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _read(table: pa.Table, threshold: int, k: int, buckets: int) -> Batch:
    return Batch(_ids(table.column("_id").combine_chunks()), table.column("_text").combine_chunks(), threshold, k, buckets)


def _chosen(b: Batch, replies: pa.Table) -> np.ndarray:
    other = {int(x): raw for x, raw in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist(), strict=True)}
    chosen = np.zeros(len(b.codes), bool)
    for bucket, own in b.cells():
        chosen[own] = _flags(other[bucket], len(own))
    return chosen


def duplicate_spans(docs: DataFrame, out, schema: str, *, threshold: int = 50, batch_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Run the three rounds over ``docs``; ``out(rows, data, at, removed)`` makes the result of a batch from its rows (a table with ``_id``, ``_text`` and the other columns, sorted by id), its bytes, where texts begin, and a flag a byte."""
    k = min(24, max(8, threshold // 2))
    if threshold < 16:
        raise ValueError("threshold must be at least 16")
    rows = docs.withColumnsRenamed({c: f"c_{c}" for c in docs.columns}).withColumns({"_id": F.col(f"c_{key}").cast("long"), "_text": F.col(f"c_{text}").cast("string")}).drop(f"c_{text}")
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = max(8, -(-total // batch_bytes))
    dealt = rows.withColumn("_batch", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(parts)).cast("int"))

    def send_anchors(key_, table):
        b = _read(table, threshold, k, parts)
        cells = list(b.cells())
        return pa.Table.from_batches([_cell([c for c, _ in cells], key_[0].as_py(), [[(b.codes[own] >> np.uint64(32)).astype(np.uint32).tobytes() for _, own in cells], [_bits(b.shared[own]) for _, own in cells]], ["codes", "own"])])

    def shared_anchors(key_, table):
        batch, raw, own = (table.column(c).to_pylist() for c in ("batch", "codes", "own"))
        codes = [np.frombuffer(x, np.uint32) for x in raw]
        every, back, count = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        many = count > 1
        ends = np.cumsum([len(c) for c in codes])
        bits = [_bits(many[back.reshape(-1)[e - len(c) : e]] | _flags(o, len(c))) for c, e, o in zip(codes, ends, own, strict=True)]
        return pa.table({"bucket": pa.array([key_[0].as_py()] * len(batch), pa.int32()), "batch": pa.array(batch, pa.int32()), "bits": pa.array(bits, pa.binary())})

    def send_runs(key_, table, replies):
        b = _read(table, threshold, k, parts)
        _, _, strings, least, bucket = b.owned(_chosen(b, replies))
        order = np.argsort(bucket, kind="stable")
        cuts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
        text_of = [b"".join(strings[i] for i in own) for own in cuts]
        sizes = [np.array([len(strings[i]) for i in own], np.uint32).tobytes() for own in cuts]
        return pa.Table.from_batches([_cell([int(bucket[own[0]]) for own in cuts], key_[0].as_py(), [text_of, sizes, [least[own].tobytes() for own in cuts]], ["strings", "sizes", "least"])])

    def repeated_windows(key_, table):
        batch, strings, sizes, least = (table.column(c).to_pylist() for c in ("batch", "strings", "sizes", "least"))
        size = np.concatenate([np.frombuffer(x, np.uint32) for x in sizes]).astype(np.int64)
        owner = np.concatenate([np.frombuffer(x, np.int64) for x in least])
        windows = size - threshold + 1
        # batches may send equal strings: each goes into the sort once, under its least id
        raw, end = b"".join(strings), np.cumsum(size)
        names: dict[bytes, int] = {}
        number = np.fromiter((names.setdefault(raw[a:b], len(names)) for a, b in zip((end - size).tolist(), end.tolist(), strict=True)), np.int64, len(size))
        own = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(own, number, owner)
        data = np.frombuffer(b"".join(names), np.uint8)
        length = np.fromiter(map(len, names), np.int64, len(names))
        inner = length - threshold + 1
        first = np.cumsum(inner) - inner
        of = np.repeat(np.arange(len(length)), inner)
        start = np.repeat(np.cumsum(length) - length - first, inner) + np.arange(inner.sum())
        live, group = sort_windows(data, start, threshold)
        least_id = own[of]
        if len(live):
            of_group = np.full(group[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(of_group, group, least_id[live])
            least_id[live] = of_group[group]
        at = np.repeat(first[number] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
        smaller = least_id[at] < np.repeat(owner, windows)
        per = [int(x) for x in np.add.reduceat(windows, np.cumsum([0, *[len(x) // 4 for x in sizes][:-1]]))]
        ends = np.cumsum(per)
        return pa.table({"bucket": pa.array([key_[0].as_py()] * len(batch), pa.int32()), "batch": pa.array(batch, pa.int32()), "seen": pa.array([_bits(smaller[e - n : e]) for e, n in zip(ends, per, strict=True)], pa.binary())})

    def cut(key_, table, replies):
        b = _read(table, threshold, k, parts)
        chosen = _chosen(b, replies.filter(replies.column("bits").is_valid()))
        run, number, strings, least, bucket = b.owned(chosen)
        removed = np.zeros(len(b.data), bool)
        if len(strings):
            answers = replies.filter(replies.column("seen").is_valid())
            seen = {int(x): raw for x, raw in zip(answers.column("bucket").to_pylist(), answers.column("seen").to_pylist(), strict=True)}
            windows = np.fromiter(map(len, strings), np.int64, len(strings)) - threshold + 1
            order = np.argsort(bucket, kind="stable")
            flags = np.zeros(windows.sum(), bool)
            place = np.cumsum(windows) - windows
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                to = np.repeat(place[own] - np.cumsum(windows[own]) + windows[own], windows[own]) + np.arange(windows[own].sum())
                flags[to] = _flags(seen[int(bucket[own[0]])], len(to))
            # a window goes if a smaller id has it than the least one of its string in this batch, or if its own id is a larger one
            count = b.windows[run]
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            gone = flags[np.repeat(place[number], count) + inner] | np.repeat(b.ids[b.doc[run]] != least[number], count)
            at = (np.repeat(b.start[run], count) + inner)[gone]
            cover = np.bincount(at, minlength=len(b.data) + 1) - np.bincount(at + threshold, minlength=len(b.data) + 1)
            removed = np.cumsum(cover[:-1]) > 0
        rows_ = table.take(pa.array(np.argsort(_ids(table.column("_id").combine_chunks()), kind="stable")))
        return out(rows_, b.data, b.at, removed)

    sent = dealt.groupBy("_batch").applyInArrow(lambda key_, table: freed(send_anchors, key_, table), "bucket int, batch int, codes binary, own binary")
    known = sent.groupBy("bucket").applyInArrow(lambda key_, table: freed(shared_anchors, key_, table), "bucket int, batch int, bits binary")
    by_batch = dealt.groupBy("_batch")
    runs = by_batch.cogroup(known.groupBy("batch")).applyInArrow(lambda key_, table, replies: freed(send_runs, key_, table, replies), "bucket int, batch int, strings binary, sizes binary, least binary")
    seen = runs.groupBy("bucket").applyInArrow(lambda key_, table: freed(repeated_windows, key_, table), "bucket int, batch int, seen binary")
    answers = known.select("bucket", "batch", "bits", F.lit(None).cast("binary").alias("seen")).unionByName(seen.select("bucket", "batch", F.lit(None).cast("binary").alias("bits"), "seen"))
    return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(lambda key_, table, replies: freed(cut, key_, table, replies), schema)


def _spans(removed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Maximal removed runs of each text."""
    head = removed.copy()
    head[1:] &= ~removed[:-1]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(removed))]
    head[edge] = removed[edge]
    total = np.concatenate([[0], np.cumsum(head)])
    return total[at[1:]] - total[at[:-1]]


def dedup_report(docs: DataFrame, *, threshold: int = 50, batch_bytes: int = 4 << 20) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def out(rows: pa.Table, data: np.ndarray, at: np.ndarray, removed: np.ndarray) -> pa.Table:
        total = np.concatenate([[0], np.cumsum(removed)])
        digest = [hashlib.sha256(data[a:b][~removed[a:b]].tobytes()).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table({"doc_id": rows.column("c_doc_id"), "n_bytes": pa.array(np.diff(at), pa.int64()), "n_removed": pa.array(total[at[1:]] - total[at[:-1]], pa.int64()), "n_spans": pa.array(_spans(removed, at), pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return duplicate_spans(docs.select("doc_id", "text"), out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", threshold=threshold, batch_bytes=batch_bytes)


def remove_repeats(docs: DataFrame, *, threshold: int = 50, batch_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with repeated stretches cut out of ``text``; all rows and columns stay.

    A cut never splits a character: bytes of a character that is only partly covered stay.  Null texts stay null.
    """
    names = docs.columns

    def out(rows: pa.Table, data: np.ndarray, at: np.ndarray, removed: np.ndarray) -> pa.Table:
        kept, size = whole_characters(data, removed), np.diff(at)
        null = rows.column("_text").is_null().to_pylist()
        texts = [None if gone else (data[a:b][~kept[a:b]] if n else data[a:b]).tobytes().decode("utf-8", "replace") for gone, a, b, n in zip(null, at[:-1].tolist(), at[1:].tolist(), size.tolist(), strict=True)]
        return pa.table([pa.array(texts, pa.string()) if c == "text" else rows.column(f"c_{c}") for c in names], names=names)

    return duplicate_spans(docs, out, docs.schema, threshold=threshold, batch_bytes=batch_bytes)


def whole_characters(data: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """``removed``, less the bytes of characters of which some byte stays."""
    if not len(data) or not removed.any():
        return removed
    char = np.cumsum((data & 0xC0) != 0x80)
    stays = np.zeros(char[-1] + 1, bool)
    stays[char[~removed]] = True
    return removed & ~stays[char]
