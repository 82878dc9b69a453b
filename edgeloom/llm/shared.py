"""Helpers shared by the training-data operators.

Intermediate results that several plans read are written as Parquet under
``spark.checkpoint.dir``, the folder that driver and executors share, so that a
lost executor costs a re-read and not a recomputation of its whole lineage.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.plans.storage import discard, new_path  # noqa: F401
from edgeloom.plans.storage import written as materialize  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give memory that is free inside this process back to the system: a worker is used again, and keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for ``mapInArrow``, with memory trimmed when a part ends."""

    def held(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return held


def freed(f: Callable, *args):
    """``f(*args)`` with memory trimmed when it has returned."""
    try:
        return f(*args)
    finally:
        trim()


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Consecutive slices of a batch whose texts hold about ``limit`` bytes."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(size, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each text begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    else:
        texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over an array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], by: str, total: int, how: str = "inner", hubs: int = 256, salts: int = 64) -> DataFrame:
    """``rows`` joined to ``groups``, which has one row a key with the key's number of rows ``n``.

    A key with more than one in ``hubs`` of the ``total`` rows is hot.  There are few of
    those, so they are broadcast; a hot key's rows are dealt over ``salts`` keys by a hash
    of column ``by``, and its group is copied to each.  No row has a null key.
    """
    hot = max(64, total // hubs)
    rest = [c for c in groups.columns if c not in on]
    names = {c: f"_g_{c}" for c in on}
    marks = F.broadcast(groups.filter(F.col("n") >= hot).select(*(F.col(c).alias(f"_h_{c}") for c in on), F.struct(*rest).alias("_mark")))
    dealt = rows.join(marks, [F.col(c) == F.col(f"_h_{c}") for c in on], "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_mark").isNotNull(), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_mark", *(f"_h_{c}" for c in on))
    copies = groups.withColumnsRenamed(names).withColumn("_own", F.explode(F.sequence(F.lit(0), F.when(F.col("n") >= hot, F.lit(salts - 1)).otherwise(F.lit(0)))))
    return dealt.join(copies, [*(F.col(c) == F.col(f"_g_{c}") for c in on), F.col("_salt") == F.col("_own")], how).drop("_salt", "_own", *names.values())


def fold(doc_id: str, n: int):
    """crc32 of doc_id as text, modulo n; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def thinned(key: str | list[str], total: int, bound: int):
    """A condition that keeps about ``bound`` of ``total`` rows, chosen by a hash of ``key`` (one column or several)."""
    if total <= bound:
        return F.lit(True)
    return share_of(key) < F.lit(bound / total)


def share_of(key: str | list[str]):
    """A number in [0, 1) made of a hash of ``key``."""
    return F.xxhash64(*[F.col(k) for k in ([key] if isinstance(key, str) else key)]).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches that are sorted by ``keys`` (longs); a group that a batch's end cuts is carried over."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        if not now.num_rows:
            continue
        last = np.ones(now.num_rows, bool)
        for k in keys:
            column = now.column(k).to_numpy()
            last &= column == column[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield now.slice(0, cut).combine_chunks()
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def partners(group: np.ndarray, alone: np.ndarray, second: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs that a group has to look at, about ``limit`` at a time; ``group`` rises.

    In a group that is ``alone`` these are all its pairs; in any other the pairs of a row that
    isn't ``second`` with one that is, which stand behind.
    """
    n = len(group)
    end = np.searchsorted(group, group, side="right")
    place = np.arange(n)
    behind = np.searchsorted(2 * group + (second & ~alone), 2 * group + 1)
    begin = np.where(alone, place + 1, np.where(second, end, behind))
    count = np.maximum(0, end - begin)
    total = np.cumsum(count)
    a = 0
    while a < n:
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + limit)))
        each = count[a:b]
        if each.sum():
            left = np.repeat(place[a:b], each)
            yield left, np.repeat(begin[a:b], each) + np.arange(len(left)) - np.repeat(total[a:b] - each - before, each)
        a = b


class Forest:
    """Disjoint sets of 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """Have the two been apart until now?"""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b
