"""Near-duplicate groups of vectors: random-hyperplane sign hashing, exact cosine, components.

Each table has random hyperplanes; the signs of a vector's products with them are its code.
Vectors of one label and length that share a code in some table are candidates, and a
candidate counts as a link only if its cosine in double precision reaches the threshold.
Codes grow with the logarithm of the number of vectors, so that a bucket holds few chance
neighbours at any size, and the number of tables follows from them: a pair at the
threshold shares no code with chance ``MISS`` (20 bits and 32 tables for 50,000 vectors at 0.98).

Equal vectors of a label form a class first, with a number of its own, and only classes
are paired.  Only buckets that hold two classes or more go on.  A bucket is dealt into
blocks of about ``BLOCK`` classes, pairs of blocks meet in tasks, and a pair is judged in the
first table in which its codes agree.  What leaves a task is a sum of linked members for
each class and a spanning set of the links, not a row for each pair.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; neither do rows with a null label or id.  Vectors of different lengths link with
nothing.  An id that has several vectors or labels is linked by each of them: its links
are counted over all its classes, another id once, and all of it is one node of
the components; each of its rows gets the id's result.  A row with a null id has no links, a null
``component_id``, and is kept.  Columns other than the three that are named are not read, so
their names may clash with any; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.components import components
from edgeloom.llm.shared import Forest, groups_of, materialize, partners, spread_join

MISS = 5e-5
#: Classes of a block, and pairs that a task looks at together.
BLOCK, PAIRS = 256, 1 << 18
SEED = 20


def shape(rows: int, threshold: float) -> tuple[int, int]:
    """Tables, and bits of a code, for ``rows`` vectors."""
    bits = min(31, max(12, math.ceil(math.log2(max(2, rows))) + 4))
    agree = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return (1 if agree >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-agree))), bits


def planes(dimension: int, tables: int, bits: int) -> np.ndarray:
    """Normals of all tables' hyperplanes, one a row."""
    return np.random.default_rng([SEED, dimension]).standard_normal((tables * bits, dimension))


def units(x: np.ndarray) -> np.ndarray:
    """The unit vectors of finite, non-zero rows, in double precision."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def sign_codes(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """A code for each vector and table."""
    signs = (vectors @ planes(vectors.shape[1], tables, bits).T > 0).reshape(len(vectors), tables, bits)
    return (signs @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)


def coded(vectors: DataFrame, tables: int, bits: int) -> DataFrame:
    """``id, label, v``, the codes and the digest ``p, q`` of the unit vector; digest and codes of a row that can't link are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("v").to_pylist()
            named = [i.is_valid and x.is_valid for i, x in zip(batch.column("id"), batch.column("label"), strict=True)]
            codes: list = [None] * len(raw)
            p: list = [None] * len(raw)
            q: list = [None] * len(raw)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                if named[i] and v and None not in v:
                    by_size.setdefault(len(v), []).append(i)
            for rows in by_size.values():
                x = np.array([raw[i] for i in rows], dtype=np.float64)
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                u = units(x[good])
                for i, c, w in zip(np.array(rows)[good].tolist(), sign_codes(u, tables, bits), u, strict=True):
                    h = xxhash.xxh3_128_intdigest(w.tobytes())
                    codes[i], p[i], q[i] = c, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "v")), pa.array(codes, pa.list_(pa.int32())), pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["id", "label", "v", "codes", "p", "q"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, v {kinds['v']}, codes array<int>, p long, q long")


def judged(dealt: DataFrame, kind: str, threshold: float) -> DataFrame:
    """What a bucket's pairs of blocks have found.

    Rows with ``n``: class ``x`` is linked to that many members of other classes; with ``a, b``:
    links that span all others of the task; with ``x, y``: a link, both ways, of which a side is marked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, ["bucket", "i", "j"]):
            get = {c: t.column(c).to_numpy() for c in ("bucket", "i", "j", "own", "node", "w", "mark", "place")}
            new = np.concatenate([[0], np.cumsum((np.diff(get["bucket"]) != 0) | (np.diff(get["i"]) != 0) | (np.diff(get["j"]) != 0))])
            codes = np.stack(t.column("codes").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1), axis=1)
            v = t.column("v").combine_chunks()
            at, flat = v.offsets.to_numpy() - v.offsets[0].as_py(), v.flatten().to_numpy().astype(np.float64)
            size = np.diff(at)
            unit: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            row = np.zeros(t.num_rows, np.int64)
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                row[own] = np.arange(len(own))
                unit[d] = units(flat[at[own][:, None] + np.arange(d)])
            ones, twos = [], []
            for a, b in partners(new, get["i"] == get["j"], get["own"] == get["j"], PAIRS):
                fresh = np.ones(len(a), bool)
                for s in range(len(codes)):
                    here = np.flatnonzero(fresh & (get["place"][a] > s))
                    fresh[here[codes[s][a[here]] == codes[s][b[here]]]] = False
                a, b = a[fresh], b[fresh]
                for d, u in unit.items():
                    mine = size[a] == d
                    x, y = a[mine], b[mine]
                    good = np.einsum("ij,ij->i", u[row[x]], u[row[y]]) >= threshold
                    ones.append(x[good])
                    twos.append(y[good])
            if not ones:
                continue
            x, y = np.concatenate(ones), np.concatenate(twos)
            node, place = np.unique(get["node"], return_inverse=True)
            sums = np.bincount(place[x], weights=get["w"][y], minlength=len(node)) + np.bincount(place[y], weights=get["w"][x], minlength=len(node))
            forest = Forest(len(node))
            keep = [k for k, (one, two) in enumerate(zip(place[x].tolist(), place[y].tolist(), strict=True)) if forest.join(one, two)]
            rep = t.column("rep").combine_chunks()
            marked = np.flatnonzero(get["mark"][x] | get["mark"][y])
            some = np.flatnonzero(sums)
            yield table(rep.type, x=node[some], n=sums[some].astype(np.int64))
            yield table(rep.type, a=rep.take(pa.array(x[keep])), b=rep.take(pa.array(y[keep])))
            yield table(rep.type, x=np.concatenate([get["node"][x[marked]], get["node"][y[marked]]]), y=np.concatenate([get["node"][y[marked]], get["node"][x[marked]]]))

    return dealt.mapInArrow(run, f"a {kind}, b {kind}, x long, y long, n long")


def table(kind: pa.DataType, **columns) -> pa.RecordBatch:
    """A batch of ``judged``'s rows; the columns that aren't given are null."""
    size = len(next(iter(columns.values())))
    kinds = {"a": kind, "b": kind, "x": pa.int64(), "y": pa.int64(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()], names=list(kinds))


def links(lead: DataFrame, threshold: float) -> DataFrame:
    """The links of the classes ``lead``, as ``judged`` gives them."""
    kind = lead.schema["rep"].dataType.simpleString()
    where = lead.select("node", "label", F.size("v").alias("d"), F.posexplode("codes").alias("place", "code"))
    key = ["label", "d", "place", "code"]
    buckets = where.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("bucket", F.monotonically_increasing_id()).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    buckets = materialize(buckets, "buckets")
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    inside = spread_join(where, buckets, key, "node", total).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumnRenamed("node", "k")
    full = inside.select("k", "bucket", "place", "own", "blocks").join(lead.select("node", "rep", "w", "mark", "codes", "v"), F.col("k") == F.col("node"))
    dealt = full.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("own", "s").alias("i"), F.greatest("own", "s").alias("j"), "own", "node", "place", "rep", "w", "mark", "codes", "v")
    order = ["bucket", "i", "j"]
    return judged(dealt.repartition(*order).sortWithinPartitions(*order, "own"), kind, threshold)


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, n_links, component_id, kept`` of each row of ``vectors``."""
    source = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    total = source.count()
    rows = materialize(coded(source, *shape(total, threshold)), "coded")
    usable = rows.filter("p is not null")
    # an id is of several classes if its rows differ in label or digest, or if some can't link
    parts = ["label", "p", "q"]
    ids = rows.filter("id is not null").groupBy("id").agg(*(f(c).alias(f"{c}_{f.__name__}") for c in parts for f in (F.min, F.max)), F.max(F.col("p").isNull()).alias("bad"))
    several = ids.filter(" or ".join(["bad", *(f"{c}_min <> {c}_max" for c in parts)])).filter("p_min is not null").select(F.col("id").alias("i"))
    several = materialize(several, "several")
    repeats = bool(several.head(1))
    single = ids.filter(" and ".join(["not bad", *(f"{c}_min = {c}_max" for c in parts)])).select("id", *(F.col(f"{c}_min").alias(c) for c in parts))
    members = single.withColumn("solo", F.lit(1))
    if repeats:
        shared = materialize(usable.join(several, F.col("id") == F.col("i")).select("id", *parts).distinct(), "shared")
        members = members.unionByName(shared.withColumn("solo", F.lit(0)))
    stats = members.groupBy(*parts).agg(F.min("id").alias("rep"), F.sum("solo").alias("w"), (F.min("solo") == 0).alias("mark"))
    lead = usable.groupBy(*parts).agg(F.first(F.struct("codes", "v")).alias("s"), F.count("*").alias("rows")).join(stats, parts)
    lead = materialize(lead.select(*parts, F.monotonically_increasing_id().alias("node"), "rep", "w", "mark", "s.codes", "s.v", "rows"), "lead")
    found = materialize(links(lead, threshold), "found")

    tie = found.filter("a is not null").select("a", "b")
    if repeats:
        shared = shared.join(lead.select(*parts, "node", "rep", "w"), parts).select("id", "node", "rep", "w")
        shared = materialize(shared, "shared-classes")
        tie = tie.unionByName(shared.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    group = components(tie).withColumnsRenamed({"id": "g", "component_id": "c"})
    near = found.filter("n is not null").groupBy("x").agg(F.sum("n").alias("others"))
    state = lead.select(*parts, F.col("rows").alias("n"), "node", "rep", "w").join(near, F.col("node") == F.col("x"), "left").drop("x")
    state = state.withColumn("links", F.col("w") - 1 + F.coalesce("others", F.lit(0)))
    if repeats:
        state, own = _with_repeats(state, found, shared)
    state = state.join(group, F.col("rep") == F.col("g"), "left").select(*parts, "n", "links", F.coalesce("c", "rep").alias("c"))
    out = spread_join(usable.select("id", *parts), state, parts, "id", total).select("id", "links", "c")
    out = out.unionByName(rows.filter("p is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("c")))
    if repeats:
        again = own.join(group, F.col("i") == F.col("g"), "left").select("i", "own", F.coalesce("c", "i").alias("oc"))
        out = out.join(again, F.col("id") == F.col("i"), "left").select("id", F.coalesce("own", "links").alias("links"), F.coalesce("oc", "c").alias("c"))
    return out.select(F.col("id").alias(key), F.col("links").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"))


def _with_repeats(state: DataFrame, found: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``state`` with the links to ids of several classes added, each such id once; and the links of those ids themselves.

    ``w`` counts a class's ids of one class only; ``found`` has every link of a class that holds others.
    """
    pairs = found.filter("y is not null").select("x", "y").unionByName(shared.select(F.col("node").alias("x"), F.col("node").alias("y"))).distinct()
    there = shared.select(F.col("node").alias("y"), F.col("id").alias("j"))
    more = pairs.join(there, "y").groupBy("x").agg(F.countDistinct("j").alias("more"))
    state = state.join(more, F.col("node") == F.col("x"), "left").drop("x").withColumn("links", F.col("links") + F.coalesce("more", F.lit(0)))
    reached = shared.select(F.col("id").alias("i"), F.col("node").alias("x")).join(pairs, "x").select("i", "y").distinct()
    weight = state.select(F.col("node").alias("y"), "w")
    solo = reached.join(weight, "y").groupBy("i").agg(F.sum("w").alias("solo"))
    several = reached.join(there, "y").filter("i <> j").groupBy("i").agg(F.countDistinct("j").alias("several"))
    own = solo.join(several, "i", "left").select("i", (F.col("solo") + F.coalesce("several", F.lit(0))).cast("long").alias("own"))
    return state, own
