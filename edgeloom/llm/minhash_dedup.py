"""Near-duplicate groups of texts: fast similarity sketching, banding, exact verification.

A text's set holds its distinct word shingles.  The sketch has T coordinates.  In round
i every shingle is thrown into one of T bins with a value that grows with i; each bin
keeps its least.  After T rounds without a full sketch, T more rounds throw every shingle
into bin i - T, so every coordinate is filled, and two sketches agree in each coordinate
with a chance equal to the sets' Jaccard similarity.

Texts with equal sets form a class first, with a number of its own; only classes go on.  A
sketch is cut into ``BANDS`` bands of ``ROWS`` coordinates, and classes that share a band's
bucket are candidates:

1. Of the centres (least numbers) of its buckets, each class is checked against the
   one that its sketch is closest to.  Links found so make components.
2. In the buckets that still hold several components, the fingerprints of classes of different components
   meet.  Pairs that could reach the threshold make groups; only a spanning set of them
   leaves a task.
3. The texts of a group's classes meet, nearest fingerprints first, and a pair is checked
   unless its components have been joined meanwhile.

Every link is checked on the full sets before it counts.  Meetings are dealt by ``dealt``:
the classes of the largest component meet all others in blocks of about ``BLOCK`` and never
each other, so a bucket with most of all classes in one component sends each once, and no
table of pairs is ever made.  Texts are fetched for the classes that a step
wants, which a bitmap of bounded size picks out before the shuffle.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.  A text
with fewer words than a shingle is one shingle; a null text or one without words has
an empty set and is linked with nothing.  Rows with a null id keep their row: no
component but their own, ``component_id`` null, ``kept`` true.  An id with several texts is linked by
each of them; each of its rows has the set size of its own text and the id's component.  Whole
texts are read, a text at a time; other columns aren't, so their names may clash with any.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.components import components
from edgeloom.llm.shared import Forest, groups_of, lean, materialize, mix64, partners, slices, spread_join

BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
SALTS = 64
#: Classes of a block whose fingerprints meet, and whose texts do; pairs that a task looks at together.
BLOCK, TEXT_BLOCK, PAIRS = 4096, 256, 1 << 18
#: Bits of the bitmap of wanted ids, which bounds its broadcast: 2^19 rows of 64.
BITMAP = 25
#: Longs of a fingerprint: one bit a coordinate, twice.
PRINTS = 2 * COORDINATES // 64


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < n:
        return np.array([digest(b"\0".join([b"short", *words]))], np.uint64)
    word = np.fromiter(map(digest, words), np.uint64, len(words))
    out = word[: len(word) - n + 1].copy()
    for i in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word[i : len(word) - n + 1 + i])
    return np.unique(out)


def sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """The sketches of non-empty sets, one row each."""
    size = np.array([len(s) for s in sets])
    item = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    best = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * t):
        h = mix64(item ^ np.uint64((i + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        bin_ = (h % np.uint64(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        # the round stands in the upper bits, so a later round never replaces an earlier one
        value = (np.uint64(i) << np.uint64(54)) | (mix64(h) >> np.uint64(10))
        np.minimum.at(best, owner * t + bin_, value)
        open_ = (best.reshape(-1, t) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        if not open_.all():
            keep = open_[owner]
            item, owner = item[keep], owner[keep]
    return best.reshape(-1, t)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the band's number is hashed in."""
    n = len(sketches)
    parts = sketches.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.astype(np.int64)


def fingerprints(sketches: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, as longs."""
    h = mix64(sketches)
    bits = np.concatenate([h & np.uint64(1), h >> np.uint64(1) & np.uint64(1)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def far_bits(threshold: float, sigmas: float = 4.5) -> int:
    """Differing coordinates (of their two bits) from which two sets almost surely stay under the threshold."""
    p = (1 - threshold) * 0.75
    return math.ceil(COORDINATES * p + sigmas * math.sqrt(COORDINATES * p * (1 - p)))


def distance(a: str, b: str):
    """Coordinates whose two fingerprint bits differ, of columns ``a`` and ``b``."""
    half = PRINTS // 2
    out = F.lit(0)
    for i in range(half):
        first = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        second = F.col(a)[i + half].bitwiseXOR(F.col(b)[i + half])
        out = out + F.bit_count(first.bitwiseOR(second))
    return out


def halves(digest: int) -> tuple[int, int]:
    """A 128-bit number as two longs."""
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def sketched(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """Per row: ``id``, size ``n``, digest ``p, q`` of the set and ``tp, tq`` of the text, band keys and prints; the text isn't carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = part.column("text").to_pylist()
                sets = [shingles(t, n) for t in texts]
                named = part.column("id").is_valid().to_pylist()
                full = [i for i, s in enumerate(sets) if len(s) and named[i]]
                keys: list = [None] * len(sets)
                prints: list = [None] * len(sets)
                digests: list = [(None, None, None, None)] * len(sets)
                if full:
                    sk = sketch([sets[i] for i in full])
                    for i, k, p in zip(full, band_keys(sk), fingerprints(sk), strict=True):
                        keys[i], prints[i] = k, p
                        digests[i] = (*halves(xxhash.xxh3_128_intdigest(sets[i].tobytes())), *halves(xxhash.xxh3_128_intdigest(texts[i].encode())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[c] for d in digests], pa.int64()) for c in range(4)), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.list_(pa.int64()))],
                    names=["id", "n", "p", "q", "tp", "tq", "keys", "prints"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"id {kind}, n long, p long, q long, tp long, tq long, keys array<long>, prints array<long>")


def _bit(column: str):
    """Where an id stands in the bitmap: the number of its word, and its bit there."""
    at = F.xxhash64(column).bitwiseAND(F.lit((1 << BITMAP) - 1))
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def _marked(rows: DataFrame, column: str, wanted: DataFrame, other: str) -> DataFrame:
    """The ``rows`` whose ``column`` may be among ``wanted``'s ``other``: a bitmap of at most 2^(``BITMAP`` - 6) rows is broadcast; it drops no wanted row."""
    (word, bit), (at, mark) = _bit(column), _bit(other)
    bitmap = wanted.select(at.alias("_word"), mark.alias("_mark")).groupBy("_word").agg(F.bit_or("_mark").alias("_bits"))
    return rows.join(F.broadcast(bitmap), (word == F.col("_word")) & (bit.bitwiseAND(F.col("_bits")) != 0)).drop("_word", "_bits")


def texts_of(wanted: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``node`` and compressed text ``z`` of each row of ``wanted`` (``node, id, tp, tq``).

    A bitmap of the wanted ids, of at most 2^(``BITMAP`` - 6) rows, is broadcast and drops most other
    texts before the shuffle; the join by id and text digest decides.  Equal rows of a batch are sent once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "text"):
                found: dict = {}
                for i, (name, t) in enumerate(zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True)):
                    raw = t.encode()
                    mark = halves(xxhash.xxh3_128_intdigest(raw))
                    if (name, mark) not in found:
                        found[name, mark] = (i, press.compress(raw))
                at = [i for i, _ in found.values()]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())), pa.array([m[0] for _, m in found], pa.int64()), pa.array([m[1] for _, m in found], pa.int64()), pa.array([z for _, z in found.values()], pa.binary())], names=["i", "mp", "mq", "z"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null and text is not null")
    rows = _marked(rows, "id", wanted, "id").select("id", "text")
    packed = rows.mapInArrow(lean(run), f"i {kind}, mp long, mq long, z binary")
    return packed.join(wanted, (F.col("i") == F.col("id")) & (F.col("mp") == F.col("tp")) & (F.col("mq") == F.col("tq"))).select("node", "z")


def verified(pairs: DataFrame, lead: DataFrame, docs: DataFrame, n: int, threshold: float, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold, as pairs of their ``rep``; ``pairs`` are distinct.

    A centre a meets its partners in ``SALTS`` parts, by a hash of the partner; a part has one
    copy of the centre's text.  Parts are streamed: first the centre's set, then its
    partners one by one.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    roles = salted.select(F.col("b").alias("w"), "a", "salt", F.lit(1).alias("role")).unionByName(salted.select("a", "salt").distinct().select(F.col("a").alias("w"), "a", "salt", F.lit(0).alias("role")))
    roles = materialize(roles, "roles")
    own = lead.select("node", "rep", "id", "tp", "tq")
    wanted = materialize(roles.select("w").distinct().join(own, F.col("w") == F.col("node")).drop("w"), "wanted")
    texts = texts_of(wanted.drop("rep"), docs, key, text)
    rows = texts.join(roles.join(wanted.select(F.col("node").alias("x"), "rep"), F.col("w") == F.col("x")).drop("x"), texts["node"] == F.col("w")).select("a", "salt", "role", "rep", "z")
    kind = lead.schema["rep"].dataType.simpleString()
    hundredths = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        centre, name, own = None, None, None
        for batch in batches:
            links: list[tuple] = []
            for a, role, rep, z in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "rep", "z")), strict=True):
                s = shingles(open_.decompress(z).decode(), n)
                if role == 0:
                    centre, name, own = a, rep, s
                elif centre == a and len(s) and len(own):
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * common >= hundredths * (len(own) + len(s) - common):
                        links.append((name, rep))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], batch.schema.field("rep").type), pa.array([y for _, y in links], batch.schema.field("rep").type)], names=["a", "b"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").select("a", "role", "rep", "z").mapInArrow(lean(run), f"a {kind}, b {kind}")


def dealt(rows: DataFrame, total: int, block: int) -> DataFrame:
    """The meetings of the classes ``rows`` (group ``g``, ``node``, component ``c``): ``node, c, g, part, i, j, second``.

    A group with one component has none.  Part 0: the blocks of the largest component meet those of the
    others.  Part 1: the blocks of the others meet each other and themselves.
    """
    sizes = rows.groupBy("g", "c").agg(F.count("*").alias("m")).groupBy("g").agg(F.sum("m").alias("n"), F.max(F.struct("m", "c")).alias("top"))
    sizes = sizes.filter("n > top.m").select("g", "n", F.col("top.c").alias("main"), F.ceil(F.col("top.m") / block).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("top.m")) / block).cast("int").alias("others"))
    sizes = materialize(sizes, "sizes")
    inside = spread_join(_marked(rows, "g", sizes, "g"), sizes, ["g"], "node", total)
    inside = inside.withColumn("second", F.col("c") != F.col("main"))
    inside = inside.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("second"), F.col("others")).otherwise(F.col("mains"))).cast("int"))
    across = inside.withColumn("s", F.explode(F.sequence(F.lit(0), F.when(F.col("second"), F.col("mains")).otherwise(F.col("others")) - 1)))
    across = across.select("node", "c", "g", F.lit(0).alias("part"), F.when(F.col("second"), F.col("s")).otherwise(F.col("own")).alias("i"), F.when(F.col("second"), F.col("own")).otherwise(F.col("s")).alias("j"), "second")
    among = inside.filter("second").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    among = among.select("node", "c", "g", F.lit(1).alias("part"), F.least("own", "s").alias("i"), F.greatest("own", "s").alias("j"), (F.col("own") == F.greatest("own", "s")).alias("second"))
    return across.unionByName(among)


MEETING = ["g", "part", "i", "j"]


def met(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over tables of whole meetings."""
    return rows.repartition(*MEETING).sortWithinPartitions(*MEETING, "second").mapInArrow(lean(lambda batches: (out for t in groups_of(batches, MEETING) for out in run(t))), schema)


def near_pairs(t: pa.Table, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (a, b) and distance of the meetings' pairs of different components whose fingerprints may be of similar sets."""
    get = {c: t.column(c).to_numpy() for c in (*MEETING, "second")}
    change = np.zeros(t.num_rows - 1, bool)
    for c in MEETING:
        change |= np.diff(get[c]) != 0
    group = np.concatenate([[0], np.cumsum(change)])
    comp = t.column("c").combine_chunks().dictionary_encode().indices.to_numpy()
    bits = t.column("prints").combine_chunks().flatten().to_numpy().reshape(-1, PRINTS).view(np.uint64)
    alone = (get["part"] == 1) & (get["i"] == get["j"])
    half, ones, twos, fars = PRINTS // 2, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in partners(group, alone, get["second"], PAIRS):
        apart = comp[a] != comp[b]
        a, b = a[apart], b[apart]
        far = np.zeros(len(a), np.int64)
        for k in range(half):
            far += np.bitwise_count((bits[a, k] ^ bits[b, k]) | (bits[a, k + half] ^ bits[b, k + half]))
        good = far < limit
        ones.append(a[good])
        twos.append(b[good])
        fars.append(far[good])
    return np.concatenate(ones), np.concatenate(twos), np.concatenate(fars)


def close_pairs(meetings: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes that span all pairs of the meetings whose fingerprints may be of similar sets."""
    limit = far_bits(threshold)

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, _ = near_pairs(t, limit)
        node, place = np.unique(t.column("node").to_numpy(), return_inverse=True)
        forest = Forest(len(node))
        keep = [k for k, (x, y) in enumerate(zip(place[a].tolist(), place[b].tolist(), strict=True)) if forest.join(x, y)]
        yield pa.RecordBatch.from_arrays([pa.array(node[place[a[keep]]]), pa.array(node[place[b[keep]]])], names=["a", "b"])

    return met(meetings, run, "a long, b long")


def cross_links(meetings: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links (a, b) of components, enough of them to join all that the meetings' texts ``z`` link."""
    kind = meetings.schema["c"].dataType.simpleString()
    limit, hundredths = far_bits(threshold), round(threshold * 100)

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        a, b, far = near_pairs(t, limit)
        order = np.argsort(far, kind="stable")
        names = t.column("c").combine_chunks().dictionary_encode()
        comp, forest = names.indices.to_numpy(), Forest(len(names.dictionary))
        node, z = t.column("node").to_numpy(), t.column("z")
        sets: dict[int, np.ndarray] = {}
        links = []
        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            if forest.root(comp[x]) == forest.root(comp[y]):
                continue
            for d in (x, y):
                if node[d] not in sets:
                    sets[node[d]] = shingles(open_.decompress(z[d].as_py()).decode(), n)
            one, two = sets[node[x]], sets[node[y]]
            common = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * common >= hundredths * (len(one) + len(two) - common):
                forest.join(comp[x], comp[y])
                links.append((comp[x], comp[y]))
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array([x for x, _ in links], pa.int32())), names.dictionary.take(pa.array([y for _, y in links], pa.int32()))], names=["a", "b"])

    return met(meetings, run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` of each row of ``docs``."""
    rows = materialize(sketched(docs, n, key, text), "sketches")
    usable = rows.filter("p is not null")
    one = F.first(F.struct("id", "tp", "tq", "keys", "prints")).alias("s")
    lead = usable.groupBy("p", "q").agg(F.min("id").alias("rep"), F.count("*").alias("n"), one)
    lead = materialize(lead.select("p", "q", "rep", "n", "s.*").withColumn("node", F.monotonically_increasing_id()), "lead")
    prints = lead.select(F.col("node").alias("x"), "rep", "prints")

    bands = lead.select("node", F.explode("keys").alias("k"))
    buckets = bands.groupBy("k").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    buckets = materialize(buckets.join(lead.select(F.col("node").alias("x"), F.col("prints").alias("middle")), F.col("centre") == F.col("x")).drop("x"), "buckets")
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shared = spread_join(bands, buckets, ["k"], "node", total).select("node", "k", "centre", "middle")
    shared = shared.join(prints, F.col("node") == F.col("x")).select("node", "k", "centre", "rep", distance("middle", "prints").alias("far"))
    shared = materialize(shared, "shared")

    nearest = shared.filter((F.col("node") != F.col("centre")) & (F.col("far") < far_bits(threshold))).groupBy("node").agg(F.min(F.struct("far", "centre")).alias("s"))
    links = verified(nearest.select(F.col("s.centre").alias("a"), F.col("node").alias("b")), lead, docs, n, threshold, key, text)
    several = _several(rows)
    if several is not None:  # each class of an id with several texts holds the id
        links = links.unionByName(usable.join(several, F.col("id") == F.col("i")).join(lead.select("p", "q", "rep"), ["p", "q"]).select(F.col("rep").alias("a"), F.col("id").alias("b")))
    first = materialize(components(links), "components").withColumnsRenamed({"id": "i", "component_id": "c"})

    placed = shared.join(first, F.col("rep") == F.col("i"), "left").select(F.col("k").alias("g"), "node", F.coalesce("c", "rep").alias("c"))
    meetings = dealt(placed, total, BLOCK).join(prints.drop("rep"), F.col("node") == F.col("x")).drop("x")
    group = materialize(components(close_pairs(meetings, threshold)), "open").withColumnsRenamed({"id": "x", "component_id": "g"})
    inside = group.join(lead.select("node", "rep", "id", "tp", "tq", "prints"), F.col("x") == F.col("node")).join(first, F.col("rep") == F.col("i"), "left")
    inside = materialize(inside.select("g", "node", F.coalesce("c", "rep").alias("c"), "id", "tp", "tq", "prints"), "inside")
    texts = texts_of(inside.select("node", "id", "tp", "tq"), docs, key, text).withColumnRenamed("node", "t")
    full = inside.select(F.col("node").alias("x"), "prints").join(texts, F.col("x") == F.col("t")).drop("t")
    again = cross_links(dealt(inside.select("g", "node", "c"), inside.count(), TEXT_BLOCK).join(full, F.col("node") == F.col("x")).drop("x"), n, threshold)
    # the second round joins components: only they, not their members, are linked again
    second = components(again).withColumnsRenamed({"id": "i2", "component_id": "c2"})
    state = lead.select("p", "q", "n", "rep").join(first, F.col("rep") == F.col("i"), "left").withColumn("c", F.coalesce("c", "rep"))
    state = state.join(second, F.col("c") == F.col("i2"), "left").select("p", "q", "n", F.coalesce("c2", "c").alias("c"))
    out = spread_join(usable.select("id", F.col("n").alias("size"), "p", "q"), state, ["p", "q"], "id", rows.count()).select("id", "size", "c")
    out = out.unionByName(rows.filter("p is null").select("id", F.col("n").alias("size"), F.col("id").alias("c")))
    if several is not None:
        least = out.join(several, F.col("id") == F.col("i")).groupBy("i").agg(F.min("c").alias("own"))
        out = out.join(least, F.col("id") == F.col("i"), "left").select("id", "size", F.coalesce("own", "c").alias("c"))
    return out.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"))


def _several(rows: DataFrame) -> DataFrame | None:
    """The ids ``i`` whose rows differ in their sets, if there are any that have a set at all."""
    ids = rows.filter("id is not null").groupBy("id").agg(*(f(c).alias(f"{c}_{f.__name__}") for c in ("p", "q") for f in (F.min, F.max)), F.max(F.col("p").isNull()).alias("bad"))
    found = materialize(ids.filter("p_min is not null and (bad or p_min <> p_max or q_min <> q_max)").select(F.col("id").alias("i")), "several")
    return found if found.head(1) else None


def keep_one(docs: DataFrame, *, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text is kept: one of each group of near duplicates, with all their columns.

    Rows with a null id stay; of a repeated id that is kept, all rows stay.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), n=n, threshold=threshold).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_gone"], "left_anti")
