"""WARC archives as a Python data source, to read and to write.

Reading.  ``spark.read.format("warc").load(path)`` plans partitions of about
``split_bytes`` over the files under ``path``.  Filters on the header columns
(``record_id, record_type, target_uri, date, payload_digest, refers_to``) are pushed down
(Spark asks for them if ``spark.sql.python.filterPushdown.enabled`` is true).  Of each
record only its headers are parsed at first; a record that fails a pushed filter is
skipped without its payload being inflated or read.  ``option("payload", "false")`` skips
all payloads.

Writing.  ``df.write.format("warc").mode("append").save(path)`` writes one ``.warc.gz`` file a task, a gzip member
a record, each with the ``sl`` (skip length) extra field, by which a reader hops over a
member.  Each commit adds a manifest of its own, moved into place when it is whole, with its files and the places of a
member every ``MARK`` bytes; there partitions begin, so no reader has to look for a member.
Files of failed attempts are in no manifest and so never read.

Other files are read too, a file a partition: plain ``.warc``, and gzip files with or without skip
lengths.  Members are only ever found by the end of the one before, so an archive inside a
payload is not taken for records.  Paths go through ``pyarrow.fs`` (local folders, HDFS, object stores).

Null cells are left-out headers; a null payload is an empty one.  A record of type
``revisit`` is written without its payload; the HTTP header keeps the payload's length.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from edgeloom.llm.shared import materialize, new_path

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, payload binary"
# Header names of the WARC format.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip header with one extra field, ``sl`` of 8 bytes; two 32-bit lengths follow.
MEMBER = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0"
FIRST_BYTES = 8 << 10
#: Bytes that a step of inflating a record's headers gives at most.
STEP = 1 << 10
BLANK = b"\r\n\r\n"
UNKNOWN = 0xFFFFFFFF
#: Bytes between two members of a file whose places the manifest keeps.
MARK = 1 << 20


# ---------------------------------------------------------------- records


def encode_record(row: dict) -> bytes:
    """A record's bytes: WARC headers, HTTP headers, payload."""
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "response"
    length = row.get("payload_length")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length)
    block = http + (b"" if kind == "revisit" else payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    for column, name in HEADERS.items():
        value = row.get(column)
        if column == "record_type" or value is None:
            continue
        value = quote(value, safe="".join(map(chr, range(33, 127)))) if column == "target_uri" else value.replace("\r", " ").replace("\n", " ")
        lines.append(f"{name}: {f'<{value}>' if column in ('record_id', 'refers_to') else value}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(raw) + press.flush()
    total = len(MEMBER) + 8 + len(body) + 8
    lengths = struct.pack("<II", min(total, UNKNOWN), min(len(raw), UNKNOWN))
    return MEMBER + lengths + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    """The named fields of a header block, names in lower case; broken lines continue the one before."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def header_columns(fields: dict[str, str]) -> dict[str, str | None]:
    out = {c: fields.get(name.lower()) for c, name in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if out[c] is not None:
            out[c] = out[c].removeprefix("<").removesuffix(">")
    return out


def payload_of(fields: dict[str, str], block: bytes) -> tuple[int, bytes]:
    """Length and bytes of the payload: what follows the HTTP headers, or the whole block if it has none."""
    if fields.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        stated = parse_headers(head).get("content-length", "")
        return (int(stated) if stated.isdigit() else len(body)), body
    return len(block), block


# ---------------------------------------------------------------- reading


class Bytes:
    """A file that is read in larger pieces, or a stretch of it."""

    def __init__(self, file, piece: int = 1 << 20):
        self.file, self.size, self.piece = file, file.size(), piece
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, bytes(self.file.read_at(min(max(n, self.piece), self.size - at), at))
        return self.held[at - self.at : at - self.at + n]


class Held:
    """Bytes in memory, read like a file."""

    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]


class Opening:
    """The beginning of a member's content, inflated in small steps as far as it is asked for."""

    def __init__(self, file: Bytes, at: int):
        self.file, self.at, self.rest, self.held = file, at, b"", b""
        self.open_ = zlib.decompressobj(-15)

    def more(self) -> bool:
        if self.open_.eof:
            return False
        if not self.rest:
            self.rest = self.file.read(self.at, FIRST_BYTES)
            self.at += len(self.rest)
            if not self.rest:
                return False
        self.held += self.open_.decompress(self.rest, STEP)
        self.rest = self.open_.unconsumed_tail
        return True

    def blank(self, start: int, end: int | None = None) -> int:
        """Where the first blank line from ``start`` on ends, or where the content or ``end`` does."""
        seen = start
        while (i := self.held.find(BLANK, seen, end)) < 0:
            seen = max(start, len(self.held) - len(BLANK) + 1)
            if (end is not None and len(self.held) >= end) or not self.more():
                return len(self.held) if end is None else min(end, len(self.held))
        return i + len(BLANK)

    def payload_length(self, fields: dict[str, str], begin: int) -> int:
        """What ``payload_of`` would say of the block that begins there, from its headers alone."""
        size = int(fields.get("content-length", 0))
        if not fields.get("content-type", "").startswith("application/http"):
            return size
        end = self.blank(begin, begin + size)
        stated = parse_headers(self.held[begin:end].removesuffix(BLANK)).get("content-length", "")
        return int(stated) if stated.isdigit() else begin + size - end


def hopping(file: Bytes, start: int, end: int, wanted, payloads: bool) -> Iterator[dict]:
    """Records of the members in [start, end) of a gzip file; a member begins at ``start``.  Members without a skip length are inflated to find their end."""
    at = start
    while at < min(end, file.size):
        fixed = file.read(at, len(MEMBER) + 8)
        size = struct.unpack("<II", fixed[len(MEMBER) :])[0] if fixed[: len(MEMBER)] == MEMBER and len(fixed) == len(MEMBER) + 8 else UNKNOWN
        if size == UNKNOWN:
            raw, at = whole_member(file, at)
            if raw.startswith(b"WARC/"):
                yield from streaming(Bytes(Held(raw)), False, wanted, payloads)
            continue
        body, after = at + len(fixed), at + size
        opening = Opening(file, body)
        while len(opening.held) < 5 and opening.more():
            pass
        if opening.held.startswith(b"WARC/"):
            begin = opening.blank(0)
            fields = parse_headers(opening.held[:begin].removesuffix(BLANK))
            row = header_columns(fields)
            if wanted(row):
                if payloads:
                    raw = zlib.decompressobj(-15).decompress(file.read(body, size - len(fixed) - 8))
                    length, body_bytes = payload_of(fields, raw[begin:][: int(fields.get("content-length", 0))])
                else:
                    length, body_bytes = opening.payload_length(fields, begin), None
                yield row | {"payload_length": length, "payload": body_bytes if row["record_type"] != "revisit" else None}
        at = after


def whole_member(file: Bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member that begins there, and where the next one does."""
    open_, out = zlib.decompressobj(31), []
    while not open_.eof:
        piece = file.read(at, 1 << 16)
        if not piece:
            raise ValueError(f"a gzip member ends before its time at byte {at}")
        out.append(open_.decompress(piece))
        at += len(piece) - len(open_.unused_data)
    return b"".join(out), at


class Inflated:
    """A gzip file of any members, or a plain file, as one stream."""

    def __init__(self, file: Bytes, gzipped: bool):
        self.file, self.gzipped, self.at, self.held = file, gzipped, 0, b""
        self.open_ = zlib.decompressobj(31) if gzipped else None

    def more(self) -> bool:
        piece = self.file.read(self.at, 1 << 16)
        if not piece:
            return False
        self.at += len(piece)
        while self.gzipped and piece:
            self.held += self.open_.decompress(piece)
            piece = self.open_.unused_data
            if self.open_.eof:
                self.open_ = zlib.decompressobj(31)
        self.held += piece
        return True

    def until(self, sign: bytes) -> bytes:
        while sign not in self.held:
            if not self.more():
                return b""
        head, _, self.held = self.held.partition(sign)
        return head

    def take(self, n: int, keep: bool) -> bytes:
        out = []
        while n > 0:
            if not self.gzipped and not self.held and not keep:
                self.at += n  # a plain file is sought over
                break
            if not self.held and not self.more():
                break
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            if keep:
                out.append(piece)
        return b"".join(out)


def streaming(file: Bytes, gzipped: bool, wanted, payloads: bool) -> Iterator[dict]:
    """Records of a whole file without skip lengths."""
    stream = Inflated(file, gzipped)
    while head := stream.until(b"\r\n\r\n"):
        head = head.lstrip(b"\r\n")
        fields = parse_headers(head)
        size = int(fields.get("content-length", 0))
        row = header_columns(fields)
        keep = bool(wanted(row))
        block = stream.take(size, keep)
        stream.take(4, False)
        if keep:
            length, body = payload_of(fields, block)
            yield row | {"payload_length": length, "payload": body if payloads and row["record_type"] != "revisit" else None}


def tests(filters: list[Filter]):
    """One condition of header columns from pushed filters; null compares as in SQL."""
    checks = []
    for f in filters:
        c = f.attribute[0]
        if isinstance(f, EqualNullSafe):
            checks.append(lambda r, c=c, v=f.value: r[c] == v)
        elif isinstance(f, EqualTo):
            checks.append(lambda r, c=c, v=f.value: r[c] is not None and r[c] == v)
        elif isinstance(f, In):
            checks.append(lambda r, c=c, v=frozenset(f.value): r[c] is not None and r[c] in v)
        elif isinstance(f, IsNull):
            checks.append(lambda r, c=c: r[c] is None)
        elif isinstance(f, IsNotNull):
            checks.append(lambda r, c=c: r[c] is not None)
        elif isinstance(f, StringStartsWith):
            checks.append(lambda r, c=c, v=f.value: r[c] is not None and r[c].startswith(v))
        elif isinstance(f, StringEndsWith):
            checks.append(lambda r, c=c, v=f.value: r[c] is not None and r[c].endswith(v))
        elif isinstance(f, StringContains):
            checks.append(lambda r, c=c, v=f.value: r[c] is not None and v in r[c])
    return lambda row: all(check(row) for check in checks)


PUSHED = (EqualNullSafe, EqualTo, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int
    hops: bool
    gzipped: bool


def archive_files(path: str) -> list[tuple[str, int, list[int]]]:
    """Archives under ``path`` (a file or a folder), their sizes, and places where members begin; the committed ones if there are manifests."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size, [0])]
    found = {i.base_name: (i.path, i.size) for i in store.get_file_info(fs.FileSelector(at, recursive=False)) if i.type == fs.FileType.File}
    manifests = [v for n, (v, _) in sorted(found.items()) if n.startswith("_manifest-")]
    if not manifests:
        return [(*v, [0]) for n, v in sorted(found.items()) if n.endswith((".warc", ".warc.gz"))]
    out = {}
    for m in manifests:
        with store.open_input_stream(m) as f:
            out |= {n: (*found[n], marks) for n, marks in json.loads(f.read())["files"].items()}
    return [v for _, v in sorted(out.items())]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 16 << 20))
        self.payloads = options.get("payload", "true").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, PUSHED) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        out = []
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path, size, marks in archive_files(self.path):
            with store.open_input_file(path) as f:
                sign = f.read_at(min(len(MEMBER), size), 0)
            cuts = [0]
            for mark in marks:
                if mark - cuts[-1] >= self.split:
                    cuts.append(mark)
            out += [Stretch(path, i, j, sign == MEMBER, sign[:2] == MEMBER[:2]) for i, j in zip(cuts, [*cuts[1:], size], strict=True)]
        return out or [Stretch("", 0, 0, False, False)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
        if not partition.path:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        wanted = tests(self.filters)
        with store.open_input_file(partition.path) as f:
            file = Bytes(f)
            rows = hopping(file, partition.start, partition.end, wanted, self.payloads) if partition.hops else streaming(file, partition.gzipped, wanted, self.payloads)
            part, size = [], 0
            for row in rows:
                part.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], t) for n, t in zip(names, types, strict=True)], names=names)
                    part, size = [], 0
            if part:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], t) for n, t in zip(names, types, strict=True)], names=names)


# ---------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    marks: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.level = int(options.get("level", 6))
        self.mark = int(options.get("mark_bytes", MARK))

    def _store(self):
        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        store.create_dir(at, recursive=True)
        return store, at

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = self._store()
        name, out, place, marks = None, None, 0, [0]
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{at}/{name}", compression=None)
                    if place - marks[-1] >= self.mark:
                        marks.append(place)
                    member = gzip_member(encode_record({c: batch.column(c)[i].as_py() for c in batch.schema.names}), self.level)
                    out.write(member)
                    place += len(member)
        finally:
            if out is not None:
                out.close()
        return Written(name, marks)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = self._store()
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{at}/.{name}", compression=None) as f:
            f.write(json.dumps({"files": {m.name: m.marks for m in messages if m is not None and m.name}}).encode())
        store.move(f"{at}/.{name}", f"{at}/_manifest-{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = self._store()
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{at}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---------------------------------------------------------------- pages


def archive_pages(pages: DataFrame, path: str, *, revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (``page_id, url, html``).

    Of rows with equal payloads of at least ``revisit_bytes`` bytes the one with the largest
    page_id (null is least) is the response, the others revisit it; rows that share that id
    and payload are all responses.  Digests, not payloads, are grouped.
    """
    register(pages.sparkSession)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    marks = materialize(rows.select("page_id", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha")).distinct(), "digests")
    leads = marks.filter(F.col("n") >= revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("lead"), F.count("*").alias("m")).filter("m > 1").select(F.col("sha").alias("s"), "lead")
    leads = materialize(leads, "leads")  # so that both sides of the join are plain shuffles, and a hot digest can be split
    decided = marks.join(leads, marks["sha"] == leads["s"]).filter(~F.col("page_id").eqNullSafe(F.col("lead"))).select(F.col("page_id").alias("p"), F.col("sha").alias("d"), "lead", F.lit(True).alias("again"))
    keyed = rows.withColumn("sha", F.sha1("payload"))
    both = keyed.join(decided, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("d")), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    again = F.coalesce("again", F.lit(False))
    records = both.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), "sha").alias("payload_digest"),
        F.when(again, urn(F.col("lead"))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").option("path", path).save()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``; a response's digest is taken from the payload that was read."""
    register(spark)
    rows = spark.read.format("warc").option("path", path).load().filter(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:page:(-?[0-9]+)$', 1) as bigint)")
    response = F.col("record_type") == "response"
    return rows.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring("payload_digest", 6, 40)).alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive ``pages`` and read the archives back."""
    path = path or new_path(pages.sparkSession, "warc")
    archive_pages(pages, path)
    return read_pages(pages.sparkSession, path)
