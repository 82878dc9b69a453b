"""Payloads that nobody asked for are not inflated, however well they compress."""

import random
import types
import zlib

import pytest

from edgeloom.llm import warc


class Memory:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.fixture
def inflated(monkeypatch):
    count = [0]

    class Counting:
        def __init__(self, wbits):
            self.open_ = zlib.decompressobj(wbits)

        def decompress(self, *a):
            out = self.open_.decompress(*a)
            count[0] += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.open_, name)

    monkeypatch.setattr(warc, "zlib", types.SimpleNamespace(decompressobj=Counting, compressobj=zlib.compressobj, crc32=zlib.crc32, DEFLATED=zlib.DEFLATED))
    return count


def records(data, wanted, payloads):
    return list(warc.hopping(warc.Bytes(Memory(data)), 0, len(data), wanted, payloads))


def test_unwanted_payloads_stay_deflated(inflated):
    big = bytes(3_000_000)
    long_ = "http://h/" + "".join(random.Random(1).choices("abcdefgh", k=30_000))  # headers of many steps
    rows = [dict(record_id="a", target_uri="http://a/", payload=big), dict(record_id="b", target_uri=long_, payload=big), dict(record_id="c", target_uri="http://c/", payload=b"hello")]
    data = b"".join(warc.gzip_member(warc.encode_record(r)) for r in rows)
    assert records(data, lambda r: False, True) == []
    assert inflated[0] < 50_000
    got = records(data, lambda r: True, False)
    assert [(r["record_id"], r["target_uri"], r["payload_length"], r["payload"]) for r in got] == [(r["record_id"], r["target_uri"], len(r["payload"]), None) for r in rows]
    assert inflated[0] < 100_000
    assert [r["payload"] for r in records(data, lambda r: r["record_id"] != "b", True)] == [big, b"hello"]


@pytest.mark.parametrize("kind", ["application/http", "text/plain"])
@pytest.mark.parametrize("stated", [True, False])
@pytest.mark.parametrize("body", [b"", b"x\r\n\r\ny", random.Random(2).randbytes(40_000)])
def test_length_without_payload_is_that_with_it(kind, stated, body):
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n" + (b"Content-Length: %d\r\n" % len(body) if stated else b"") + b"\r\n" + body
    raw = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % (kind.encode(), len(block)) + block + b"\r\n\r\n"
    data = warc.gzip_member(raw)
    (a,), (b,) = records(data, lambda r: True, True), records(data, lambda r: True, False)
    assert a["payload_length"] == b["payload_length"] and b["payload"] is None
