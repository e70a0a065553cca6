"""Archives of other writers, and damaged ones in time that grows with their length."""

import base64
import hashlib
import os
import random
import time

import pytest

from lookback.llm import warc


def foreign(kind: str, block: bytes, *extra: str, version: str = "WARC/1.0", length: str | None = None) -> bytes:
    lines = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", *extra, length or f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + warc.END + block + warc.END


HTTP = "Content-Type: application/http; msgtype=response"
BODY = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
FOREIGN = [
    foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
    foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "Content-Type: application/http; msgtype=request"),
    foreign("response", BODY, HTTP, "WARC-Target-URI: http://h/"),
    foreign("response", BODY, HTTP, length=f"content-length:{len(BODY)}"),
    foreign("response", BODY, HTTP, "warc-payload-digest: SHA1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode().lower()),
    foreign("response", BODY, HTTP, "WARC-Payload-Digest: sha256:" + hashlib.sha256(b"hello").hexdigest(), "X-Note: one", "\ttwo"),
    foreign("response", BODY, HTTP, "WARC-Payload-Digest: xyz:1234"),
    foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n", HTTP, "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()),
    foreign("revisit", b"HTTP/1.1 304 Not Modified\r\nDate: x\r\n\r\n", HTTP, "WARC-Payload-Digest: sha1:AAAA"),
    foreign("revisit", b"HTTP/1.1 200 OK\r\ncontent-length:7\r\nDate: x\r\n\r\n", HTTP),
    foreign("revisit", b"", "WARC-Page-ID: none"),
    foreign("resource", b"\xff\xfe\x00", "Content-Type: image/x", "X-Odd: é"),
    foreign("metadata", b"", version="WARC/0.18"),
]
SIZES = [13, 0, 5, 5, 5, 5, 5, 15, None, 7, None, 3, 0]
WRONG = foreign("response", BODY, HTTP, "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"other").digest()).decode())


def written(spark, tmp_path, *files: bytes):
    rows = []
    for k, data in enumerate(files):
        (tmp_path / f"{k}.warc").write_bytes(data)
        rows.append((f"file://{tmp_path}/{k}.warc", "other"))
    return spark.createDataFrame(rows, "path string, start string")


def test_records_of_other_writers(spark, tmp_path):
    files = [b"".join(FOREIGN), b"".join(map(warc.member, FOREIGN)), warc.member(b"".join(FOREIGN)), b"", FOREIGN[0] + WRONG + FOREIGN[1]]
    rows = warc.read_warc(written(spark, tmp_path, *files)).collect()
    for k in range(3):
        own = [r for r in rows if r["path"].endswith(f"/{k}.warc")]
        assert [r["kind"] for r in own] == ["record"] * len(FOREIGN) and [r["payload_bytes"] for r in own] == SIZES
        assert [r["record_type"] for r in own][:3] == ["warcinfo", "request", "response"]
        assert own[2]["url"] == "http://h/" and bytes(own[2]["payload"]) == b"hello" and own[8]["payload"] is None and own[10]["page_id"] is None
    assert not [r for r in rows if r["path"].endswith("/3.warc")]
    assert [(r["kind"], r["reason"]) for r in rows if r["path"].endswith("/4.warc")] == [("record", None), ("gap", "payload digest"), ("record", None)]


@pytest.mark.parametrize("pack", [warc.member, lambda r: r])
def test_a_damaged_file_in_linear_time(pack):
    rng, whole = random.Random(3), bytearray()
    records = [pack(warc.record(k, "u", os.urandom(2_000), "x", None, False)) for k in range(400)]
    while len(whole) < 32 << 20:  # every record is damaged
        one = bytearray(rng.choice(records))
        one[rng.randrange(len(one) // 2, len(one) - 4)] ^= 0x55
        whole += one
    good = pack(warc.record(7, "u", b"good", warc.digest(b"good"), None, False))
    begun = time.time()
    found = list(warc.salvage(warc.stored_bytes(bytes(whole) + good)))
    assert time.time() - begun < 20
    assert found[-1][0] == "record" and found[-1][3]["warc-page-id"] == "7" and found[-1][1] == len(whole)
    assert sum(x[2] - x[1] for x in found) == len(whole) + len(good)


def test_version_lines_without_headers_in_linear_time():
    begun = time.time()
    found = list(warc.salvage(warc.stored_bytes(b"WARC/1.0\r\n" * 200_000 + FOREIGN[0])))
    assert time.time() - begun < 20 and found[-1][0] == "record"


def test_a_file_larger_than_the_window(monkeypatch):
    monkeypatch.setattr(warc, "WINDOW", 100)
    records = [warc.record(k, "u", b"p" * (37 * k), warc.digest(b"p" * (37 * k)), None, False) for k in range(30)]
    for pack in (warc.member, lambda r: r):
        data = b"x" * 333 + b"".join(map(pack, records))
        stored = warc.stored_bytes(data)
        found = list(warc.salvage(stored))
        assert [x[0] for x in found] == ["gap"] + ["record"] * 30 and len(stored.held) < 70_000
        assert [x[4] for x in found[1:]] == [warc.parse(warc.stored_bytes(r))[1] for r in records]
