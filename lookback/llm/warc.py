"""WARC archives (operator 9): a writer with revisit records and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: A file is closed once it has so many bytes.
FILE_BYTES = 32_000_000
LEVEL = 3
#: Bytes that a gzip reader takes at a time.
STEP = 1 << 16
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
GZIP, MARK, VERSION_LINE = b"\x1f\x8b\x08", b"WARC/", re.compile(rb"WARC/\d\.\d+\r\n")
CONTROLS = re.compile(r"[\x00-\x08\x0a-\x1f\x7f]")
#: Bytes of a file that a reader holds, but for a longer record or member; bytes of the longest header, and those that are
#: looked at before the rest of it.
WINDOW, HEADER, FIRST = 1 << 22, 1 << 20, 1 << 12
#: Payloads that several pages have are broadcast while they are at most so many; beyond, pages are shuffled to them.
REPEATED = 100_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, sha1: str, refers_to, revisit: bool) -> bytes:
    """One record, not compressed. A revisit holds the HTTP header alone, with the length and digest of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{sha1}/{revisit}')}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(c for c in url or "" if c > " ") or "about:blank",
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-Page-ID": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To-Page-ID"] = "" if refers_to is None else str(refers_to)
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"
    return head + block + END


def member(raw: bytes, level: int = LEVEL) -> bytes:
    """A gzip member of its own, so that a reader can start at any record."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Stored:
    """A stored file's bytes, of which about WINDOW are held at a time, and where patterns come next."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.held = file, size, 0, b""
        self.hits: dict[bytes, tuple[int, int]] = {}

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, min(WINDOW, self.size - at)))
        return self.held[at - self.at : at - self.at + n]

    def find(self, pattern: bytes, at: int) -> int:
        """Where a pattern comes next at or behind a place, or size."""
        while at < self.size:
            part = self.read(at, WINDOW)
            k = part.find(pattern)
            if k >= 0:
                return at + k
            if at + len(part) >= self.size:
                break
            at += max(1, len(part) - len(pattern) + 1)
        return self.size

    def following(self, pattern: bytes, at: int) -> int:
        """find() for places that go on: the last hit is remembered, so that bytes without one aren't searched again."""
        since, hit = self.hits.get(pattern, (0, -1))
        if not since <= at <= hit:
            self.hits[pattern] = at, (hit := self.find(pattern, at))
        return hit


def stored_bytes(data: bytes) -> Stored:
    return Stored(io.BytesIO(data), len(data))


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a header by lower-case name; a line that begins with white space goes on with the one before, and of a name
    that repeats the first counts. Bytes that aren't UTF-8 are replaced, but a header with control characters is none."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if CONTROLS.search(line):
            raise ValueError("bad header")
        if line[:1] in (" ", "\t"):
            if name is not None:
                out[name] += " " + line.strip()
            continue
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            raise ValueError("bad header")
        name = key.strip().lower() if key.strip().lower() not in out else None
        if name is not None:
            out[name] = value.strip()
    return out


def has_digest(data: bytes, named: str | None) -> bool:
    """Whether data has a digest `algorithm:value` in base 32 or hexadecimal; one of an algorithm that isn't known says nothing."""
    algorithm, _, value = (named or "").partition(":")
    if algorithm.lower() not in ("sha1", "sha256", "sha512", "md5") or not value:
        return True
    raw = hashlib.new(algorithm.lower(), data).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def parse(data: Stored, at: int = 0) -> tuple[dict, bytes, int]:
    """Header fields (by lower-case name), block and end of the record at a version line; raises ValueError where a check fails.

    Where the block ends is looked at before it is read, so that a wrong length costs nothing.
    """
    if not VERSION_LINE.match(data.read(at, 16)):
        raise ValueError("no version line")
    head_end = data.following(END, at)
    if head_end >= data.size or head_end - at > HEADER:
        raise ValueError("header without end")
    if head_end - at > FIRST:
        header_fields(data.read(at, FIRST).rpartition(b"\r\n")[0])  # what isn't a header is mostly none from its first lines on
    fields = header_fields(data.read(at, head_end - at))
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise ValueError("bad header")
    start = head_end + 4
    end = start + int(size)
    if end + 4 > data.size or data.read(end, 4) != END:
        raise ValueError("block doesn't end where its length says")
    block = data.read(start, int(size))
    if not has_digest(block, fields.get("warc-block-digest")):
        raise ValueError("block digest")
    return fields, block, end + 4


def one_member(data: Stored, at: int) -> tuple[bytes, int]:
    """The content and end of the gzip member that starts at a place; reads STEP bytes at a time and no more than the member."""
    z, parts = zlib.decompressobj(31), []
    try:
        while not z.eof and at < data.size:
            step = data.read(at, STEP)
            parts.append(z.decompress(step))
            at += len(step)
    except zlib.error as e:
        raise ValueError("gzip member") from e
    if not z.eof:
        raise ValueError("gzip member without end")
    return b"".join(parts), at - len(z.unused_data)


def records_at(data: Stored, at: int) -> tuple[list[tuple[dict, bytes]], int]:
    """The records of the gzip member, or the plain record, at a place, and its end."""
    if data.read(at, len(GZIP)) != GZIP:
        fields, block, end = parse(data, at)
        return [(fields, block)], end
    raw, end = one_member(data, at)
    inner, place, found = stored_bytes(raw), 0, []
    while place < len(raw) or not found:
        fields, block, place = parse(inner, place)
        found.append((fields, block))
    return found, end


def salvage(data: Stored):
    """Everything valid in a file of gzip members or plain records, in order.

    Yields ("record", start, end, fields, block), or after failed checks ("gap", start, end, reason, None) for the
    quarantined bytes up to the next gzip member or version line at which a valid record starts. Each byte is searched once
    for either, and a failed candidate reads no more than the member or record that it claims to be. A member may hold several
    records, which have its start and end.
    """
    at, gap, reason = 0, None, ""
    while at < data.size:
        try:
            found, end = records_at(data, at)
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            at = min(data.following(GZIP, at + 1), data.following(MARK, at + 1))
            continue
        if gap is not None:
            yield "gap", gap, at, reason, None
            gap = None
        for fields, block in found:
            yield "record", at, end, fields, block
        at = end
    if gap is not None:
        yield "gap", gap, data.size, reason, None


def contents(fields: dict, block: bytes) -> tuple[bytes | None, int | None]:
    """Payload and its length: of a record of HTTP what comes behind its header, else the block; raises ValueError if it
    doesn't have its digest. A revisit has no payload, and the length that its header states, if it states one.

    A body that was sent in parts or compressed may have a digest of either form, and isn't held against it.
    """
    http = fields.get("content-type", "").lower().startswith("application/http")
    head, blank, body = block.partition(END) if http else (b"", b"", block)
    inner = {}
    try:
        inner = header_fields(head) if head else {}
    except ValueError:
        pass  # a server's header may be anything
    if fields.get("warc-type", "").lower() == "revisit":
        size = inner.get("content-length", "")
        return None, int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None
    encoded = "transfer-encoding" in inner or "content-encoding" in inner
    if not encoded and not has_digest(body, fields.get("warc-payload-digest")):
        raise ValueError("payload digest")
    return body, len(body)


def planned(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, refers_to and revisit of every page; what a row gets follows from values alone.

    Rows of one payload are ordered by page_id and url, nulls last. The least is the response. Rows that are alike in
    all three are summed up as one with its number: one of them is the response, if it is the least, the others revisits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    key = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    long = F.length("payload") >= least
    seen = rows.filter(long).groupBy("sha1", key.alias("key")).agg(F.count("*").alias("rows"))
    first = seen.groupBy("sha1").agg(F.min("key").alias("first"), F.sum("rows").alias("rows"), F.min_by("rows", "key").alias("alike"))
    first = shared.materialize(first.filter("rows > 1").drop("rows"), "payloads")
    known = first.withColumnRenamed("sha1", "_key")
    known = F.broadcast(known) if first.count() <= REPEATED else known
    joined = rows.withColumn("_key", F.when(long, F.col("sha1"))).join(known, "_key", "left")
    other = F.col("first").isNotNull() & (key != F.col("first"))
    alike = F.coalesce((key == F.col("first")) & (F.col("alike") > 1), F.lit(False))
    columns = ["page_id", "url", "payload"]
    refers = F.col("first.page_id").alias("refers_to")
    single = joined.filter(~alike).select(*columns, F.when(other, F.col("first.page_id")).alias("refers_to"), other.alias("revisit"))
    if not first.filter("alike > 1").limit(1).count():
        return single
    once = joined.filter(alike).groupBy("page_id", "url", "sha1").agg(F.first("payload").alias("payload"), F.first("first").alias("first"), F.first("alike").alias("alike"))
    again = once.select(*columns, refers, F.explode(F.sequence(F.lit(1), F.col("alike"))).alias("n"))
    return single.unionByName(again.select(*columns, F.when(F.col("n") > 1, F.col("refers_to")).alias("refers_to"), (F.col("n") > 1).alias("revisit")))


def write_warc(pages: DataFrame, folder: str, least: int = 0, level: int = LEVEL) -> DataFrame:
    """Writes a record a page and gives the manifest: path, records, bytes.

    Of pages with equal payloads of at least `least` bytes the one with the smallest page_id is the response and the
    others are revisits of it; where rows repeat page_id and payload, the one with the least url is the response. Null
    ids and urls come last. Null html is an empty payload. An empty table gives an empty manifest. Other columns are not
    read. A lost task writes again under another name; only files of the manifest count.
    """

    def write(batches):
        part, k, buffer, size = TaskContext.get().partitionId(), 0, [], 0
        store, base = shared.open_store(folder)
        store.create_dir(base, recursive=True)

        def flush():
            name = f"part-{part:06d}-{k:04d}-{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(b"".join(buffer))
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(buffer)], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page_id, url, body, refers_to, again in zip(*(c.to_pylist() for c in batch.columns)):
                raw = member(record(page_id, url, body, digest(body), refers_to, again), level)
                buffer.append(raw)
                size += len(raw)
                if size >= FILE_BYTES:
                    yield flush()
                    k, buffer, size = k + 1, [], 0
        if buffer:
            yield flush()

    return shared.materialize(planned(pages, least).mapInArrow(write, "path string, records long, bytes long"), "warc-files")


def read_warc(manifest: DataFrame) -> DataFrame:
    """Records and gaps of every file of a manifest (column path), a file at a time.

    kind (record or gap), path, start, end, page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    payload (null for revisits), reason (of a gap). A record whose payload doesn't have its digest is a gap; one without a
    digest is taken as it is, and so is what other writers leave out: page_id, refers_to, url and payload_digest are null
    then, and a revisit's payload_bytes if its header states none. payload_digest is bare, as the record writes it. Records of
    all types come back. Files may be of any length, WINDOW bytes of which are held; a record is a row and is held whole.
    Empty files have no rows. Other columns of the manifest are not read.
    """

    def row(path, kind, start, end, fields, block):
        if kind == "gap":
            return (kind, path, start, end, *[None] * 7, fields)
        try:
            payload, size = contents(fields, block)
        except ValueError as e:
            return ("gap", path, start, end, *[None] * 7, str(e))
        number = lambda k: int(fields[k]) if re.fullmatch(r"-?[0-9]{1,18}", fields.get(k, "")) else None
        named = fields.get("warc-payload-digest")
        return ("record", path, start, end, number("warc-page-id"), fields.get("warc-target-uri"), fields.get("warc-type"), number("warc-refers-to-page-id"), size, None if named is None else named.rpartition(":")[2], payload, None)

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = ["kind", "path", "start", "end", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "reason"]

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, base = shared.open_store(path)
                rows, size = [], 0
                with store.open_input_file(base) as f:
                    for kind, start, end, fields, block in salvage(Stored(f, f.size())):
                        rows.append(row(path, kind, start, end, fields, block))
                        size += len(block or b"")
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = "kind string, path string, start long, end long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, reason string"
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.scratch(spark, "warc")
    records = read_warc(write_warc(shared.table(spark, sf_dir, "pages"), folder)).filter("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
