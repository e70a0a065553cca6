"""Token ids in binary files (operator 4): ranks by frequency, 1 to 4 bytes each, with the lengths in control bytes."""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

MAGIC = b"RVB1"
#: Tokens of one file, about; a document is never split between files.
FILE_TOKENS = 4_000_000
#: A vocabulary of more ids than this is refused: its ranks are sent to every task.
VOCABULARY_BOUND = 1 << 21

#: For each control byte the lengths of the four values it stands for.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def bytes_written(lengths: np.ndarray, width: int) -> np.ndarray:
    """Which bytes of values in a fixed width are written, by their lengths."""
    mask = np.empty((len(lengths), width), bool)
    for k in range(width):
        np.greater(lengths, k, out=mask[:, k])
    return mask


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes, of four values each, and the values' bytes, lowest first."""
    v, width = np.ascontiguousarray(values, "<u4"), 4
    code = (v > 0xFF).astype(np.uint8)
    if v.max(initial=0) > 0xFFFF:
        code += (v > 0xFFFF).astype(np.uint8) + (v > 0xFFFFFF)
    else:  # as ranks of most vocabularies are: half of the bytes to look at
        v, width = v.astype("<u2"), 2
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, width)[bytes_written(code + 1, width)]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values; lengths come from the table by control byte."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    width = 2 if lengths.max(initial=1) <= 2 else 4
    out = np.zeros((n, width), np.uint8)
    out[bytes_written(lengths, width)] = np.frombuffer(data, np.uint8)
    return out.view(f"<u{width}").ravel().astype(np.uint32)


def file_bytes(doc_ids: list, lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    """magic, header length, JSON header, ids (int64), nulls among them (uint8), lengths (uint32), control, data, crc32."""
    control, data = encode_values(ranks)
    header = json.dumps({"documents": len(doc_ids), "tokens": len(ranks), "control": len(control), "data": len(data)}).encode()
    body = b"".join((MAGIC, struct.pack("<I", len(header)), header, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), lengths.astype("<u4").tobytes(), control, data))
    return body + struct.pack("<I", zlib.crc32(body))


def parse_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ranks; raises ValueError for a damaged file."""
    if raw[:4] != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("damaged token file")
    size = struct.unpack("<I", raw[4:8])[0]
    h, at = json.loads(raw[8 : 8 + size]), 8 + size
    n, cuts = h["documents"], []
    for width in (8 * n, n, 4 * n, h["control"], h["data"]):
        cuts.append(raw[at : at + width])
        at += width
    nulls = np.frombuffer(cuts[1], np.uint8)
    ids = [None if z else x for x, z in zip(np.frombuffer(cuts[0], "<i8").tolist(), nulls)]
    return ids, np.frombuffer(cuts[2], "<u4"), decode_values(cuts[3], cuts[4], h["tokens"])


def write_file(folder: str, name: str, body: bytes) -> str:
    """Writes under a name of its own and gives the path; only files of a manifest count, so a task may run twice."""
    store, base = shared.open_store(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(body)
    return f"{folder}/{name}"


def read_file(path: str) -> bytes:
    store, base = shared.open_store(path)
    with store.open_input_file(base) as f:
        return f.read()


def id_width(vocabulary: str) -> str:
    """What ids are kept in until they are written: 2 bytes where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokens.vocabulary(vocabulary)).get_vocab_size() <= 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int, width: str) -> DataFrame:
    """doc_id and the ids of the whole text with end_id, in integers of the given width; null texts are empty."""

    def run(batches):
        encode = tokens.encoder(tokens.vocabulary(vocabulary), tokens.BYTE_LEVEL)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in shared.slices([t or "" for t in texts], 4_000_000):
                ids = [np.frombuffer(encode(t or "") + end, "<u4").astype(width).tobytes() for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def in_steps(values: list[bytes], size: int):
    """Lists of values, one after the other, of about so many bytes each; none is empty."""
    held, total = [], 0
    for x in values:
        held.append(x)
        total += len(x)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def id_counts(encoded: DataFrame, width: str) -> DataFrame:
    """How often each id occurs; each task hands on at most one row an id."""

    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for ids in (b"".join(x) for x in in_steps(batch.column(0).to_pylist(), 4 << 20)):
                c = np.bincount(np.frombuffer(ids, width))
                if len(c) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(c) - len(counts), np.int64)])
                counts[: len(c)] += c
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(counts[has], pa.int64())], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes token files in ascending doc_id order and a file of ranks, and gives the manifest.

    manifest: file (its place in the order), path, documents, tokens, start (ids in the files before it). Null ids
    come first. Rows that repeat a doc_id are all written, next to each other. Null and empty texts are the end id alone. Very
    long texts are encoded piece by piece and written whole; a file that has file_tokens ids is closed behind the document
    that it has begun. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    width = id_width(vocabulary)
    encoded, at = shared.materialize_at(encode_documents(docs, vocabulary, end_id, width), "ids", compression="zstd")
    counts = id_counts(encoded, width).toPandas()  # at most the vocabulary
    if len(counts) and counts.id.max() >= VOCABULARY_BOUND:
        raise ValueError("the vocabulary is too large to send to every task")
    by_rank = counts.sort_values(["n", "id"], ascending=[False, True]).id.to_numpy("<u4")
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    write_file(folder, "ranks.bin", by_rank.tobytes())
    ranks = spark.sparkContext.broadcast(rank_of)
    files = max(1, -(-int(counts.n.sum()) // file_tokens))

    def write(batches):
        ids, lengths, parts, pending, part, k = [], [], [], 0, TaskContext.get().partitionId(), 0

        def flush():
            body = file_bytes(ids, np.array(lengths, np.int64), ranks.value[np.concatenate(parts)])
            path = write_file(folder, f"part-{part:06d}-{k:04d}-{uuid.uuid4().hex}.rvb", body)
            columns = [[part], [k], [path], [len(ids)], [pending]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "piece", "path", "documents", "tokens"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, width)
                ids.append(doc_id)
                lengths.append(len(own))
                parts.append(own)
                pending += len(own)
                if pending >= file_tokens:
                    yield flush()
                    ids, lengths, parts, pending, k = [], [], [], 0, k + 1
        if ids:
            yield flush()

    ordered = encoded.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    manifest = shared.materialize(ordered.mapInArrow(write, "part int, piece int, path string, documents long, tokens long"), "token-files")
    shared.remove(spark, at)
    from pyspark.sql import Window

    order = Window.orderBy("part", "piece")  # one row a file
    before = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return manifest.select((F.row_number().over(order) - 1).alias("file"), "path", "documents", "tokens", F.coalesce(before, F.lit(0)).alias("start"))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, ids of every document in the files of a manifest; start counts all ids before it.

    ids are little-endian unsigned 32-bit integers, never none, as each document has its end id. A task reads a file at a
    time; one that is damaged is an error. An empty manifest gives no row. Other columns of it are not read.
    """

    def run(batches):
        by_rank = np.frombuffer(read_file(f"{folder}/ranks.bin"), "<u4")
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids, lengths, ranks = parse_file(read_file(path))
                ids, ends = by_rank[ranks], np.cumsum(lengths, dtype=np.int64)
                for a in range(0, len(doc_ids), 2_000):
                    b = min(a + 2_000, len(doc_ids))
                    own = [ids[e - n : e].tobytes() for e, n in zip(ends[a:b], lengths[a:b])]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), pa.array(start + ends[a:b] - lengths[a:b], pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "start", "ids"])

    dealt = manifest.select("path", "start").repartition(max(1, manifest.count()))
    return dealt.mapInArrow(run, "doc_id long, start long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.scratch(spark, "tokens")
    manifest = write_tokens(shared.table(spark, sf_dir, "documents"), folder)
    read = read_tokens(manifest, folder)
    n = (F.length("ids") / 4).cast("long")
    return read.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
