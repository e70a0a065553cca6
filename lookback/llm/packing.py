"""Best-fit packing in rounds (operator 7)."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

#: A bin with at least so large a part of its capacity filled is closed at once.
FULL = 0.98
#: Pieces that one task of the first round packs, groups that one task of a later round joins, and bins of over half
#: their capacity that a group hands on at most.
ITEMS, FAN_IN, HAND_ON = 20_000, 8, 256

PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Each document's ids and end_id, cut into pieces of capacity where it is longer; null texts are empty.

    Rows that repeat a doc_id are documents of their own. item numbers the pieces and differs between any two of them
    in one run; write the result down before using it twice.
    """

    def cut(batches):
        encode = tokens.encoder(tokens.vocabulary(vocabulary), tokens.WORD_LEVEL)
        end, item, width = end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 33, 4 * capacity
        for batch in (step for whole in batches for step in shared.row_steps(whole)):
            rows = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for column, value in zip(rows, (item, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
                    item += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["item", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Longest first, each into the fullest bin that has room. Gives bin and offset of each, and what each bin holds."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    where, offset, held = [0] * len(lengths), [0] * len(lengths), []
    open_bins: dict[int, list[int]] = {}  # by room
    rooms = 0  # bit r: some bin has room r
    for i in order:
        size = lengths[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(held)
            held.append(0)
        where[i], offset[i] = b, held[b]
        held[b] += size
        if left := room - size:
            open_bins.setdefault(left, []).append(b)
            rooms |= 1 << left
    return where, offset, held


def pack_round(items: DataFrame, capacity: int, number: int) -> DataFrame:
    """Best fit within each group: item, bin, offset, held, onward. Bins of different groups and rounds differ.

    onward marks the bins that go on to the next round: after best fit at most one of a group is half empty or more,
    and only such a bin can still join another; with it go the HAND_ON emptiest of the others, as its partners. So a
    later task gets at most FAN_IN * (HAND_ON + 1) items, however many pieces there are.
    """

    def pack(key, group):
        ids, lengths = group.column("item").to_pylist(), group.column("length").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)  # so that a rerun packs alike
        ids, lengths = [ids[i] for i in order], [lengths[i] for i in order]
        where, offset, held = best_fit(lengths, capacity)
        underfull = sorted((b for b in range(len(held)) if held[b] < FULL * capacity), key=held.__getitem__)
        onward = {b for k, b in enumerate(underfull) if k <= HAND_ON or 2 * held[b] <= capacity}
        first = (number << 56) | (key[0].as_py() << 28)
        return pa.table({"item": pa.array(ids, pa.int64()), "bin": pa.array([first + b for b in where], pa.int64()), "offset": pa.array(offset, pa.int64()), "held": pa.array([held[b] for b in where], pa.int64()), "onward": pa.array([b in onward for b in where], pa.bool_())})

    return items.groupBy("group").applyInArrow(pack, "item long, bin long, offset long, held long, onward boolean")


def pack(pieces: DataFrame, capacity: int, items: int = ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Adds sequence_id and offset to written pieces (item, length): each sequence holds at most capacity.

    Round 1 packs groups of about `items` pieces, dealt by a hash of the piece. Bins filled to FULL of their capacity
    are done; underfull ones go on as items of their own to the next round (see pack_round), in which `fan_in` groups
    are one, until one group is left: a tree in which each task is bounded. Pieces
    of capacity close a bin alone and skip all rounds.
    """
    whole = pieces.filter(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).select("item", "length")
    count = rest.count()
    groups = max(1, -(-count // items))
    level = rest.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)))
    placed, number = None, 1
    while True:
        binned = shared.materialize(pack_round(level, capacity, number), f"bins-{number}")
        if placed is None:
            placed = binned.select("item", F.col("bin").alias("sequence_id"), "offset")
        else:
            moved = binned.select(F.col("item").alias("sequence_id"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
            placed = placed.join(moved, "sequence_id", "left").select("item", F.coalesce("_to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"))
        if groups == 1:
            break
        shrunk = -(-groups // fan_in)
        # a bin's group is in bits 28 to 55 of its number
        level = binned.filter("onward").groupBy(F.col("bin").alias("item")).agg(F.first("held").alias("length"))
        level = level.withColumn("group", F.floor(F.shiftrightunsigned(F.col("item").bitwiseAND((1 << 56) - 1), 28) / fan_in).cast("long"))
        groups, number = shrunk, number + 1
    return pieces.join(placed.unionByName(whole), "item").drop("item")


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null ids, null and empty texts, repeated rows: each row is a document and has a piece, of the end id alone if
    there is no text. An empty table gives an empty one. Other columns are not read.
    """
    return pack(shared.materialize(token_pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(shared.table(spark, sf_dir, "documents"))
