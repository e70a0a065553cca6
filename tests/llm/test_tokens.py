"""Token files and packing against the library, text by text."""

import functools
import random
import zlib

import numpy as np
import pytest

from lookback.llm import packing, shared, tokenbin, tokens

TEXTS = ["", None, "Hello, world!", "don't  stop\n\n x", " lead and trail ", "é日本語 İ ß ²", "a" * 5000, "x 'll 're\t\x1cy <|endoftext|>", "a <|endoftext|> b", "<|startoftext|><|endoftext|>x<|endoftext|", "word<|endoftext|>Word <|EndOfText|>"]


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary(name))


def reference(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,pattern", [("byte_bpe_50k.json", tokens.BYTE_LEVEL), ("word_bpe_49k.json", tokens.WORD_LEVEL)])
def test_pieces_give_the_librarys_ids(name, pattern):
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("ab cÉé's \n\t.,-_9²Σж漢́İ’") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    encode = tokens.encoder(tokens.vocabulary(name), pattern)
    texts += [rng.choice(["", "a ", "é"]) + rng.choice(["<|endoftext|>", "<|startoftext|>"]) + rng.choice(["'s b", " 12", "\n\n", ""]) for _ in range(50)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == reference(name, t), repr(t)


def test_words_in_byte_characters():
    from tokenizers.pre_tokenizers import ByteLevel

    for word in ["plain", " lead", "ñuegabo", " Ciónó", "".join(map(chr, range(0x700)))]:
        pieces = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(word)
        assert tokens.in_byte_characters(word) == "".join(x for x, _ in pieces)


def test_variable_length_codes():
    values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = tokenbin.encode_values(values[:n])
        assert tokenbin.decode_values(control, data, n).tolist() == values[:n].tolist()


def test_files_round_trip(spark):
    rows = [(k * 3 % 11 if k != 2 else None, t, "clash") for k, t in enumerate(TEXTS)] + [(5, "again", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    folder = shared.scratch(spark, "test-tokens")
    manifest = tokenbin.write_tokens(docs, folder, file_tokens=50)
    assert manifest.count() > 1
    got = tokenbin.read_tokens(manifest, folder).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    want = sorted((str(i), np.array(reference("byte_bpe_50k.json", t) + [2], "<u4").tobytes()) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == want
    raw = bytearray(tokenbin.read_file(manifest.first()["path"]))
    raw[-6] ^= 1
    with pytest.raises(ValueError):
        tokenbin.parse_file(bytes(raw))
    empty = shared.scratch(spark, "test-tokens")
    assert tokenbin.read_tokens(tokenbin.write_tokens(docs.limit(0), empty), empty).count() == 0


def test_best_fit():
    where, offset, held = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert sorted(held) == [10, 10] and all(0 <= o for o in offset)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(k % 90, " ".join(["word"] * rng.randint(0, 40)), "clash") for k in range(200)] + [(None, None, "x"), (7, "word " * 130, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    pieces = shared.materialize(packing.token_pieces(docs, "word_bpe_49k.json", 1, 50), "test-pieces")
    got = packing.pack(pieces, 50, items=20, fan_in=3).toPandas()
    assert len(got) == pieces.count() and sorted(got["length"]) == sorted(r["length"] for r in pieces.collect())
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x["length"].sum() <= 50 and (x["offset"].to_numpy() == np.r_[0, x["length"].cumsum()[:-1]]).all()
    least = -(-got["length"].sum() // 50)
    assert got["sequence_id"].nunique() <= 1.1 * least + 3
    long = got[(got.doc_id == 7) & (got.ids_crc32 != 0)].groupby("piece")["length"].max()
    assert long.max() == 50
    one = np.array(reference("word_bpe_49k.json", "") + [1], "<u4").tobytes()
    assert zlib.crc32(one) in set(got[got.doc_id.isna()].ids_crc32)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packed_pieces_are_the_librarys_ids(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(3, "again", "x"), (None, "none " * 30, "x"), (50, "a very long text, with 12 numbers. " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(docs).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array(reference("word_bpe_49k.json", t) + [1], "<u4")
        want += [(str(i), k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) == -(-total // 4096) + (total % 4096 == 0)


def test_bins_that_stay_behind_are_over_half_full(spark):
    # what pack_round hands on: all bins of up to half the capacity, whatever HAND_ON is
    rng = random.Random(4)
    items = [(k, rng.randint(1, 30), k % 3) for k in range(900)]
    frame = spark.createDataFrame(items, "item long, length long, group long")
    got = packing.pack_round(frame, 50, 1).collect()
    assert all(r["onward"] for r in got if 2 * r["held"] <= 50)


def test_a_worker_keeps_one_table_at_a_time(monkeypatch):
    from lookback.llm import neardup, shared

    monkeypatch.setattr(shared, "_kept", {})
    first = shared.kept("one", dict)
    assert shared.kept("one", dict) is first
    text = "a b c a b c d"
    before = neardup.shingles(text, 2)
    assert list(shared._kept) == ["word hashes"]
    assert shared.kept("one", dict) is not first and list(shared._kept) == ["one"]
    assert (neardup.shingles(text, 2) == before).all() and len(before) == 4


def test_steps_of_rows_hold_few_bytes():
    import pyarrow as pa

    from lookback.llm import shared

    texts = ["a", None, "b" * 90, "c" * 300, "", "d" * 60, "e" * 60, *["f"] * 7]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    steps = list(shared.row_steps(batch, rows=5, most=100))
    assert [x for s in steps for x in s.column("text").to_pylist()] == texts
    assert all(len(s) <= 5 and (len(s) == 1 or sum(len(t or "") for t in s.column("text").to_pylist()) <= 100) for s in steps)
    assert list(shared.row_steps(batch.slice(0, 0))) == []
    assert [len(s) for s in shared.row_steps(batch.select(["id"]), rows=5)] == [5, 5, 4]


@pytest.mark.parametrize("top,width", [(200, 2), (50_000, 2), (1 << 20, 4), ((1 << 32) - 1, 4)])
def test_bytes_of_values_as_plain_python_writes_them(top, width):
    values = [top, 0, 255, *np.random.default_rng(2).integers(0, top, 41).tolist()]
    control, data = tokenbin.encode_values(np.array(values, np.uint32))
    sizes = [max(1, -(-v.bit_length() // 8)) for v in values]
    assert data == b"".join(v.to_bytes(n, "little") for v, n in zip(values, sizes))
    assert tokenbin.decode_values(control, data, len(values)).tolist() == values
    # values of two bytes at most are looked at in two, not four
    assert tokenbin.bytes_written(np.array(sizes), width).sum() == len(data)
