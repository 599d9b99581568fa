"""Packing, records, archive, chat: round trips and odd inputs."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barquet.llm import archive, chat, packing, records
from barquet.llm.common import importable
from barquet.llm.queries import tokenizer_path
from barquet.llm.tokens import Encoder

ODD_TEXTS = [
    None, "", " ", "a", "A b\n\nc", "don't I'll  x y", "日本語 text", "<|endoftext|> hi", "a\x85b", "áb́c",
    "½ ²³ 12½", " \n \n", "\x1c a", "é'Sx 's", "word " * 5000, "same text here", "same text here",
]


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    rows = [(i, t, "n") for i, t in enumerate(ODD_TEXTS)] + [(3, "a", "repeated")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


@pytest.fixture(scope="module")
def coder():
    return Encoder(tokenizer_path())


def ids_of(coder, text):
    return np.array(coder._library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_encoder_equals_the_library(coder):
    for text, coded in zip(ODD_TEXTS, coder.encode(ODD_TEXTS)):
        assert np.frombuffer(coded, "<u4").tolist() == ids_of(coder, text).tolist(), text


def test_contractions_are_split_as_the_library_does(coder):
    texts = ["'s't're've'm'll'd", "''s 'll 'lll 're're", "'S 'RE we'd've 'veto 'x'", "don't 12's ½'m\n'd"]
    assert coder.encode(texts) == [coder._whole(t) + b"\0\0\0\0" for t in texts]


def test_cut_is_exact_and_near_reciprocal():
    for n in range(1, 4000):
        parts = packing.cut(n)
        assert sum(parts) == n and max(parts) <= 1024
        for p in parts[:-1]:
            assert p * (1024 // p) > 1024 - 1024 // p


def test_pack_places_each_token_once(spark, docs, coder):
    rows = packing.pack(docs, tokenizer_path()).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(ODD_TEXTS)))
    for doc_id, parts in by_doc.items():
        ids = ids_of(coder, ODD_TEXTS[doc_id])
        copies = 2 if doc_id == 3 else 1
        assert sum(p.length for p in parts) == copies * len(ids)
        for p in parts:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024


def test_pack_of_nothing(spark, docs):
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_records_round_trip_in_order(spark, docs, coder, tmp_path):
    folder = f"file://{tmp_path}/records"
    index = records.write(docs, folder, tokenizer_path(), file_bytes=4096)
    got = sorted(records.read_digests(index, folder).collect())
    at = 0
    expected = sorted([*range(len(ODD_TEXTS)), 3])
    assert [r.doc_id for r in got] == expected
    for r in got:
        ids = ids_of(coder, ODD_TEXTS[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    files = [r.file for r in index.select("file").distinct().collect()]
    assert len(files) > 1
    # Files hold the records in order: a plain reader meets rising ids.
    for name in files:
        data, at, last = (tmp_path / "records" / name).read_bytes(), 0, -1
        while at < len(data):
            (n,) = struct.unpack_from("<Q", data, at)
            (doc_id,) = struct.unpack_from("<q", records.payload_of(data[at : at + n + 16]))
            assert doc_id >= last
            last, at = doc_id, at + n + 16


def test_records_without_an_id(spark, coder, tmp_path):
    importable(spark)
    rows = [(None, "first"), (-(1 << 63), "least"), (0, "nought"), (None, "second one"), (None, None)]
    folder = f"file://{tmp_path}/records"
    index = records.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, tokenizer_path())
    got = sorted(records.read_digests(index, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, None, -(1 << 63), 0]
    want = [(d, len(ids := ids_of(coder, t)), zlib.crc32(ids.tobytes())) for d, t in rows]
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)


def test_broken_frames_are_refused():
    whole = records.frame(b"payload")
    for at in range(len(whole)):
        broken = bytearray(whole)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.payload_of(bytes(broken))
    with pytest.raises(ValueError):
        records.payload_of(whole[:-1])


def test_archive_round_trip(spark, tmp_path):
    importable(spark)
    long, longer = "x" * 1000, "é" * 700
    rows = [(1, "http://a/", long), (2, "http://a b\r\n/", long), (3, None, long), (4, "u", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", ""), (8, "u", longer), (None, "u", longer), (9, "u", "z" * 2000), (9, "u", "z" * 2000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha1 string")
    folder = f"file://{tmp_path}/archive"
    archive.write(pages, folder)
    got = archive.parse(archive.records(spark, folder)).collect()
    assert len(got) == len(rows)
    kinds = defaultdict(list)
    for r in got:
        kinds[r.page_id].append((r.record_type, r.refers_to))
    assert kinds[1] == [("revisit", 3)] and kinds[2] == [("revisit", 3)] and kinds[3] == [("response", None)]
    assert kinds[4] == kinds[5] == kinds[6] == kinds[7] == kinds[8] == [("response", None)]
    assert kinds[None] == [("revisit", 8)]
    assert sorted(kinds[9], key=str) == [("response", None), ("revisit", 9)]
    assert spark.read.parquet(f"{folder}/payloads").count() == 5
    record = archive.records(spark, folder).collect()[0].record
    assert archive.read_record(record)["fields"]["WARC-Record-ID"]
    with pytest.raises(ValueError):
        archive.read_record(record[:-3])


def test_archive_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archive.write(pages, f"file://{tmp_path}/none")
    assert archive.parse(archive.records(spark, f"file://{tmp_path}/none")).count() == 0


CONTROLS = ["<turn user>", "</turn>\n", "\\", "\\\\", "<\\turn x", "<\\/turn>", "<image 1.1>", "\\</turn>", "plain é \n", "", "<", "<\\"]


def test_escape_is_reversible(spark):
    texts = CONTROLS + [a + b for a in CONTROLS for b in CONTROLS]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t")))
    for r in df.withColumn("u", chat.unescaped(F.col("e"))).collect():
        assert r.u == r.t
        assert "</turn>" not in r.e and "<turn " not in r.e


def test_chat_round_trip(spark):
    rows = []
    for i, t in enumerate(CONTROLS):
        rows += [(i, 0, "user", t), (i, 1, "assistant", t + "!"), (i, 2, "a>b \n", t)]
    rows += [(99, None, None, None), (None, 1, "assistant", "x"), (None, 1, "assistant", "x"), (98, 1, "user", "y"), (98, 1, "user", "y")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int")
    done = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    got = done.select("conv_id", chat.parsed(F.col("formatted")).alias("turns"),
                      chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    found = defaultdict(list)
    for r in got:
        found[r.conv_id].append(([tuple(t) for t in r.turns], r.loss))
    for i, t in enumerate(CONTROLS):
        assert found[i] == [([("user", t), ("assistant", t + "!"), ("a>b \n", t)], t + "!")]
    assert found[99] == [([("", "")], "")]
    assert found[None] == [([("assistant", "x")], "x")] * 2
    assert found[98] == [([("user", "y")] * 2, "")]
    assert done.limit(0).count() == 0


def test_attachments_are_counted_in_order(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None),
             ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 2),
             ("image", None, "?", None, None, None, None), ("other", "text", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<turn user>\nsee <image 1.2><audio 1.3><document 1.4><image 1.5>text</turn>\n"
    assert [(a.ref, a.tokens) for a in r.attachments] == [("i.png", 3), ("a.wav", 50), ("d.pdf", 1024), ("?", 0)]
    assert r.attachment_tokens == 1077
