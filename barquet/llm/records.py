"""Length-delimited binary records with a separate offset index.

A file is a run of frames. A frame is

    length      unsigned 64-bit, little-endian: bytes of the payload
    check       masked crc32 of those eight bytes, unsigned 32-bit
    payload
    check       masked crc32 of the payload, unsigned 32-bit

and a payload is the document id (signed 64-bit) followed by its token ids, two
bytes each where the vocabulary fits into them and four otherwise; the index says
which. A null id is written as the least signed number, and one byte after the token ids, which
makes the length odd, says so. The checksum is CRC-32 as zlib has it, rotated right by 15 bits with a constant added,
so that a checksum over data that itself holds checksums stays sound.

The index is a Parquet table with one row for each record: file, byte offset, frame
bytes, id width, token count, tokens before it in its shard. Its rows are what makes
a file part of the data set: a task that runs twice leaves a second file which no row
names. Reading goes by index rows, in any order and by any number of tasks.

Null text is empty text; repeated rows are written again; an empty table gives an
empty index; further columns are ignored; rows without doc_id come first and are read back without one.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barquet.llm.tokens import encoder, in_groups

# Fixed value: the mask of checksums in record files.
MASK = 0xA282EAD8
FILE_BYTES = 256 << 20
NO_ID, NO_ID_MARK = struct.pack("<q", -(1 << 63)), b"\0"

INDEX = (
    "shard int, file string, position long, frame_bytes long, doc_id long, id_bytes int, "
    "n_tokens long, first_token long"
)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join(
        (head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload)))
    )


def payload_of(data: bytes) -> bytes:
    """The payload of one frame; raises ValueError if a length or checksum is wrong."""
    if len(data) < 16:
        raise ValueError("short frame")
    (length,), head = struct.unpack_from("<Q", data), data[:8]
    if struct.unpack_from("<I", data, 8)[0] != masked(head) or len(data) != length + 16:
        raise ValueError("broken frame head")
    payload = data[12 : 12 + length]
    if struct.unpack_from("<I", data, 12 + length)[0] != masked(payload):
        raise ValueError("broken payload")
    return payload


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.record_batch(
        [pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)],
        names=[n for n, _ in fields],
    )


def write(docs: DataFrame, folder: str, tokenizer: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every document, write record files in ascending doc_id order and the
    index under `folder` (a URI all executors reach), and return the index."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, coder = TaskContext.get().partitionId(), encoder(tokenizer)
        width = 2 if coder.vocabulary <= 1 << 16 else 4
        store, root = _store(folder)
        out, name, position, before = None, "", 0, 0
        try:
            for batch in batches:
                ids = batch.column("doc_id")
                for first, group in in_groups(batch.column("text")):
                    rows = []
                    for i, coded in enumerate(coder.encode(group), first):
                        if out is None or position >= file_bytes:
                            if out is not None:
                                out.close()
                            name = f"records-{worker:06d}-{uuid.uuid4().hex}.rec"
                            out, position = store.open_output_stream(f"{root}/{name}"), 0
                        n, doc_id = len(coded) // 4, ids[i].as_py()
                        if width == 2:
                            coded = np.frombuffer(coded, "<u4").astype("<u2").tobytes()
                        data = frame(NO_ID + coded + NO_ID_MARK if doc_id is None else struct.pack("<q", doc_id) + coded)
                        out.write(data)
                        rows.append((worker, name, position, len(data), doc_id, width, n, before))
                        position += len(data)
                        before += n
                    yield _arrow(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    # The row number splits even a third of all rows with one doc_id.
    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(shard, INDEX).write.mode("errorifexists").parquet(f"{folder}/index")
    return index(docs.sparkSession, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index, with each record's tokens before it in all shards."""
    rows = spark.read.parquet(f"{folder}/index")
    # One row for each shard: the running total stays small.
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select(
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start")
    )
    return rows.join(F.broadcast(before), "shard").withColumn(
        "start", F.col("shard_start") + F.col("first_token")
    )


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digests(indexed: DataFrame, folder: str) -> DataFrame:
    """Every record read from its file by its index row, checked, and its ids digested."""
    return _read(indexed, folder, READ, lambda doc_id, start, ids: (
        doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
    ))


def _read(indexed: DataFrame, folder: str, schema: str, row) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    if source is not None:
                        source.close()
                    name = r["file"]
                    source = store.open_input_file(f"{root}/{name}")
                payload = payload_of(source.read_at(r["frame_bytes"], r["position"]))
                (doc_id,) = struct.unpack_from("<q", payload)
                if len(payload) % 2:
                    doc_id, payload = None, payload[: -len(NO_ID_MARK)]
                ids = np.frombuffer(payload, f"<u{r['id_bytes']}", offset=8)
                if doc_id != r["doc_id"] or len(ids) != r["n_tokens"]:
                    raise ValueError(f"{name} at {r['position']}: not the record of the index")
                rows.append(row(doc_id, r["start"], ids))
            yield _arrow(rows, schema)
        if source is not None:
            source.close()

    return indexed.select(
        "file", "position", "frame_bytes", "doc_id", "id_bytes", "n_tokens", "start"
    ).mapInArrow(read, schema)
