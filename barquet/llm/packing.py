"""Harmonic packing: documents into sequences of a fixed capacity.

Lengths fall into classes by the reciprocal of the capacity: class k holds the
pieces of which k, but not k + 1, fill a sequence, and a bin of class k takes k
pieces. No bin looks at another, so every worker fills its own.

* A document is cut greedily into the largest pieces of an exact reciprocal length
  (1024, 512, 341, 256, ...) until at most `REST` tokens are left, which make the
  last piece. Exact pieces fill their bins to within k - 1 tokens.
* First pass: a worker fills the bins of its own rows, class by class. What is left
  are fewer than k pieces for each class and worker.
* Second pass: those are numbered through all workers (counts by worker and class,
  summed up), and every k of a class form a bin. That leaves fewer than k pieces for
  each class in all: at most a few thousand, whatever the input.
* These few are packed first fit by falling length.

Null text is empty text, which still has its end id. Repeated rows are packed like
any others, an empty table gives no rows, further columns are ignored. A sequence is
padded to the capacity, unless its length is a power of two.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet.llm.tokens import encoder, in_groups
from barquet.session import materialize

CAPACITY = 1024
REST = 64

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "klass int, worker int, local_rank long, sequence_id long, offset long"
)

# Bins of the first pass are numbered worker * 2**32 + n, later ones from here on.
_SECOND, _THIRD = 1 << 61, 1 << 62


def cut(length: int, capacity: int = CAPACITY, rest: int = REST) -> list[int]:
    """Piece lengths of a document, in order; they sum up to its length."""
    parts = [capacity] * (length // capacity)
    left = length % capacity
    while left > rest:
        parts.append(capacity // -(-capacity // left))
        left -= parts[-1]
    return parts + [left] * (left > 0)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, rest: int = REST) -> DataFrame:
    """Pieces of every document with the bins of the first pass; open ones have none."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, coder = TaskContext.get().partitionId(), encoder(tokenizer)
        names = [f.split()[0] for f in PIECE.split(", ")]
        kinds = {"klass": pa.int32(), "worker": pa.int32()}
        schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])
        open_bins: dict[int, list[list]] = defaultdict(list)
        bins = 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for first, group in in_groups(texts):
                out = []
                for i, coded in enumerate(coder.encode(group), first):
                    n, start, doc_id = len(coded) // 4, 0, ids[i].as_py()
                    for part in cut(n, capacity, rest):
                        crc = zlib.crc32(coded[4 * start : 4 * (start + part)])
                        k = capacity // part
                        held = open_bins[k]
                        held.append([doc_id, start, part, crc, n, k, worker, None, None, None])
                        start += part
                        if len(held) == k:
                            offset = 0
                            for row in held:
                                row[8:] = (worker << 32) + bins, offset
                                offset += row[2]
                            bins += 1
                            out += held
                            held.clear()
                yield _batch(out, schema)
        out = []
        for held in open_bins.values():
            for rank, row in enumerate(held):
                row[7] = rank
                out.append(row)
        yield _batch(out, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        fill, PIECE
    )


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.record_batch(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
    )


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, the lengths falling."""
    room: list[int] = []
    placed = []
    for n in lengths:
        b = next((i for i, free in enumerate(room) if free >= n), len(room))
        if b == len(room):
            room.append(capacity)
        placed.append((b, capacity - room[b]))
        room[b] -= n
    return placed


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, rest: int = REST) -> DataFrame:
    """One row for each piece: where it comes from, and its sequence and offset there."""
    cut_rows = materialize(pieces(docs, tokenizer, capacity, rest), "pieces")
    done = cut_rows.filter("sequence_id is not null").select(*RESULT)
    left = cut_rows.filter("sequence_id is null")
    # Ranks of the open pieces through all workers: one row for each worker and class.
    counts = left.groupBy("klass", "worker").agg(F.count("*").alias("n"))
    before = counts.select(
        "klass", "worker",
        (F.sum("n").over(Window.partitionBy("klass").orderBy("worker")) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("klass")).alias("total"),
    )
    ranked = left.join(before, ["klass", "worker"]).withColumn(
        "rank", F.col("before") + F.col("local_rank")
    )
    full = F.col("rank") < F.col("total") - F.col("total") % F.col("klass")
    bin_of = F.floor(F.col("rank") / F.col("klass")).cast("long")
    second = ranked.filter(full).withColumn(
        "sequence_id", F.lit(_SECOND) + F.col("klass").cast("long") * F.lit(1 << 44) + bin_of
    )
    in_bin = Window.partitionBy("sequence_id").orderBy("rank")
    second = second.withColumn(
        "offset", F.sum("length").over(in_bin) - F.col("length")
    ).select(*RESULT)

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "descending") for c in ("length", "doc_id", "start", "ids_crc32")])
        placed = first_fit(group["length"].to_pylist(), capacity)
        out = group.select(RESULT[:5])
        return out.append_column("sequence_id", pa.array([_THIRD + b for b, _ in placed], pa.int64())
                                 ).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    # Fewer than k pieces of each class are left here, whatever the input.
    third = (
        ranked.filter(~full).select(*RESULT[:5]).groupBy()
        .applyInArrow(place, ", ".join(PIECE.split(", ")[:5]) + ", sequence_id long, offset long")
    )
    return done.unionByName(second).unionByName(third)


RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
