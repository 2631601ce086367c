"""Concatenate and cut: token ids of all documents form one stream, cut into fixed windows.

Pass one encodes each document once, counts tokens per partition and writes the ids beside each document's place in its
partition. The totals, one number per partition, are summed on the driver to offsets; pass two adds the offset to each
document's place and cuts at multiples of the window. There is no shuffle, and no task holds more than a batch.

Null text: empty, so only the separator is packed. Null doc_id stays null. Empty table: no rows. Repeated rows and ids:
each row is packed by itself. Only the key and the text column are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, staged, with_ids
from .tokens import ByteEncoder

#: Rows of a table of offsets, one per partition of the first pass; beyond this the join isn't broadcast.
BROADCAST_PARTITIONS = 200_000


def encode_pass(docs: DataFrame, tokenizer: str, ranks: str, separator: int) -> DataFrame:
    """part, before (tokens of the part before this document), doc_id, n, ids (little-endian unsigned 16- or 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.of(tokenizer, ranks)
        part, before = TaskContext.get().partitionId(), 0
        end = np.array([separator], encoder.dtype)
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(1).slice(at, 512).to_pylist()
                packed = [np.concatenate([x, end]).tobytes() for x in encoder.encode_all(texts)]
                n = np.fromiter((len(x) for x in packed), np.int64, len(packed)) // encoder.width
                place = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), part, np.int64)), pa.array(place), ids.slice(at, 512), pa.array(n), pa.array(packed, pa.binary())], names=["part", "before", "doc_id", "n", "ids"])

    return with_ids(docs).mapInArrow(run, "part long, before long, doc_id long, n long, ids binary")


def padded_length(n: int, window: int = 1024) -> int:
    """The stored length of a sequence of n tokens: the window, but a power of two stays as it is."""
    return n if n & (n - 1) == 0 else window


def cut(start: int, ids: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """start in the document, length, CRC of the ids as unsigned 32-bit, sequence, offset; start: of the document in the stream."""
    raw = memoryview(ids.astype("<u4").tobytes())
    at, n = 0, len(ids)
    while at < n:
        sequence, offset = divmod(start + at, window)
        length = min(n - at, window - offset)
        yield at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), sequence, offset
        at += length


def pack(docs: DataFrame, tokenizer: str, ranks: str, window: int = 1024, separator: int = 0) -> DataFrame:
    """Boundary records of the packed stream: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer, ranks: files of one vocabulary, for the tokenizers and the tiktoken library. Every document's ids are
    followed by the separator. Only the last sequence of all can be shorter than the window."""
    spark = docs.sparkSession
    width = ByteEncoder.of(tokenizer, ranks).dtype
    encoded = staged(encode_pass(docs, tokenizer, ranks, separator), "pack")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total")).orderBy("part").collect()  # a row per partition
    sums = np.concatenate([[0], np.cumsum([r.total for r in totals], dtype=np.int64)])
    offsets = spark.createDataFrame([(int(r.part), int(s)) for r, s in zip(totals, sums)], "part long, offset long")
    offsets = F.broadcast(offsets) if len(totals) <= BROADCAST_PARTITIONS else offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, n, start, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                out += [(doc, a, b, c, n, d, e) for a, b, c, d, e in cut(start, np.frombuffer(raw.as_buffer(), width), window)]
            for at in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[at : at + 50_000])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = encoded.join(offsets, "part").select("doc_id", "n", (F.col("before") + F.col("offset")).alias("start"), "ids")
    pieces = placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.select(id_back(), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
