"""Line dedup: range-partitioned line hashes, streamed in order, and keep bitmaps in place of text.

Each line with a long enough key becomes a row of 128 hash bits, document and position. The rows are range-partitioned by
hash, document (largest first) and position, so a key that a third of all lines have spreads over many partitions.
A partition streams its rows in order and keeps, per key, no more than the three first documents and the lines of the
second. What it can't settle alone, the key that it starts with and the one that it ends with, it passes on with a summary
of at most three documents for each; the summaries, two keys a partition, are joined by broadcast.

Null or empty text: one empty line, which stays. Null doc_id: such rows are one document, smaller than every other.
Repeated rows: equal rows of one doc_id have equal results, and count as one document. Empty table: no rows. Only doc_id
and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import id_back, staged, with_ids

#: What is stripped from both ends of a line, and the lower-casing of A to Z.
BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
DROP, OPEN, SUMMARY = 0, 1, 2
ROW = "kind byte, a long, b long, doc_id long, mark long, pos int"

#: Keys at the ends of partitions that are broadcast, 32 bytes each.
EDGES = 1 << 18


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).translate(LOWER)


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode())


def _explode(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, rows, pos = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, line in enumerate(text.encode().split(b"\n")):
                    if len(line) >= least and code_points(key := line_key(line)) >= least:
                        h = xxhash.xxh3_128_intdigest(key)
                        a.append(h >> 64)
                        b.append(h & 0xFFFFFFFFFFFFFFFF)
                        rows.append(i)
                        pos.append(k)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), batch.column(0).take(at), batch.column(2).take(at), pa.array(pos, pa.int32())], names=["a", "b", "doc_id", "mark", "pos"])

    return run


class _Stream:
    """Settles the rows of one partition, in order of key, document (descending) and position."""

    def __init__(self, least_docs: int):
        self.least, self.key, self.at_start = least_docs, None, True
        self.out: list[tuple] = []

    def _emit(self, kind: int, docs, marks, pos) -> None:
        if len(docs):
            n = len(docs)
            self.out.append((np.full(n, kind, np.int8), np.full(n, self.key[0]), np.full(n, self.key[1]), docs, marks, pos))

    def _end(self, last: bool) -> None:
        if self.key is not None and (self.at_start or last):
            for rows in self.pending:
                self._emit(OPEN, *rows)
            n = len(self.docs)
            self._emit(SUMMARY, np.array(self.docs, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32))
        if self.key is not None:
            self.at_start = False

    def feed(self, key: tuple, docs, marks, pos) -> None:
        """Rows of one key, all or some of them."""
        if key != self.key:
            self._end(False)
            self.key, self.docs, self.pending = key, [], []
        changed = docs[np.concatenate([[True], docs[1:] != docs[:-1]])]
        for d in changed[: self.least + 1].tolist():
            if len(self.docs) < self.least and d not in self.docs:
                self.docs.append(d)
        if self.at_start:
            self._emit(OPEN, docs, marks, pos)
            return
        rest = docs != self.docs[0]
        rows = docs[rest], marks[rest], pos[rest]
        if len(self.docs) < self.least:
            self.pending.append(rows)
            return
        for x in (*self.pending, rows):
            self._emit(DROP, *x)
        self.pending = []

    def inner(self, a, b, docs, marks, pos, new) -> None:
        """Whole keys, none of which is the partition's first or last."""
        group = np.cumsum(new) - 1
        changed = new | np.concatenate([[True], docs[1:] != docs[:-1]])
        n_docs = np.bincount(group, changed)
        drop = (n_docs[group] >= self.least) & (docs != docs[new][group])
        if drop.any():
            self.out.append((np.full(int(drop.sum()), DROP, np.int8), a[drop], b[drop], docs[drop], marks[drop], pos[drop]))

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*self.out)], names=["kind", "a", "b", "doc_id", "mark", "pos"])
            self.out = []


def _settle(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(least_docs)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, docs, marks, pos = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            bounds = [*np.flatnonzero(new).tolist(), len(a)]
            head, tail = bounds[1], bounds[-2]
            stream.feed((a[0], b[0]), docs[:head], marks[:head], pos[:head])
            if len(bounds) > 2:
                if tail > head:
                    # the key before has ended, so what follows up to the last key is whole
                    stream._end(False)
                    stream.key = None
                    stream.inner(*(x[head:tail] for x in (a, b, docs, marks, pos, new)))
                stream.feed((a[tail], b[tail]), docs[tail:], marks[tail:], pos[tail:])
            yield from stream.taken()
        stream._end(True)
        yield from stream.taken()

    return run


def dropped_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, mark (a hash that tells apart rows of one doc_id), drops: the positions of a document's dropped lines.

    Documents that keep all their lines have no row."""
    rows = with_ids(docs).withColumn("mark", F.xxhash64("text"))
    lines = staged(rows.mapInArrow(_explode(least_chars), "a long, b long, doc_id long, mark long, pos int"), "lines")
    order = [F.col("a"), F.col("b"), F.col("doc_id").desc(), F.col("pos")]
    settled = staged(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_settle(least_docs), ROW), "line-marks")
    # at most two keys a partition, three documents each
    edges = settled.where(F.col("kind") == SUMMARY).groupBy("a", "b").agg(F.max("doc_id").alias("largest"), F.countDistinct("doc_id").alias("n")).where(F.col("n") >= least_docs)
    edges = staged(edges, "edges")
    small = F.broadcast(edges) if edges.count() <= EDGES else edges  # beyond, a join that splits hot keys
    late = settled.where(F.col("kind") == OPEN).join(small, ["a", "b"]).where(F.col("doc_id") < F.col("largest"))
    drops = settled.where(F.col("kind") == DROP).select("doc_id", "mark", "pos").unionByName(late.select("doc_id", "mark", "pos"))
    return drops.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("drops"))


def bitmap(n_lines: int, drops) -> bytes:
    """One bit a line, 1 if it stays, compressed."""
    keep = np.ones(n_lines, bool)
    if drops is not None and len(drops):
        keep[np.asarray(drops)] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def apply_bitmap(text: str, packed: bytes) -> str:
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=len(lines))
    return "\n".join([x for x, k in zip(lines, keep.tolist()) if k])


def _with_drops(docs: DataFrame, least_chars: int, least_docs: int, *extra: str) -> DataFrame:
    drops = dropped_lines(docs, least_chars, least_docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    return rows.withColumn("mark", F.xxhash64("text")).join(drops, ["doc_id", "mark"], "left")


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep (compressed bitmap), kept_sha256 of the lines that stay, for each document.

    Lines whose key has at least least_chars code points and stands in at least least_docs documents go, but in the
    document with the largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, maps, digests = [], [], [], []
            for text, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                packed = bitmap(lines := text.count("\n") + 1, drops)
                n.append(lines)
                dropped.append(len(drops or ()))
                maps.append(packed)
                digests.append(hashlib.sha256((apply_bitmap(text, packed) if drops else text).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary()), pa.array(digests)], names=["doc_id", "n_lines", "n_dropped", "keep", "kept_sha256"])

    out = _with_drops(docs, least_chars, least_docs).select("doc_id", "text", "drops").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, keep binary, kept_sha256 string")
    return out.select(id_back(), "n_lines", "n_dropped", "keep", "kept_sha256")


def without_dropped(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """The documents with the lines that stay: doc_id as a long, null texts empty, other columns as they are."""
    columns = docs.columns
    inner = docs.select([F.col(c).alias(c if c in ("doc_id", "text") else f"other_{i}") for i, c in enumerate(columns)])
    names = inner.columns
    rows = _with_drops(inner, least_chars, least_docs, *(c for c in names if c.startswith("other_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [apply_bitmap(t, bitmap(t.count("\n") + 1, d)) if d else t for t, d in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist())]
            yield batch.select(names).set_column(names.index("text"), "text", pa.array(texts, pa.string()))

    kept = rows.withColumn("doc_id", id_back()).select(*names, "drops").mapInArrow(run, StructType([inner.schema[c] if c not in ("doc_id", "text") else StructField(c, LongType() if c == "doc_id" else StringType()) for c in names]))
    return kept.toDF(*columns)
