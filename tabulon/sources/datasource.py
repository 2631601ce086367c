"""Spark data source "dif": the raw rows of one section, in partitions of whole lines, as Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import FileBytes
from .layout import Layout

LEAST, MOST, BATCH = 4 << 20, 64 << 20, 1 << 20
SCHEMA = "chunk_id int, pos long, off long, raw string"


@dataclass
class Chunk(InputPartition):
    number: int
    start: int
    end: int


class SectionReader(DataSourceReader):
    """A chunk has the lines that start in its range, so ranges need no look at the file."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.start, self.end = int(options["start"]), int(options["end"])
        self.chunk = max(1, int(options.get("chunkbytes", 0)) or min(MOST, max(LEAST, (self.end - self.start) // 64)))

    def partitions(self) -> list[InputPartition]:
        cuts = [*range(self.start, self.end, self.chunk), self.end]
        return [Chunk(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] or [Chunk(0, self.start, self.start)]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        number, at, pos = partition.number, partition.start, 0
        names = ["chunk_id", "pos", "off", "raw"]
        with FileBytes(self.path) as source:
            carry = b""
            if at > self.start:  # a line that began before belongs to the chunk before
                while at < self.end and source.read(at - 1, 1) != b"\n":
                    block = source.read(at, min(BATCH, self.end - at))
                    found = block.find(b"\n")
                    at += len(block) if found < 0 else found + 1
            where = at  # of the carry's first byte
            while where < partition.end or carry:
                block = source.read(at, min(BATCH, self.end - at))
                at += len(block)
                whole = carry + block
                ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)
                if not block and whole:  # the last line may lack its end
                    ends = np.append(ends, len(whole))
                starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
                inside = int(np.searchsorted(starts + where, partition.end))
                done = int(ends[inside - 1]) + 1 if inside else 0
                carry = whole[done:] if block and inside == len(ends) else b""
                if inside and (n := (found := lines_of(whole, starts[:inside], ends[:inside]))[1].size):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(np.arange(pos, pos + n)), pa.array(found[1] + where), found[0]], names=names)
                    pos += n
                where += done
                if not block or inside < len(ends):
                    break


def lines_of(whole: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lines that aren't blank, without one carriage return at the end, and where they start.

    Valid text becomes an Arrow array by its offsets at once; only a block that isn't valid is decoded line by line."""
    data = np.frombuffer(whole, np.uint8)
    stops = ends - ((ends > starts) & (data[np.maximum(ends, 1) - 1] == 13))
    shown = stops > starts
    try:
        str(whole[: int(ends[-1])], "utf-8")
    except UnicodeDecodeError:
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(starts[shown].tolist(), stops[shown].tolist())], pa.string()), starts[shown]
    kept = np.ones(int(ends[-1]), bool)
    kept[ends[:-1]] = False
    kept[stops[stops < ends]] = False
    sizes = np.concatenate([[0], np.cumsum((stops - starts)[shown])]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes) - 1, pa.py_buffer(sizes), pa.py_buffer(data[: len(kept)][kept])), starts[shown]


class SectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dif"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SectionReader:
        return SectionReader({k.lower(): v for k, v in self.options.items()})


def raw_rows(spark: SparkSession, layout: Layout, section: int = 0, chunk_bytes: int = 0) -> DataFrame:
    """chunk_id, pos, off, raw of a section's rows; blank lines aren't rows, one carriage return before a line's end isn't text."""
    spark.dataSource.register(SectionSource)
    s = layout.sections[section]
    return spark.read.format("dif").options(path=layout.path, start=s.data_start, end=s.data_end, chunkBytes=chunk_bytes).load()


def numbered(rows: DataFrame) -> DataFrame:
    """row_idx, off, raw: dense numbers in file order, from the counts of the chunks, one number each."""
    counts = sorted((r["chunk_id"], r["n"]) for r in rows.groupBy("chunk_id").agg(F.count("*").alias("n")).collect())
    first, total = [], 0
    for chunk, n in counts:
        first.append((chunk, total))
        total += n
    starts = rows.sparkSession.createDataFrame(first, "chunk_id int, first long")
    return rows.join(F.broadcast(starts), "chunk_id").select((F.col("first") + F.col("pos")).alias("row_idx"), "off", "raw")


def section_fields(spark: SparkSession, layout: Layout, section: int = 0, chunk_bytes: int = 0) -> DataFrame:
    """row_idx, raw and fields of a section: rows stay as long as they are, trailing empty fields included.

    Fields are split from raw where they are read; a search of whole lines never splits."""
    rows = numbered(raw_rows(spark, layout, section, chunk_bytes))
    return rows.select("row_idx", "raw", F.split("raw", "\\Q" + layout.delimiter + "\\E", -1).alias("fields"))

