"""Exports: rows as lines of CSV, TSV, JSON or the sectioned format, in one file or as text for the clipboard.

Lines are made by Spark; the driver writes them to one file in order, partition by partition, or, where one file isn't
needed, Spark writes part files in order."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date
from typing import BinaryIO, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.staging import put_blocks
from tabulon.functions.text import csv_field, csv_value, tsv_field, tsv_value
from tabulon.sources.files import FileBytes, files_of
from tabulon.sources.layout import DATA_END, Layout

from .predicates import Filters
from .table import TextTable

PREVIEW_ROWS, CLIPBOARD_ROWS = 2, 100_000
FORMATS = ("dif", "csv", "tsv", "json")
COPIED = 1 << 20


def csv_line(fields: Column) -> Column:
    return F.concat_ws(",", F.transform(fields, csv_field))


def tsv_line(fields: Column) -> Column:
    return F.concat_ws("\t", F.transform(fields, tsv_field))


def dif_line(fields: Column, delimiter: str) -> Column:
    return F.concat_ws(delimiter, fields)


def json_line(fields: Column, names: tuple[str, ...]) -> Column:
    """An object of a row: names without a field are left out, fields without a name, too. Names may repeat."""
    quoted = F.transform(fields, _json_text)
    labels = F.array(*(F.lit(json.dumps(n, ensure_ascii=False) + ":") for n in names))
    n = F.least(F.size(fields), F.lit(len(names)))
    pairs = F.zip_with(F.slice(labels, 1, n), F.slice(quoted, 1, n), lambda a, b: F.concat(a, b))
    return F.concat(F.lit("{"), F.concat_ws(",", pairs), F.lit("}"))


def _json_text(x: Column) -> Column:
    whole = F.to_json(F.struct(x.alias("a")))  # {"a":...}
    return whole.substr(F.lit(6), F.length(whole) - 6)


class Format(Protocol):
    """What an export format gives: bytes before and after, and a line for each row."""

    def begin(self) -> Iterator[bytes]: ...

    def line(self, table: TextTable) -> Column: ...

    def between(self) -> str: ...

    def end(self, rows: int) -> Iterator[bytes]: ...


class Csv:
    def __init__(self, names: tuple[str, ...]):
        self.names = names

    def begin(self) -> Iterator[bytes]:
        yield (",".join(map(csv_value, self.names)) + "\r\n").encode()

    def line(self, table: TextTable) -> Column:
        return F.concat(csv_line(table.fields), F.lit("\r\n"))

    def between(self) -> str:
        return ""

    def end(self, rows: int) -> Iterator[bytes]:
        yield b""


class Tsv(Csv):
    def begin(self) -> Iterator[bytes]:
        yield ("\t".join(map(tsv_value, self.names)) + "\n").encode()

    def line(self, table: TextTable) -> Column:
        return F.concat(tsv_line(table.fields), F.lit("\n"))


class Json(Csv):
    def begin(self) -> Iterator[bytes]:
        yield b"["

    def line(self, table: TextTable) -> Column:
        return json_line(table.fields, self.names)

    def between(self) -> str:
        return ","

    def end(self, rows: int) -> Iterator[bytes]:
        yield b"]"


class Dif(Csv):
    """The source file's bytes around the rows. Of a file with several sections only the file's head, the section's own
    block and what follows the last section are kept; counts of records stay as they were."""

    def __init__(self, layout: Layout, section: int):
        self.layout, self.section = layout, layout.sections[section]

    def _bytes(self, start: int, end: int) -> Iterator[bytes]:
        with FileBytes(self.layout.path) as f:
            while start < end:
                block = f.read(start, min(COPIED, end - start))
                if not block:
                    return
                yield block
                start += len(block)

    def begin(self) -> Iterator[bytes]:
        if self.layout.is_bulk:
            yield from self._bytes(0, self.layout.sections[0].block_start)
            yield from self._bytes(self.section.block_start, self.section.data_start)
        else:
            yield from self._bytes(0, self.section.data_start)

    def line(self, table: TextTable) -> Column:
        return F.concat(dif_line(table.fields, self.layout.delimiter), F.lit(self.layout.line_end))

    def end(self, rows: int) -> Iterator[bytes]:
        if self.layout.is_bulk:
            yield DATA_END + self.layout.line_end.encode()
            yield from self._bytes(self.layout.trailer_start, self.layout.size)
        else:
            yield from self._bytes(self.section.data_end, self.layout.size)


def format_of(name: str, table: TextTable) -> Format:
    if name == "dif":
        if table.layout is None:
            raise ValueError("only rows of a sectioned file can go to that format")
        return Dif(table.layout, table.section)
    return {"csv": Csv, "tsv": Tsv, "json": Json}[name](table.names)


def export(table: TextTable, order: list[Column], form: Format, out: BinaryIO, most: int | None = None) -> int:
    """Writes rows in an order to one stream; holds one partition of lines at a time. Gives their number."""
    lines = table.df.orderBy(*order)
    lines = (lines if most is None else lines.limit(most)).select(form.line(table).alias("line"))
    for block in form.begin():
        out.write(block)
    rows, comma = 0, form.between().encode()
    for r in lines.toLocalIterator(prefetchPartitions=True):
        if rows and comma:
            out.write(comma)
        out.write(r["line"].encode())
        rows += 1
    for block in form.end(rows):
        out.write(block)
    return rows


def export_parts(table: TextTable, order: list[Column], form: Format, folder: str) -> None:
    """The rows' lines as part files written by Spark's tasks, between the files "head" and "tail"; in order by name.

    Without a separator between rows the files on end are the bytes of export(). JSON has one object a line, head and tail
    left out, as only whole lines can be made apart from each other."""
    sep = form.layout.line_end if isinstance(form, Dif) else "\n" if isinstance(form, Tsv | Json) else "\r\n"
    line = form.line(table)
    line = line if form.between() else line.substr(F.lit(1), F.length(line) - len(sep))
    table.df.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("line")).write.option("lineSep", sep).text(folder)
    if not form.between():
        spark = table.df.sparkSession
        put_blocks(spark, f"{folder}/head", form.begin())
        put_blocks(spark, f"{folder}/tail", form.end(0))


def joined_parts(folder: str, out: BinaryIO) -> None:
    """The files of export_parts on end, copied in blocks."""

    def place(name: str) -> tuple:
        number = re.match(r"part-(\d+)", name)
        return (1, int(number[1])) if number else (0 if name == "head" else 2, 0)

    for name in sorted(files_of(folder), key=place):
        with FileBytes(f"{folder}/{name}") as f:
            at = 0
            while block := f.read(at, COPIED):
                out.write(block)
                at += len(block)


def preview(table: TextTable, order: list[Column], form: Format) -> bytes:
    import io

    out = io.BytesIO()
    export(table, order, form, out, PREVIEW_ROWS)
    return out.getvalue()


def export_sections(views: list, form: str, opened) -> list[int]:
    """Every row of each section, whatever the views' filters; their sorts by id and edits hold. opened(i): a stream."""
    done = []
    for i, v in enumerate(views):
        t = Filters().apply(v.resolved())
        by_id = type(v.sort)((), v.sort.by_id)
        with opened(i) as out:
            t, order = by_id.prepared(t)
            done.append(export(t, order, format_of(form, t), out))
    return done


def clipboard(table: TextTable, order: list[Column], form: str, columns: list[str] | None = None, headers: bool = True) -> tuple[str, bool]:
    """Text of rows, and whether rows beyond the limit were left out. Short rows are filled with blanks, lines end in a newline."""
    names = tuple(columns or table.names)
    cells = F.array(*(v if (v := table.value(n)) is not None else F.lit("") for n in names))
    line = json_line(cells, names) if form == "json" else dif_line(cells, table.layout.delimiter if table.layout else "|") if form == "dif" else {"csv": csv_line, "tsv": tsv_line}[form](cells)
    rows = [r["line"] for r in table.df.orderBy(*order).limit(CLIPBOARD_ROWS + 1).select(line.alias("line")).collect()]
    cut, rows = len(rows) > CLIPBOARD_ROWS, rows[:CLIPBOARD_ROWS]
    if form == "json":
        return "[" + ",".join(rows) + "]", cut
    if headers:
        sep, quote = {"csv": (",", csv_value), "tsv": ("\t", tsv_value)}.get(form, (table.layout.delimiter if table.layout else "|", str))
        rows = [sep.join(map(quote, names)), *rows]
    return "".join(x + "\n" for x in rows), cut


def base_name(path: str) -> str:
    """The file's name without a date and a format at its end."""
    name = re.split(r"[/\\]", path)[-1]
    return re.sub(r"(?i)\.(dif|out|csv|tsv|json|txt)$", "", re.sub(r"\.[0-9]{8}$", "", name))


def file_name(path: str, form: str, day: date, section: str | None = None) -> str:
    safe = "_" + "".join(c if c.isalnum() or c in "-_" else "_" for c in section).strip("_") if section and section.strip() else ""
    return f"{base_name(path)}{safe}.{form}.{day:%Y%m%d}"
