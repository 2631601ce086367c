"""Orders as lists of key columns: file order, the id's bytes, and columns by number-aware keys, each on top of the last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.staging import staged
from tabulon.functions.text import key_columns

from .table import ORDER, TextTable

ID_BYTES = 32
ID_COLUMN = "_ID"
#: What names of columns with sort keys begin with.
KEY = "_key"


@dataclass(frozen=True)
class Sorted:
    """The sorts that hold, the latest first: (column, descending). The latest decides, ties go to those before it."""

    keys: tuple[tuple[str, bool], ...] = ()
    by_id: bool | None = None  # descending

    def by(self, column: str, descending: bool = False, extract: bool = False) -> Sorted:
        if column == ID_COLUMN and not extract:
            return Sorted((), descending)
        return Sorted(((column, descending), *(k for k in self.keys if k[0] != column)), self.by_id)

    def toggled(self, column: str, extract: bool = False) -> Sorted:
        now = self.by_id if column == ID_COLUMN and not extract else dict(self.keys[:1]).get(column)
        return self.by(column, now is False, extract)

    def cleared(self) -> Sorted:
        return Sorted()

    def prepared(self, table: TextTable) -> tuple[TextTable, list[Column]]:
        """The table with the sorts' keys as columns more, and what to order by; columns that aren't there don't count.
        Added rows (negative numbers) come last unless a column decides."""
        df, out = table.df, []
        for i, (name, down) in enumerate(self.keys):
            if (v := table.value(name)) is not None:
                df, parts = key_columns(df, v, f"{KEY}{i}")
                out += [F.col(c).desc() if down else F.col(c).asc() for c in parts]
        added = (F.col(ORDER) < 0).cast("int")
        if self.by_id is not None:
            key = F.when(added == 0, id_key(table)).otherwise(F.lit(b""))
            out += [added.asc(), key.desc() if self.by_id else key.asc()]
        return table.having(df), [*out, added.asc(), F.abs(ORDER).asc()]


def without_keys(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(KEY)))


def id_key(table: TextTable) -> Column:
    """The first bytes of the id as the file has it: of the column id_bytes, if rows carry edits, else of the field."""
    if "id_bytes" in table.df.columns:
        return F.col("id_bytes")
    v = table.value(ID_COLUMN)
    return F.lit(b"") if v is None else F.substring(F.encode(v, "UTF-8"), 1, ID_BYTES)


def ordered(table: TextTable, by: Sorted) -> DataFrame:
    table, order = by.prepared(table)
    return without_keys(table.df.orderBy(*order))


def page(table: TextTable, by: Sorted, size: int, number: int) -> DataFrame:
    """One page; Spark keeps only its rows and those before it, a task at a time."""
    table, order = by.prepared(table)
    return without_keys(table.df.orderBy(*order).offset(size * number).limit(size))


def positions(df: DataFrame, order: list[Column], name: str = "pos", *keep: str) -> DataFrame:
    """Dense positions in an order, from 0: range partitions, sorted and counted; no window over all rows.

    The sorted table, without its keys, is written before it is counted, so both reads see the same partitions."""
    kept = list(keep) or [c for c in df.columns if not c.startswith(KEY)]
    made = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias("_at")), "positions")
    part = F.shiftright("_at", 33)
    counts = sorted((r["part"], r["n"]) for r in made.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one a partition
    first, total = [], 0
    for p, n in counts:
        first.append((p, total))
        total += n
    starts = made.sparkSession.createDataFrame(first, "_part long, _first long")
    at = (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    return made.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*kept, at)
