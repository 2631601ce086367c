"""Tables of text: named columns over rows that may be longer or shorter than the names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from tabulon.sources.datasource import section_fields
from tabulon.sources.layout import Layout, read_layout

ORDER = "row_idx"


@dataclass(frozen=True)
class TextTable:
    """row_idx and either fields (an array) or, for tables made from DataFrames, one column c0, c1, ... a field.

    Single columns let Catalyst read only what an operator uses; arrays keep ragged rows as they are."""

    df: DataFrame
    names: tuple[str, ...]
    uniform: bool = False
    layout: Layout | None = None
    section: int = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, section: int = 0, chunk_bytes: int = 0) -> TextTable:
        layout = read_layout(path)
        if not layout.valid:
            raise ValueError(next(d.message for d in layout.diagnostics if d.severity == "error"))
        return cls.of_section(spark, layout, section, chunk_bytes)

    @classmethod
    def of_section(cls, spark: SparkSession, layout: Layout, section: int = 0, chunk_bytes: int = 0) -> TextTable:
        return cls(section_fields(spark, layout, section, chunk_bytes), layout.sections[section].columns, False, layout, section)

    @classmethod
    def from_dataframe(cls, df: DataFrame, key: str) -> TextTable:
        """Every column as text, nulls as blanks (when they are read, so filters of stored columns reach the scan); key, an integer column without nulls, gives the order of rows."""
        cells = [_as_text(df.schema[c]).alias(f"c{i}") for i, c in enumerate(df.columns)]
        return cls(df.select(F.col(f"`{key}`").cast("long").alias(ORDER), *cells), tuple(df.columns), True)

    def ordinal(self, name: str) -> int:
        """The first column of that very name, or -1."""
        return self.names.index(name) if name in self.names else -1

    def cell(self, i: int) -> Column:
        """A column's value; blank where a row is too short."""
        return F.coalesce(F.col(f"c{i}") if self.uniform else F.get("fields", F.lit(i)), F.lit(""))

    def stored(self, i: int) -> Column:
        """A column as it is stored, for conditions that no blank fulfils: null where a value is missing."""
        return F.col(f"c{i}") if self.uniform else self.cell(i)

    def value(self, name: str) -> Column | None:
        return self.cell(i) if (i := self.ordinal(name)) >= 0 else None

    @property
    def fields(self) -> Column:
        return F.array(*(self.cell(i) for i in range(len(self.names)))) if self.uniform else F.col("fields")

    def ragged(self) -> TextTable:
        """With the fields of each row as an array."""
        rest = [c for c in self.df.columns if not (self.uniform and c[0] == "c" and c[1:].isdigit())]
        return TextTable(self.df.select(*rest, self.fields.alias("fields")), self.names, False, self.layout, self.section) if self.uniform else self

    def having(self, df: DataFrame) -> TextTable:
        return TextTable(df, self.names, self.uniform, self.layout, self.section)

    def wide(self, columns: list[str] | None = None) -> DataFrame:
        """row_idx and the columns under their names; a name that stands twice, whatever its case, gets a number."""
        seen: dict[str, int] = {}
        out = []
        for name in columns or self.names:
            if (v := self.value(name)) is not None:
                k = seen[name.lower()] = seen.get(name.lower(), 0) + 1
                out.append(v.alias(name if k == 1 else f"{name}_{k}"))
        return self.df.select(ORDER, *out)

    def detail(self, row: int) -> DataFrame:
        """column, value of one row, in the order of columns (pos); missing fields are blank, extra ones left out."""
        pairs = F.array(*(F.struct(F.lit(n).alias("column"), self.cell(i).alias("value")) for i, n in enumerate(self.names)))
        return self.df.where(F.col(ORDER) == row).select(F.posexplode(pairs).alias("pos", "x")).select("pos", "x.column", "x.value")

    def visible(self, most: int = 20) -> list[str]:
        return list(self.names[:most])

    def columns_matching(self, text: str) -> list[str]:
        return [n for n in self.names if text.lower() in n.lower()]


def _as_text(f: StructField) -> Column:
    """The value as it stands: of doubles the digits that tell them apart, NaN and Infinity by name."""
    return F.col(f"`{f.name}`").cast("string")
