"""Keyed comparison of two tables: a full outer join by key, the last right row of each key against every left row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .table import ORDER, TextTable

DIFFS = "array<struct<column:string,left:string,right:string>>"


@dataclass(frozen=True)
class Comparison:
    entries: DataFrame  # kind, key, left_row, right_row, diffs
    columns: tuple[str, ...]
    missing_left: bool
    missing_right: bool
    duplicates: DataFrame  # one row: left, right

    def summary(self) -> DataFrame:
        """One row: added, removed, changed, unchanged."""
        count = lambda k: F.count_if(F.col("kind") == k).alias(k)
        return self.entries.agg(*(count(k) for k in ("added", "removed", "changed", "unchanged")))

    def extracted(self, kind: str, left: TextTable, right: TextTable) -> TextTable:
        """The rows of one kind: added rows of the right table, others of the left."""
        side, row = (right, "right_row") if kind == "added" else (left, "left_row")
        rows = self.entries.where(F.col("kind") == kind).select(F.col(row).alias(ORDER)).distinct()
        return side.having(side.df.join(rows, ORDER, "left_semi"))

    def warnings(self) -> dict[str, tuple[bool, bool]]:
        """What limits the result, for the left and the right side: missing_key (nothing was compared), repeated_key (the
        last right row of a key was compared)."""
        d = self.duplicates.head()
        return {"missing_key": (self.missing_left, self.missing_right), "repeated_key": (d["left"], d["right"])}


def compared(left: TextTable, right: TextTable, key: str = "_ID") -> Comparison:
    """Left rows are removed, changed or unchanged, each by itself; right keys that no left row has are added.

    Rows stand in the order of the file, added rows (negative numbers) after them."""
    spark = left.df.sparkSession
    columns = tuple(dict.fromkeys(n for n in left.names if n in right.names))
    lk, rk = left.value(key), right.value(key)
    if lk is None or rk is None:
        none = spark.createDataFrame([], f"kind string, key string, left_row long, right_row long, diffs {DIFFS}")
        return Comparison(none, columns, lk is None, rk is None, spark.createDataFrame([(False, False)], "left boolean, right boolean"))
    place = F.struct((F.col(ORDER) < 0).alias("added"), F.abs(ORDER).alias("n"))
    pick = lambda t: F.struct(*(t.value(c).alias(f"v{i}") for i, c in enumerate(columns)))
    l = left.df.select(lk.alias("key"), F.col(ORDER).alias("left_row"), pick(left).alias("l"))
    last = right.df.select(rk.alias("key"), place.alias("place"), F.struct(F.col(ORDER).alias("right_row"), pick(right).alias("r")).alias("x"))
    r = last.groupBy("key").agg(F.max_by("x", "place").alias("x"), F.count("*").alias("n"))
    both = l.join(r.select("key", "x.right_row", "x.r"), "key", "full_outer")
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"l.v{i}").alias("left"), F.col(f"r.v{i}").alias("right")) for i, c in enumerate(columns)))
    matched = F.col("left_row").isNotNull() & F.col("right_row").isNotNull()
    diffs = F.when(matched, F.filter(each, lambda x: x["left"] != x["right"])).otherwise(F.array().cast(DIFFS))
    kind = F.when(F.col("left_row").isNull(), "added").when(F.col("right_row").isNull(), "removed").when(F.size("diffs") > 0, "changed").otherwise("unchanged")
    entries = both.withColumn("diffs", diffs).select(kind.alias("kind"), "key", "left_row", "right_row", "diffs")
    several = lambda d, name: d.agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias(name))
    repeated = several(l.groupBy("key").agg(F.count("*").alias("n")), "left").join(F.broadcast(several(r.select("n"), "right")))
    return Comparison(entries, columns, False, False, repeated)


def changed_cells(found: Comparison) -> DataFrame:
    return found.entries.select("key", "left_row", F.explode("diffs").alias("d")).select("key", "left_row", "d.column", "d.left", "d.right")
