"""What the operators of this subpackage share: tables and bounded hashing helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.staging import drop_staged, staged  # noqa: F401 - for the operators

#: Stands for a null id inside an operator; results have null again.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_ids(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, under the names doc_id and text: no other column can clash; null ids become NO_ID, null texts empty."""
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def id_back(column: str = "doc_id"):
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x * _A
    x ^= x >> _S32
    x *= _B
    x ^= x >> _S29
    return x


def windows8(data: np.ndarray, room: int = 0) -> np.ndarray:
    """At each byte the little-endian number of the eight bytes from there; zeros follow the end, and room more entries."""
    n = len(data) + room
    padded = np.zeros(n + 8, np.uint8)
    padded[: len(data)] = data
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))).view("<u8").ravel()
