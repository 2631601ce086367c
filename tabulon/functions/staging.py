"""Tables written to the folder that a cluster shares, to cut lineage or to fix a partitioning."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode only, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tabulon.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set("tabulon.shared.dir", found)
    return found.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may have ended
        pass


def put_blocks(spark: SparkSession, path: str, blocks: Iterable[bytes]) -> None:
    """Blocks on end as one file, through the file system that holds the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    for block in blocks:
        out.write(bytearray(block))
    out.close()


def written_text(spark: SparkSession, name: str, text: str) -> str:
    """A text as a file of its own folder in the shared one, through the file system that holds it; gives its path."""
    folder = f"{shared_folder(spark)}/tabulon/file-{uuid.uuid4().hex}"
    put_blocks(spark, f"{folder}/{name}", [text.encode()])
    atexit.register(_drop, spark, folder)
    return f"{folder}/{name}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df as a table written to the shared folder: it cuts lineage and survives lost executors. It goes when the process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tabulon/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # type: ignore[attr-defined]
    return out


def drop_staged(df: DataFrame) -> None:
    """Removes a staged table early, once nothing reads it any more."""
    if path := getattr(df, "_staged_path", None):
        _drop(df.sparkSession, path)
