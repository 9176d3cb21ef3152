"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where none is set, a local master gets a temporary folder, as driver and executors are one process;
    on a cluster that is an error, since every machine would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="uttermark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/uttermark/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: short lineage, cheap to scan more than once."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder made for ``new_path``."""
    if not path.startswith(f"{shared_folder(spark)}/uttermark/"):
        raise ValueError(f"not a staged table: {path}")
    remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


@contextmanager
def staged_while(df: DataFrame, label: str, **options: str) -> Iterator[DataFrame]:
    """``staged``, with options of the writer, for a block whose results are all written within it; the folder is removed at its end."""
    spark = df.sparkSession
    path = new_path(spark, label)
    try:
        df.write.options(**options).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        discard(spark, path)
