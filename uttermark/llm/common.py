"""Helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermark.operators.staging import shared_folder, staged

__all__ = ["UPPER", "LOWER", "ascii_lower", "attach", "documents", "kept_columns", "staged", "checkpointed", "text_of"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str) -> Column:
    """The text, null as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def kept_columns(df: DataFrame, *replaced: str) -> list[Column]:
    """The columns of ``df`` but those whose names, in any case, an operator is about to write."""
    gone = {name.lower() for name in replaced}
    return [df[f"`{name}`"] for name in df.columns if name.lower() not in gone]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def attach(rows: DataFrame, table: DataFrame, key: str, uses: str, total: int, share: int = 256) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per ``key``) that a hot key cannot slow.

    ``table[uses]`` counts the rows that hold the key, ``total`` all rows.  At most ``share`` keys can hold
    a ``share``-th of all rows each: that proves the bound of what is broadcast.  The other keys meet in a
    shuffle join whose groups are smaller than that.
    """
    least = max(total // share, 1000)
    heavy = F.broadcast(table.where(F.col(uses) >= least).drop(uses))
    light = table.where(F.col(uses) < least).drop(uses)
    rare = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rare.join(light, key))
