"""Even work for jobs that cost far more per byte than a shuffle does."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a small scan over all cores; leave a large one alone.

    A file is read by at least one task per split, so a table with fewer splits than cores leaves
    cores idle, and its shuffle is small by the same token.  A table with enough splits keeps them:
    no shuffle.  ``keys`` should identify a row, so that long and hot rows scatter.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() > 2 * cores else scan.repartition(2 * cores, *keys)
