"""Bloom filters as tables of 4 KB bit blocks, built and probed with SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_count(rows: int, per_row: int = 16, most: int = 2**30) -> int:
    """Cells of a filter for ``rows`` keys: a power of two, ``most`` at the utmost (2**30 bits are 128 MB)."""
    return min(most, max(2**16, 1 << (max(rows, 1) * per_row - 1).bit_length()))


def cells(key: Column, n_cells: int, probes: int) -> list[Column]:
    """The cells of a key, counted from 1."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(n_cells)) + 1 for i in range(probes)]


def bitmap(frame: DataFrame, cell: str) -> DataFrame:
    """(bucket, bits) with the bits of all cells set; at most ``n_cells / 32768`` rows of 4 KB."""
    return frame.groupBy(F.bitmap_bucket_number(F.col(cell)).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(cell))).alias("bits")
    )


def probe(frame: DataFrame, filter_bits: DataFrame, key: Column, n_cells: int, probes: int, out: str) -> DataFrame:
    """Add ``out``: true where all cells of the key are set.  The filter is broadcast; its size is bounded by ``n_cells``."""
    hits = []
    for i, cell in enumerate(cells(key, n_cells, probes)):
        block = filter_bits.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bits").alias(f"_bits{i}"))
        frame = frame.join(F.broadcast(block), F.bitmap_bucket_number(cell) == F.col(f"_bucket{i}"), "left")
        place = F.bitmap_bit_position(cell)
        byte = F.substring(F.col(f"_bits{i}"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))
        hits.append(F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (place % 8).cast("int")) == 1)
    found = F.lit(True)
    for hit in hits:
        found = found & F.coalesce(hit, F.lit(False))
    names = [f"_{part}{i}" for i in range(probes) for part in ("bucket", "bits")]
    return frame.withColumn(out, found).drop(*names)
