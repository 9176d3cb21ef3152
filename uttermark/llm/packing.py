"""Best-fit packing of documents into bins under conflicts of source and of duplicate cluster."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.llm.common import ascii_lower, staged, text_of


def _numbers(values: list) -> list[int]:
    """A bit for each value; none for null, which conflicts with nothing."""
    known: dict = {}
    return [0 if v is None else 1 << known.setdefault(v, len(known)) for v in values]


def _shared(values: list) -> list:
    """The values that occur more than once; a value of one row only cannot conflict."""
    seen, twice = set(), set()
    for v in values:
        (twice if v in seen else seen).add(v)
    return [v if v in twice else None for v in values]


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(first full bin, full bins, bin, offset) of each item, in the order given, and the number of bins.

    Open bins are kept in the order of their residual, ties by age.  For each item the search starts at the
    tightest bin that holds it and goes on to the next residual until neither the source bitmap nor the
    cluster bitmap of the bin meets the item's; if no bin is left a new one opens.  An item larger than a
    bin fills bins of its own and packs the rest.
    """
    source_bits, cluster_bits = _numbers(_shared(sources)), _numbers(_shared(clusters))
    order: list[tuple[int, int]] = []
    held_sources: dict[int, int] = {}
    held_clusters: dict[int, int] = {}
    placed, bins = [], 0
    for size, source, cluster in zip(sizes, source_bits, cluster_bits):
        full = (size - 1) // capacity if size > capacity else 0
        first, bins = bins, bins + full
        rest = size - full * capacity
        at = bisect_left(order, (rest, -1))
        while at < len(order) and (held_sources[order[at][1]] & source or held_clusters[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            residual, chosen = order.pop(at)
        else:
            residual, chosen, bins = capacity, bins, bins + 1
            held_sources[chosen] = held_clusters[chosen] = 0
        placed.append((first, full, chosen, capacity - residual))
        held_sources[chosen] |= source
        held_clusters[chosen] |= cluster
        if residual > rest:
            insort(order, (residual - rest, chosen))
    return placed, bins


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    capacity: int = 8192,
    per_shard: int = 4096,
    cluster_col: str | None = None,
) -> DataFrame:
    """(doc_id, size, first_full_bin, full_bins, bin_id, bin_offset), one row per row of ``docs``.

    ``size`` is the UTF-8 bytes of the text and one for the separator (null texts: 1); bins hold ``capacity``
    bytes.  No bin holds two documents of one source, nor two of one cluster: ``cluster_col`` if given, else
    texts equal after lower-casing A-Z.  Null sources, null clusters and empty texts conflict with nothing.  A document above the
    capacity fills ``full_bins`` bins of its own from ``first_full_bin`` on, and its rest goes to ``bin_id``.

    Rows are dealt by the hash of their id and text into shards of about ``per_shard`` rows, packed each on its own
    in the order of falling size, then of the id, nulls first; a shard can leave a few bins half empty,
    whatever the number of rows.  A source or an id (null, say) that holds a third of all rows spreads over all
    shards alike, and so do rows that repeat both id and text.  Rows that repeat an id are packed each.  An empty table gives an empty result.
    """
    text = text_of(text_col)
    cluster = F.when(F.length(text) > 0, F.xxhash64(ascii_lower(text))) if cluster_col is None else F.col(cluster_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(cluster).alias("cluster") if cluster_col else cluster.alias("cluster"),
        F.xxhash64(F.col(id_col), text).alias("mark"),
    )
    slim = staged(slim, "pack-items")
    total = slim.count()
    shards = max(1, -(-total // per_shard))
    # Rows that repeat id and text can't be told apart, so where they are very many any of them may go anywhere.
    often = slim.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(per_shard, total // 256))
    heavy = [r["mark"] for r in often.select("mark").collect()]  # at most 256

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, sizes = table.column("doc_id").to_pylist(), table.column("size").to_pylist()
        sources, clusters = table.column("source").to_pylist(), table.column("cluster").to_pylist()
        rows = sorted(
            range(len(ids)),
            key=lambda i: (-sizes[i], ids[i] is not None, 0 if ids[i] is None else ids[i], sources[i] or "", clusters[i] or 0),
        )
        placed, _ = best_fit([sizes[i] for i in rows], [sources[i] for i in rows], [clusters[i] for i in rows], capacity)
        base = key[0].as_py() << 32
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(pa.array(rows, pa.int64())),
                "size": pa.array([sizes[i] for i in rows], pa.int64()),
                "first_full_bin": pa.array([base + p[0] if p[1] else None for p in placed], pa.int64()),
                "full_bins": pa.array([p[1] for p in placed], pa.int64()),
                "bin_id": pa.array([base + p[2] for p in placed], pa.int64()),
                "bin_offset": pa.array([p[3] for p in placed], pa.int64()),
            }
        )

    kind = slim.schema["doc_id"].dataType.simpleString()
    salt = F.when(F.col("mark").isin(heavy), F.monotonically_increasing_id()).otherwise(0) if heavy else F.lit(0)
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("mark", salt), F.lit(shards))).drop("mark")
    schema = f"doc_id {kind}, size long, first_full_bin long, full_bins long, bin_id long, bin_offset long"
    return dealt.groupBy("shard").applyInArrow(run, schema).withColumnRenamed("doc_id", id_col)
