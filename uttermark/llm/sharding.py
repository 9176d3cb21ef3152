"""Sharding by bytes: histogram sort over an ordered hash key, with one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttermark.llm.common import staged, text_of

KEY_BITS, STEP = 60, 12


def _hash(*columns: Column) -> Column:
    """60 bits of a hash as a number that is never negative."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - KEY_BITS)


def _histogram(keys: DataFrame, part: str, level: int, within: list[tuple[int, ...]]) -> list:
    """Exact bytes and rows of each probe interval one level below the intervals ``within``.

    ``part`` 'a': intervals of the text key, as (prefix,); 'b': of the id key below one text key, as
    (text key, prefix).  At most 2**STEP rows come back for each of the open intervals, of which there are
    fewer than shards.
    """
    shift = KEY_BITS - STEP * (level + 1)
    cell = F.shiftright(F.col(part), shift).alias("cell")
    parent = F.shiftright(F.col(part), min(shift + STEP, 63))
    if part == "a":
        if level:
            keys = keys.where(parent.isin([p for (p,) in within]))
        group = [cell]
    else:
        wanted = F.lit(False)
        for a, p in within:
            wanted = wanted | ((F.col("a") == a) & (parent == p))
        keys, group = keys.where(wanted), [F.col("a"), cell]
    bounds = [F.min("a").alias("low"), F.max("a").alias("high")] if part == "a" else []
    return keys.groupBy(*group).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *bounds).collect()


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Lower bounds (a, b) of shards 1.. in the key order, each within ``tolerance`` of a shard's bytes if rows allow.

    Every round counts the exact bytes below all probes and keeps, for each boundary, the interval that
    holds it; the next round probes that interval alone.  An interval that holds one text only, as that of
    a hot group of copies, is split further by the ids of its rows.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = {j: total * j / shards for j in range(1, shards)}
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    # Boundary -> (part, level, interval, bytes below the interval)
    open_at = {j: ("a", 0, (0,), 0) for j in targets}
    while open_at:
        rounds: dict[tuple, dict[tuple, list[int]]] = {}
        for j, (part, level, interval, _) in open_at.items():
            rounds.setdefault((part, level), {}).setdefault(interval, []).append(j)
        following = {}
        for (part, level), intervals in rounds.items():
            rows = _histogram(keys, part, level, list(intervals))
            for interval, boundaries in intervals.items():
                inside = sorted(
                    (r for r in rows if (r["cell"] >> STEP, *((r["a"],) if part == "b" else ())) == (interval[-1], *interval[:-1])),
                    key=lambda r: r["cell"],
                )
                below = open_at[boundaries[0]][3]
                for row in inside:
                    above = below + row["bytes"]
                    for j in boundaries:
                        if not below <= targets[j] < above:
                            continue
                        shift = KEY_BITS - STEP * (level + 1)
                        edge = (lambda c: (c << shift, 0)) if part == "a" else (lambda c, a=interval[0]: (a, c << shift))
                        last = part == "b" and shift == 0
                        if min(targets[j] - below, above - targets[j]) <= slack or row["n"] == 1 or last:
                            nearer = row["cell"] if targets[j] - below <= above - targets[j] else row["cell"] + 1
                            found[j] = edge(nearer)
                        elif part == "a" and row["low"] == row["high"]:
                            following[j] = ("b", 0, (row["low"], 0), below)
                        else:
                            following[j] = (part, level + 1, (*interval[:-1], row["cell"]), below)
                    below = above
        open_at = following
    return [found.get(j, (0, 0)) for j in sorted(targets)]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002) -> DataFrame:
    """All rows and columns of ``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``; law: bytes.

    Rows are ordered by the hash of their text, then of their id and text, and cut where the bytes (UTF-8 bytes of
    the text plus 8, null texts 8) are nearest to equal shares.  Equal texts lie together; only a group that
    holds a boundary is cut.  ``slot`` counts from 0 without gaps, in the order of the second hash, so that
    copies do not follow one another.  Counting goes by intervals of that order, which no text, source or id
    can make hot, and their offsets are a table of bounded size.  Rows that repeat id and text lie in one
    shard in slots that may be exchanged.  Columns that bear the names of the new ones, in any case, are
    replaced.  Null ids are an id of their own.  An empty table gives an empty result.
    """
    fields = [F.col(f"`{name}`").alias(f"_c{i}") for i, name in enumerate(docs.columns)]
    wide = docs.select(
        *fields,
        F.col(id_col).alias("_id"),
        (F.octet_length(text_of(text_col)) + 8).cast("long").alias("size"),
        F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
        _hash(text_of(text_col)).alias("a"),
        _hash(F.col(id_col), text_of(text_col)).alias("b"),
    )
    keys = staged(wide.select("size", "a", "b"), "shard-keys")
    at = F.lit(0)
    for a, b in splitters(keys, shards, tolerance):
        at = at + ((F.col("a") > a) | ((F.col("a") == a) & (F.col("b") >= b))).cast("int")
    fine = min(12, max(0, (keys.count() // (shards * 2000)).bit_length()))
    bin_ = F.shiftright(F.col("b"), KEY_BITS - fine)
    counts = keys.groupBy(at.alias("shard"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "bin").orderBy("b", "_id", "a", "text_crc32")
    placed = wide.withColumn("shard", at).withColumn("bin", bin_)
    placed = placed.withColumn("rank", F.row_number().over(order)).join(F.broadcast(offsets), ["shard", "bin"])
    new = {"size", "text_crc32", "shard", "slot"}
    return placed.select(
        *[F.col(f"_c{i}").alias(name) for i, name in enumerate(docs.columns) if name.lower() not in new],
        "size",
        "text_crc32",
        "shard",
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
    )
