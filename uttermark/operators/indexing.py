"""Dense row numbers and limits that never put a whole group into one task, whatever the ties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

# A limit looks at this many rows at the utmost with the top-k operator; until then it cuts the rows down by counts.
TOP_ROWS = 100_000
_SAMPLE_PER_BUCKET = 20
_MOST_BUCKETS = 2_000
_SELECT_BUCKETS = 256


def tie_break(df: DataFrame, ties: list[str] | None = None) -> Column:
    """A hash of the columns ``ties``; of the whole row where none are named (but for map columns, which have no order)."""
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)] if ties is None else ties
    return F.xxhash64(*[F.col(f"`{name}`") for name in names]) if names else F.lit(0).cast("long")


def _key(order: list[Column], ties: Column) -> Column:
    """The order columns and the tie-break as one comparable value; nulls come first, as in an ascending sort."""
    return F.struct(*[o.alias(f"o{i}") for i, o in enumerate([*order, ties])])


def _constant(value, df: DataFrame, key: Column) -> Column:
    """A collected key value as a literal of the key's type."""
    fields = df.select(key.alias("k")).schema["k"].dataType.fields
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(value, fields)])


def _ordinals(order: list[Column]) -> Column:
    return F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])


def _cut_points(df: DataFrame, key: Column, buckets: int) -> tuple[list, list]:
    """At most ``buckets - 1`` keys that split the rows about evenly, and those among them that very many rows share.

    They come from the rows with the smallest key hashes, a uniform sample of fixed size, so the driver holds a
    bounded list whatever the table size.  They steer balance only: any cut points give the same numbers.  Rows of
    one key have one hash, so the sample takes a second hash, of the key and the partition, to draw them in proportion.
    """
    wanted = buckets * _SAMPLE_PER_BUCKET
    sample = (
        df.select(key.alias("k"))
        .withColumn("hash", F.xxhash64("k", F.monotonically_increasing_id()))
        .orderBy("hash")
        .limit(wanted)
        .agg(F.array_sort(F.collect_list("k")).alias("ks"))
        .select(
            F.transform(
                F.sequence(F.lit(1), F.lit(buckets - 1)),
                lambda i: F.get("ks", (i * F.size("ks") / buckets).cast("int")),
            ).alias("cuts"),
        )
        .select(
            F.array_distinct(F.filter("cuts", lambda c: c.isNotNull())).alias("cuts"),
            F.filter("cuts", lambda c: c.isNotNull()).alias("all"),
        )
    ).first()
    if len(sample["cuts"]) == len(sample["all"]):
        return sample["cuts"], []
    times: dict = {}
    for cut in sample["all"]:
        times[tuple(cut)] = times.get(tuple(cut), 0) + 1
    return sample["cuts"], [cut for cut in sample["cuts"] if times[tuple(cut)] > 1]


def _bucket(key: Column, cuts: Column, count: int) -> Column:
    """Number of cut points at or below ``key``, by binary search."""
    steps = [1 << b for b in reversed(range(count.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= count) & (F.get(cuts, at + step - 1) <= key), at + step
        ).otherwise(at),
    )


def dense_index(
    df: DataFrame, by: list[str], order: list[Column], out: str = "idx", buckets: int | None = None, ties: list[str] | None = None
) -> DataFrame:
    """Number the rows of each ``by`` group 0, 1, 2, ... (``bigint``) in ascending ``order``, ties by a hash of the row.

    ``ties`` names columns that tell rows of one order key apart, so that the other columns are not read to find
    the ranges; by default all do.

    The table is cut into ranges of (order, group, row hash): each (group, range) is numbered on its own and
    shifted by the rows of the ranges before it.  Any group, however hot, is spread over all ranges, and so are
    the rows that share an order key.  Rows equal in every column can't be told apart: where the sample shows
    that very many are, they are counted instead of gathered, and their numbers written out from the count.
    The input is read three times (sample, range counts, numbers), so pass a stored table (see ``staging.staged``).
    """
    spark = df.sparkSession
    buckets = buckets or min(_MOST_BUCKETS, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    broken = tie_break(df, ties)
    # The group follows the order: ranges cut between groups too where many groups share few order keys.
    key = _key([*order, *[F.col(f"`{c}`") for c in by]], broken)
    points, heavy = _cut_points(df, key, buckets)
    # One constant array; it is folded into the plan as a literal.
    cuts = F.array(*[_constant(point, df, key) for point in points]) if points else F.array()
    place = _bucket(key, cuts, len(points)) if points else F.lit(0)
    # The rows of a heavy key are a range of their own, before the others of its bucket.
    is_heavy = F.coalesce(F.array_contains(F.array(*[_constant(point, df, key) for point in heavy]), key), F.lit(False)) if heavy else F.lit(False)
    placed = df.withColumn("__range", 2 * place + F.when(is_heavy, 0).otherwise(1))
    # One struct, whose null fields are equal, so that the join below finds the rows as the window has left them.
    placed = placed.withColumn("__group", F.struct(*[F.col(f"`{c}`") for c in by], "__range"))
    group = [*by, "__range"]
    before = Window.partitionBy(*[F.col(f"`{c}`") for c in by] or [F.lit(0)]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per (group, range): small next to the data, and combined before the shuffle.
    shift = (
        placed.groupBy(*[F.col(f"`{c}`") for c in group])
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(F.struct(*[F.col(f"`{c}`") for c in group]).alias("__own"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )

    def shifted(rows: DataFrame) -> DataFrame:
        return rows.join(shift, rows["__group"] == shift["__own"]).select(
            *[rows[f"`{c}`"] for c in df.columns], (F.col("__at") + F.col("__shift")).cast("long").alias(out)
        )

    within = Window.partitionBy("__group")
    light = placed.where(F.col("__range") % 2 == 1) if heavy else placed
    numbered = shifted(light.withColumn("__at", F.row_number().over(within.orderBy(*order, broken)) - 1))
    if not heavy:
        return numbered
    counted = placed.where(F.col("__range") % 2 == 0).groupBy(*[F.col(f"`{c}`") for c in placed.columns]).agg(F.count(F.lit(1)).alias("__n"))
    # Different rows whose keys and hashes are equal follow one another.
    earlier = F.coalesce(F.sum("__n").over(within.orderBy(*order, broken).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.withColumn("__first", earlier)
    block = 65_536
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("__n") - 1), F.lit(block).cast("long"))))
    spread = blocks.repartition(*[F.col(f"`{c}`") for c in by], "__block") if by else blocks.repartition("__block")
    copies = spread.withColumn("__i", F.explode(F.sequence(F.col("__block"), F.least(F.col("__block") + block, F.col("__n")) - 1)))
    return numbered.unionByName(shifted(copies.withColumn("__at", F.col("__first") + F.col("__i"))))


@dataclass(frozen=True)
class Cut:
    """Where a limit ends: the key of the last row, and how many of the rows with that very key still belong."""

    order: list[Column]
    ties: list[str] | None
    last: tuple | None
    copies: int

    def reach(self, df: DataFrame) -> Column:
        """Condition on the order columns alone that no row of the limit misses: one that a scan can push down."""
        if self.last is None:
            return F.lit(False)
        if len(self.order) == 1 and self.last[0] is not None:
            return self.order[0].isNull() | (self.order[0] <= F.lit(self.last[0]))
        own = _ordinals(self.order)
        return own <= _constant(self.last[:-1], df, own)

    def rows(self, df: DataFrame) -> DataFrame:
        """The rows of the limit, in no order.  Rows with the key of the last one are equal, so any of them will do."""
        if self.last is None:
            return df.where(F.lit(False))
        key = _key(self.order, tie_break(df, self.ties))
        last = _constant(self.last, df, key)
        near = df.where(self.reach(df))
        return near.where(key < last).unionByName(near.where(key.eqNullSafe(last)).limit(self.copies))


def cut(df: DataFrame, n: int, order: list[Column], ties: list[str] | None = None) -> Cut:
    """The ``n``-th row in ``order``, ties by a hash of the row or of the columns ``ties``.

    Exact at any ``n``: while more than ``TOP_ROWS`` rows are asked for, the rows are counted by ranges of the key,
    and only the range that holds the ``n``-th is looked at further; what is then left is found by the top-k
    operator.  All on the keys alone; the driver gets a bounded number of cut points and counts.
    """
    keys, key = df.select(_key(order, tie_break(df, ties)).alias("k")), F.col("k")
    while n > TOP_ROWS:
        points, _ = _cut_points(keys, key, _SELECT_BUCKETS)
        if not points:
            break
        cuts = F.array(*[_constant(point, keys, key) for point in points])
        place = _bucket(key, cuts, len(points))
        # The rows of a cut point are a range of their own, so every round leaves some out.
        placed = keys.withColumn("b", 2 * place + F.when(F.get(cuts, place - 1).eqNullSafe(key), 0).otherwise(1))
        counted = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
        before = 0
        for r in sorted(counted.collect(), key=lambda r: r["b"]):
            if before + r["n"] >= n:
                break
            before += r["n"]
        else:
            return Cut(order, ties, tuple(r["high"]), before)  # fewer rows than asked for: all of them
        n -= before
        if r["low"] == r["high"]:
            return Cut(order, ties, tuple(r["low"]), n)
        keys = placed.where(F.col("b") == r["b"]).select("k")
    found = keys.orderBy("k").limit(n).groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(key.desc()).first()
    return Cut(order, ties, None, 0) if found is None else Cut(order, ties, tuple(found["k"]), found["n"])


def first_rows(df: DataFrame, n: int | None, order: list[Column], ties: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in ``order``, ties by a hash of the row; ``None`` or a value below 1 means all.

    The result is a filter by the ``n``-th key.  A bare ``orderBy().limit()`` is not enough: the
    optimizer moves later projections below the limit, where the top-k operator is no longer recognised,
    and the whole table gets sorted.  The rows come in no order; ``ties`` as in ``dense_index``.
    """
    return df if n is None or n <= 0 else cut(df, n, order, ties).rows(df)


def batch_ids(df: DataFrame, size: int, order: list[Column], by: list[str] | None = None, out: str = "batch_id") -> DataFrame:
    """Fixed-size batches over the chosen order: ``floor(index / size)``."""
    indexed = dense_index(df, by or [], order, "__at")
    return indexed.withColumn(out, F.expr(f"__at div {int(size)}")).drop("__at")
