"""Batch planning and the batch-function seam."""

from __future__ import annotations

import queue
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from uttermark.operators.indexing import batch_ids, first_rows
from uttermark.operators.staging import new_path, staged_while


def longest_first(length: str, key: str) -> list[Column]:
    """Order keys of the longest-first order, ties by key, both ascending."""
    return [-F.col(length), F.col(key)]


def longest(df: DataFrame, n: int, length: str, key: str) -> DataFrame:
    """The ``n`` longest rows."""
    return first_rows(df, n, longest_first(length, key))


def spread_evenly(df: DataFrame, total: Column, by: list[str], out: str) -> DataFrame:
    """Give each row of a group an equal share of the group's ``total``.

    The group sizes are counted (combined before the shuffle) and joined back instead of windowed:
    a window would put a hot group into one task.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__k"))
    return df.join(sizes, by).withColumn(out, total / F.col("__k")).drop("__k")


def share_batches(
    df: DataFrame, size: int, order: list[Column], total: Column, out: str = "transcription_time_s"
) -> DataFrame:
    """Batches of ``size`` rows in ``order``, each row with an even share of its batch's ``total``.

    ``total`` may use ``batch_id``.  A batch is bounded, so a window counts it; the table is numbered once.
    """
    batched = batch_ids(df, size, order)
    return batched.withColumn(out, total / F.count(F.lit(1)).over(Window.partitionBy("batch_id")))


def length_buckets(
    df: DataFrame, key: str, length: str, budget: int, batch: int, order: list[Column]
) -> DataFrame:
    """Split fixed-size batches into buckets under a padded-cost budget.

    Rows of a batch are taken by ascending length; a bucket is closed before the row that would
    bring ``length * rows`` to the budget.  The fold is sequential, but only within a batch of
    ``batch`` rows, so no group grows with the table.  Returns (``batch_id``, ``key``, ``length``,
    ``bucket_id``).
    """
    batched = batch_ids(df.select(key, length), batch, order)
    rows = F.array_sort(F.collect_list(F.struct(F.col(length).alias("len"), F.col(key).alias("key"))))
    start = F.struct(
        F.lit(0).alias("bucket"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("buckets")
    )

    def add(state: Column, row: Column) -> Column:
        full = (row["len"].cast("long") * (state["held"] + 1) >= budget) & (state["held"] > 0)
        bucket = F.when(full, state["bucket"] + 1).otherwise(state["bucket"])
        return F.struct(
            bucket.alias("bucket"),
            F.when(full, 1).otherwise(state["held"] + 1).alias("held"),
            F.array_append(state["buckets"], bucket).alias("buckets"),
        )

    return (
        batched.groupBy("batch_id")
        .agg(rows.alias("rows"))
        .withColumn("buckets", F.aggregate("rows", start, add, lambda state: state["buckets"]))
        .select("batch_id", F.explode(F.arrays_zip("rows", "buckets")).alias("z"))
        .select(
            "batch_id",
            F.col("z.rows.key").alias(key),
            F.col("z.rows.len").alias(length),
            F.col("z.buckets").alias("bucket_id"),
        )
    )


class PermanentError(Exception):
    """Raised by a batch function for a failure that no retry can cure."""


Columns = dict[str, list]
BatchFunction = Callable[[Columns], Columns]
# Scored rows are handed on in frames of about this many rows or bytes.
_OUT_ROWS, _OUT_BYTES = 1024, 16 * 2**20


def _attempt(call: Callable[[], Columns], retries: int, pause: float):
    """(result or None, attempts made, last error or None)."""
    for attempt in range(1, retries + 2):
        try:
            return call(), attempt, None
        except PermanentError as error:
            return None, attempt, str(error)
        except Exception as error:  # noqa: BLE001 - any other failure is worth another try
            last = str(error)
            if attempt <= retries:
                time.sleep(pause)
    return None, retries + 1, last


def cells(column: pa.Array) -> list:
    """A column as the list that a batch function gets.

    Arrays of numbers come as NumPy arrays over the Arrow memory, structs as dicts of such cells; everything
    else as Python values.
    """
    kind = column.type
    if pa.types.is_list(kind) and (pa.types.is_integer(kind.value_type) or pa.types.is_floating(kind.value_type)):
        flat = column.flatten()
        if not flat.null_count:
            values, lengths = flat.to_numpy(), column.value_lengths().to_pylist()
            out, at = [], 0
            for length in lengths:
                out.append(None if length is None else values[at : at + length])
                at += length or 0
            return out
    if pa.types.is_struct(kind):
        fields = {kind.field(i).name: cells(column.field(i)) for i in range(kind.num_fields)}
        return [{name: own[i] for name, own in fields.items()} if held else None for i, held in enumerate(column.is_valid().to_pylist())]
    return column.to_pylist()


def in_completion_order(items: Iterator, call: Callable, window: int) -> Iterator[tuple[object, object, int]]:
    """(item, result, calls in flight when it was started, itself included), as the calls end.

    At most ``window`` calls are in flight.  The next item is taken when there is room for it, so a slow call
    holds back the reading, and no more items are held than calls.
    """
    if window <= 1:
        for item in items:
            yield item, call(item), 1
        return
    ended: queue.SimpleQueue = queue.SimpleQueue()
    held: dict = {}
    with ThreadPoolExecutor(window) as pool:

        def one() -> tuple[object, object, int]:
            future = ended.get()
            item, at = held.pop(future)
            return item, future.result(), at

        for item in items:
            if len(held) == window:
                yield one()
            future = pool.submit(call, item)
            held[future] = (item, len(held) + 1)
            future.add_done_callback(ended.put)
        while held:
            yield one()


def _batches(frames: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows over the borders of Arrow frames; only the last one of a partition can be short."""
    parts: list[pa.RecordBatch] = []
    held = 0
    for frame in frames:
        at = 0
        while at < frame.num_rows:
            part = frame.slice(at, size - held)
            parts.append(part)
            at, held = at + part.num_rows, held + part.num_rows
            if held == size:
                yield parts[0] if len(parts) == 1 else pa.concat_batches(parts)
                parts, held = [], 0
    if parts:
        yield parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value: those of its texts and binaries, eight for any other leaf."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value).cast("long"), F.lit(0))
    if isinstance(kind, T.StructType):
        return reduce(add, [_bytes(value.getField(f.name), f.dataType) for f in kind.fields], F.lit(8).cast("long"))
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.StructType | T.MapType | T.ArrayType):
            return F.coalesce(F.aggregate(value, F.lit(8).cast("long"), lambda sum_, x: sum_ + _bytes(x, kind.elementType)), F.lit(8))
        return 8 + 8 * F.coalesce(F.array_size(value).cast("long"), F.lit(0))
    return F.lit(8).cast("long")


def table_bytes(df: DataFrame) -> int:
    """About the bytes of the table's values, uncompressed; one pass over it."""
    row = reduce(add, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(0).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def _in_turns(df: DataFrame, mapped: Callable[[DataFrame], DataFrame], turns: int) -> DataFrame:
    """``mapped`` of about equal parts of the table, one part after another; the results are stored.

    The table is stored first, a file for each of its partitions, and the files are dealt to the turns.
    """
    spark, out = df.sparkSession, new_path(df.sparkSession, "turns")
    with staged_while(df, "calls", compression="zstd") as rows:
        files = sorted(unquote(file) for file in rows.inputFiles())
        for turn in range(min(turns, len(files))):
            part = mapped(spark.read.schema(rows.schema).parquet(*files[turn::turns]))
            part.write.mode("append").option("compression", "zstd").parquet(out)
    return spark.read.schema(part.schema).parquet(out)


def map_batches(
    df: DataFrame,
    function: BatchFunction,
    adds: list[tuple[str, str]],
    batch_size: int = 64,
    drop: tuple[str, ...] = ("audio",),
    retries: int = 10,
    pause: float = 1.0,
    parallel: int | None = None,
    in_flight: int = 1,
    parallel_by: tuple[str, ...] = (),
    task_bytes: int | None = None,
) -> DataFrame:
    """Run a batch function over column batches inside the partitions.

    ``function`` takes a dict of column lists of ``batch_size`` rows (1 for a row-at-a-time function;
    fewer only at the end of a partition; see ``cells`` for arrays) and returns one with the columns ``adds`` (name, SQL type), in row order.  Each row
    also gets ``transcription_time_s`` (batch time / rows), ``attempts``, ``error`` and ``in_flight``.  A batch that
    still fails keeps its rows with null results, so the loss is visible; ``drop_failed`` removes
    them.  ``parallel`` sets the number of partitions, dealt by the columns ``parallel_by`` if there are any.
    ``task_bytes`` bounds what each of them gets, about: a table of more than ``parallel`` times as much goes through
    the same number of partitions in turns, one after another, so that there are never more calls at once.  It is measured
    first, and where that takes more than one turn the calls are made here and their results stored (types that
    Parquet holds).  ``in_flight`` is the number of calls that each of them
    keeps going at once, for functions that wait for a service: retries hold their place among them, rows come
    back in the order in which calls end, and the column says how many were going when a row's call was started.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    extra = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in adds)).fields
    accounting = T.StructType.fromDDL("transcription_time_s double, attempts int, error string, in_flight int").fields
    schema = T.StructType([*kept, *extra, *accounting])
    arrow_schema = to_arrow_schema(schema)
    kept_names, added = [f.name for f in kept], [f.name for f in extra]

    def scored(batch: pa.RecordBatch) -> tuple:
        columns = {name: cells(batch.column(i)) for i, name in enumerate(batch.schema.names)}
        began = time.perf_counter()
        result, attempts, error = _attempt(lambda: function(columns), retries, pause)
        return result, time.perf_counter() - began, attempts, error

    def gathered(done: list[tuple]) -> pa.RecordBatch:
        """One frame from some scored batches."""
        own: Columns = {f.name: [] for f in arrow_schema if f.name not in kept_names}
        for batch, (result, seconds, attempts, error), going in done:
            rows = batch.num_rows
            new: Columns = {name: [None] * rows if result is None else list(result[name]) for name in added}
            wrong = {name: len(values) for name, values in new.items() if len(values) != rows}
            if wrong:
                raise ValueError(f"the batch function got {rows} rows and gave {wrong}")
            share = None if result is None else seconds / rows
            new |= {"transcription_time_s": [share] * rows, "attempts": [attempts] * rows, "error": [error] * rows, "in_flight": [going] * rows}
            for name, values in new.items():
                own[name] += values
        table = done[0][0] if len(done) == 1 else pa.concat_batches([batch for batch, *_ in done])
        arrays = [table.column(f.name).cast(f.type) if f.name in kept_names else pa.array(own[f.name], f.type) for f in arrow_schema]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        rows = size = 0
        for batch, outcome, going in in_completion_order(_batches(frames, batch_size), scored, in_flight):
            slim = batch.select(kept_names)
            done.append((slim, outcome, going))
            rows, size = rows + slim.num_rows, size + slim.nbytes
            if rows >= _OUT_ROWS or size >= _OUT_BYTES:
                yield gathered(done)
                done, rows, size = [], 0, 0
        if done:
            yield gathered(done)

    def mapped(part: DataFrame) -> DataFrame:
        source = part.repartition(parallel, *parallel_by) if parallel else part
        return source.mapInArrow(run, schema)

    turns = -(-table_bytes(df) // (parallel * task_bytes)) if parallel and task_bytes else 1
    return mapped(df) if turns <= 1 else _in_turns(df, mapped, turns)


def drop_failed(df: DataFrame, result: str = "predictions") -> DataFrame:
    """Rows whose batch function gave a result."""
    return df.where(F.col(result).isNotNull())


def failure_report(df: DataFrame, by: list[str], result: str = "predictions") -> DataFrame:
    """Rows kept and dropped, and attempts made, per group."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(result).isNotNull()).alias("kept"),
        F.count_if(F.col(result).isNull()).alias("dropped"),
        F.max("attempts").alias("max_attempts"),
    )


# Below this many seconds the scorer is not asked, and its answer is this.
SHORTEST_SCORED_SECONDS = 0.160
TOO_SHORT_ANSWER = "."


def too_short(seconds: Column) -> Column:
    return seconds < SHORTEST_SCORED_SECONDS
