"""Overlapping chunk plans and the merge of chunk texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from uttermark.functions.answers import Fold, overlap_chars

# Seconds of a chunk, of its overlap, and the length up to which nothing is cut.
CHUNK_SECONDS, OVERLAP_SECONDS, WHOLE_UP_TO_SECONDS = 25, 5, 30


def _repeated(kind: str) -> Column:
    return F.raise_error(F.lit("two chunks of one parent have the same index")).cast(kind)


def chunk_spans(length: Column, size: int, overlap: int, whole_up_to: int) -> Column:
    """Array of (idx, start, end), end exclusive; one span when the length is at most ``whole_up_to``."""
    step = size - overlap
    starts = F.when(length > whole_up_to, F.sequence(F.lit(0).cast("long"), length - 1, F.lit(step).cast("long")))
    cut = F.transform(
        starts,
        lambda start, i: F.struct(i.alias("idx"), start.alias("start"), F.least(start + size, length).alias("end")),
    )
    whole = F.array(
        F.struct(F.lit(0).alias("idx"), F.lit(0).cast("long").alias("start"), length.alias("end"))
    )
    return F.coalesce(cut, whole)


def chunk_plan(
    df: DataFrame,
    length: str,
    rate: int = 16_000,
    chunk: float = CHUNK_SECONDS,
    overlap: float = OVERLAP_SECONDS,
    whole_up_to: float = WHOLE_UP_TO_SECONDS,
) -> DataFrame:
    """One row per chunk: the input columns plus ``chunk_idx``, ``chunk_start``, ``chunk_end``."""
    spans = chunk_spans(F.col(length).cast("long"), int(chunk * rate), int(overlap * rate), int(whole_up_to * rate))
    return df.select("*", F.explode(spans).alias("__c")).select(
        *df.columns,
        F.col("__c.idx").alias("chunk_idx"),
        F.col("__c.start").alias("chunk_start"),
        F.col("__c.end").alias("chunk_end"),
    )


def regroup_chunks(chunks: DataFrame, parent: str, idx: str = "chunk_idx", text: str = "chunk_text") -> DataFrame:
    """Chunk texts of each parent in order, as one array.  Two chunks at one place fail."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(text).alias("t"))))
    grouped = chunks.groupBy(parent).agg(pairs.alias("pairs"))
    repeated = F.size(F.array_distinct("pairs.i")) < F.size("pairs")
    texts = F.when(repeated, _repeated("array<string>")).otherwise(F.col("pairs.t"))
    return grouped.select(parent, texts.alias("texts"))


def chunk_pieces(chunks: DataFrame, parent: str, idx: str = "chunk_idx", text: str = "chunk_text") -> DataFrame:
    """What each chunk adds to its left neighbour: its text without the longest suffix of the
    neighbour that it starts with.

    Each chunk is sent to its own index and to the next one, where the two meet as a group of at
    most two rows.  So a parent with very many chunks is spread over all tasks, where a window over
    the parent would hold it in one, and the input is computed once, where a self-join would take
    it twice.  Two chunks of a parent at one place fail, and so does a chunk without a text.
    """
    offset = F.explode(F.array(F.lit(0), F.lit(1))).alias("__offset")
    sent = chunks.select(parent, idx, text, offset).withColumn(idx, F.col(idx) + F.col("__offset"))
    text_at = lambda n: F.max(F.when(F.col("__offset") == n, F.col(text)))
    met = sent.groupBy(parent, idx).agg(text_at(0).alias(text), text_at(1).alias("__left"), F.count_if(F.col("__offset") == 0).alias("__n"))
    lost = F.raise_error(F.lit("a chunk has no text")).cast("string")
    checked = F.when(F.col("__n") > 1, _repeated("string")).when((F.col("__n") == 1) & F.col(text).isNull(), lost).otherwise(F.col(text))
    met = met.withColumn(text, checked).where(F.col(text).isNotNull()).withColumn("overlap", overlap_chars(F.col("__left"), F.col(text)))
    return met.select(parent, idx, "overlap", F.substring(F.col(text), F.col("overlap") + 1, F.length(text)).alias("piece"))


def _folded(chunks: DataFrame, parent: str, idx: str, text: str) -> DataFrame:
    """The fold over partitions sorted by (parent, index), carried across the borders of Arrow frames."""
    rows = chunks.select(F.col(parent).alias("parent"), F.col(idx).alias("idx"), F.col(text).alias("text"))
    rows = rows.repartition("parent").sortWithinPartitions("parent", "idx")
    schema = StructType([rows.schema["parent"]]).add("merged", StringType())
    arrow = to_arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, last, place = None, None, None
        done: tuple[list, list] = ([], [])

        def close() -> None:
            done[0].append(last)
            done[1].append(str(fold))

        for frame in frames:
            for own, at, chunk in zip(*(column.to_pylist() for column in frame.columns)):
                if fold is None or own != last:
                    if fold is not None:
                        close()
                    fold, last, place = Fold(), own, None
                if chunk is None or at is None:
                    raise ValueError(f"a chunk of {own!r} has no text or no index")
                if at == place:
                    raise ValueError(f"two chunks of one parent have the same index: {own!r}, {at!r}")
                fold.add(chunk)
                place = at
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(done, arrow)], schema=arrow)
                done = ([], [])
        if fold is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(done, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("parent", parent)


def merge_chunks(
    chunks: DataFrame, parent: str, idx: str = "chunk_idx", text: str = "chunk_text", mode: str = "overlap"
) -> DataFrame:
    """One text per parent.

    ``overlap`` joins the pieces of ``chunk_pieces``, first in runs of neighbours and then per
    parent, so that the last step of a long parent handles few strings.  ``reference`` folds the
    chunks one after the other, dropping as many leading characters as the longest common substring
    is long; the result of each step feeds the next, so one parent is folded by one task.  Its chunks are not
    gathered: they stream through in order, and what is held is the text so far with the places of its runs of
    letters, or with its automaton where chunks share little (see ``Fold``).
    """
    if mode == "reference":
        return _folded(chunks, parent, idx, text)
    if mode != "overlap":
        raise ValueError(f"unknown mode {mode!r}")

    def joined(order: str, part: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(part).alias("t"))))
        return F.array_join(F.transform(pairs, lambda p: p["t"]), "")

    pieces = chunk_pieces(chunks, parent, idx, text).withColumn("run", F.floor(F.col(idx) / 256))
    runs = pieces.groupBy(parent, "run").agg(joined(idx, "piece").alias("part"))
    return runs.groupBy(parent).agg(joined("run", "part").alias("merged"))
