"""Tables behind a service that gives pages: a Python data source for batch and stream reads."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

from uttermark.operators.batching import PermanentError
from uttermark.sources.utterances import PAGE_ROWS

#: (first row, number of rows) to the rows, as dicts.
Fetch = Callable[[int, int], list[dict]]

# Attempts after the first one, and seconds between them.
PAGE_RETRIES, PAGE_PAUSE = 20, 10.0


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


def pages(start: int, end: int, page: int) -> list[Page]:
    """The pages of rows ``start`` to ``end``; none crosses a multiple of ``page``."""
    borders = [start, *range((start // page + 1) * page, end, page), end]
    return [Page(a, b - a) for a, b in zip(borders, borders[1:]) if b > a]


def fetched(fetch: Fetch, page: Page, retries: int, pause: float) -> list[dict]:
    """The rows of a page, tried again while ``fetch`` raises anything but a ``PermanentError``.

    A page that has not as many rows as asked for is tried again too: the service may lag behind its own count.
    """
    for attempt in range(retries + 1):
        try:
            rows = fetch(page.offset, page.length)
            if len(rows) != page.length:
                raise RuntimeError(f"page at {page.offset} has {len(rows)} rows for {page.length}")
            return rows
        except PermanentError:
            raise
        except Exception:  # noqa: BLE001 - any other failure is worth another try
            if attempt == retries:
                raise
            time.sleep(pause)
    raise AssertionError


def page_source(
    name: str,
    fetch: Fetch,
    schema: StructType | str,
    total: Callable[[], int],
    page: int = PAGE_ROWS,
    retries: int = PAGE_RETRIES,
    pause: float = PAGE_PAUSE,
    pages_per_trigger: int = 1000,
) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``; read it with ``spark.read.format(name)`` or ``readStream``.

    Every page is an input partition, fetched by the task that reads it: the driver only asks for the ``total``
    number of rows.  As a stream, the offset is the number of rows read; a trigger takes what was added since
    the last one (from the second trigger of a run on at most ``pages_per_trigger`` pages of it), and a replayed
    trigger fetches the same pages.
    """

    def read(partition: Page, kind: StructType) -> Iterator[pa.RecordBatch]:
        rows = fetched(fetch, partition, retries, pause)
        yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(kind))

    class Reader(DataSourceReader):
        def __init__(self, kind: StructType):
            self.kind = kind

        def partitions(self) -> list[Page]:
            return pages(0, total(), page) or [Page(0, 0)]

        def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
            return read(partition, self.kind) if partition.length else iter(())

    class StreamReader(DataSourceStreamReader):
        def __init__(self, kind: StructType):
            self.kind, self.known = kind, None

        def initialOffset(self) -> dict:
            return {"rows": 0}

        def latestOffset(self) -> dict:
            there = total()
            if self.known is not None:
                there = min(there, self.known + page * pages_per_trigger)
            self.known = there
            return {"rows": there}

        def partitions(self, start: dict, end: dict) -> list[Page]:
            return pages(start["rows"], end["rows"], page)

        def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
            return read(partition, self.kind)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType | str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(schema)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return StreamReader(schema)

    return Source


def read_pages(spark: SparkSession, name: str, fetch: Fetch, schema: StructType | str, total: Callable[[], int], **options) -> DataFrame:
    """All rows behind ``fetch``, a task per page."""
    spark.dataSource.register(page_source(name, fetch, schema, total, **options))
    return spark.read.format(name).load()


def stream_pages(spark: SparkSession, name: str, fetch: Fetch, schema: StructType | str, total: Callable[[], int], **options) -> DataFrame:
    """The rows behind ``fetch`` as a stream that grows with ``total``."""
    spark.dataSource.register(page_source(name, fetch, schema, total, **options))
    stream: DataStreamReader = spark.readStream.format(name)
    return stream.load()
