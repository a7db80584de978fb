"""Paginated market-data endpoints. There is no network here: the page source is an argument, so pages can come from anywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Page = Callable[[int, int, int], list]


def paginate(fetch: Page, start_ms: int, end_ms: int, last_ms: Callable[[object], int], limit: int = 1000, most_calls: int = 20_000) -> Iterator[object]:
    """Rows of fetch(start, end, limit), page after page, each from one millisecond after the last row of the one before."""
    at = start_ms
    for _ in range(most_calls):
        page = fetch(at, end_ms, limit) if at <= end_ms else []
        yield from page
        if len(page) < limit:
            return
        nxt = last_ms(page[-1]) + 1
        if nxt <= at:
            return
        at = nxt


class Span(InputPartition):
    def __init__(self, start_ms: int, end_ms: int) -> None:
        self.start_ms, self.end_ms = start_ms, end_ms


def read_pages(spark: SparkSession, fetch: Page, schema: T.StructType, start_ms: int, end_ms: int, last_ms: Callable[[object], int], span_ms: int = 30 * 86_400_000, limit: int = 1000) -> DataFrame:
    """All rows of an endpoint between two times, both included, as a table: the range is cut into spans, which tasks read side by
    side, page after page. fetch runs in the workers, returns rows (tuples) in order of time, and must be picklable."""

    class PageReader(DataSourceReader):
        def partitions(self) -> list[Span]:
            return [Span(a, min(a + span_ms - 1, end_ms)) for a in range(start_ms, end_ms + 1, span_ms)] or [Span(start_ms, end_ms)]

        def read(self, partition: Span) -> Iterator[tuple]:
            yield from map(tuple, paginate(fetch, partition.start_ms, partition.end_ms, last_ms, limit))

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "barloom_pages"

        def schema(self) -> T.StructType:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return PageReader()

    spark.dataSource.register(PageSource)
    return spark.read.format("barloom_pages").load()
