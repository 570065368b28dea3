"""A history that an endpoint serves page by page, as a Spark data source: one partition for each page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Row = tuple
#: An endpoint gives the rows (hour, close, volume) of some hours from a first one on.
Endpoint = Callable[[int, int], list[Row]]
SCHEMA = "h bigint, close double, volume bigint"


class EndpointError(RuntimeError):
    """An endpoint that doesn't answer, or not in the agreed form."""


def reference_series(first: int, count: int) -> list[Row]:
    """A made-up series that is the same everywhere: values follow from the hour alone."""
    return [(h, 100 + h * 37 % 101 / 10, h * 13 % 97) for h in range(first, first + count)]


def silent(first: int, count: int) -> list[Row]:
    raise TimeoutError("no answer")


def malformed(first: int, count: int) -> list[Row]:
    return [(str(h), None) for h in range(first, first + count)]


ENDPOINTS: dict[str, Endpoint] = {"reference": reference_series, "silent": silent, "malformed": malformed}


def checked(rows: list[Row], first: int, count: int) -> list[Row]:
    """The rows, if they are (int, float, int) for exactly the hours asked for."""
    if [x[0] for x in rows] != list(range(first, first + count)) or any(len(x) != 3 or not isinstance(x[1], float) or not isinstance(x[2], int) for x in rows):
        raise EndpointError("the answer isn't in the agreed form")
    return rows


def fetch(names: list[str], first: int, count: int, tries: int = 2) -> list[Row]:
    """The page from the first endpoint that serves it in form; each is asked ``tries`` times."""
    errors = []
    for name in names:
        for _ in range(tries):
            try:
                return checked(ENDPOINTS[name](first, count), first, count)
            except Exception as e:  # whatever an endpoint does, the next is asked
                errors.append(f"{name}: {e}")
    raise EndpointError("; ".join(errors))


class Page(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__(first)
        self.first, self.count = first, count


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.names = options["endpoints"].split(",")
        self.start, self.end, self.page = (int(options[k]) for k in ("start", "end", "page"))

    def partitions(self) -> list[Page]:
        return [Page(h, min(self.page, self.end - h)) for h in range(self.start, self.end, self.page)] or [Page(self.start, 0)]

    def read(self, partition: Page) -> Iterator[Row]:
        yield from fetch(self.names, partition.first, partition.count) if partition.count else ()


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def history(spark: SparkSession, start: int, end: int, page: int = 1000, endpoints: tuple[str, ...] = ("reference",)) -> DataFrame:
    """Hours start to end (exclusive). A page whose endpoints all fail fails the read; an empty range has no rows."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_history").options(start=start, end=end, page=page, endpoints=",".join(endpoints)).load()
