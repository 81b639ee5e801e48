"""Market and macro data providers as Spark data sources: partitioned reads with pushed time and symbol filters, and streams by time.

A provider is a small object that can be pickled. Spark asks it for slices of time and lists of symbols, in as many tasks as
there are slices, so a long history is never fetched in one call. Filters on the time column (all four comparisons) and on
the symbol column (equal, in a list) reach ``fetch``; other filters stay with Spark. Pushing needs
``spark.sql.python.filterPushdown.enabled``; without it the rows are the same.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

_MICRO = dt.timedelta(microseconds=1)
_EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Table:
    """What a provider offers under one name: its schema, and which columns hold a row's time (never NULL) and symbol (None: there is none)."""

    schema: str
    time: str
    symbol: str | None = None


class Provider(Protocol):
    tables: dict[str, Table]

    def span(self, table: str) -> tuple[dt.datetime, dt.datetime] | None:
        """The first and last time of a table's rows now; None without rows."""

    def fetch(self, table: str, symbols: list[str] | None, start: dt.datetime, end: dt.datetime) -> Iterator[pa.RecordBatch]:
        """Rows of [start, end) for some symbols (None: all), as the table's schema has them."""

    def cost(self, table: str, symbols: list[str] | None, start: dt.datetime, end: dt.datetime) -> float:
        """What fetching would cost."""


@dataclass
class Slice(InputPartition):
    start: dt.datetime
    end: dt.datetime
    symbols: list | None


def slices(start: dt.datetime, end: dt.datetime, hours: float, symbols: list | None) -> list[Slice]:
    """[start, end) in steps; nothing for an empty range."""
    step, out = dt.timedelta(hours=hours), []
    while start < end:
        out.append(Slice(start, min(start + step, end), symbols))
        start += step
    return out


class _Reader(DataSourceReader):
    def __init__(self, provider: Provider, table: str, hours: float) -> None:
        self.provider, self.table, self.hours = provider, table, hours
        self.start, self.end, self.symbols = dt.datetime.min, dt.datetime.max, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  (Spark's name)
        shape = self.provider.tables[self.table]
        for f in filters:
            on, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if on == (shape.time,) and isinstance(value, dt.datetime) and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)):
                value = value.replace(tzinfo=None)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.start = max(self.start, value + _MICRO if isinstance(f, GreaterThan) else value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.end = min(self.end, value if isinstance(f, LessThan) else value + _MICRO)
            elif shape.symbol and on == (shape.symbol,) and isinstance(f, (EqualTo, In)):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.symbols = sorted((asked if self.symbols is None else asked & set(self.symbols)) - {None})
            else:
                yield f

    def partitions(self) -> list[Slice]:
        span = self.provider.span(self.table)
        if span is None or self.symbols == []:
            return [Slice(_EPOCH, _EPOCH, [])]
        return slices(max(self.start, span[0]), min(self.end, span[1] + _MICRO), self.hours, self.symbols) or [Slice(_EPOCH, _EPOCH, [])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition.start < partition.end:
            yield from self.provider.fetch(self.table, partition.symbols, partition.start, partition.end)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times: a batch has the rows from the last offset up to the latest time there is. Rows that come later with earlier times are not seen."""

    def __init__(self, provider: Provider, table: str, hours: float) -> None:
        self.provider, self.table, self.hours = provider, table, hours

    def _at(self, last: bool) -> dict:
        span = self.provider.span(self.table)
        return {"at": 0 if span is None else (span[1] - _EPOCH) // _MICRO + 1 if last else (span[0] - _EPOCH) // _MICRO}

    def initialOffset(self) -> dict:  # noqa: N802
        return self._at(last=False)

    def latestOffset(self) -> dict:  # noqa: N802
        return self._at(last=True)

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return slices(*(_EPOCH + dt.timedelta(microseconds=o["at"]) for o in (start, end)), self.hours, None)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        yield from self.provider.fetch(self.table, partition.symbols, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, name: str, provider: Provider) -> None:
    """Makes ``spark.read.format(name).option("table", ...)`` and ``readStream`` read a provider; option ``hours``: the length of a slice (24)."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return provider.tables[self.options["table"]].schema

        def _parts(self) -> tuple:
            return provider, self.options["table"], float(self.options.get("hours", 24))

        def reader(self, schema: object) -> DataSourceReader:
            return _Reader(*self._parts())

        def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
            return _StreamReader(*self._parts())

    spark.dataSource.register(Source)


@dataclass(frozen=True)
class ParquetProvider:
    """A provider over Parquet files in a folder that all executors see, one file or folder a table; row groups outside a slice aren't read."""

    root: str
    tables: dict[str, Table]
    price_a_row: float = 0.0

    def _dataset(self, table: str) -> ds.Dataset:
        return ds.dataset(f"{self.root}/{table}.parquet", format="parquet")

    def _chosen(self, table: str, symbols: list[str] | None, start: dt.datetime, end: dt.datetime) -> ds.Expression:
        shape = self.tables[table]
        chosen = (ds.field(shape.time) >= start) & (ds.field(shape.time) < end)
        return chosen if symbols is None else chosen & ds.field(shape.symbol).isin(symbols)

    def span(self, table: str) -> tuple[dt.datetime, dt.datetime] | None:
        """From the files' statistics: no rows are read."""
        time, lows, highs = self.tables[table].time, [], []
        for part in self._dataset(table).get_fragments():
            at = part.metadata.schema.names.index(time)
            for g in range(part.metadata.num_row_groups):
                stats = part.metadata.row_group(g).column(at).statistics
                if stats is not None and stats.has_min_max:
                    lows.append(stats.min)
                    highs.append(stats.max)
        return (min(lows).replace(tzinfo=None), max(highs).replace(tzinfo=None)) if lows else None

    def fetch(self, table: str, symbols: list[str] | None, start: dt.datetime, end: dt.datetime) -> Iterator[pa.RecordBatch]:
        columns = [c.strip().split()[0] for c in self.tables[table].schema.split(",")]
        for batch in self._dataset(table).to_batches(columns=columns, filter=self._chosen(table, symbols, start, end), batch_size=10_000):
            if len(batch):
                yield batch

    def cost(self, table: str, symbols: list[str] | None, start: dt.datetime, end: dt.datetime) -> float:
        return self.price_a_row * self._dataset(table).count_rows(filter=self._chosen(table, symbols, start, end))
