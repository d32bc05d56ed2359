"""A feed that is read in pages: as a table, and as a stream that goes on where it stopped."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class PagedFeed(DataSource):
    """A feed of rows that have a place, from 0 on, and keep it.

    Options: schema, page (rows a page), fetcher, the "module:function" that gives the rows of (offset, limit), as tuples
    or as record batches; further options go to it by name. total says how many rows there are; a counter, also a
    "module:function", can say so instead.

    As a table pages are read in parallel where the number of rows is known, else one after the other, up to the first
    page that is empty or short, or to max_rows. As a stream each trigger takes what has come since the last, in pages
    read in parallel; where a feed stands is the stream's checkpoint, so a stream that was stopped goes on there and each
    row comes once. Without total and counter the end is looked for by asking for single rows ever farther on.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _PagedStream(self.options)


class _Feed:
    _OWN = {"schema", "page", "fetcher", "total", "counter", "max_rows"}

    def __init__(self, options):
        self.options = dict(options)

    def _function(self, name: str) -> Callable:
        module, function = self.options[name].split(":")
        found = getattr(importlib.import_module(module), function)
        more = {k: v for k, v in self.options.items() if k not in self._OWN}
        wanted = inspect.signature(found).parameters if more else {}
        return lambda *a: found(*a, **{k: v for k, v in more.items() if k in wanted})

    @property
    def page(self) -> int:
        return int(self.options["page"])

    def known(self) -> int | None:
        """How many rows there are, if that is known."""
        if "total" in self.options:
            return int(self.options["total"])
        return int(self._function("counter")()) if "counter" in self.options else None

    def parts(self, start: int, end: int) -> list[InputPartition]:
        return [InputPartition((k, min(self.page, end - k))) for k in range(start, end, self.page)]


class _PagedReader(_Feed, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        self.total = self.known()
        return [InputPartition(None)] if self.total is None else [InputPartition(p.value[0]) for p in self.parts(0, self.total)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = self._function("fetcher")
        if partition.value is not None:
            yield from fetch(partition.value, min(self.page, self.total - partition.value))
            return
        offset, most = 0, int(self.options.get("max_rows", -1))
        while most < 0 or offset < most:
            limit = self.page if most < 0 else min(self.page, most - offset)
            rows = list(fetch(offset, limit))
            yield from rows
            got = sum(r.num_rows if isinstance(r, pa.RecordBatch) else 1 for r in rows)
            offset += got
            if got < limit:
                return


class _PagedStream(_Feed, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        total = self.known()
        return {"offset": self._end() if total is None else total}

    def _end(self) -> int:
        """The first place without a row: twice as far each time, then halving."""
        fetch = self._function("fetcher")
        there = lambda k: any(True for _ in fetch(k, 1))
        low, high = 0, 1
        if not there(0):
            return 0
        while there(high):
            low, high = high, high * 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        return high

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.parts(start["offset"], end["offset"])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self._function("fetcher")(*partition.value)

    def commit(self, end: dict) -> None:
        pass


def parquet_page(offset: int, limit: int, path: str, columns: str) -> Iterator[pa.RecordBatch]:
    """A fetcher over saved pages: rows of a Parquet table in the order of its files, of the row groups that are asked
    for only. columns are separated by commas."""
    import pyarrow.dataset as ds

    place = 0
    for fragment in ds.dataset(path, format="parquet").get_fragments():
        for group in fragment.split_by_row_group():
            rows = group.metadata.row_group(group.row_groups[0].id).num_rows
            low, high = max(offset, place), min(offset + limit, place + rows)
            if low < high:
                yield from group.to_table(columns=columns.split(",")).slice(low - place, high - low).to_batches()
            place += rows
            if place >= offset + limit:
                return
