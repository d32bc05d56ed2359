"""Rows whose key has never been seen, however long ago that was."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PART = 1 << 17


def _firsts(keys: list[str], order: list[str], most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the first row of each key by ``order``, nulls before all else, of a task's rows; with ``most`` a task that
    holds more goes on from there, so that a key may come again."""

    def first(rows: pa.Table) -> pa.Table:
        sorted_ = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        places = sorted_.select(keys).rename_columns([f"k{k}" for k in range(len(keys))]).append_column("at", pa.array(np.arange(len(sorted_))))
        return sorted_.take(places.group_by(places.column_names[:-1], use_threads=False).aggregate([("at", "min")]).column("at_min"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, n = None, [], 0
        for batch in batches:
            more.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n > max(PART, 0 if held is None else len(held)):
                held = first(pa.concat_tables(more if held is None else [held, *more]))
                more, n = [], 0
                if most is not None and len(held) > most:
                    yield from held.to_batches()
                    held = None
        if held is not None or n:
            yield from first(pa.concat_tables(more if held is None else [held, *more])).to_batches()

    return combine


def first_ever(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of a stream whose key is new, one per key: of those in one trigger the first by ``order``, nulls before
    all else. The state grows with the number of keys; see ``state_on_disk``.

    A trigger's rows are cut down to one per key before they meet the state: first where they are read, then where a key's
    rows are together. There a task holds its share of the trigger's keys, so more shuffle partitions hold less each.
    """
    near = stream.mapInArrow(_firsts(keys, order, PART), stream.schema)
    return near.repartition(*keys).mapInArrow(_firsts(keys, order, None), stream.schema).dropDuplicates(keys)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within hold their state in RocksDB, on the executors' disks, with changes in the checkpoint."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
