"""Helpers that the corpus operators share: shared-folder tables, Arrow batches, hashing of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.sources.staging import materialize, shared_folder  # noqa: F401

CHUNK_BYTES = 2 << 20


def quoted(name: str) -> str:
    """A column's name as SQL takes it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, name: str = "doc") -> Column:
    """All columns of a frame as one struct, so that columns added beside it can't clash with them."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias(name)


def unpacked(docs: DataFrame, changed: dict[str, Column] | None = None, added: dict[str, Column] | None = None, name: str = "doc") -> list[Column]:
    """The columns of a packed frame again, some of them changed, and new ones. A new column takes the place of one that
    has its name already, in whatever case."""
    changed, added = changed or {}, added or {}
    gone = {c.lower() for c in added}
    kept = [(changed[c] if c in changed else F.col(name).getField(c)).alias(c) for c in docs.columns if c.lower() not in gone]
    return [*kept, *[v.alias(c) for c, v in added.items()]]


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have at most ``limit`` bytes, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    start, total = 0, 0
    for row, n in enumerate(lengths):
        if row > start and total + n > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts (n + 1 offsets). Null counts as empty."""
    column = pa.compute.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    if len(_POWERS.get("up", ())) < max(n, 1):
        size = max(n + n // 8, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch follows; see ``stretch_hash``."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return sums


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], alike for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def every_stretch(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all stretches of n bytes, as ``stretch_hash`` gives them."""
    _, down = powers(len(sums))
    return mix((sums[n:] - sums[:-n]) * down[: len(sums) - n] + np.uint64(n))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def mask_bounds(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes, and each run's row. Runs never cross rows."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.zeros(len(inside) + 1, bool)
    first[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words between ASCII white space, and each word's row. Words never cross rows."""
    return mask_bounds(~((data == 32) | ((data >= 9) & (data <= 13))), at)


def pinned(df: DataFrame, **columns) -> DataFrame:
    """The frame with more columns, each computed once a row: without a generator in between, the optimizer would copy
    the expression into every lambda that uses it."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(F.expr(column) if isinstance(column, str) else column)).alias(name))
    return df
