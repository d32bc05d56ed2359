"""Keys that recur across the corpus, found per chunk of documents.

A scan task cuts its rows into chunks of bounded size. Every chunk sends its distinct keys (packed, sorted, by bucket)
through one shuffle and gets back those that recur; no row is sent per key, and a key with any number of holders is one
entry per chunk. A second pass then has each chunk's texts and its recurring keys together.

A chunk is named by its rows and its place, so both passes see the same chunks when the input reads the same rows in the
same order, as a table scan does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import buffer_of, quoted, slices


def bucket_count(docs: DataFrame) -> int:
    """A power of two, twice the shuffle partitions at least, so that buckets stay small as the input grows."""
    return 1 << (2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


def chunk_name(part: pa.RecordBatch, k: int) -> int:
    """A 63-bit name that follows from the ids and texts of a chunk, from its partition and its place k there, so that
    chunks of equal rows have names of their own."""
    total = xxhash.xxh3_64(f"{TaskContext.get().partitionId()} {k} {part.column(0).to_pylist()!r}")
    for column in part.columns[1:]:
        data, at = buffer_of(column)
        total.update(at.tobytes())
        total.update(np.ascontiguousarray(data))
    return total.intdigest() >> 1


def in_chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(name, rows) of a task's chunks. Two passes over the same scan give the same."""
    k = 0
    for batch in batches:
        for part in slices(batch, batch.schema.names[1], limit):
            yield chunk_name(part, k), part
            k += 1


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as differences, low bytes apart from high ones, compressed."""
    import zstandard

    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(gaps.T).tobytes())


def unpack_keys(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def chunked(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """id, text and chunk: rows tagged with the chunk that they are in."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in in_chunks(batches, limit):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([name] * len(part), pa.int64())], names=["id", "text", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(task, f"id {kind}, text string, chunk long")


def recurring_keys(docs: DataFrame, id_col: str, text_col: str, keys_of: Callable, limit: int, bits: int = 64) -> DataFrame:
    """(chunk, keys): per chunk and bucket the packed keys that recur.

    keys_of(part) gives a sorted array of distinct keys of a chunk, and a mask of those that recur within it. The mask
    travels beside them. Keys have as many bits as given.
    """
    buckets = bucket_count(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in in_chunks(batches, limit):
            keys, twice = keys_of(part)
            if len(keys):
                cut = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << np.uint64(bits - (buckets - 1).bit_length()))
                own = [(b, name, pack_keys(k), np.packbits(t).tobytes()) for b, (k, t) in enumerate(zip(np.split(keys, cut), np.split(twice, cut), strict=True)) if len(k)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*own, strict=True)], names=["bucket", "chunk", "keys", "twice"])

    def meet(table: pa.Table) -> pa.Table:
        names, blobs, marks = table.column("chunk").to_pylist(), table.column("keys"), table.column("twice")
        held = [unpack_keys(b.as_py()) for b in blobs]
        extra = [k[np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(k)).astype(bool)] for k, m in zip(held, marks, strict=True)]
        every = np.sort(np.concatenate([*held, *extra]))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for name, keys in zip(names, held, strict=True):
            at = np.searchsorted(again, keys)
            at[at == len(again)] = 0
            own = keys[again[at] == keys] if len(again) else keys[:0]
            if len(own):
                out.append((name, pack_keys(own)))
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "keys": pa.array([x[1] for x in out], pa.binary())})

    sent = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(send, "bucket long, chunk long, keys binary, twice binary")
    return sent.groupBy("bucket").applyInArrow(meet, "chunk long, keys binary")


def with_recurring(docs: DataFrame, id_col: str, text_col: str, keys_of: Callable, use: Callable, schema: str, limit: int, bits: int = 64) -> DataFrame:
    """use(ids, texts, keys) -> pa.Table for every chunk that has recurring keys: its rows and those keys, sorted."""
    found = recurring_keys(docs, id_col, text_col, keys_of, limit, bits)

    def join(rows: pa.Table, blobs: pa.Table) -> pa.Table:
        if not len(blobs):
            return pa.Table.from_batches([], schema=_empty)
        if not len(rows):
            raise ValueError("a chunk's rows changed between two passes; write the input to a table first")
        keys = np.sort(np.concatenate([unpack_keys(b.as_py()) for b in blobs.column("keys")]))
        return use(rows.column("id").combine_chunks(), rows.column("text").combine_chunks(), keys)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    _empty = to_arrow_schema(kind)
    left = chunked(docs, id_col, text_col, limit).groupBy("chunk")
    return left.cogroup(found.groupBy("chunk")).applyInArrow(join, schema)
