"""Harmonic packing: lengths in reciprocal-capacity classes, each class's bins filled with a fixed number of documents.

Whole sequences are cut off a document first; what is left of it, its tail, has class k when it is longer than
capacity / (k + 1) and not longer than capacity / k. A bin of class k takes exactly k tails. What it then has room for
is less than any tail of its class, so the next document that is long enough gives its beginning to fill it, and its
tail gets shorter. Beside the cuts of whole sequences a document is therefore cut once at most, and no piece is shorter
than LEAST because of a cut.

Every task fills its own bins, so nothing is shuffled. Bins that are still open when a task ends are laid end to end;
the task's last sequence alone may be short.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import quoted, slices
from rentloom.llm.pretokens import WordEncoder, WordIds, Words, gather

CAPACITY = 1024
END_ID = 0
END_TEXT = "<|endoftext|>"
LEAST = 16
CACHED_WORDS = 400_000
CHUNK = 1 << 20

COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts as the tokenizers library gives them for name.json. Words are encoded by the same vocabulary's ranks,
    once each; a text that holds the end marker itself goes to the library."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers as P

        self.name, self.library = name, None
        self.words = WordIds(WordEncoder(P.path(f"{name}.tiktoken")), CACHED_WORDS)

    def whole(self, text: str) -> np.ndarray:
        import public_tokenizers as P
        from tokenizers import Tokenizer

        self.library = self.library or Tokenizer.from_file(P.path(f"{self.name}.json"))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        """Each text's ids and the end id."""
        words = Words(column)
        first, many = self.words.of(words.hashes, words.texts)
        many_of = many[words.row]
        ids = gather(self.words.flat, first[words.row], many_of)
        ends = np.concatenate([[0], np.cumsum(many_of)])[words.cut[1:]]
        # np.insert puts each end id before the place given, that is after the text's last id.
        ids = np.insert(ids, ends, END_ID)
        parts = np.split(ids, (ends + np.arange(1, len(ends) + 1))[:-1])
        if END_TEXT.encode() in words.data.tobytes():
            for k, text in enumerate(column.to_pylist()):
                if text and END_TEXT in text:
                    parts[k] = np.append(self.whole(text), np.uint32(END_ID))
        return parts


class Bins:
    """The bins of one task. Pieces are (doc, start, ids as bytes, doc_tokens); ``out`` gathers them with their places."""

    def __init__(self, worker: int, capacity: int = CAPACITY, least: int = LEAST):
        self.capacity, self.least = capacity, least
        self.next = worker << 40
        self.open: dict[int, list[tuple]] = {}
        # Room in bins that have all the tails of their class: (room, sequence, offset), sorted.
        self.room: list[tuple[int, int, int]] = []
        self.out: list[tuple] = []

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _emit(self, piece: tuple, sequence: int, offset: int) -> int:
        doc, start, raw, total = piece
        self.out.append((doc, start, len(raw) // 4, zlib.crc32(raw), total, sequence, offset, raw))
        return offset + len(raw) // 4

    def _close(self, pieces: list[tuple]) -> None:
        sequence, at = self._sequence(), 0
        for p in pieces:
            at = self._emit(p, sequence, at)
        if self.capacity - at >= self.least:
            insort(self.room, (self.capacity - at, sequence, at))

    def _tail(self, piece: tuple) -> None:
        k = self.capacity // (len(piece[2]) // 4)
        own = self.open.setdefault(k, [])
        own.append(piece)
        if len(own) == k:
            del self.open[k]
            self._close(own)

    def _given(self, n: int) -> tuple[int, tuple | None]:
        """How much of a document of n ids goes into a bin with room for it, and into which."""
        exact = bisect_right(self.room, (n, float("inf"))) - 1
        if exact < 0:
            return 0, None
        if self.room[exact][0] == n:
            return n, self.room.pop(exact)
        k = bisect_right(self.room, (n - self.least, float("inf"))) - 1
        if k >= 0:
            return self.room[k][0], self.room.pop(k)
        return (n - self.least, self.room.pop(exact)) if n >= 2 * self.least else (0, None)

    def add(self, doc, ids: np.ndarray) -> None:
        raw, n = ids.astype("<u4", copy=False).tobytes(), len(ids)
        piece = lambda a, b: (doc, a, raw[4 * a : 4 * b], n)
        at, bin_ = self._given(n)
        if bin_ is not None:
            self._emit(piece(0, at), *bin_[1:])
        while n - at >= self.capacity:
            # A tail of a few ids only takes some from the sequence before it.
            short = 0 < (n - at) % self.capacity < self.least and n - at < 2 * self.capacity
            to = at + self.capacity - (self.least if short else 0)
            self._close([piece(at, to)])
            at = to
        if at < n:
            self._tail(piece(at, n))

    def finish(self) -> None:
        """What is left in open bins fills the room there is, then sequences of its own, end to end."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        while rest:
            room, sequence, at = self.room.pop() if self.room else (self.capacity, self._sequence(), 0)
            while rest and room:
                doc, start, raw, total = rest.pop(0)
                n = min(room, len(raw) // 4)
                at = self._emit((doc, start, raw[: 4 * n], total), sequence, at)
                room -= n
                if 4 * n < len(raw):
                    rest.insert(0, (doc, start + n, raw[4 * n :], total))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless left out, ids
    (little-endian uint32).

    A null text is empty and still gives its end id; ids of any type are passed on, null and repeated ones too; other
    columns are not read, so their names can't clash. The number of pieces a document can have has no limit.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = Encoder(), Bins(TaskContext.get().partitionId(), capacity)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in slices(batch, batch.schema.names[1], CHUNK):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.texts(part.column(1)), strict=True):
                    bins.add(doc, ids)
                    if len(bins.out) >= 20_000:
                        yield _batch(bins, kind)
        bins.finish()
        if bins.out:
            yield _batch(bins, kind)

    key = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def _batch(bins: Bins, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*bins.out, strict=True))
        bins.out = []
        types = [kind, *[pa.int64()] * 6, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[: len(names)], types, strict=False)], names=names)

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(task, f"id {key}, {COLUMNS}{', ids binary' * with_ids}").withColumnRenamed("id", id_col)


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """tokens, padded: totals over all sequences, where a sequence of a power of two has no padding."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.expr("bit_count(n) = 1")
    return per.agg(F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))).alias("padded"))


def op9_harmonic_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
