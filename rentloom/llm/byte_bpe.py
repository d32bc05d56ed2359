"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are split into pre-tokens. A chunk of documents keeps its pre-tokens as positions: for each document the number of
every pre-token, in order, among the chunk's own distinct words, which are sorted by hash. The words go through one
shuffle by ranges of their hash, packed per chunk and range; there each distinct word of the corpus is encoded once, and
its ids go back to every chunk that has it. Each chunk then puts its documents' ids together by position. Decoding joins
the ids so put together with the table of token bytes, which has one row a token and is joined to every chunk whole.

Chunks are made twice, once for the words and once for the positions; both are named alike (see ``chunks``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentloom.llm.chunks import bucket_count, in_chunks
from rentloom.llm.common import prefix_hash, quoted, slices, stretch_hash
from rentloom.llm.pretokens import WordEncoder, WordIds, Words, gather, ranks

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 32 << 20
PART = 2 << 20
CACHED_WORDS = 2_000_000
STEP = 200_000
U = np.uint64


def token_table(path: str) -> list[bytes]:
    """Bytes by id."""
    table = [b""] * (max(ranks(path).values()) + 1)
    for token, rank in ranks(path).items():
        table[rank] = token
    return table


def _default_path() -> str:
    import public_tokenizers as P

    return P.path(RANKS)


def _planes(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(1).compress(raw.tobytes())


def _unplanes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def _bits(buckets: int) -> int:
    return (buckets - 1).bit_length()


class ChunkWords:
    """A chunk's distinct words, sorted by hash, and its rows' pre-tokens as numbers of them. Words are cut PART bytes of
    text at a time."""

    def __init__(self, part: pa.RecordBatch):
        self.parts = [Words(p.column(1)) for p in slices(part, part.schema.names[1], PART)]
        none = np.zeros(0, U)
        every = np.concatenate([none, *[w.hashes for w in self.parts]])
        self.hashes, self.first, self.number = np.unique(every, return_index=True, return_inverse=True)
        self.edges = np.concatenate([[0], np.cumsum([len(w) for w in self.parts])]).astype(np.int64)

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """(how many pre-tokens each row has, all their numbers)."""
        counts = [np.diff(w.cut) for w in self.parts]
        rows = [self.number[a:][w.row] for a, w in zip(self.edges, self.parts, strict=False)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *counts]), np.concatenate([none, *rows])

    def texts(self) -> list[bytes]:
        out: list = [b""] * len(self.hashes)
        for k, w in enumerate(self.parts):
            mine = np.flatnonzero((self.first >= self.edges[k]) & (self.first < self.edges[k + 1]))
            for row, text in zip(mine.tolist(), w.texts(self.first[mine] - self.edges[k]), strict=True):
                out[row] = text
        return out


def word_ids(docs: DataFrame, path: str, chunk: int, buckets: int) -> DataFrame:
    """(chunk, bucket, n, ids): for each chunk's words of a bucket, in the chunk's order, how many ids and which. A bucket
    is read row by row, and holds no more than the ids of CACHED_WORDS words."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in in_chunks(batches, chunk):
            own = ChunkWords(part)
            words = own.texts()
            cut = np.searchsorted(own.hashes, np.arange(1, buckets, dtype=U) << U(64 - _bits(buckets))) if buckets > 1 else []
            edges = [0, *map(int, cut), len(words)]
            out = []
            for bucket, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if b > a:
                    sizes = np.fromiter(map(len, words[a:b]), np.uint32, b - a)
                    out.append((bucket, name, _planes(sizes), zstandard.ZstdCompressor(3).compress(b"".join(words[a:b]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "sizes", "words"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(WordEncoder(path), CACHED_WORDS)
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(_unplanes(row["sizes"]).astype(np.int64))
                raw = zstandard.ZstdDecompressor().decompress(row["words"])
                starts = np.concatenate([[0], ends[:-1]])
                hashes = stretch_hash(prefix_hash(np.frombuffer(raw, np.uint8)), starts, ends)
                first, many = known.of(hashes, lambda which: [raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])  # noqa: B023
                ids = gather(known.flat, first, many)
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([row["bucket"]], pa.int64()), pa.array([_planes(many)]), pa.array([_planes(ids)])], names=["chunk", "bucket", "n", "ids"])

    sent = docs.mapInArrow(send, "bucket long, chunk long, sizes binary, words binary")
    return sent.groupBy("bucket").applyInArrow(encode, "chunk long, bucket long, n binary, ids binary")


def positions(docs: DataFrame, chunk: int) -> DataFrame:
    """One row per chunk: the ids of its documents, how many pre-tokens each has, their word numbers, how many words."""
    kind = docs.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in in_chunks(batches, chunk):
            own = ChunkWords(part)
            counts, rows = own.positions()
            ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), ids, pa.array([_planes(counts)]), pa.array([_planes(rows)]), pa.array([len(own.hashes)], pa.int64())],
                names=["chunk", "docs", "counts", "rows", "words"],
            )

    return docs.mapInArrow(task, f"chunk long, docs array<{kind}>, counts binary, rows binary, words long")


def token_row(spark: SparkSession, path: str) -> DataFrame:
    """The token-byte table as one row (sizes and bytes by id), which as many bytes as the vocabulary has bound."""
    table = token_table(path)
    sizes = np.array(list(map(len, table)), "<u4").tobytes()
    return spark.createDataFrame([(bytearray(sizes), bytearray(b"".join(table)))], "token_sizes binary, token_bytes binary")


class _Strings:
    """Byte strings by number, put one after the other."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes.astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, strings: list[bytes]) -> _Strings:
        return cls(np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings)), np.int64))

    def join(self, numbers: np.ndarray) -> bytes:
        return gather(self.flat, self.first[numbers], self.sizes[numbers]).tobytes()


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK, buckets: int | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and ids (array of int) unless it is left out.

    No special tokens. A null text is empty and has no ids; ids of any type are passed on, null or repeated ones too; other
    columns are not read. buckets is a power of two.
    """
    path, buckets = path or _default_path(), buckets or bucket_count(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    more = ", ids array<int>" if with_ids else ""

    def assemble(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
        order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
        blobs = lambda name: [_unplanes(b.as_py()) for b in answers.column(name).take(pa.array(order))]
        many = np.concatenate([np.zeros(0, np.int64), *blobs("n")]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *blobs("ids")])
        first = np.cumsum(many) - many
        for row in own.to_pylist():
            if row["words"] != len(many):
                raise ValueError("a chunk's rows changed between two passes; write the input to a table first")
            tokens = _Strings(np.frombuffer(row["token_bytes"], np.uint8), np.frombuffer(row["token_sizes"], "<u4"))
            decimal = _Strings.of([b"%d," % k for k in range(len(tokens.sizes))])
            every, cut = _unplanes(row["rows"]), np.concatenate([[0], np.cumsum(_unplanes(row["counts"]).astype(np.int64))])
            # Whole documents, of about STEP pre-tokens at a time.
            doc = 0
            while doc < len(row["docs"]):
                stop = max(doc + 1, int(np.searchsorted(cut, cut[doc] + STEP, "right")) - 1)
                mine = every[cut[doc] : cut[stop]]
                size = many[mine]
                ids = gather(flat, first[mine], size)
                at = np.concatenate([[0], np.cumsum(size)])[cut[doc : stop + 1] - cut[doc]]
                text, raw = decimal.join(ids), tokens.join(ids)
                text_at = np.concatenate([[0], np.cumsum(decimal.sizes[ids])])[at].tolist()
                raw_at = np.concatenate([[0], np.cumsum(tokens.sizes[ids])])[at].tolist()
                out["id"] += row["docs"][doc:stop]
                out["n_tokens"] += np.diff(at).tolist()
                out["ids_sha256"] += [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(text_at, text_at[1:], strict=False)]
                out["decoded_sha256"] += [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(raw_at, raw_at[1:], strict=False)]
                if with_ids:
                    out["ids"] += [ids[a:b].astype(np.int32) for a, b in zip(at, at[1:], strict=False)]
                doc = stop
        types = {"id": own.schema.field("docs").type.value_type, "n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        return pa.table({k: pa.array(v, types.get(k, pa.string())) for k, v in out.items()})

    # The join with the token-byte table, one row of a bounded size.
    left = positions(rows, chunk).crossJoin(F.broadcast(token_row(docs.sparkSession, path))).groupBy("chunk")
    right = word_ids(rows, path, chunk, buckets).groupBy("chunk")
    got = left.cogroup(right).applyInArrow(assemble, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return got.withColumnRenamed("id", id_col)


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(token, bytes) of a rank file: as many rows as the vocabulary has, which is what bounds a broadcast of it."""
    return spark.createDataFrame(list(enumerate(map(bytearray, token_table(path or _default_path())))), "token int, bytes binary")


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, decoded): ids joined with the token-byte table and put together by position. Unknown ids give nothing.

    For tables of ids from elsewhere; rows are told apart by id and ids. An empty or null list decodes to an empty value.
    """
    keyed = encoded.select(F.col(quoted(id_col)).alias("__id"), F.xxhash64(quoted(ids_col)).alias("__h"), F.posexplode_outer(quoted(ids_col)).alias("__pos", "token")).distinct()
    joined = keyed.join(F.broadcast(token_bytes(encoded.sparkSession, path)), "token", "left")
    parts = joined.groupBy("__id", "__h").agg(F.sort_array(F.collect_list(F.struct("__pos", F.hex("bytes").alias("x")))).alias("p"))
    return parts.select(F.col("__id").alias(id_col), F.unhex(F.array_join(F.transform("p", lambda p: p["x"]), "")).alias("decoded"))


def op5_byte_bpe(spark, sf_dir):
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
