"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of documents of bounded size within a scan task. Its words become the numbers that they have among the
test items' words; a word that no item has can't be part of a match and ends a run, and runs shorter than the shortest
window are left out for the same reason. The shard's runs are indexed, each window of the items is looked for backwards
through wavelet-tree ranks, its occurrences are located from sampled suffix positions, and the words that they cover are
merged to spans to remove. Documents are never shuffled, and words are compared as bytes, not by hashes.

Windows are ``words`` consecutive words of an item; an item of fewer, but not none, is one window. Items come to the
tasks in blocks of BLOCK bytes of text, or one item; a larger benchmark takes a pass for each block, between which what
was found is written to the shared folder.

Words are runs of a-z, 0-9 and non-ASCII characters, after A-Z are lower-cased. A null text has no words. Ids of documents
are passed on as they are, null and repeated ones too. Items of one id count once; a null item id is named by the empty
string. Without documents there are no rows, without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import buffer_of, mask_bounds, materialize, quoted, slices
from rentloom.llm.fm_index import FMIndex

WORDS = 10
SHARD = 8 << 20
BLOCK = 4 << 20

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_INSIDE = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


class Words:
    """The words of a text column: where each begins and ends in the buffer, its row, and the words as an array."""

    def __init__(self, column: pa.Array):
        data, self.at = buffer_of(column)
        data = _LOWER[data]
        inside = _INSIDE[data]
        self.start, self.end, self.row = mask_bounds(inside, self.at)
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        self.words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])


class Windows:
    """The distinct windows of a block of items, by length, as numbers of the block's words, and whose each one is."""

    def __init__(self, ids: list[str], texts: pa.Array, words: int = WORDS):
        own = Words(texts)
        coded = own.words.dictionary_encode()
        self.known = coded.dictionary
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        count = np.bincount(own.row, minlength=len(ids))
        begin = np.cumsum(count) - count
        self.ids = ids
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted({min(int(c), words) for c in count if c}):
            items = np.flatnonzero(np.minimum(count, words) == length)
            many = count[items] - length + 1
            item = np.repeat(items, many)
            first = np.repeat(begin[items], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            patterns, of = np.unique(number[first[:, None] + np.arange(length)], axis=0, return_inverse=True)
            # Whose windows: for each pattern a stretch of ``items``.
            pair = np.unique(np.stack([of.ravel(), item]), axis=1)
            self.by_length.append((patterns, np.searchsorted(pair[0], np.arange(len(patterns) + 1)), pair[1]))

    @property
    def shortest(self) -> int:
        return min((p.shape[1] for p, _, _ in self.by_length), default=0)


class Found:
    """What of a shard's rows the windows hit: the words, by number, and for each row the items."""

    def __init__(self, shard: Words, rows: int, windows: Windows):
        self.hit = np.zeros(len(shard.row), bool)
        self.items: list[set[str]] = [set() for _ in range(rows)]
        if not len(shard.row) or not windows.shortest:
            return
        symbol = pc.fill_null(pc.index_in(shard.words, value_set=windows.known), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        kept, run = _runs(symbol > 0, shard.row, windows.shortest)
        if not len(kept):
            return
        # Runs one after the other, each with a 0 behind it.
        place = np.arange(len(kept)) + run
        symbols, back = np.zeros(place[-1] + 2, np.int64), np.zeros(place[-1] + 2, np.int64)
        symbols[place], back[place] = symbol[kept], kept
        index = FMIndex(symbols, len(windows.known))
        change = np.zeros(len(shard.row) + 1, np.int64)
        for patterns, cut, items in windows.by_length:
            low, high = index.find(patterns)
            window = np.flatnonzero(high > low)
            many = (high - low)[window]
            rows_found = np.repeat(low[window], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            word = back[index.locate(rows_found)]
            change += np.bincount(word, minlength=len(change))
            change -= np.bincount(word + patterns.shape[1], minlength=len(change))
            for r, w in np.unique(np.stack([shard.row[word], np.repeat(window, many)]), axis=1).T.tolist():
                self.items[r].update(windows.ids[i] for i in items[cut[w] : cut[w + 1]].tolist())
        self.hit = np.cumsum(change)[:-1] > 0


def _runs(good: np.ndarray, row: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in runs of at least ``shortest`` good words of a row, and each one's run, counted from 0."""
    words = np.flatnonzero(good)
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[1:] != words[:-1] + 1) | (row[words[1:]] != row[words[:-1]])
    run = np.cumsum(fresh) - 1
    long = np.bincount(run, minlength=1) >= shortest
    kept = long[run] if len(words) else np.zeros(0, bool)
    return words[kept], (np.cumsum(long) - 1)[run[kept]]


def _spans(hit: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each maximal run of hit words of a row."""
    words = np.flatnonzero(hit)
    fresh = np.ones(len(words) + 1, bool)
    fresh[1:-1] = (words[1:] != words[:-1] + 1) | (row[words[1:]] != row[words[:-1]])
    return words[fresh[:-1]], words[fresh[1:]]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _span_column(row: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int) -> pa.Array:
    cut = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(cut), pairs).cast(_SPAN)


def _shard(part: pa.RecordBatch, windows: Windows, last: bool, cut: bool) -> list[pa.Array]:
    """The columns behind id of a shard's rows: id, text and, from earlier blocks, spans of words and items."""
    shard = Words(part.column(1))
    found = Found(shard, len(part), windows)
    begin = np.searchsorted(shard.row, np.arange(len(part) + 1))
    if part.num_columns > 2:
        for r, (spans, items) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
            found.items[r].update(items)
            for s in spans:
                found.hit[begin[r] + s["start"] : begin[r] + s["end"] + 1] = True
    first, final = _spans(found.hit, shard.row)
    row = shard.row[first]
    items = pa.array([sorted(x) for x in found.items], pa.list_(pa.string()))
    if not last:
        return [part.column(1), _span_column(row, first - begin[row], final - begin[row], len(part)), items]
    data, at = buffer_of(part.column(1))
    # Characters, not bytes: all but the bytes that go on with one.
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]).astype(np.int64)
    start, end = shard.start[first], shard.end[final]
    spans = _span_column(row, letters[start] - letters[at[row]], letters[end] - letters[at[row]], len(part))
    out = [pa.array(np.diff(begin)), pa.array(np.bincount(shard.row[found.hit], minlength=len(part))), items, spans]
    if cut:
        change = np.zeros(len(data) + 1, np.int64)
        change[start] += 1
        change[end] -= 1
        kept = np.cumsum(change)[:-1] == 0
        offsets = np.concatenate([[0], np.cumsum(kept)])[at].astype(np.int64)
        out.append(pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets), pa.py_buffer(data[kept])).cast(pa.string()))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, words: int, block: int) -> Iterator[Windows]:
    """The items' windows, block bytes of text at a time; each block is read by itself and is all that the driver holds."""
    named = benchmark.select(F.coalesce(F.col(quoted(item_col)).cast("string"), F.lit("")).alias("id"), F.col(quoted(text_col)).alias("text"))
    named = named.where(F.octet_length("text") > 0).distinct()
    total = named.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = max(1, -(-total // block))
    for k in range(count):
        mine = named if count == 1 else named.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k)
        rows = mine.collect()
        yield Windows([r["id"] for r in rows], pa.array([r["text"] for r in rows], pa.string()), words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, shard: int = SHARD, block: int = BLOCK, cut: bool = True) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (ids of items with a window in it, sorted), spans (start and end,
    in characters, of the stretches to remove) and, with ``cut``, kept, the text without them."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    between = {"text": "string", "spans": "array<struct<start: long, end: long>>", "items": "array<string>"}
    ending = {"n_words": "long", "n_hit": "long", "items": "array<string>", "spans": between["spans"]} | ({"kept": "string"} if cut else {})

    def searched(rows: DataFrame, windows: Windows, last: bool) -> DataFrame:
        columns = ending if last else between

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", shard):
                    yield pa.RecordBatch.from_arrays([part.column(0), *_shard(part, windows, last, cut)], names=["id", *columns])

        return rows.mapInArrow(task, ", ".join([f"id {kind}", *[f"{k} {v}" for k, v in columns.items()]]))

    waiting = None
    for windows in _blocks(benchmark, item_col, item_text, words, block):
        if waiting is not None:
            rows = materialize(searched(rows, waiting, False), "decontaminated")
        waiting = windows
    out = searched(rows, waiting, True)
    return out.select(F.col("id").alias(id_col), *[c for c in out.columns if c != "id"])


def op13_benchmark_decontamination(spark, sf_dir):
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=False)
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _WORD + "') AS ws"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} FROM documents),
b AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM (SELECT item_id, {_WORDS} FROM benchmark) WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, k, array_to_string(ws[p : p + k - 1], ' ') AS w FROM (SELECT *, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS p FROM b)),
w AS (SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS w FROM (SELECT doc_id, ws, k, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS p FROM d, (SELECT DISTINCT k FROM b) WHERE len(ws) >= k)),
f AS (SELECT doc_id, p, k, item_id FROM w JOIN i USING (k, w)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM f) GROUP BY 1),
c AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM f GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)
"""
