"""Phrase collocations by vertical partitioning of a suffix tree of words.

Texts are cut into pieces and words, per language, and the suffixes of all pieces, LONGEST words deep, are what the tree
holds. It is never built as a whole. Words are counted first. A suffix begins with a prefix that is rare enough for a
group's memory budget: one word, two where the word is too frequent, three where the pair is. Prefixes are dealt over as
many groups as the budget asks for, and each group builds the subtrees of its own prefixes, apart from all others: it
sorts its distinct suffixes, which are the leaves, and adds up their totals to the counts of the nodes above them.

A suffix ends at a word that occurs less than LEAST times, as no candidate holds one. A chunk of documents sends each of
its distinct suffixes once, with a count, so neither a frequent phrase nor a repeated passage weighs more than once a
chunk. Words are told apart as strings and have a number of 64 bits; nothing is compared by hash.

How rare is rare: prefixes of more than an eighth of the budget, or of SHARE of all suffixes if that is more, are made
longer. There are 1 / SHARE of them at most, which bounds what the driver sends out. A pair of SHARE of all suffixes has
that share in some chunk, so it is enough that chunks report those.

A null text is empty, a null language is ``und``. Only text and language are read. No words, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rentloom.llm.common import buffer_of, lower_ascii, mask_bounds, materialize, mix, quoted, slices

LEAST = 10
TOP = 2000
COVERED = 50
CHUNK = 8 << 20
BUDGET = 1 << 20
SHARE = 1 / 16384
# Numbers of three words fit one key of 64 bits while a group or chunk has fewer words than this; else columns are sorted.
KEY_BITS = 21
U = np.uint64

_BREAK = np.isin(np.arange(256), [*b".,;:!?\n\x0b\x0c\r"])
_INSIDE = ~(_BREAK | np.isin(np.arange(256), [*b" \t"]))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers as one blob, byte by byte of the numbers."""
    raw = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel() for c in columns]
    return zstandard.ZstdCompressor(1).compress(np.concatenate(raw).tobytes())


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view("<u8").ravel().astype(np.int64) for c in raw]


def leaves(suffixes: list[np.ndarray], totals: np.ndarray, key_bits: int = KEY_BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct suffixes (three columns, 0 where one has ended) in order, and their totals added up."""
    if not len(totals):
        return suffixes, totals
    held = np.unique(np.concatenate(suffixes))
    if len(held) < 1 << key_bits:
        ranks = [np.searchsorted(held, c) for c in suffixes]
        key = ranks[0] << 2 * key_bits | ranks[1] << key_bits | ranks[2]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
    else:
        order = np.lexsort(suffixes[::-1])
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([np.diff(c[order]) != 0 for c in suffixes], axis=0)
        first = np.flatnonzero(fresh)
    return [c[order][first] for c in suffixes], np.add.reduceat(totals[order], first)


def nodes(suffixes: list[np.ndarray], totals: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The nodes at a depth of the subtrees over sorted leaves, and the sums of the leaves below each."""
    if not len(totals):
        return suffixes[:depth], totals
    fresh = np.ones(len(totals), bool)
    fresh[1:] = np.any([np.diff(c) != 0 for c in suffixes[:depth]], axis=0)
    first = np.flatnonzero(fresh)
    return [c[first] for c in suffixes[:depth]], np.add.reduceat(totals, first)


class Prefixes:
    """Which prefix of a suffix decides its group: the numbers of frequent words, and the frequent pairs of them."""

    def __init__(self, words: list[int], pairs: list[tuple[int, int]], groups: int):
        self.words, self.groups = np.array(sorted(words), np.int64), groups
        # One number for a pair, by the places of its words, both of which are frequent where the pair is.
        self.pairs = np.array(sorted(self._pair(np.array([a]), np.array([b]))[0] for a, b in pairs), np.int64)

    @staticmethod
    def _in(held: np.ndarray, x: np.ndarray) -> np.ndarray:
        return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x if len(held) else np.zeros(len(x), bool)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = self._in(self.words, a) & self._in(self.words, b)
        return np.where(both, np.searchsorted(self.words, a) * (len(self.words) + 1) + np.searchsorted(self.words, b), -1)

    def long_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._in(self.pairs, self._pair(a, b))

    def group(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        one = mix(a.astype(U))
        two = mix(one + b.astype(U))
        three = mix(two + c.astype(U))
        chosen = np.where(self._in(self.words, a), np.where(self.long_pair(a, b), three, two), one)
        return (chosen % U(self.groups)).astype(np.int64)


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column, in order, and which of them are followed by one of their piece."""
    data, at = buffer_of(column)
    data = lower_ascii(data)
    inside = _INSIDE[data]
    start, end, row = mask_bounds(inside, at)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    piece = np.cumsum(_BREAK[data])[start] if len(start) else np.zeros(0, np.int64)
    goes_on = np.zeros(len(start), bool)
    goes_on[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    return words, goes_on


_CHUNKS = "chunk long, lang string, n long, words array<string>, counts array<long>, places binary, pairs array<struct<a: int, b: int, n: long>>"


def chunks(docs: DataFrame, lang_col: str, text_col: str, limit: int, share: float) -> DataFrame:
    """One row per run of a task's documents and language: how many words, its distinct words and how often each occurs,
    its text as numbers of these from 1 on, 0 behind a piece, and the pairs that make up more than ``share`` of it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", limit):
                for lang in part.column(0).unique().to_pylist():
                    words, goes_on = _words(part.filter(pa.compute.equal(part.column(0), lang)).column(1))
                    if not len(words):
                        continue
                    coded = words.dictionary_encode()
                    place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    size = len(coded.dictionary)
                    pair, often = np.unique((place[:-1] * size + place[1:])[goes_on[:-1]], return_counts=True)
                    many = often > len(words) * share
                    pairs = [{"a": p // size, "b": p % size, "n": n} for p, n in zip(pair[many].tolist(), often[many].tolist(), strict=True)]
                    flat = np.zeros(len(place) + int((~goes_on).sum()), np.int64)
                    flat[np.arange(len(place)) + np.concatenate([[0], np.cumsum(~goes_on)[:-1]])] = place + 1
                    counts = np.bincount(place, minlength=size)
                    one = lambda x, kind: pa.array([x], kind)
                    yield pa.RecordBatch.from_arrays(
                        [one(number, pa.int64()), one(lang, pa.string()), one(len(place), pa.int64()), pa.ListArray.from_arrays([0, size], coded.dictionary.cast(pa.string())), pa.ListArray.from_arrays([0, size], pa.array(counts)), one(pack([flat]), pa.binary()), one(pairs, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])))],
                        names=["chunk", "lang", "n", "words", "counts", "places", "pairs"],
                    )
                    number += 1

    rows = docs.select(F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    return rows.mapInArrow(task, _CHUNKS)


def frequent_words(held: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id): words that occur ``least`` times, each with a number from 1 on."""
    each = held.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("f"))
    words = each.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return materialize(words.withColumn("id", F.monotonically_increasing_id() + 1), "phrase-words")


def long_prefixes(held: DataFrame, words: DataFrame, budget: int, share: float) -> Prefixes:
    """The prefixes that are too frequent for a group, as numbers: 1 / share words and as many pairs at most."""
    total = held.agg(F.sum("n")).first()[0] or 0
    most = max(budget / 8, total * share)
    frequent = words.where(F.col("f") > most)
    word = lambda k: F.element_at("words", F.col(f"x.{k}") + 1).alias(k)
    pairs = held.select("lang", "words", F.explode("pairs").alias("x")).select("lang", word("a"), word("b"), F.col("x.n").alias("n"))
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    # Both words of such a pair are frequent too.
    of = lambda k: frequent.select("lang", F.col("word").alias(k), F.col("id").alias(f"{k}_id"))
    found = pairs.join(F.broadcast(of("a")), ["lang", "a"]).join(F.broadcast(of("b")), ["lang", "b"]).select("a_id", "b_id")
    return Prefixes([r[0] for r in frequent.select("id").collect()], [tuple(r) for r in found.collect()], max(1, -(-total // budget)))


def grouped_suffixes(held: DataFrame, words: DataFrame, prefixes: Prefixes, key_bits: int = KEY_BITS) -> DataFrame:
    """(group, suffixes): each chunk's distinct suffixes of two words or more and their counts, for each group."""
    each = held.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    numbers = each.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of"), "place", "id")

    def send(own: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        for row in own.to_pylist():
            number = np.zeros(row["size"] + 1, np.int64)
            number[found.column("place").to_numpy() + 1] = found.column("id").to_numpy()
            (place,) = unpack(row["places"], 1)
            a = np.concatenate([number[place], [0, 0]])
            a, b, c = a[:-2], a[1:-1], a[2:]
            whole = (a > 0) & (b > 0)
            suffixes, totals = leaves([x[whole] for x in (a, b, c)], np.ones(int(whole.sum()), np.int64), key_bits)
            group = prefixes.group(*suffixes)
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.diff(group[order], prepend=-1))
            for k in np.split(order, cut[1:]) if len(cut) else []:
                out.append((int(group[k[0]]), pack([*[x[k] for x in suffixes], totals[k]])))
        return pa.table({"group": pa.array([x[0] for x in out], pa.int64()), "suffixes": pa.array([x[1] for x in out], pa.binary())})

    left = held.select("chunk", F.size("words").alias("size"), "places").groupBy("chunk")
    return left.cogroup(numbers.groupBy("of")).applyInArrow(send, "group long, suffixes binary")


def subtrees(grouped: DataFrame, prefixes: Prefixes, least: int, budget: int, key_bits: int = KEY_BITS) -> DataFrame:
    """(a, b, c, n): phrases of two words (c is 0) and of three that occur ``least`` times, from each group's subtrees."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, totals = [np.zeros(0, np.int64)] * 3, np.zeros(0, np.int64)
        waiting, size = [], 0
        for batch in batches:
            for blob in batch.column(batch.schema.get_field_index("suffixes")):
                waiting.append(unpack(blob.as_py(), 4))
                size += len(waiting[-1][0])
                if size > budget:
                    suffixes, totals = _merged(suffixes, totals, waiting, key_bits)
                    waiting, size = [], 0
        suffixes, totals = _merged(suffixes, totals, waiting, key_bits)
        (a, b), n = nodes(suffixes, totals, 2)
        # A long pair's suffixes are in several groups, so its count here is a part of it.
        counted = (n >= least) | prefixes.long_pair(a, b)
        deep = (totals >= least) & (suffixes[2] > 0)
        columns = [(a[counted], suffixes[0][deep]), (b[counted], suffixes[1][deep]), (np.zeros(int(counted.sum()), np.int64), suffixes[2][deep]), (n[counted], totals[deep])]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["a", "b", "c", "n"])

    found = grouped.groupBy("group").applyInArrow(build, "a long, b long, c long, n long")
    return materialize(found.groupBy("a", "b", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")


def _merged(suffixes: list[np.ndarray], totals: np.ndarray, more: list[list[np.ndarray]], key_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    columns = [np.concatenate([x, *[m[k] for m in more]]) for k, x in enumerate([*suffixes, totals])]
    return leaves(columns[:3], columns[3], key_bits)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact for counts below 10^16."""
    d = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {d(a)} * {d(a)}) DIV ({d(left)} * {d(right)})")


def candidates(phrases: DataFrame, words: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one takes the place of."""
    word = lambda k: words.select(F.col("id").alias(k), F.col("word").alias(f"{k}_word"), F.col("f").alias(f"{k}_f"), *(["lang"] if k == "a" else []))
    two, three = phrases.where("c = 0").drop("c"), phrases.where("c > 0")
    inside = three.select("a", "b", "n").unionByName(three.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("longer"))
    left = two.join(inside, ["a", "b"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * covered))
    pairs = left.join(word("a"), "a").join(word("b"), "b")
    pairs = pairs.select("lang", F.concat_ws(" ", "a_word", "b_word").alias("phrase"), F.col("n").alias("a"), F.col("a_f").alias("l"), F.col("b_f").alias("r"), _score("n", "a_f", "b_f").alias("score"))
    head = two.withColumnRenamed("n", "ab")
    tail = two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("bc"))
    longer = three.join(head, ["a", "b"]).join(tail, ["b", "c"]).join(word("a"), "a").join(word("b"), "b").join(word("c"), "c")
    longer = longer.withColumns({"first": _score("n", "a_f", "bc"), "second": _score("n", "ab", "c_f")})
    early = F.col("first") <= F.col("second")
    choice = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y))
    triples = longer.select("lang", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), F.col("n").alias("a"), choice("a_f", "ab").alias("l"), choice("bc", "c_f").alias("r"), choice("first", "second").alias("score"))
    return pairs.unionByName(triples)


def first_of_each(rows: DataFrame, key: str, order: list[Column], tie: str, most: int) -> DataFrame:
    """Adds rank to the first ``most`` rows of each key. Rows of a key are dealt over ever fewer tasks, each of which
    passes on no more than ``most``, so a key with a large share of the rows doesn't meet in one."""
    for deal in (1024, 32, 1):
        mine = W.partitionBy(key, "__deal").orderBy(*order)
        rows = rows.withColumn("__deal", F.pmod(F.xxhash64(tie), F.lit(deal))).withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= most)
    return rows.drop("__deal")


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, covered: int = COVERED, chunk: int = CHUNK, budget: int = BUDGET, share: float = SHARE, key_bits: int = KEY_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two or three words."""
    held = materialize(chunks(docs, lang_col, text_col, chunk, share), "phrase-chunks")
    words = frequent_words(held, least)
    prefixes = long_prefixes(held, words, budget, share)
    phrases = subtrees(grouped_suffixes(held, words, prefixes, key_bits), prefixes, least, budget, key_bits)
    sizes = held.groupBy("lang").agg(F.sum("n").alias("n"))
    best = first_of_each(candidates(phrases, words, covered), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "phrase", top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir):
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY 1),
f1 AS (SELECT lang, x, count(*) AS f FROM g GROUP BY 1, 2),
f2 AS (SELECT lang, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM g WHERE z IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
o AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY 1, 2, 3),
c2 AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, p.f AS l, q.f AS r FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y
       LEFT JOIN o ON o.lang = f2.lang AND o.x = f2.x AND o.y = f2.y WHERE o.f IS NULL OR 100 * o.f < 50 * f2.f),
c3 AS (SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.f AS a, p.f AS l1, bc.f AS r1, ab.f AS l2, q.f AS r2 FROM f3
       JOIN f1 p ON p.lang = f3.lang AND p.x = f3.x JOIN f1 q ON q.lang = f3.lang AND q.x = f3.z
       JOIN f2 ab ON ab.lang = f3.lang AND ab.x = f3.x AND ab.y = f3.y JOIN f2 bc ON bc.lang = f3.lang AND bc.x = f3.y AND bc.y = f3.z),
k AS (SELECT lang, phrase, a, 1 AS cut, l, r FROM c2 UNION ALL SELECT lang, phrase, a, 1, l1, r1 FROM c3 UNION ALL SELECT lang, phrase, a, 2, l2, r2 FROM c3),
s AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM k),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM s) WHERE i = 1),
t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
