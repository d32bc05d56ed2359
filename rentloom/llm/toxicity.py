"""Toxicity by noisy-channel deobfuscation.

Words that look disguised (digits or signs inside a word, letters in threes, letters set apart) are read as lattices:
every character may stand for a letter that it looks like, may repeat the letter before it, or may be filler. The most
likely reading under a character trigram model is found with Viterbi's algorithm. The trigrams are counted over all
documents. The restored words, and their beginnings, are then scored by what they tell about the label.

Learning uses a bounded sample of labelled documents (TRAIN_ROWS, those with the smallest hashes of their ids), always
without the held-out fold. Hashed words and beginnings that toxic documents have more often than clean ones by the
largest margins (CANDIDATES of them) become the inputs of a logistic regression: how often a text has each, and its
length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import buffer_of, lower_ascii, materialize, mix, prefix_hash, quoted, slices, stretch_hash

TRAIN_ROWS = 12_000
THRESHOLD = 0.3
CANDIDATES = 1500
LEAST_DOCS, LEAST_SHARE = 4, 0.01
BUCKETS = 1 << 22
BEGINNINGS = (4, 5, 6, 7)
U = np.uint64

# Letters that a sign may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
FILLER = " .-_*'"
COST_SIGN, COST_REPEAT, COST_FILLER, COST_KEEP_REPEAT = 1.0, 0.5, 0.3, 1.5

# The model's alphabet: 0 is an edge, 1 to 26 are letters, 27 is any other letter.
LETTERS = 28
SPACED = 4
APART = " .-_*"
WINDOW = 256


def _of(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(characters.encode(), np.uint8)] = True
    return table


_LETTER, _SIGN, _APART = _of("".join(map(chr, [*range(65, 91), *range(97, 123)]))), _of("".join(LOOKS_LIKE)), _of(APART)
_WORD = _LETTER | _of("0123456789")


def disguised_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of what looks disguised: words of letters and signs, of any length from three on, with a sign before
    their last letter or a letter three times in a row; and SPACED or more single letters or signs, set apart by one
    separator each. ``at`` says where texts begin (n + 1 places). The time is linear in the bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[at] = True
    letter, sign = _LETTER[data], _SIGN[data]
    symbol = letter | sign
    begins, ends = symbol.copy(), symbol.copy()
    begins[1:] &= ~symbol[:-1] | first[1:n]
    ends[:-1] &= ~symbol[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    start, end = start[end - start >= 3], end[end - start >= 3]
    last = np.maximum.accumulate(np.where(letter, np.arange(n), -1))[end - 1] if len(end) else end
    signs = np.concatenate([[0], np.cumsum(sign)])
    thrice = np.zeros(n + 1, np.int64)
    if n > 2:
        thrice[1 : n - 1] = np.cumsum(letter[:-2] & (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:]))
        thrice[n - 1 :] = thrice[n - 2]
    inside = last >= start
    hit = inside & ((signs[np.maximum(last, start)] > signs[start]) | (thrice[end - 2] > thrice[start]))
    start, end = start[hit], end[hit]
    # Single symbols: no letter or digit on either side. A link is such a symbol, a separator and the next one.
    word = _WORD[data]
    single = symbol.copy()
    single[1:] &= ~(word[:-1] & ~first[1:n])
    single[:-1] &= ~(word[1:] & ~first[1:n])
    link = np.zeros(n, bool)
    if n > 2:
        link[:-2] = single[:-2] & _APART[data[1:-1]] & single[2:] & ~first[1 : n - 1] & ~first[2:n]
    more = [(start, end)]
    for odd in (0, 1):
        own = np.concatenate([[False], link[odd::2], [False]]).astype(np.int8)
        step = np.diff(own)
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = b - a >= SPACED - 1
        more.append((2 * a[long] + odd, 2 * b[long] + odd + 1))
    start, end = (np.concatenate([m[k] for m in more]) for k in (0, 1))
    order = np.argsort(start, kind="stable")
    return start[order], end[order]


def letter_codes(data: np.ndarray) -> np.ndarray:
    low = lower_ascii(data)
    return np.where((low >= 97) & (low <= 122), low - 96, np.where(data >= 128, 27, 0)).astype(np.int32)


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over all documents; the table has LETTERS cubed cells, whatever the input."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = buffer_of(part.column(0))
                code = np.zeros(len(data) + 2 * len(at) + 2, np.int32)
                code[np.arange(len(data)) + 2 * np.searchsorted(at, np.arange(len(data)), "right")] = letter_codes(data)
                total += np.bincount((code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:], minlength=LETTERS**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    rows = docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(task, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(LETTERS**3)
    counts[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return counts


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), mixed with lower orders."""
    tri = counts.reshape(LETTERS, LETTERS, LETTERS)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + LETTERS)
    p2 = (bi + 5 * p1[None]) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
    return np.log(p3)


def readings(ch: str) -> list[tuple[int, float, str]]:
    """(letter's code, cost, letter) of what a character may stand for; none where it is no letter."""
    if "a" <= ch <= "z":
        return [(ord(ch) - 96, 0.0, ch)]
    if ch in LOOKS_LIKE:
        return [(ord(c) - 96, COST_SIGN, c) for c in LOOKS_LIKE[ch]]
    return [(27, 0.0, ch)] if ch.isalpha() else []


def restore(span: str, model: np.ndarray) -> str:
    """The most likely word behind a span: Viterbi over (last two letters), with the readings of each character. Where each
    state came from is kept for WINDOW characters at a time; for the ones before, the states' costs at each window's begin
    are, from which a window is gone through again. So the reading is the best of the whole span, however long."""
    text = span.lower()
    begins, costs, back = range(0, max(len(text), 1), WINDOW), {(0, 0): 0.0}, []
    before: list[dict[tuple[int, int], float]] = []
    for k in begins:
        before.append(costs)
        back = []
        costs = _forward(text[k : k + WINDOW], costs, model, back)
    ends = {to: cost - model[to[0], to[1], 0] for to, cost in costs.items()}
    now = min(ends, key=lambda to: (ends[to], to))
    letters: list[str] = []
    for k in reversed(range(len(begins))):
        if k < len(begins) - 1:
            back = []
            _forward(text[begins[k] : begins[k] + WINDOW], before[k], model, back)
        for came in reversed(back):
            now, letter = came[now]
            letters.append(letter)
    return "".join(reversed(letters))


def _forward(text: str, best: dict[tuple[int, int], float], model: np.ndarray, back: list[dict]) -> dict[tuple[int, int], float]:
    """The least cost of each state behind a text; ``back`` gets, for each character, where each state came from."""
    for ch in text:
        options = readings(ch)
        after: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple] = {}

        def offer(to, cost, of, letter, after=after, came=came):
            if to not in after or cost < after[to]:
                after[to], came[to] = cost, (of, letter)

        for of, cost in best.items():
            a, b = of
            for code, own, letter in options:
                if code == b:
                    offer(of, cost + own + COST_REPEAT, of, "")
                    own += COST_KEEP_REPEAT
                offer((b, code), cost + own - model[a, b, code], of, letter)
            if ch in FILLER or not options:
                offer(of, cost + COST_FILLER, of, "")
        best = after
        back.append(came)
    return best


def disguised_words(data: np.ndarray, at: np.ndarray, model: np.ndarray, known: dict) -> tuple[np.ndarray, list[str]]:
    """(row, restored word) of every disguised span; a span is decoded once."""
    start, end = disguised_spans(data, at)
    words = []
    raw = data.tobytes()
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        span = raw[a:b].decode("ascii").lower()
        if span not in known:
            if len(known) > 200_000:
                known.clear()
            known[span] = restore(span, model)
        words.append(known[span])
    return np.searchsorted(at, start, "right") - 1, words


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Buckets of words, and of their beginnings where the word is longer."""
    sums = prefix_hash(data)
    out = [mix(stretch_hash(sums, start, end) + U(1)) & U(BUCKETS - 1)]
    for n in BEGINNINGS:
        cut = np.minimum(start + n, end)
        out.append(mix(stretch_hash(sums, start, cut) + U(n)) & U(BUCKETS - 1))
    return [x.astype(np.int64) for x in out]


def features(texts: pa.Array, model: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of all words' features, of the plain words and of the restored ones, and how many words rows have."""
    data, at = buffer_of(texts)
    rows, buckets, many = [], [], np.zeros(len(texts), np.int64)
    found_rows, found = disguised_words(data, at, model, known)
    restored = "\n".join(found).encode()
    for raw, edges, owner in ((data, at, None), (np.frombuffer(restored, np.uint8), None, found_rows)):
        if not len(raw):
            continue
        inside = letter_codes(raw) > 0
        first = np.zeros(len(raw) + 1, bool)
        if edges is not None:
            first[edges] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends[:-1] &= ~inside[1:] | first[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(start):
            continue
        if owner is None:
            row = np.searchsorted(edges, start, "right") - 1
            many += np.bincount(row, minlength=len(texts))
        else:
            lines = np.concatenate([[0], np.cumsum(raw == 10)])
            row = owner[lines[start]]
        for b in _hashed(lower_ascii(raw), start, end):
            rows.append(row)
            buckets.append(b)
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, many
    return np.concatenate(rows), np.concatenate(buckets), many


@dataclass
class Toxicity:
    """The language model, the buckets that tell something with their weights, the weight of the length, the constant."""

    language: np.ndarray
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    length: float = 0.0
    constant: float = -3.0

    def score(self, many: np.ndarray, row: np.ndarray, k: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probabilities from how often each row has bucket k."""
        s = self.constant + self.length * np.log1p(many)
        s = s + np.bincount(row, self.weights[k] * np.log1p(count), minlength=len(many))
        return 1 / (1 + np.exp(np.clip(-s, -40, 40)))


def regress(label: np.ndarray, many: np.ndarray, row: np.ndarray, k: np.ndarray, count: np.ndarray, size: int, steps: int = 300) -> tuple:
    """Logistic regression over sparse counts by Adam, with a penalty on the weights."""
    x, length = np.log1p(count), np.log1p(many)
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    p = np.zeros(size + 2)
    p[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        s = p[-1] + p[-2] * length + np.bincount(row, p[k] * x, minlength=len(label))
        error = (1 / (1 + np.exp(np.clip(-s, -40, 40))) - label) / len(label)
        grad = np.concatenate([np.bincount(k, error[row] * x, minlength=size) + 2e-5 * p[:size], [error @ length, error.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:size], float(p[-2]), float(p[-1])


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> Toxicity:
    """Learn from labelled rows outside the held-out fold. An id that is labelled twice counts with its larger label."""
    language = trigram_model(count_trigrams(docs, text_col))
    own, label = F.col(quoted(id_col)), F.col(quoted(label_col))
    known = labels.where(label.isNotNull() & own.isNotNull() & ~held_out(id_col)).groupBy(own.alias("of")).agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("of"), "of").limit(most)
    # Bounded by ``most`` rows of two numbers; their documents are written once, and read three times.
    sample = docs.select(own.alias("of"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(chosen), "of")
    joined = materialize(sample.select("text", F.col("label").cast("int").alias("label")), "toxicity-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen: dict = {}
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket, many = features(part.column(0), language, seen)
                pairs, count = np.unique(row * BUCKETS + bucket, return_counts=True)
                yield part.column(1).to_numpy(zero_copy_only=False), pairs // BUCKETS, pairs % BUCKETS, count, many

    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many toxic documents have each bucket; their number under -1, that of clean ones under -2."""
        n, docs_of = np.zeros(BUCKETS, np.int32), np.zeros(2, np.int64)
        for label, row, bucket, _, _ in counted(batches):
            n += np.bincount(bucket[label[row] == 1], minlength=BUCKETS).astype(np.int32)
            docs_of += np.bincount(label, minlength=2)[:2]
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([*cells, -1, -2], pa.int64()), pa.array([*n[cells], docs_of[1], docs_of[0]], pa.int64())], names=["bucket", "n"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted), np.int64)
        for label, row, bucket, _, _ in counted(batches):
            k, hit = _find(wanted, bucket)
            n += np.bincount(k[hit & (label[row] == 0)], minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int64()), pa.array(n[n > 0], pa.int64())], names=["k", "n"])

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, row, bucket, count, many in counted(batches):
            k, hit = _find(wanted, bucket)
            row, k, count = row[hit], k[hit].astype(np.int32), count[hit].astype(np.int32)
            cut = np.searchsorted(row, np.arange(len(label) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), pa.array(many, pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(k)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(count))],
                names=["label", "many", "k", "count"],
            )

    rows = joined.mapInArrow(toxic, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.expr(f"bucket < 0 OR n >= {LEAST_DOCS}")).toArrow()
    bucket, n1 = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    total1, total0 = int(n1[bucket == -1].sum()), int(n1[bucket == -2].sum())
    use = (bucket >= 0) & (n1 >= LEAST_SHARE * total1)
    if not use.any() or not total0:
        return Toxicity(language)
    order = np.argsort(bucket[use])
    wanted, n1 = bucket[use][order], n1[use][order]
    back = joined.mapInArrow(clean, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    n0 = np.zeros(len(wanted))
    n0[back.column("k").to_numpy()] = back.column("n").to_numpy()
    share = (n0 + n1) / (total0 + total1)
    margin = (n1 / total1 - n0 / total0) / np.sqrt(share * (1 - share) * (1 / total0 + 1 / total1) + 1e-9)
    wanted = np.sort(wanted[np.argsort(-margin, kind="stable")[:CANDIDATES]])
    held = joined.mapInArrow(matrix, "label int, many long, k array<int>, count array<int>").toArrow()
    lists = held.column("k").combine_chunks()
    row = np.repeat(np.arange(len(held)), np.diff(lists.offsets.to_numpy()))
    fitted = regress(held.column("label").to_numpy().astype(float), held.column("many").to_numpy(), row, lists.flatten().to_numpy(), held.column("count").combine_chunks().flatten().to_numpy(), len(wanted))
    return Toxicity(language, wanted, *fitted)


def _find(wanted: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket stands among the wanted ones, and whether it does."""
    k = np.searchsorted(wanted, bucket)
    k[k == len(wanted)] = 0
    return k, wanted[k] == bucket


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted. A null or empty text has no words, and scores as such."""
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(BUCKETS, -1, np.int16)
        table[model.buckets] = np.arange(len(model.buckets))
        seen: dict = {}
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket, many = features(part.column(1), model.language, seen)
                k = table[bucket].astype(np.int64)
                pairs, count = np.unique(row[k >= 0] * CANDIDATES + k[k >= 0], return_counts=True)
                s = model.score(many, pairs // CANDIDATES, pairs % CANDIDATES, count)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), held_out(id_col).alias("held_out")).mapInArrow(task, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def op3_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
