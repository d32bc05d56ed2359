"""Suffix-array dedup: remove every byte covered by a 100-byte string that also starts earlier.

1. Every 100-byte window picks an anchor, the smallest hash among its 32-byte grams. Around an anchor a window reaches
   34 bytes or more to one side, so two equal windows share the anchor and one of two 66-byte grams. Those grams go
   through one shuffle (see ``chunks``); windows whose gram recurs nowhere are done with.
2. The windows left form segments, one per anchor. Equal segments are one, held by the earliest place; whatever stands
   in another place is a repeat as a whole.
3. Different segments of one anchor are suffix-sorted together, word by word, by linear grouping (``suffix_groups``).
   Suffixes that agree in as many bytes as a window has after its first word break are neighbours in that order;
   together with the bytes before the break they say which windows are equal, and the earliest place of each stays.
   An anchor of more than HOT different segments is dealt over all groups by segment; each group's earliest windows then
   meet by their anchor and a hash of their bytes, which keeps the earliest of all.
4. Removed stretches are joined to their documents.

Segments are equal by two hashes of 64 bits, windows of one group by their bytes, windows of different groups by the
anchor's 63 bits and 64 bits of their own.
Places are ordered by id, then by start. Rows that repeat both id and text are one document; a null id comes first; a
null text is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.chunks import bucket_count, with_recurring
from rentloom.llm.common import buffer_of, every_stretch, materialize, mix, prefix_hash, quoted, slices, stretch_hash
from rentloom.llm.suffix_groups import suffix_order

LENGTH = 100
GRAM = 32
SIDE = (LENGTH - GRAM) // 2
WIDE = GRAM + SIDE
KEY_BITS = 48
CHUNK = 3 << 19
HOT = 512
U = np.uint64
_LOW = U((1 << 24) - 1)
SECTION = 1 << 23
# Bytes as other numbers, so that sums over them are a second hash, which has nothing to do with the first.
OTHER = mix(np.arange(256, dtype=U) + U(0x1234567))


def _smallest(grams: np.ndarray, count: int) -> np.ndarray:
    """Where the smallest gram of each of the first ``count`` windows is, the leftmost of equal ones. Positions stand in the
    low bits beside the hashes, so a section has fewer windows than these bits can count."""
    tag = grams | np.arange(len(grams), dtype=U)
    w = LENGTH - GRAM + 1
    full = np.full(-(-len(tag) // w) * w, np.iinfo(np.uint64).max, U)
    full[: len(tag)] = tag
    grid = full.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:count], ahead[w - 1 : w - 1 + count]) & _LOW).astype(np.int64)


def anchors(data: np.ndarray, at: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, row), one for each run of windows with the same anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none
    grams = every_stretch(sums, GRAM) & ~_LOW
    count = n - LENGTH + 1
    place = np.empty(count, np.int64)
    for x in range(0, count, SECTION):
        y = min(x + SECTION, count)
        place[x:y] = x + _smallest(grams[x : y + LENGTH - GRAM], y - x)
    first = np.arange(count)
    row = np.repeat(np.arange(len(at) - 1), np.diff(np.minimum(at, count)))
    inside = first + LENGTH <= at[row + 1]
    first, row = first[inside], row[inside]
    place = place[inside]
    if not len(first):
        return none, none, none, none
    cut = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    last = np.append(cut[1:], len(first)) - 1
    return place[cut], first[cut], first[last], row[cut]


def _wide_keys(sums: np.ndarray, at: np.ndarray, anchor: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of the wide grams that end and that begin with each anchor's gram, and whether the text has room for them."""
    a, b = np.maximum(anchor - SIDE, 0), anchor + WIDE
    left, right = anchor - SIDE >= at[row], b <= at[row + 1]
    key = lambda i, j, salt: mix(stretch_hash(sums, i, j) + U(salt)) >> U(64 - KEY_BITS)
    return key(a, anchor + GRAM, 1), left, key(anchor, np.minimum(b, at[row + 1]), 2), right


def _prepared(column: pa.Array):
    data, at = buffer_of(column)
    sums = prefix_hash(data)
    anchor, first, last, row = anchors(data, at, sums)
    return data, at, sums, anchor, first, last, row


def _keys_of(part: pa.RecordBatch):
    _, at, sums, anchor, _, _, row = _prepared(part.column(1))
    if not len(anchor):
        return np.zeros(0, U), np.zeros(0, bool)
    lk, left, rk, right = _wide_keys(sums, at, anchor, row)
    # An anchor may have several runs of windows; its grams stand in one place all the same.
    once = np.unique(anchor, return_index=True)[1]
    keys, count = np.unique(np.concatenate([lk[once][left[once]], rk[once][right[once]]]), return_counts=True)
    return keys, count > 1


def _known(again: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = np.searchsorted(again, keys)
    k[k == len(again)] = 0
    return again[k] == keys


def _segments(ids: pa.Array, texts: pa.Array, again: np.ndarray) -> pa.Table:
    """One row per different segment of a chunk: anchor hash, two segment hashes, its bytes, how many windows, and its places.

    Places of one text that touch or overlap, as in a text that repeats itself, are one: the first start, the second (-1
    if there is none) and the last.
    """
    data, at, sums, anchor, first, last, row = _prepared(texts)
    out = {"a": [], "g": [], "h": [], "windows": [], "seg": [], "ids": [], "texts": [], "starts": [], "seconds": [], "lasts": []}
    if len(anchor):
        lk, left, rk, right = _wide_keys(sums, at, anchor, row)
        left, right = left & _known(again, lk), right & _known(again, rk)
        # Windows that reach SIDE bytes or more to the left need the left gram, the others the right one.
        lo = np.where(left, first, np.maximum(first, anchor - SIDE))
        hi = np.where(right, last, np.minimum(last, anchor - SIDE))
        lo = np.where(left & ~right, first, lo)
        keep = (left | right) & (lo <= hi)
        anchor, lo, hi, row = anchor[keep], lo[keep], hi[keep], row[keep]
    if len(anchor):
        a = (mix(stretch_hash(sums, anchor, anchor + GRAM)) >> U(1)).astype(np.int64)
        g, h = (mix(stretch_hash(x, lo, hi + LENGTH) + (anchor - lo).astype(U)).view(np.int64) for x in (sums, prefix_hash(OTHER[data])))
        own = np.array([hash_of(texts[r].as_py()) for r in range(len(texts))], np.int64)
        names = np.array([i if i is not None else -(1 << 63) for i in ids.to_pylist()], np.int64)
        order = np.lexsort((lo, names[row], h, g, a))
        a, g, h, lo, hi, row = a[order], g[order], h[order], lo[order], hi[order], row[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        touch = np.diff(lo, prepend=-1) <= hi - lo + LENGTH
        # Runs of places, and the runs at which another segment begins.
        run = np.flatnonzero(fresh | (np.diff(row, prepend=-1) != 0) | ~touch)
        stop = np.append(run[1:], len(a))
        cut = np.flatnonzero(fresh[run])
        ends = np.append(cut[1:], len(run))
        raw = data.tobytes()
        start = lo - at[row]
        second = np.where(stop - run > 1, start[np.minimum(run + 1, len(a) - 1)], -1)
        one = run[cut]
        per = lambda values: [values[x:y] for x, y in zip(cut.tolist(), ends.tolist(), strict=True)]
        out = {
            "a": a[one],
            "g": g[one],
            "h": h[one],
            "windows": hi[one] - lo[one] + 1,
            "seg": [raw[x:y] for x, y in zip(lo[one].tolist(), (hi[one] + LENGTH).tolist(), strict=True)],
            "ids": per(names[row[run]]),
            "texts": per(own[row[run]]),
            "starts": per(start[run]),
            "seconds": per(second),
            "lasts": per(start[stop - 1]),
        }
    longs = pa.list_(pa.int64())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), longs, longs, longs, longs, longs), strict=True)})


def hash_of(text: str | None) -> int:
    """A text's own hash, signed, as every task computes it."""
    return int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "little", signed=True)


def _blocks(data: np.ndarray) -> np.ndarray:
    """Positions after white space: where words begin, judged by bytes before them alone."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    return np.flatnonzero(space) + 1


def equal_windows(segs: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, window in it, class): equal windows of all segments have equal classes."""
    size = np.array([len(s) for s in segs])
    base = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(segs), np.uint8)
    sums = prefix_hash(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[_blocks(data)] = True
    edge[base] = True
    starts = np.flatnonzero(edge[:-1])
    seg_of = np.searchsorted(base, starts, "right") - 1
    # One symbol a word; a separator after each segment, all different and smaller than any word.
    end = np.append(starts[1:], len(data))
    # Words rank by their bytes. Each ends with its white space, so none begins another, and suffixes are in byte order.
    _, sample, kind = np.unique(stretch_hash(sums, starts, end), return_index=True, return_inverse=True)
    raw = data.tobytes()
    different = [raw[x:y] for x, y in zip(starts[sample].tolist(), end[sample].tolist(), strict=True)]
    word = np.empty(len(different), np.int64)
    word[sorted(range(len(different)), key=different.__getitem__)] = np.arange(len(different)) + len(segs) + 1
    word = word[kind]
    where = np.arange(len(starts)) + seg_of
    symbols = np.zeros(len(starts) + len(segs), np.int64)
    symbols[where] = word
    symbols[np.flatnonzero(symbols == 0)] = len(segs) - np.arange(len(segs))
    symbols[-1] = 0
    ranked = suffix_order(symbols)
    back = np.full(len(symbols), -1)
    back[where] = np.arange(len(starts))
    ranked = back[ranked]
    ranked = ranked[ranked >= 0]
    # Bytes that neighbours in the order share, LENGTH at most.
    common = np.zeros(len(ranked), np.int64)
    room = base[seg_of + 1] - starts
    step = 20_000
    reach = np.arange(LENGTH)
    wide = np.concatenate([data, np.zeros(LENGTH, np.uint8)])
    for k in range(1, len(ranked), step):
        x, y = ranked[k - 1 : k - 1 + step], ranked[k : k + step]
        x = x[: len(y)]
        same = wide[starts[x][:, None] + reach] == wide[starts[y][:, None] + reach]
        run = np.where(same.all(1), LENGTH, same.argmin(1))
        common[k : k + step] = np.minimum(run, np.minimum(room[x], room[y]))
    rank = np.empty(len(starts), np.int64)
    rank[ranked] = np.arange(len(ranked))
    owner = np.repeat(np.arange(len(segs)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = base[owner] + offset
    breaks = _blocks(data)
    k = np.searchsorted(breaks, first, "right")
    at = np.where(k < len(breaks), breaks[np.minimum(k, len(breaks) - 1)] if len(breaks) else len(data), len(data))
    reach_to = at - first
    alone = reach_to >= LENGTH
    cls = np.empty(len(first), U)
    cls[alone] = mix(stretch_hash(sums, first[alone], first[alone] + LENGTH) + U(5))
    of = np.searchsorted(starts, at)
    for e in np.unique(reach_to[~alone]):
        mine = np.flatnonzero(reach_to == e)
        stretch = np.cumsum(common < LENGTH - e)
        cls[mine] = mix(mix(stretch_hash(sums, first[mine], at[mine])) ^ mix(stretch[rank[of[mine]]].astype(U) * U(2 * LENGTH) + U(int(e))))
    return owner, offset, cls


def _alike(data: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the windows at x and y have the same bytes."""
    reach, step = np.arange(LENGTH), 20_000
    parts = [(data[x[k : k + step][:, None] + reach] == data[y[k : k + step][:, None] + reach]).all(1) for k in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def told_apart(data: np.ndarray, at: np.ndarray, cls: np.ndarray, place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order, again): windows by class and place, and which have the same bytes as the one before. Classes are hashes, so
    neighbours are compared; where two of one class differ, its windows are put in order by their bytes."""

    def neighbours(order, *kinds):
        again = np.zeros(len(order), bool)
        again[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in kinds])
        return again

    order = np.lexsort((*place, cls))
    again = neighbours(order, cls)
    hit = np.flatnonzero(again)
    same = _alike(data, at[order[hit]], at[order[hit - 1]])
    if not same.all():
        mixed = np.flatnonzero(np.isin(cls, cls[order[hit[~same]]]))
        raw, names, own = data.tobytes(), {}, np.zeros(len(cls), np.int64)
        own[mixed] = [names.setdefault(raw[x : x + LENGTH], len(names)) for x in at[mixed].tolist()]
        order = np.lexsort((*place, own, cls))
        again = neighbours(order, cls, own)
    return order, again


def _later(table: pa.Table) -> pa.Table:
    """For the different segments of some anchors: stretches of windows that stand earlier elsewhere, and with ``c``, the
    hash of its bytes, each other window of the hot anchors, whose segments are in other groups too."""
    segs = [s.as_py() for s in table.column("seg")]
    windows, a, g, doc, start = (table.column(c).to_numpy() for c in ("windows", "a", "g", "id", "start"))
    owner, offset, cls = equal_windows(segs, windows)
    # Only windows of one anchor can be equal.
    cls = mix(cls ^ mix(a.astype(U)[owner]))
    data = np.frombuffer(b"".join(segs), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in segs])]).astype(np.int64)
    order, same = told_apart(data, base[owner] + offset, cls, (start[owner] + offset, doc[owner]))
    again = np.zeros(len(order), bool)
    again[order] = same
    hit = np.flatnonzero(again)
    cut = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(owner[hit], prepend=-1) != 0)) if len(hit) else hit
    ends = np.append(cut[1:], len(hit))
    o, x, y = owner[hit[cut]], offset[hit[cut]], offset[hit[ends - 1]] if len(hit) else hit
    fresh = np.flatnonzero(~again)
    fresh = fresh[table.column("hot").to_numpy()[owner[fresh]]]
    f, z = owner[fresh], offset[fresh]
    at = base[f] + z
    c = mix(stretch_hash(prefix_hash(OTHER[data]), at, at + LENGTH)).view(np.int64)
    none = pa.nulls(len(o), pa.int64())
    put = lambda one, two: pa.chunked_array([pa.array(one, pa.int64()), pa.array(two, pa.int64())])
    return pa.table({"a": put(a[o], a[f]), "g": put(g[o], g[f]), "x": put(x, z), "y": put(y + 1, z + 1), "c": put(none, c), "id": put(none, doc[f]), "start": put(none, start[f] + z)})


def dealt(holders: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(a, g, owner, windows, hot, bucket) of the anchors that have several segments: those of one anchor share a bucket, unless
    they are more than ``hot``; then each segment has its own."""
    several = holders.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", (F.col("n") > hot).alias("hot"))
    return holders.join(several, "a").select("a", "g", "owner", "windows", "hot", F.pmod(F.when(F.col("hot"), F.col("g")).otherwise(F.col("a")), F.lit(buckets)).alias("bucket"))


def _hot_runs(windows: DataFrame) -> DataFrame:
    """(a, g, x, y): stretches of the hot anchors' windows that stand earlier in another group."""
    first = windows.groupBy("a", "c").agg(F.min(F.struct("id", "start", "g")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = windows.join(first, ["a", "c"]).where(F.struct("id", "start", "g") != F.col("first"))
    own = again.groupBy("a", "g").agg(F.sort_array(F.collect_set("x")).alias("xs"))
    starts = "filter(xs, (v, i) -> i = 0 or xs[i - 1] != v - 1)"
    ends = "filter(xs, (v, i) -> i = size(xs) - 1 or xs[i + 1] != v + 1)"
    return own.select("a", "g", F.explode(F.expr(f"zip_with({starts}, {ends}, (s, e) -> struct(s as x, e + 1 as y))")).alias("r")).select("a", "g", "r.x", "r.y")


def owned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, and one row per different segment (a, g, owner, windows, clash), held by its earliest place. Where segments
    share an anchor and the first hash but not the second one, both hashes together take the first one's place."""
    first = F.struct(F.col("ids")[0].alias("id"), F.col("starts")[0].alias("start"), F.col("texts")[0].alias("text"))

    def holders(rows: DataFrame) -> DataFrame:
        light = rows.select("a", "g", "h", "windows", first.alias("p")).groupBy("a", "g")
        return materialize(light.agg(F.min("p").alias("owner"), F.min("windows").alias("windows"), (F.min("h") != F.max("h")).alias("clash")), "segment-owners")

    found = holders(rows)
    clash = found.where("clash").select("a", "g", "clash")
    if clash.isEmpty():
        return rows, found
    both = F.when(F.col("clash"), F.xxhash64("g", "h")).otherwise(F.col("g"))
    rows = materialize(rows.join(clash, ["a", "g"], "left").withColumn("g", both).drop("clash"), "segments")
    return rows, holders(rows)


def removed_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, text_hash, start, stop): bytes to remove; stretches may overlap."""
    longs = "ids array<long>, texts array<long>, starts array<long>, seconds array<long>, lasts array<long>"
    found = with_recurring(docs, id_col, text_col, _keys_of, _segments, f"a long, g long, h long, windows long, seg binary, {longs}", CHUNK, KEY_BITS)
    rows = materialize(found, "segments")
    rows, holders = owned(rows)
    owners = dealt(holders, 2 * bucket_count(docs), hot)
    full = rows.select("a", "g", "seg", F.col("ids")[0].alias("i"), F.col("starts")[0].alias("s"), F.col("texts")[0].alias("t"))
    held = full.join(owners, ["a", "g"]).where((F.col("owner.id") == F.col("i")) & (F.col("owner.start") == F.col("s")) & (F.col("owner.text") == F.col("t")))
    held = held.select("a", "g", "windows", "seg", F.col("i").alias("id"), F.col("s").alias("start"), "hot", "bucket").dropDuplicates(["a", "g"])
    runs = held.groupBy("bucket").applyInArrow(lambda t: _later(t), "a long, g long, x long, y long, c long, id long, start long")
    runs = materialize(runs, "segment-runs")
    runs = runs.where("c is null").select("a", "g", "x", "y").unionByName(_hot_runs(runs.where("c is not null")))
    places = rows.select("a", "g", "windows", F.explode(F.arrays_zip("ids", "starts", "texts", "seconds", "lasts")).alias("p"))
    own = holders.select("a", "g", "owner")
    placed = places.join(own, ["a", "g"]).withColumn("first", (F.col("p.ids") == F.col("owner.id")) & (F.col("p.starts") == F.col("owner.start")) & (F.col("p.texts") == F.col("owner.text")))
    again = F.when(F.col("first"), F.col("p.seconds")).otherwise(F.col("p.starts"))
    whole = placed.withColumn("again", again).where("again >= 0").select(F.col("p.ids").alias("id"), F.col("p.texts").alias("text_hash"), F.col("again").alias("start"), (F.col("p.lasts") + F.col("windows") + LENGTH - 1).alias("stop"))
    part = runs.join(own, ["a", "g"]).select(F.col("owner.id").alias("id"), F.col("owner.text").alias("text_hash"), (F.col("owner.start") + F.col("x")).alias("start"), (F.col("owner.start") + F.col("y") + LENGTH - 1).alias("stop"))
    return whole.unionByName(part)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) if asked for.

    Documents are in the order of their ids, which have to be integers; ids of other types raise a TypeError. Other columns
    are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; documents are put in order by integer ids")
    docs = docs.select(F.col(quoted(id_col)).alias("own"), F.col(quoted(text_col)).alias("text"))
    gone = removed_stretches(docs, "own", "text", hot)
    # Stretches of one document are joined up before they are gathered, in runs of neighbours.
    per = gone.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone"))

    def tag(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([hash_of(t.as_py()) for t in part.column(1)], pa.int64())], names=["own", "text", "h"])

    more = ", kept binary" if with_text else ""
    ddl = f"own {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}"

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                kept, at, many = [], 0, 0
                stretches = spans.values if spans.is_valid else None
                if stretches is not None and len(stretches):
                    start, stop = (stretches.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    reach = np.maximum.accumulate(stop)
                    fresh = np.concatenate([[0], np.flatnonzero(start[1:] > reach[:-1]) + 1])
                    for x, y in zip(start[fresh].tolist(), reach[np.append(fresh[1:], len(start)) - 1].tolist(), strict=True):
                        kept.append(raw[at:x])
                        at, many = y, many + 1
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc, len(raw), len(raw) - len(left), many, hashlib.sha256(left).hexdigest(), *([left] * with_text)))
            yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, batch.column(0).type) for k, c in enumerate(zip(*out, strict=True))], names=["own", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    rows = docs.mapInArrow(tag, f"own {kind}, text string, h long")
    key = F.coalesce(F.col("own").cast("long"), F.lit(-(1 << 63)))
    joined = rows.join(per, (key == F.col("id")) & (F.col("h") == F.col("text_hash")), "left").select("own", "text", "gone")
    return joined.mapInArrow(cut, ddl).withColumnRenamed("own", id_col)


def op6_suffix_dedup(spark, sf_dir):
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
