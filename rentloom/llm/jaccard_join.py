"""N-gram Jaccard join by parity sketches.

A document's set is its distinct 5-word shingles. Per size band the sketch has m blocks of 64 bits; each shingle is
hashed to one block and XORed into it, so a shingle on one side only changes one block at most, and the number of
blocks that differ is a lower bound of the symmetric difference. Two sets with a Jaccard similarity of 0.8 or more
differ in at most (|A| + |B|) / 9 shingles. m is chosen so that more blocks than that hold anything: two linked sets
then share a block that is not empty (sets with too many empty blocks meet by those as well). Sets that share a block
are candidates; the number of blocks that they share decides whether the bound still allows a link; the sets of those
left are compared in full.

Bands double in size. A set is sketched for its own band and, when a set of the band below can be 0.8 of its size, for
that band too. Equal sets are one class throughout, so copies cost nothing.

Within a block's holders each is first compared with one only, one of a few with the fewest blocks that recur nowhere.
Components are formed of the links found, and holders that are still apart are compared with the one that has the most
links, which is what copies were made of rather than a changed copy; after that only holders in different components
remain, and those are looked up by their rarest shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.chunks import pack_keys, unpack_keys, with_recurring
from rentloom.llm.common import buffer_of, lower_ascii, materialize, mix, packed, prefix_hash, quoted, slices, stretch_hash, unpacked, word_bounds
from rentloom.llm.components import components

WORDS = 5
PERCENT = 80
CHUNK = 2 << 20
KEY_BITS = 48
HUBS = 4
ROUNDS = 1
U = np.uint64


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text, sorted by row and hash."""
    data, at = buffer_of(column)
    data = lower_ascii(data)
    start, end, row = word_bounds(data, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U)
    word = stretch_hash(prefix_hash(data), start, end)
    count = np.bincount(row, minlength=len(column))
    ends = np.cumsum(count)
    whole = np.flatnonzero(ends[row] - np.arange(len(row)) >= words)
    shingle = np.zeros(len(whole), U)
    for k in range(words):
        shingle += word[whole + k] * U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    shingle, of = mix(shingle), row[whole]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        # All words of a short text together, marked with their number.
        extra = []
        for r in short:
            own = word[ends[r] - count[r] : ends[r]]
            extra.append(sum(int(w) * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k, w in enumerate(own)) + (int(count[r]) << 60) & (1 << 64) - 1)
        shingle, of = np.concatenate([shingle, mix(np.array(extra, U))]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        shingle, of = shingle[order], of[order]
    cut = np.searchsorted(of, np.arange(len(column) + 1))
    for r in np.flatnonzero(np.diff(cut)):
        shingle[cut[r] : cut[r + 1]].sort()
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (shingle[1:] != shingle[:-1])
    return of[first], shingle[first]


def class_ids(row: np.ndarray, shingle: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and 63-bit class of each row; equal sets have equal classes. Empty sets have class 0."""
    size = np.bincount(row, minlength=n)
    if not len(row):
        return size, np.zeros(n, np.int64)
    cut = np.flatnonzero(np.diff(row, prepend=-1))
    total, odd = np.zeros(n, U), np.zeros(n, U)
    total[row[cut]] = np.add.reduceat(mix(shingle + U(1)), cut)
    odd[row[cut]] = np.bitwise_xor.reduceat(mix(shingle + U(2)), cut)
    name = mix(mix(total) ^ (odd * U(3)) ^ size.astype(U)) >> U(1)
    return size, np.where(size > 0, name.astype(np.int64), 0)


def band_of(size: np.ndarray) -> np.ndarray:
    return np.frexp(size.astype(float))[1] - 1


def block_count(band: int) -> int:
    """Blocks of a band's sketches: about 3.2 shingles a block at the band's top. Up to 4 a block, more blocks hold
    something than linked sets can differ by."""
    top = (2 << band) - 1
    return max(2, int(np.ceil(top / 3.2)) if top > 100 else top)


def most_different(size: np.ndarray) -> np.ndarray:
    """The most that a set of this size and any set linked with it can differ by: (|A| + |B|) / 9 at 80 percent."""
    return (size + size * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)


def block_keys(row: np.ndarray, shingle: np.ndarray, size: np.ndarray, below: bool) -> tuple[np.ndarray, ...]:
    """(row, band, whether it holds anything, key) of the blocks of each set, for its own band or the one below where that can hold a partner."""
    band = band_of(size) - below
    use = size > 0
    if below:
        use &= (band >= 0) & (size * PERCENT <= ((2 << np.maximum(band, 0)) - 1) * 100)
    pick = use[row]
    row, shingle = row[pick], shingle[pick]
    if not len(row):
        return row, row, row > 0, shingle
    shapes = np.array([block_count(b) for b in range(int(band.max()) + 1)], dtype=np.int64)
    blocks = np.where(use, shapes[np.maximum(band, 0)], 0)
    base = np.concatenate([[0], np.cumsum(blocks)])
    at = base[row] + (mix(shingle ^ U(0xA5A5)) >> U(33)).astype(np.int64) % blocks[row]
    held, filled = np.zeros(base[-1], U), np.zeros(base[-1], bool)
    np.bitwise_xor.at(held, at, shingle)
    filled[at] = True
    r = np.repeat(np.arange(len(size)), blocks)
    # Fewer filled blocks than may differ: such a set also meets others like it by its empty blocks.
    thin = use & (np.bincount(r[filled], minlength=len(size)) <= most_different(size))
    sent = np.flatnonzero(filled | thin[r])
    r, b, held, real = r[sent], (np.arange(base[-1]) - base[r])[sent], held[sent], filled[sent]
    bd = band[r]
    key = mix(mix(held + U(7)) ^ mix((bd.astype(U) << U(40)) ^ b.astype(U))) >> U(64 - KEY_BITS)
    # The lowest bit tells the two bands apart that a set is sketched for.
    return r, bd, real, (key & ~U(1)) | (bd.astype(U) & U(1))


def _keys(column: pa.Array):
    row, shingle = shingle_sets(column)
    size, name = class_ids(row, shingle, len(column))
    # One row of each class is enough.
    _, first = np.unique(name, return_index=True)
    chosen = np.zeros(len(name), bool)
    chosen[first] = True
    chosen &= size > 0
    pick = chosen[row]
    row, shingle = row[pick], shingle[pick]
    size = np.where(chosen, size, 0)
    parts = [block_keys(row, shingle, size, below) for below in (False, True)]
    return row, shingle, size, name, *(np.concatenate(x) for x in zip(*parts, strict=True))


def _keys_of(part: pa.RecordBatch):
    *_, key = _keys(part.column(1))
    keys, count = np.unique(key, return_counts=True)
    return keys, count > 1


def _holders(ids: pa.Array, texts: pa.Array, again: np.ndarray) -> pa.Table:
    """One row per class of a chunk that holds recurring blocks: class, n, filled blocks by band, bands, keys, shingles."""
    row, shingle, size, name, r, band, real, key = _keys(texts)
    own = band_of(size)
    filled = [np.bincount(r[real & (band == own[r] - below)], minlength=len(size)) for below in (0, 1)]
    at = np.searchsorted(again, key)
    at[at == len(again)] = 0
    hit = again[at] == key
    # A set whose blocks that recur nowhere are more than may differ has no partner in that band.
    below = (band != own[r]).astype(np.int64)
    recurring = np.bincount(2 * r[hit] + below[hit], minlength=2 * len(size))
    every = np.stack(filled, 1).ravel()
    hit &= every[2 * r + below] - recurring[2 * r + below] <= most_different(size)[r]
    order = np.argsort(r[hit], kind="stable")
    r, band, key = r[hit][order], band[hit][order], key[hit][order]
    rows = np.unique(r)
    k0, k1 = np.searchsorted(r, rows), np.searchsorted(r, rows, "right")
    s0, s1 = np.searchsorted(row, rows), np.searchsorted(row, rows, "right")
    signed = key.view(np.int64)
    return pa.table(
        {
            "cls": pa.array(name[rows], pa.int64()),
            "n": pa.array(size[rows], pa.int32()),
            "own": pa.array(own[rows], pa.int32()),
            "f0": pa.array(filled[0][rows], pa.int32()),
            "f1": pa.array(filled[1][rows], pa.int32()),
            "u0": pa.array(filled[0][rows] - recurring[2 * rows], pa.int32()),
            "u1": pa.array(filled[1][rows] - recurring[2 * rows + 1], pa.int32()),
            "bands": pa.array([band[a:b].astype(np.int32) for a, b in zip(k0, k1, strict=True)], pa.list_(pa.int32())),
            "keys": pa.array([signed[a:b] for a, b in zip(k0, k1, strict=True)], pa.list_(pa.int64())),
            "shingles": pa.array([pack_keys(shingle[a:b] >> U(64 - KEY_BITS)) for a, b in zip(s0, s1, strict=True)], pa.binary()),
        }
    )


def _linked(batches):
    """Compare the sets of candidate pairs."""
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for k, (a, b) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
            x, y = unpack_keys(a.as_py()), unpack_keys(b.as_py())
            same = np.searchsorted(x, y)
            same[same == len(x)] = 0
            both = int((x[same] == y).sum())
            keep[k] = 100 * both >= PERCENT * (len(x) + len(y) - both)
        out = batch.filter(pa.array(keep)).select(["a", "b"])
        if len(out):
            yield out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough. Only nodes that are in pairs move their sets."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = sets.select("node", "shingles").join(needed, "node", "left_semi").dropDuplicates(["node"])
    joined = pairs.select("a", "b").join(held.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    joined = joined.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(_linked, "a long, b long")


_MOST = f"(({{0}}) * {100 - PERCENT}) div {100 + PERCENT}"


def sketch_pairs(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, that the sketches allow, from one row (a, b, key) per block that both hold.

    Each filled block of one side that the other doesn't share stands for one shingle of difference at least, in the
    band of the smaller set.
    """
    odd = F.col("key") % 2 == 1
    shared = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), odd.alias("odd")).groupBy("a", "b").agg(F.count_if("odd").alias("odd"), F.count_if(~F.col("odd")).alias("even"))
    side = lambda k: nodes.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "own", "f0", "f1")])
    both = shared.join(side("a"), "a").join(side("b"), "b")
    fa = F.when(F.col("own_a") > F.col("own_b"), F.col("f1_a")).otherwise(F.col("f0_a"))
    fb = F.when(F.col("own_b") > F.col("own_a"), F.col("f1_b")).otherwise(F.col("f0_b"))
    held = F.when(F.least("own_a", "own_b") % 2 == 1, F.col("odd")).otherwise(F.col("even"))
    alike = (F.col("n_a") * 100 >= F.col("n_b") * PERCENT) & (F.col("n_b") * 100 >= F.col("n_a") * PERCENT)
    return both.where(alike & (F.greatest(fa, fb) - held <= F.expr(_MOST.format("n_a + n_b")))).select("a", "b")


def star_pairs(blocks: DataFrame, order, nodes: DataFrame) -> DataFrame:
    """Pairs of each block's holders with the one that comes first in an order, as far as they are still apart."""
    hubs = blocks.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "c")).alias("h"), F.min("c").alias("x"), F.max("c").alias("y")).where("x != y")
    met = blocks.join(hubs.select("key", F.col("h.node").alias("a"), F.col("h.c").alias("ca")), "key").where("c != ca")
    return sketch_pairs(met.select("a", F.col("node").alias("b"), "key"), nodes)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links).

    Null and blank texts have no shingles and are linked with nothing. Rows that repeat an id are returned as often as
    they are there.
    """

    def sized(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                row, shingle = shingle_sets(part.column(1))
                size, name = class_ids(row, shingle, len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(name, pa.int64())], names=["id", "n", "cls"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    rows = plain.mapInArrow(sized, f"id {kind}, n long, cls long")
    named = _named(rows, class_links(plain, "id", "text"))
    smallest = named.where("c != 0").groupBy("c").agg(F.min("id").alias("least"))
    return named.join(smallest, "c", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _named(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with their component c by the links between classes; rows without words have 0."""
    parts = components(links)
    return rows.join(parts, rows["cls"] == parts["node"], "left").withColumn("c", F.coalesce("component", "cls")).drop("component", "node")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with one row left of each group of near-duplicates: that with the smallest id, null ids last, then
    the one with the smallest hash of its text. All rows without words stay, and all columns, whatever their names.

    Rows are told apart by id and text, so a row that repeats an id with another text is judged by its own text. Of rows
    that repeat both and stay, one stays.
    """

    def tagged(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                row, shingle = shingle_sets(part.column(1))
                size, name = class_ids(row, shingle, len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array(name, pa.int64())], names=["id", "t", "n", "cls"])

    kind = docs.schema[id_col].dataType.simpleString()
    text_hash = F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit("")))
    plain = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), text_hash.alias("t"))
    rows = plain.mapInArrow(tagged, f"id {kind}, t long, n long, cls long")
    named = materialize(_named(rows, class_links(plain, "id", "text")).where("c != 0").select("id", "t", "c"), "jaccard-named")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "t")
    first = named.groupBy("c").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    inside = named.join(first, "c").select("id", "t", (place == F.col("first")).alias("stays"))
    gone = inside.where(~F.col("stays")).select("id", "t").distinct()
    own = docs.select(packed(docs), F.col(quoted(id_col)).alias("own"), text_hash.alias("u"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("u") == F.col("t"))
    kept = own.join(gone, same, "left_anti")
    twice = materialize(inside.where("stays").groupBy("id", "t").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("id", "t"), "jaccard-repeats")
    if not twice.isEmpty():
        # Rows that stay and are there several times: one of them, the first by all its columns as text.
        repeats = kept.join(twice, same, "left_semi").groupBy("own", "u").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
        kept = kept.join(twice, same, "left_anti").select("doc").unionByName(repeats.select("doc"))
    return kept.select(*unpacked(docs))


def class_links(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Verified links (a, b) between classes, enough to connect whatever is linked."""
    schema = "cls long, n int, own int, f0 int, f1 int, u0 int, u1 int, bands array<int>, keys array<long>, shingles binary"
    held = with_recurring(docs, id_col, text_col, _keys_of, _holders, schema, CHUNK, KEY_BITS)
    holders = materialize(held, "jaccard-holders")
    # One node per class, numbered so that the sets with the fewest blocks that recur nowhere come first.
    single = holders.drop("shingles").dropDuplicates(["cls"]).orderBy("u0", "cls").withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(single, "jaccard-nodes")
    sets = holders.select("cls", "shingles").join(nodes.select("cls", "node"), "cls")
    blocks = nodes.select("node", F.explode("keys").alias("key")).withColumn("c", F.col("node"))
    # First the set with the fewest lone blocks, one of a few among equals; then the one that most links lead to, which
    # is what a group's copies were made of.
    spread = F.xxhash64("node", F.floor(F.col("key") / 2) % HUBS)
    tried = materialize(star_pairs(blocks.join(nodes.select("node", "u0"), "node"), F.struct("u0", spread.alias("s")), nodes), "jaccard-tried")
    links = materialize(verified(tried, sets), "jaccard-links")
    for _ in range(ROUNDS):
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
        degree = ends.groupBy("node").agg((-F.count(F.lit(1))).alias("d"))
        mixed = materialize(_still_apart(_placed(blocks, links)), "jaccard-mixed")
        placed = materialize(_enough(mixed, nodes), "jaccard-placed")
        ranked = placed.join(degree, "node", "left").withColumn("d", F.coalesce("d", F.lit(0)))
        more = materialize(star_pairs(ranked, F.col("d"), nodes).join(tried, ["a", "b"], "left_anti"), "jaccard-more")
        links = materialize(links.unionByName(verified(more, sets)), "jaccard-links")
        tried = tried.unionByName(more)
    # Holders of one block that are still apart, as far as they have enough such blocks for a link.
    mixed = materialize(_still_apart(_placed(placed, links)), "jaccard-mixed")
    apart = materialize(_enough(mixed, nodes), "jaccard-apart")
    rest = materialize(apart_pairs(apart, nodes, sets).join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
    found = links.unionByName(verified(rest, sets))
    names = lambda k: nodes.select(F.col("node").alias(k), F.col("cls").alias(f"cls_{k}"))
    return found.join(names("a"), "a").join(names("b"), "b").select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))


def apart_pairs(apart: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different components whose sets can be linked, by the rarest shingles of each.

    Shingles that only one component holds can't be in a link's overlap. Each set's shingles are put in one order for all:
    those first, then the others by their number of holders. From the first shingle that two linked sets share, that one
    included, each has as many left as they share in all, so a set is looked up by its first shingles only, and the smaller
    set of a pair by fewer still. Pairs that these places don't allow are dropped within the join.
    """
    placed = apart.select("node", "c").distinct().join(nodes.select("node", "n"), "node")
    held = materialize(sets.join(placed, "node").dropDuplicates(["node"]), "jaccard-held")
    rows = held.select("node", "c", "shingles").mapInArrow(_listed, "key long, node long, c long")
    # Keys are counted before they are shuffled, and joined from a table, so that a common one can be dealt to many tasks.
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("x"), F.max("c").alias("y"))
    common = materialize(counted.where("x != y").select("key", "df"), "jaccard-common")
    own = rows.join(common, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("own"))
    able = own.join(held.select("node", "c", "n"), "node").withColumn("s", F.size("own").cast("long")).where(F.col("s") * 100 >= F.col("n") * PERCENT)
    # A set of n shares n PERCENT / 100 shingles at least with a linked set, and 2 n PERCENT / (100 + PERCENT) if that is as large.
    first = F.expr(f"n * {100 - PERCENT} div 100 + 1 - (n - s)")
    looked = able.select("node", "c", "n", "s", F.posexplode(F.slice("own", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("at", "x"))
    prefixes = materialize(looked.select(F.col("x.key").alias("key"), "node", "c", "n", "s", (F.col("n") - F.col("s") + F.col("at")).alias("at")), "jaccard-prefixes")
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("node", "c", "n", "s", "at")]
    less = prefixes.where(F.expr(f"at <= n * {100 - PERCENT} div {100 + PERCENT}")).select("key", *side("a"))
    before = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    overlap = F.least("s_a", "s_b", F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    alike = (F.col("n_a") * 100 >= F.col("n_b") * PERCENT) & (overlap * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT)
    met = less.join(prefixes.select("key", *side("b")), "key").where((F.col("c_a") != F.col("c_b")) & before & alike)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _listed(batches):
    """A row for each shingle of a set."""
    for batch in batches:
        for part in slices(batch, "shingles"):
            held = [unpack_keys(x.as_py()) for x in part.column("shingles")]
            at = np.repeat(np.arange(len(held)), [len(x) for x in held])
            key = pa.array(np.concatenate(held).view(np.int64))
            yield pa.RecordBatch.from_arrays([key, part.column("node").take(pa.array(at)), part.column("c").take(pa.array(at))], names=["key", "node", "c"])


def _placed(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Blocks with their holders' components by the links so far."""
    return blocks.drop("c").join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))


def _still_apart(placed: DataFrame) -> DataFrame:
    """Rows of the blocks whose holders are in more than one component."""
    mixed = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("key")
    return placed.join(mixed, "key", "left_semi")


def _enough(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the sets that have as many blocks left, in either band, as a link needs there."""
    most = F.expr(_MOST.format(f"n + n * 100 div {PERCENT}"))
    counts = placed.groupBy("node").agg(F.count_if(F.col("key") % 2 == 1).alias("odd"), F.count_if(F.col("key") % 2 == 0).alias("even"))
    here, below = (F.when(F.col("own") % 2 == k, F.col("odd")).otherwise(F.col("even")) for k in (1, 0))
    able = counts.join(nodes.select("node", "n", "own", "f0", "f1"), "node").where((F.col("f0") - here <= most) | ((F.col("f1") + below > 0) & (F.col("f1") - below <= most)))
    return placed.join(able.select("node"), "node", "left_semi")


def op7_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
