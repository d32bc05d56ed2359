import hashlib
import random

import numpy as np

from rentloom.llm import substring_dedup as substring_dedup_module
from rentloom.llm.substring_dedup import HOT, LENGTH, dealt, owned, substring_dedup, told_apart
from rentloom.llm.suffix_groups import suffix_order


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        mark = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - LENGTH + 1):
            if raw[s : s + LENGTH] in seen:
                mark[s : s + LENGTH] = 1
            seen.add(raw[s : s + LENGTH])
        kept = bytes(b for b, m in zip(raw, mark, strict=False) if not m)
        out[i] = (len(raw), int(mark.sum()), int((np.diff(mark, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randrange(1, rng.choice([2, 3, 7])) for _ in range(rng.randrange(1, 40))] + [0]
        assert suffix_order(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i, s=s: s[i:])
    assert suffix_order(np.array([0])).tolist() == [0]


def test_against_brute_force(spark, documents):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 5)))
    passages = [" ".join(word() for _ in range(rng.randrange(20, 60))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice(passages)[rng.randrange(0, 30) :] if rng.random() < 0.5 else " ".join(word() for _ in range(30)) for _ in range(rng.randrange(1, 5))]
        rows.append((i, rng.choice([" ", "", "\n"]).join(parts)))
    rows += [(50, None), (51, ""), (52, "x" * 99), (53, "x" * 100), (54, "x" * 350), (55, "ab" * 200), (56, rows[0][1])]
    docs = documents(rows).withColumnRenamed("lang", "seg").withColumnRenamed("source", "h")
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(docs).collect()}
    assert got == brute(rows)


def test_odd_rows(spark, documents):
    text = "some words that fill a line, " * 8
    got = {r.doc_id: r.n_removed for r in substring_dedup(documents([(None, text), (3, text)])).collect()}
    assert got[3] == len(text) and 0 < got[None] < len(text)
    assert substring_dedup(documents([])).count() == 0


def test_hot_anchors(spark, documents):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    common = [prose(30), prose(22)]
    rows = [(i, f"{prose(rng.randrange(8, 20))} {common[i % 2]} {prose(rng.randrange(8, 20))}") for i in range(60)]
    # Passages with the same words next to them, so that windows outside the passage recur as well.
    rows += [(100 + i, f"{rows[i][1][40:]} {prose(9)} {rows[59 - i][1][:-30]}") for i in range(20)]
    want = brute(rows)
    for hot in (1, 5, HOT):
        assert {r[0]: tuple(r)[1:] for r in substring_dedup(documents(rows), hot=hot).collect()} == want
    holders = spark.range(3000).selectExpr("cast(if(id < 2500, 7, id % 100) as long) a", "xxhash64(id) g", "id owner", "1 windows")
    most = lambda hot: max(r["count"] for r in dealt(holders, 16, hot).groupBy("bucket").count().collect())
    assert most(HOT) < 400 and most(10_000) >= 2500


def test_sections_of_long_texts(monkeypatch):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 100, 3000), np.tile(rng.integers(97, 123, 7), 300)]).astype(np.uint8)
    at, sums = np.array([0, 1200, len(data)]), substring_dedup_module.prefix_hash(data)
    whole = substring_dedup_module.anchors(data, at, sums)
    monkeypatch.setattr(substring_dedup_module, "SECTION", 97)
    cut = substring_dedup_module.anchors(data, at, sums)
    for a, b in zip(whole, cut, strict=True):
        assert a.tolist() == b.tolist()


def test_very_long_text(spark, documents):
    line = "a sentence that stands in many places and is long enough to count as a repeat when it comes back again. "
    rows = [(1, line * 3), (2, "x" * 3_000_000 + line), (3, None)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substring_dedup(documents(rows)).collect()}
    assert got[1] == (2 * len(line), 1) and got[3] == (0, 0) and got[2][0] >= 3_000_000 - 1 + len(line) - 1


def test_windows_of_one_class_are_compared():
    rng = np.random.default_rng(5)
    kinds = [rng.integers(97, 123, LENGTH).astype(np.uint8) for _ in range(6)]
    pick = rng.integers(0, 6, 200)
    data = np.concatenate([kinds[k] for k in pick])
    at, place = np.arange(200) * LENGTH, rng.permutation(200)
    first = {k: min(place[pick == k]) for k in set(pick.tolist())}
    want = {i for i in range(200) if place[i] != first[pick[i]]}
    # Classes that tell all apart, some, and none.
    for classes in (6, 4, 1):
        order, again = told_apart(data, at, (pick % classes).astype(np.uint64), (place,))
        assert set(order[again].tolist()) == want
    order, again = told_apart(data, at[:0], np.zeros(0, np.uint64), (place[:0],))
    assert not len(order) and not len(again)


def test_segments_of_one_hash_are_told_apart(spark):
    schema = "a long, g long, h long, windows long, ids array<long>, starts array<long>, texts array<long>"
    rows = [(1, 5, 7, 3, [9], [0], [1]), (1, 5, 7, 3, [4], [2], [1]), (1, 5, 8, 4, [2], [6], [1]), (2, 5, 7, 3, [1], [0], [1])]
    same, found = owned(spark.createDataFrame([rows[0], rows[1], rows[3]], schema))
    assert sorted((r.a, r.g, r.owner.id) for r in found.collect()) == [(1, 5, 4), (2, 5, 1)] and {r.g for r in same.collect()} == {5}
    apart, found = owned(spark.createDataFrame(rows, schema))
    assert sorted((r.a, r.owner.id, r.windows) for r in found.collect()) == [(1, 2, 4), (1, 4, 3), (2, 1, 3)]
    assert len({(r.a, r.g) for r in apart.collect()}) == 3 and apart.count() == 4
