import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rentloom.llm.decontamination import Windows, decontaminate
from rentloom.llm.fm_index import FMIndex, WaveletMatrix, suffix_order


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)]


def brute(rows, items, length):
    windows = {}
    for i, t in items:
        ws = [w for w, _, _ in words_of(t)]
        k = min(length, len(ws))
        for p in range(len(ws) - k + 1 if k else 0):
            windows.setdefault(tuple(ws[p : p + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        ws = words_of(t)
        hit, named = set(), set()
        for k in range(1, length + 1):
            for p in range(len(ws) - k + 1):
                if (g := tuple(w for w, _, _ in ws[p : p + k])) in windows:
                    hit |= set(range(p, p + k))
                    named |= windows[g]
        spans = []
        for p in sorted(hit):
            if spans and p - 1 in hit:
                spans[-1][1] = ws[p][2]
            else:
                spans.append([ws[p][1], ws[p][2]])
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + (t or "")[at:a], b
        out.append((i, len(ws), len(hit), sorted(named), [tuple(s) for s in spans], kept + (t or "")[at:]))
    return out


def found(df):
    return [(r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans], r.kept) for r in df.collect()]


def order(rows):
    return sorted(rows, key=repr)


NAMES = "items string, id string, spans string, n_hit string, `a.b` string"


def tables(spark, rows, items):
    docs = spark.createDataFrame([(*r, *["mine"] * 5) for r in rows], f"doc_id long, text string, {NAMES}")
    return docs, spark.createDataFrame([(*r, "mine") for r in items], "item_id long, text string, `id` string")


@pytest.mark.parametrize("shard, block", [(8 << 20, 4 << 20), (60, 4 << 20), (400, 50)])
def test_against_brute_force(spark, shard, block):
    rng = random.Random(3)
    some = lambda n, pool: " ".join(rng.choice(pool) + rng.choice(["", "", ",", "\n", "_"]) for _ in range(n))
    pool = ["a", "b", "Ab", "É", "漢", "1"]
    items = [(k % 9, some(rng.choice([0, 1, 2, 3, 4, 7, 12]) + 3, pool)) for k in range(12)] + [(None, "zz Yy xx ww"), (50, None), (51, "--"), (52, "q"), (52, "q")]
    rows = [(rng.choice([None, *range(20)]), some(rng.randrange(30), [*pool, "other", "zz", "yy"])) for _ in range(40)]
    rows += [(100, None), (101, ""), (102, "xx zz YY xx! WW q"), (102, "xx zz YY xx! WW q"), (103, items[0][1]), (104, "b " * 3000)]
    docs, benchmark = tables(spark, rows, items)
    assert order(found(decontaminate(docs, benchmark, words=4, shard=shard, block=block))) == order(brute(rows, items, 4))


def test_ten_words_and_hot_passage(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage), (2, "three four five six seven eight nine ten eleven twelve thirteen"), (3, "five six")]
    rows = [(k, f"start{k} {passage.upper()} end" if k % 3 else "one two three four five clean six") for k in range(600)]
    docs, benchmark = tables(spark, rows, items)
    got = found(decontaminate(docs, benchmark))
    assert order(got) == order(brute(rows, items, 10))
    assert {tuple(r[3]) for r in got} == {("1", "2", "3"), ()}


def test_no_items_and_no_rows(spark):
    docs, benchmark = tables(spark, [(1, "some words"), (None, None)], [])
    assert order(found(decontaminate(docs, benchmark))) == [(1, 2, 0, [], [], "some words"), (None, 0, 0, [], [], "")]
    docs, benchmark = tables(spark, [], [(1, "x")])
    assert found(decontaminate(docs, benchmark)) == []


def test_odd_names_and_long_text(spark):
    docs = spark.createDataFrame([("k", "word " * 400_000 + "the end of it")], "`a.b` string, `c``d` string")
    items = spark.createDataFrame([("x", "the end")], "`i.j` string, text string")
    (r,) = decontaminate(docs, items, "a.b", "c`d", "i.j").collect()
    assert (r["a.b"], r.n_words, r.n_hit, r["items"]) == ("k", 400_004, 2, ["x"]) and r.kept.endswith("word  of it")


def test_index_against_plain_search():
    rng = np.random.default_rng(7)
    for most in (1, 2, 5, 40):
        runs = [rng.integers(1, most + 1, rng.integers(0, 30)) for _ in range(40)] + [np.ones(200, int)] * 3
        symbols = np.concatenate([x for r in runs for x in (r, [0])])
        index = FMIndex(symbols, most)
        for length in (1, 2, 3, 10):
            patterns = np.unique(rng.integers(1, most + 1, (50, length)), axis=0)
            low, high = index.find(patterns)
            for p, a, b in zip(patterns, low, high, strict=True):
                want = [k for k in range(len(symbols) - length + 1) if (symbols[k : k + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


def test_suffix_order_and_wavelet_ranks():
    rng = np.random.default_rng(1)
    symbols = np.append(rng.integers(0, 3, 500), 0)
    zeros = iter(range(1000))
    text = [(0, next(zeros)) if x == 0 else (int(x), -1) for x in symbols]
    assert suffix_order(symbols).tolist() == sorted(range(len(text)), key=lambda k: text[k:])
    matrix = WaveletMatrix(symbols, 2)
    places = np.arange(len(symbols) + 1)
    for c in range(3):
        (got,) = matrix.ranks(np.full(len(places), c), places)
        assert got.tolist() == np.concatenate([[0], np.cumsum(symbols == c)]).tolist()
    assert matrix.symbols(places[:-1]).tolist() == symbols.tolist()


def test_windows_know_their_items():
    w = Windows(["a", "b"], pa.array(["x y z", "y z"]), 2)
    assert [(p.shape, cut.tolist()) for p, cut, _ in w.by_length] == [((2, 2), [0, 1, 3])]
