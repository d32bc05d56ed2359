import random
import re
from collections import Counter

import numpy as np
import pytest

from rentloom.llm.phrases import Prefixes, candidates, leaves, mine_phrases, nodes


def brute(rows, least, top, covered=50):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for n in (1, 2, 3):
                for k in range(len(ws) - n + 1):
                    count[lang, tuple(ws[k : k + n])] += 1
    out = []
    good = {k: v for k, v in count.items() if len(k[1]) > 1 and v >= least}
    for (lang, p), a in good.items():
        if any(g == lang and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q))) and 100 * v >= covered * a for (g, q), v in good.items()):
            continue
        cuts = [(1000000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(p), count[lang, p[:k]], count[lang, p[k:]]))
    rows = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        rows += [(lang, i + 1, p, a, left, right, total[lang], s) for i, (_, s, a, p, left, right) in enumerate(own[:top])]
    return sorted(rows)


def mined(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], "text string, lang string, words string, `a.b` string, n string")
    return sorted(tuple(r) for r in mine_phrases(docs, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed):
    rng = random.Random(seed)
    pool = ["The", "of", "new", "York", "ÉA", "é", "漢", "x1", "-", "a" * 40]
    text = lambda: "".join(rng.choice(pool[: rng.choice([3, 10])]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "!"]) for _ in range(rng.randrange(60)))
    rows = [(text(), rng.choice(["en", "de", None, "und", ""])) for _ in range(120)]
    return [*rows, (None, "en"), ("", None), ("New York City " * 3000, "en"), ("...", "fr"), ("one two", "fr")]


@pytest.mark.parametrize("more", [{}, {"chunk": 300, "budget": 64, "share": 1e-9}, {"chunk": 2000, "budget": 100, "key_bits": 1}])
def test_against_brute_force(spark, more):
    rows = corpus(4)
    assert mined(spark, rows, least=3, top=25, **more) == brute(rows, 3, 25)


def test_copies_and_ties(spark):
    rows = [("alpha beta gamma. delta epsilon", "en")] * 400 + [("delta epsilon", "de")] * 10 + [("delta zeta", "de")] * 9
    got = mined(spark, rows)
    assert got == brute(rows, 10, 2000)
    assert [r[2] for r in got if r[0] == "en"] == ["alpha beta gamma", "delta epsilon"]


def test_no_words(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("", "en"), (" ., ", "en")]) == []


def test_exact_beyond_64_bits(spark):
    words = spark.createDataFrame([("en", "a", 4 * 10**15, 1), ("en", "b", 3 * 10**15 + 1, 2)], "lang string, word string, f long, id long")
    (r,) = candidates(spark.createDataFrame([(1, 2, 0, 2 * 10**15 + 7)], "a long, b long, c long, n long"), words).collect()
    assert r.score == 1000000 * (2 * 10**15 + 7) ** 2 // (4 * 10**15 * (3 * 10**15 + 1))


def test_groups_take_whole_prefixes():
    rng = np.random.default_rng(2)
    a, b, c = rng.integers(1, 9, (3, 5000))
    prefixes = Prefixes([1, 2], [(1, 2)], 50)
    group = prefixes.group(a, b, c)
    for k in range(3, 9):
        assert len(set(group[a == k])) == 1
    assert len(set(group[a == 2])) > 3 and all(len(set(group[(a == 2) & (b == k)])) == 1 for k in range(1, 9))
    assert len(set(group[(a == 1) & (b == 2)])) > 3 and prefixes.long_pair(a, b).tolist() == ((a == 1) & (b == 2)).tolist()


@pytest.mark.parametrize("key_bits", [21, 2])
def test_counts_from_leaves(key_bits):
    rng = np.random.default_rng(3)
    suffixes = list(rng.integers(1, 7, (3, 2000)))
    own, totals = leaves(suffixes, np.ones(2000, np.int64), key_bits)
    assert dict(zip(zip(*[x.tolist() for x in own], strict=True), totals.tolist(), strict=True)) == Counter(zip(*[x.tolist() for x in suffixes], strict=True))
    pairs, n = nodes(own, totals, 2)
    assert dict(zip(zip(*[x.tolist() for x in pairs], strict=True), n.tolist(), strict=True)) == Counter(zip(*[x.tolist() for x in suffixes[:2]], strict=True))
