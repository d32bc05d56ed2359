import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentloom.llm import components as C
from rentloom.llm import jaccard_join as J
from rentloom.llm.chunks import pack_keys
from rentloom.llm.components import components
from rentloom.llm.jaccard_join import apart_pairs, near_duplicates


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append(set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set()))
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                part[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("size", [(1, 12), (20, 60), (80, 260)])
def test_against_brute_force(spark, documents, size):
    rng = random.Random(size[0])
    words = [f"w{k}" for k in range(40)]
    rows, texts = [], []
    for i in range(70):
        if texts and rng.random() < 0.7:
            text = list(rng.choice(texts))
            for _ in range(rng.randrange(0, 1 + len(text) // 15)):
                text[rng.randrange(len(text))] = rng.choice(words)
            text = text[: len(text) - rng.randrange(0, 1 + len(text) // 10)]
        else:
            text = [rng.choice(words) for _ in range(rng.randrange(*size))]
        texts.append(text)
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else "\t".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows).withColumnRenamed("lang", "n")).collect()}
    assert got == brute(rows)


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "two words"), (9, "a b c d e f"), (9, "a b c d e f"), (8, "long " * 50000)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(documents(rows)).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (8, 1, 8), (9, 2, 9), (9, 2, 9)]
    assert near_duplicates(documents([])).count() == 0


def test_components_of_a_chain(spark):
    links = spark.range(1, 41).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(100, 101)], "a long, b long"))
    got = {r.node: r.component for r in components(links).collect()}
    assert got == dict.fromkeys(range(1, 42), 1) | {100: 100, 101: 100}


def test_components_plan_little(spark, monkeypatch):
    """The driver's memory goes to plans: no step has more than three exchanges by key, and stars take no round."""
    plans, write = [], C.materialize

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df, name)

    monkeypatch.setattr(C, "materialize", written)
    stars = spark.createDataFrame([(2, 1), (1, 3), (5, 4), (5, 5), (4, 6)], "a long, b long")
    assert {r.node: r.component for r in components(stars).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert len(plans) == 2
    components(spark.range(20).selectExpr("id AS a", "id + 1 AS b"))
    assert len(plans) > 4 and max(plans) <= 3


def test_rarest_shingles_lose_no_link(spark):
    """Every pair of different components that is linked, also just so, is found by the first shingles of its sets."""
    rng = random.Random(5)
    sets = []
    for _ in range(160):
        base = list(rng.choice(sets)) if sets and rng.random() < 0.8 else [rng.randrange(400) for _ in range(rng.randrange(1, 60))]
        held = set(base[: len(base) - rng.randrange(0, 1 + len(base) // 6)]) | {rng.randrange(400) for _ in range(rng.randrange(0, 1 + len(base) // 8))}
        sets.append(held or {1})
    sets += [set(range(1000, 1008)), set(range(1000, 1010)), set(range(1000, 1009)) | {2000}, set(range(1000, 1009)) | {2001}]
    rows = [(k, len(x), k % 150, pack_keys(np.array(sorted(x), np.uint64))) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, n int, c long, shingles binary")
    got = {tuple(r) for r in apart_pairs(df.select("node", "c", F.lit(1).alias("key")), df.select("node", "n"), df.select("node", "shingles")).collect()}
    able = [(a, b) for b in range(len(sets)) for a in range(b) if a % 150 != b % 150]
    linked = {(a, b) for a, b in able if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked <= got <= set(able) and len(linked) > 20
    edge = len(sets) - 4
    assert (edge, edge + 1) in linked and (edge + 2, edge + 3) in linked


def test_a_family_without_links_gives_no_pairs(spark, documents, monkeypatch):
    """Sets that share a passage and have too much of their own are told apart by that, not compared all with all."""
    rng = random.Random(1)
    passage = [f"p{k}" for k in range(86)]
    rows = [(i, " ".join(passage + [f"own{rng.randrange(10**9)}" for _ in range(18)])) for i in range(60)]
    tables, write = {}, J.materialize

    def written(df, name):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(J, "materialize", written)
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(rows)).collect()}
    assert got == {i: i for i, _ in rows}
    assert tables["jaccard-apart"].count() > 0 and tables["jaccard-rest"].count() == 0


def test_the_stage_tells_a_family_apart_by_few_pairs(spark, documents, monkeypatch):
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(86)]
    rows = [(i, " ".join(passage + [f"own{rng.randrange(10**9)}" for _ in range(18)])) for i in range(60)]
    rows.append((99, rows[7][1] + " more"))
    pairs, write = [], J.materialize

    def written(df, name):
        out = write(df, name)
        if name == "jaccard-rest":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(J, "materialize", written)
    kept = sorted(r.doc_id for r in J.without_near_duplicates(documents(rows)).collect())
    assert kept == list(range(60)) and len(pairs) == 1 and pairs[0] <= 1
