import hashlib
from collections import defaultdict

from rentloom.llm.exact_dedup import PAGE_BITS, equal_groups, exact_dedup, sieve, sieved


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_against_brute_force(spark, documents):
    long = "x" * 70
    rows = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, long + "1"), (8, long + "2"), (9, long.upper() + "1"), (9, "dup"), (9, "dup"), (None, "ab")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    docs = documents(rows).withColumnsRenamed({"lang": "n", "source": "full"})
    want = sorted((i is not None, i or 0, (k := max(x for x in groups[lowered(t)] if x is not None)), len(groups[lowered(t)]), i == k) for i, t in rows)
    for most in (1000, 0):
        got = exact_dedup(docs, most=most).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == want
        assert all(r.text_sha256 == hashlib.sha256(lowered(dict(rows[:9])[r.doc_id]).encode()).hexdigest() for r in got if r.doc_id in range(1, 9))
    assert exact_dedup(documents([])).count() == 0


def test_long_and_null_texts(spark, documents):
    rows = [(1, "Word " * 200_000), (2, "wORD " * 200_000), (3, "word " * 199_999 + "w0rd ")]
    assert {r.doc_id: r.keep_id for r in exact_dedup(documents(rows)).collect()} == {1: 2, 2: 2, 3: 3}
    assert {r.keep_id for r in exact_dedup(documents([(1, None), (5, None), (2, None)])).collect()} == {5}


def test_bitmap_passes_all_that_recur(spark):
    rows = spark.range(60_000).selectExpr("id", "if(id < 40000, id % 20000, id) as n")
    for pages in (1, 64):
        passed = {r.n for r in sieved(rows, ["n"], sieve(rows, ["n"], pages), pages).collect()}
        assert passed >= set(range(20_000))
        by_chance = len(passed) - 20_000
        # As many of the others as there are bits set, about.
        assert abs(by_chance / 20_000 - (1 - 2.718281828 ** (-20_000 / (pages * PAGE_BITS)))) < 0.02
    full = spark.range(400_000).selectExpr("id % 200000 as n")
    assert sieved(rows, ["n"], sieve(full, ["n"], 1), 1).count() > 59_000


def test_groups_alike_with_a_full_bitmap(spark, documents):
    rows = [(k, f"text {k % 700}" if k < 1400 else f"own {k}") for k in range(2000)]
    want = {(f"text {k}", 700 + k, 2) for k in range(700)}
    for pages in (1, 64):
        got = equal_groups(documents(rows), pages=pages).collect()
        assert {(r.keep_id, r.group_size, r.full) for r in got} == {(k, n, hashlib.sha256(t.encode()).hexdigest()) for t, k, n in want}


def test_one_text_that_a_third_of_all_rows_hold(spark, documents):
    rows = [(k, "The Same" if k % 3 == 0 else f"text {k}") for k in range(3000)]
    for most in (1000, 0):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(documents(rows).repartition(7), most=most).collect()}
        assert got == {k: (2997, 1000) if k % 3 == 0 else (k, 1) for k in range(3000)}
