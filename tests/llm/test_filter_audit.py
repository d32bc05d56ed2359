import random
import re
from itertools import permutations

from rentloom.llm.filter_audit import filter_audit


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1}
    bad = {i for i, _, t in labels if t == 1}
    items = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        items.append((lang or "", fails, i in good, i in bad))
    out = {}
    for part in {x[0] for x in items}:
        own = [x for x in items if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                hit = [x for x in left if x[1][f]]
                kept = [x for x in left if not x[1][f]]
                alone = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                out[part, "".join(order), k + 1] = [len(kept), len(hit), sum(x[1][f] for x in own) - len(hit), alone, sum(x[2] for x in hit), sum(x[3] for x in hit)]
                total[f] += len(hit)
                left = kept
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "doc_id long, text string, lang string, flags string, n string, hash string, part string, id string, `a.b` string"


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, *["mine"] * 6) for r in rows], SCHEMA)
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, n string")).collect()
    assert all(r.filter == r.filter_order[r.step - 1] for r in got)
    return {(r.part, r.filter_order, r.step): [r[c] for c in NAMES] for r in got}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["the", "and", "word", "ÄÖ", "é", "Some", "ab"]
    texts = [None, "", " ", "#", "ABC def", "a b", "x" * 300_000]
    texts += [" ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(400)), "A", "$"][: rng.randrange(1, 6)]) for _ in range(rng.choice([3, 199, 200, 201, 400]))) for _ in range(25)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for _ in range(60)]
    assert audited(spark, rows, labels) == brute(rows, [x[:3] for x in labels])


def test_copies_and_ties(spark):
    rows = [(5, "same", "en"), (5, "same", "en"), (5, "same", "fr"), (7, "same", "fr"), (3, "Same", "en"), (None, "same", "en")]
    got = audited(spark, rows, [(5, 1, 1, "")])
    assert got == brute(rows, [(5, 1, 1)])
    # Both rows of the smallest id stay, in whatever part they are.
    assert got["fr", "EABCD", 1][:2] == [1, 1] and got["en", "EABCD", 1][:2] == [4, 0]


def test_no_rows(spark):
    assert audited(spark, [], []) == {}
