import random

from rentloom.llm.line_dedup import RUN_LINES, line_dedup, repeated_runs


def brute(rows, run=RUN_LINES):
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        gone = set()
        for k in range(len(lines) - run + 1):
            gram = tuple(lines[k : k + run])
            if gram in seen:
                gone |= set(range(k, k + run))
            seen.add(gram)
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_against_brute_force(spark, documents):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    docs = documents(rows).withColumnRenamed("lang", "runs").withColumnRenamed("source", "t")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup(docs).collect()}
    assert got == brute(rows)
    for r in repeated_runs(docs).collect():
        assert (r.first_id, r.first_line) < (r.id, r.start) and r.stop - r.start >= RUN_LINES


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "a\nb"), (None, "x\ny\nz"), (5, "x\ny\nz"), (6, "l\n" * 3000)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup(documents(rows)).collect()}
    assert got[1] == (1, 0, None) and got[2] == (1, 0, "") and got[4] == (2, 0, "a\nb")
    assert got[None] == (3, 0, "x\ny\nz") and got[5] == (3, 3, "")
    assert got[6][1] == 2999 and line_dedup(documents([])).count() == 0
    assert line_dedup(documents([(1, "a\nb\nc"), (1, "a\nb\nc")])).where("n_removed > 0").count() == 0


def test_long_runs_of_few_lines(spark, documents):
    long = " ".join(f"w{k}" for k in range(51))
    half = [" ".join(f"{c}{k}" for k in range(26)) for c in "xy"]
    rows = [(1, f"a\n{long}\nb"), (2, long), (3, f"c\nd\n{long}\ne"), (4, "\n".join(half)), (5, "\n".join(["f", *half])), (6, half[0]), (7, " ".join(long.split()[1:])), (8, " ".join(long.split()[1:]))]
    docs = documents(rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup(docs).collect()}
    assert got[1] == (3, 0, rows[0][1]) and got[2] == (1, 1, "") and got[3] == (4, 1, "c\nd\ne")
    assert got[4] == (2, 0, rows[3][1]) and got[5] == (3, 2, "f") and got[6] == (1, 0, half[0])
    # Fifty words are not enough.
    assert got[8] == (1, 0, rows[7][1])
    assert {r.doc_id for r in line_dedup(docs, words=None).where("n_removed > 0").collect()} == set()


def test_windows_are_planned_once(spark, documents):
    """The driver's memory goes to plans: what makes the windows is not part of the plan that reads them twice."""
    docs = documents([(1, "a\nb\nc"), (2, "a\nb\nc\nd")])
    plan = line_dedup(docs)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Generate ") <= 2
    assert {r.doc_id: r.n_removed for r in plan.collect()} == {1: 0, 2: 3}
