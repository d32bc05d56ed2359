import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline as C
from rentloom.llm import quality
from rentloom.llm.packing import Encoder
from rentloom.llm.secret_scan import KINDS, MASK


def pack_totals(pieces):
    """What the packing holds, whatever its order: each document's ids, piece by piece."""
    return sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces.collect())


def test_stages_on_a_small_corpus(spark, documents, tmp_path):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        junk = i % 6 == 5
        rows.append((i, "same " * 90 if junk else f"{prose(30)}.\n{prose(30)}.\n{prose(30)}."))
        labels.append((i, int(not junk), 0))
    shared = "\n".join(prose(12) for _ in range(4))
    rows[0] = (0, rows[0][1] + "\n" + shared)
    rows[2] = (2, rows[2][1] + "\n" + shared)
    rows[8] = (8, rows[7][1].replace("\n", " "))
    rows[7] = (7, rows[7][1].replace("\n", " ") + " tail")
    rows[9] = (9, rows[9][1] + " password=7db7aa4a5fcc78305")
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(C.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept[name] = docs
    good = {i for i, q, _ in labels if q}
    assert {r.doc_id for r in kept["quality_classifier"].collect()} == good
    lines = {r.doc_id: r.text for r in kept["line_dedup"].collect()}
    assert set(lines) == good and lines[2] == rows[2][1].replace("\n" + shared, "") and lines[0] == rows[0][1]
    near = {r.doc_id for r in kept["ngram_jaccard_join"].collect()}
    assert near == good - {8}
    masked = {r.doc_id: r.text for r in kept["secret_scan"].collect()}
    assert set(masked) == near and "7db7aa4a" not in masked[9] and re.search(r"password=\[secret\]", masked[9])
    assert pack_totals(kept["packing"]) == pack_totals(C.run(spark, str(tmp_path)))


def test_empty_corpus(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def plain_lines(rows):
    """Later runs of three lines, or of fewer with over 50 words, go. rows: (id, text, ...) in any order."""
    seen, out = set(), []
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (row[1] or "").split("\n")
        gone = set()
        for n in (1, 2, 3):
            for k in range(len(lines) - n + 1):
                gram = tuple(lines[k : k + n])
                if n < 3 and sum(len(x.split()) for x in gram) <= 50:
                    continue
                if gram in seen:
                    gone |= set(range(k, k + n))
                seen.add(gram)
        if len(gone) < len(lines):
            out.append((row[0], "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else row[1], *row[2:]))
    return out


def plain_near(rows):
    """One row of each group of near-duplicates: the smallest id, null ids last."""
    sets = []
    for row in rows:
        w = (row[1] or "").lower().split()
        sets.append(set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for k, row in enumerate(rows):
        place = (row[0] is None, row[0] or 0)
        if sets[k] and (group[k] not in first or place < first[group[k]][0]):
            first[group[k]] = (place, k)
    return [row for k, row in enumerate(rows) if not sets[k] or first[group[k]][1] == k]


def plain_masks(rows):
    """Values that one source has in two source and language pairs at most, blanked where they stand."""
    found, owners, repos = [], {}, {}
    for k, row in enumerate(rows):
        for kind, pattern, group, least in KINDS:
            for m in re.finditer(pattern, row[1] or ""):
                value = m[group]
                if len(value) < least or kind == "opaque" and not all(re.search(c, value) for c in ("[A-Z]", "[a-z]", "[0-9]")):
                    continue
                found.append((k, m.end() - len(value), m.end(), value))
                owners.setdefault(value, set()).add(row[3])
                repos.setdefault(value, set()).add((row[2], row[3]))
    texts = {k: list(row[1]) for k, row in enumerate(rows) if row[1] is not None}
    merged = {}
    for k, a, b, value in sorted(found):
        if len(owners[value]) <= 1 and len(repos[value]) <= 2:
            spans = merged.setdefault(k, [])
            if spans and a < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
    for k, spans in merged.items():
        for a, b in reversed(spans):
            texts[k][a:b] = [MASK]
    return [(row[0], "".join(texts[k]) if k in texts else None, *row[2:]) for k, row in enumerate(rows)]


def test_run_against_plain_python(spark, tmp_path):
    """run() on rows with null and repeated ids, null texts and odd columns, against stage after stage in plain Python."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(80):
        junk = i % 6 == 5
        rows.append((i, "same " * 90 if junk else "\n".join(prose(20) for _ in range(3)), rng.choice(["en", "de", "fr"]), f"src{i % 4}"))
        labels.append((i, int(not junk), 0))
    long = prose(60)
    put = lambda i, text: rows.__setitem__(i, (i, text, *rows[i][2:]))
    put(2, rows[0][1].replace("\n", " ") + " tail")
    put(0, rows[0][1].replace("\n", " "))
    put(6, f"{rows[6][1]}\n{long}")
    put(8, f"{long}\n{rows[8][1]}")
    put(9, rows[9][1] + " password=7db7aa4a5fcc78305 token: yesterday, not yesterday")
    put(12, rows[12][1] + " secret=shared1234")
    put(13, rows[13][1] + " secret=shared1234")
    rows += [(3, prose(50), "en", "src1"), (None, prose(50), "en", "src1"), (None, prose(57), "de", "src2"), (None, rows[0][1], "en", "src0"), (90, None, "en", "src0"), (91, "", "en", "src0"), rows[10], rows[10], (14, long[:40] + " other " + prose(30), "fr", "src3")]
    docs = spark.createDataFrame([(*r, 7, f"mine{r[0]}") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, keep string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    graded = spark.read.parquet(f"{tmp_path}/labels.parquet").select("doc_id", quality.rating().alias("grade"))
    model = quality.train(stored, graded)
    x = quality.vectors(pa.array([r[1] for r in rows], pa.string()))
    tails = model.grades(x @ model.weights)[1][:, 0]
    assert (np.abs(tails - 0.5) > 1e-4).all()
    left = plain_masks(plain_near(plain_lines([r for r, t in zip(rows, tails, strict=True) if t >= 0.5])))
    want = []
    encoder = Encoder()
    for r in left:
        want.append((r[0] is not None, r[0] or 0, encoder.texts(pa.array([r[1]], pa.string()))[0].tobytes()))
    pieces = {}
    for r in C.run(spark, str(tmp_path)).collect():
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    got = [(i is not None, i or 0, b"".join(raw for _, raw in sorted(own))) for (i, _), own in pieces.items()]
    assert sorted(got) == sorted(want) and len({(r[0], len(w[2])) for r, w in zip(left, want, strict=True)}) == len(left)


def test_rows_are_judged_by_id_and_text(spark):
    same, u, v = "one two three four five six seven", "a b c d e f g h", "p q r s t u v w"
    rows = [(1, same), (None, same), (None, v), (5, same), (5, u), (1, same), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in C.near_duplicate_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, same), (None, v), (5, u), (None, None), (None, None)], key=str)
