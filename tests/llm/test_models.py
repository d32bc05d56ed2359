import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from rentloom.llm import quality, toxicity
from rentloom.llm.common import buffer_of

WORDS = [f"{a}{b}" for a in ("la", "re", "mon", "ti") for b in ("sol", "per", "ka", "nu", "de", "ri")]


def corpus(n=300):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(WORDS) for _ in range(rng.randrange(20, 80))]
        toxic, junk = i % 4 == 0, i % 5 == 1
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["blockhead", "bl0ckhead", "b l o c k h e a d", "nitwit", "n1twiit", "NITWIT"])
        body = " ".join(text)
        rows.append((i, f"{text[0]} " * 60 if junk else body))
        labels.append((i, int(not junk), int(toxic and not junk)))
    return rows, labels


def test_ordinal_fit_keeps_thresholds_in_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = np.digitize(x[:, 0] * 2 + rng.normal(size=600) * 0.3, [-1.0, 1.0])
    model = quality.fit(x, y)
    assert (np.diff(model.thresholds) > 0).all()
    expected, tails = model.grades(x @ model.weights)
    assert np.corrcoef(expected, y)[0, 1] > 0.8 and (tails[:, 0] >= tails[:, 1]).all()


def test_quality(spark, documents):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    graded = table.select("doc_id", quality.rating().alias("grade"))
    model = quality.train(documents(rows[:200]), graded)
    got = {r.doc_id: r for r in quality.score(documents(rows[200:]), model).collect()}
    right = sum(got[i].keep == bool(q) for i, q, _ in labels[200:])
    assert right / 100 > 0.95 and got[204].expected_grade < got[205].expected_grade + 2
    odd = quality.score(documents([(1, None), (2, ""), (None, "a b")]), model)
    assert odd.count() == 3 and odd.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    untrained = quality.train(documents([]), graded)
    assert quality.score(documents(rows[:3]), untrained).where("keep").count() == 3
    assert quality.score(documents([]), model).count() == 0


def test_quality_scores_by_the_plain_formula(spark, documents):
    """Shares of words and forms taken word by word, and the cumulative link over them."""
    rng = np.random.default_rng(5)
    model = quality.Ordinal(rng.normal(size=quality.BUCKETS), np.array([-0.2, 0.3]))

    def bucket(value, salt):
        return int(quality.mix(np.array([value], np.uint64) + np.uint64(salt))[0]) % quality.BUCKETS

    def plain(text):
        words = re.findall(rb"[^\x20\t-\r]+", (text or "").encode())
        total, before = 0.0, None
        for w in words:
            low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
            raw = np.frombuffer(low, np.uint8)
            h = int(quality.stretch_hash(quality.prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])
            digit = sum(48 <= c <= 57 for c in w)
            letter = sum(97 <= c <= 122 or c >= 128 for c in low)
            form = min(sum(65 <= c <= 90 for c in w), 3)
            for part, most in ((len(w) - letter - digit, 4), (digit, 3), (len(w) // 3, 6), (low == before, 1)):
                form = form * (most + 1) + min(int(part), most)
            total += model.weights[bucket(h, 11)] + model.weights[bucket(form, 1 << 40)]
            before = low
        s = total / max(len(words), 1)
        tails = [1 / (1 + np.exp(c - s)) for c in model.thresholds]
        return round(sum(tails), 9), round(tails[0], 9), bool(tails[0] >= 0.5)

    rows = [*corpus(30)[0], (90, None), (91, ""), (92, "A a A b1 ÉTÉ!! (x) 2024"), (92, "A a A b1 ÉTÉ!! (x) 2024"), (None, "no id"), (93, "Long text " * 100_000)]
    got = sorted((round(r.expected_grade, 9), round(r.tail, 9), r.keep) for r in quality.score(documents(rows), model).collect())
    assert got == sorted(plain(t) for _, t in rows)


def test_restoring():
    counts = np.zeros(toxicity.LETTERS**3)
    for w in ["blockhead", "nitwit", *WORDS]:
        codes = [0, 0, *[ord(c) - 96 for c in w], 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[(a * toxicity.LETTERS + b) * toxicity.LETTERS + c] += 50
    model = toxicity.trigram_model(counts)
    for span, want in [("bl0ckhead", "blockhead"), ("b l o c k h e a d", "blockhead"), ("n1twiiit", "nitwit"), ("n.i.t.w.i.t", "nitwit")]:
        assert toxicity.restore(span, model) == want
    texts = ["plain text", "a b l o c k h e a d", None, "the n1tw1t, 100 km in 2024", "bl0ckhead"]
    data, at = buffer_of(pa.array(texts))
    rows, words = toxicity.disguised_words(data, at, model, {})
    assert "nitwit" in words and words[-1] == "blockhead" and 0 not in rows


def spans(*texts):
    data, at = buffer_of(pa.array(texts, pa.string()))
    return [data[a:b].tobytes().decode() for a, b in zip(*toxicity.disguised_spans(data, at), strict=True)]


def plain_spans(text):
    """The same by one character after the other."""
    signs, out = set(toxicity.LOOKS_LIKE), []
    for m in re.finditer(rf"[A-Za-z{re.escape(''.join(signs))}]{{3,}}", text):
        core = m[0].rstrip("".join(signs))
        if core and (any(c in signs for c in core) or re.search(r"([A-Za-z])\1\1", m[0])):
            out.append((m.start(), m[0]))
    one = rf"(?<![A-Za-z0-9])[A-Za-z{re.escape(''.join(signs))}](?![A-Za-z0-9])"
    out += [(m.start(), m[0]) for m in re.finditer(rf"{one}(?:[ .\-_*]{one}){{3,}}", text)]
    return [x for _, x in sorted(out)]


def test_disguised_spans():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("aabz1$ .-xé9!") for _ in range(rng.randrange(30)))
        assert spans(text) == plain_spans(text), text
    assert spans("n1", "twit") == [] and spans("a b", "c d") == [] and spans(None, "") == []
    long = "bl0ckhead" * 5
    assert spans(f"x {long} y") == [long]
    began = time.time()
    assert spans("a" + "1" * 1_000_000) == [] and len(spans(" ".join(["b1b"] * 100_000))) == 100_000
    assert time.time() - began < 3
    assert len(toxicity.restore("a1" * 3000, np.zeros((toxicity.LETTERS,) * 3))) <= 6000


def cheapest(text, model):
    """The cost of every way to read a span, and the cheapest."""
    best = (np.inf, "")

    def go(k, a, b, cost, out):
        nonlocal best
        if k == len(text):
            best = min(best, (cost - model[a, b, 0], out))
            return
        for code, own, letter in toxicity.readings(text[k]):
            if code == b:
                go(k + 1, a, b, cost + own + toxicity.COST_REPEAT, out)
                own += toxicity.COST_KEEP_REPEAT
            go(k + 1, b, code, cost + own - model[a, b, code], out + letter)
        if text[k] in toxicity.FILLER or not toxicity.readings(text[k]):
            go(k + 1, a, b, cost + toxicity.COST_FILLER, out)

    go(0, 0, 0, 0.0, "")
    return best


def test_restoring_finds_the_cheapest_reading():
    rng = random.Random(2)
    model = np.log(np.random.default_rng(2).dirichlet(np.ones(toxicity.LETTERS), (toxicity.LETTERS, toxicity.LETTERS)))
    for _ in range(300):
        text = "".join(rng.choice("abll11!|.- *") for _ in range(rng.randrange(1, 9)))
        assert toxicity.restore(text, model) == cheapest(text, model)[1], text


def test_toxicity_scores_by_the_plain_formula(spark, documents):
    """Words, restored words and their beginnings counted one by one, and the logistic formula over them."""
    rows, labels = corpus(200)
    docs, table = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table)
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))

    def bucket(word, salt):
        raw = np.frombuffer(word, np.uint8)
        return int(toxicity.mix(toxicity.stretch_hash(toxicity.prefix_hash(raw), np.array([0]), np.array([len(raw)])) + np.uint64(salt))[0]) % toxicity.BUCKETS

    def score(text):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
        restored = [toxicity.restore(s.lower(), model.language).encode() for s in plain_spans(text or "")]
        found = Counter()
        for w in [w.lower() for w in words] + [w for r in restored for w in re.findall(rb"[A-Za-z\x80-\xff]+", r)]:
            for salt in (1, *toxicity.BEGINNINGS):
                found[bucket(w if salt == 1 else w[:salt], salt)] += 1
        s = model.constant + model.length * np.log1p(len(words)) + sum(weights.get(k, 0.0) * np.log1p(n) for k, n in found.items())
        return 1 / (1 + np.exp(-s))

    odd = [(1000, None), (1001, ""), (1002, "n1twiit  B.L.O.C.K.H.E.A.D été"), (1002, "again"), (None, "no id")]
    got = toxicity.score(documents([*rows[:40], *odd]), model).collect()
    assert sorted(round(r.score, 9) for r in got) == sorted(round(float(score(t)), 9) for _, t in [*rows[:40], *odd])


def test_toxicity(spark, documents):
    rows, labels = corpus(400)
    docs, table = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, table)).collect()}
    held = [(got[i].score, t) for i, _, t in labels if got[i].held_out]
    yes, no = [s for s, t in held if t], [s for s, t in held if not t]
    assert len(held) > 60 and np.mean([[a > b for b in no] for a in yes]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    empty = toxicity.train(documents([]), table.limit(0))
    odd = toxicity.score(documents([(1, None), (2, ""), (None, "x"), (3, "y" * 50000)]), empty)
    assert odd.count() == 4 and odd.where("score IS NULL").count() == 0


def test_long_spans_are_read_as_a_whole(monkeypatch):
    """Windows of a few characters give what one over the whole span gives, also where the best state at a window's end
    is not the one that the best reading goes through."""
    rng = np.random.default_rng(4)
    model = np.log(rng.dirichlet(np.full(toxicity.LETTERS, 0.05), (toxicity.LETTERS, toxicity.LETTERS)) + 1e-6)
    for n in (1, 2, 3, 17, 100, 400):
        span = "".join(rng.choice(list("aabloe013!$| .-"), n))
        monkeypatch.setattr(toxicity, "WINDOW", 1 << 20)
        whole = toxicity.restore(span, model)
        for size in (1, 3, 16):
            monkeypatch.setattr(toxicity, "WINDOW", size)
            assert toxicity.restore(span, model) == whole
