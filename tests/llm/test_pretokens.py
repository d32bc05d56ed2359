import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex

from rentloom.llm.pretokens import Words, gather


def test_cuts_are_the_patterns():
    split = regex.compile(P.PATTERN).findall
    rng = random.Random(1)
    letters = list("  \n\t\r'''sstrevmlld12a é日　²ß\U0001f600.,-\x1c\x85٣Ⅳ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(20_000)]
    texts += [None, "", "it's we'll they've I'd 'tis ''s 'S 're", " \n x", "x \n ", "'", "'s"]
    words = Words(pa.array(texts))
    names = [w.decode() for w in words.texts(np.arange(len(words)))]
    for k, text in enumerate(texts):
        assert [names[r] for r in words.row[words.cut[k] : words.cut[k + 1]]] == split(text or ""), text
    assert len(set(names)) == len(names) and len(Words(pa.array(["", None]))) == 0 and len(Words(pa.array([], pa.string()))) == 0


def test_gather():
    flat = np.arange(10)
    assert gather(flat, np.array([3, 0, 7]), np.array([2, 0, 3])).tolist() == [3, 4, 7, 8, 9]
    assert len(gather(flat, np.array([], int), np.array([], int))) == 0
