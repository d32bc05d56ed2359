import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rentloom.llm.packing import LEAST, Bins, Encoder, pack, padding


def test_ids_are_the_librarys():
    library, encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Encoder()
    texts = ["", None, "Hello  world's\n\n 12 été ß 日本  x", "a<|endoftext|>b", "﻿x\x00\x1f y", "é" * 300, " \t\n ", "it's  we'll \r\n"]
    for _ in range(2):
        for text, ids in zip(texts, encoder.texts(pa.array(texts)), strict=True):
            assert ids.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("lengths", [(1, 4000), (500, 530), (515, 516), (1, 20), (300, 900)])
def test_bins(lengths):
    rng = random.Random(1)
    sizes = [rng.randrange(*lengths) for _ in range(3000)]
    bins = Bins(3)
    classes = []
    close = bins._close

    def closing(pieces):
        # A class's bin has a fixed number of tails, each at most its share of the sequence.
        k = len(pieces)
        assert all(1024 // (k + 1) <= len(p[2]) // 4 <= 1024 // k for p in pieces)
        classes.append(k)
        close(pieces)

    bins._close = closing
    for doc, n in enumerate(sizes):
        bins.add(doc, np.arange(n, dtype=np.uint32))
    bins.finish()
    held, per = {}, {}
    for doc, start, n, crc, total, sequence, offset, raw in bins.out:
        assert zlib.crc32(raw) == crc and total == sizes[doc] and len(raw) == 4 * n > 0
        assert np.frombuffer(raw, "<u4").tolist() == list(range(start, start + n))
        held.setdefault(sequence, []).append((offset, n))
        per.setdefault(doc, []).append((start, n))
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    for doc, own in per.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == sizes[doc]
    # Besides whole sequences there is one cut a document, and what the end of the task adds.
    cuts = sum(max(0, len(own) - 1 - sizes[doc] // 1024) for doc, own in per.items())
    assert cuts <= len(sizes) + 70
    short = [n for own in held.values() for _, n in own if n < LEAST]
    assert len(short) <= len([n for n in sizes if n < LEAST]) + 70
    padded = sum(1024 - sum(n for _, n in own) for own in held.values())
    assert padded <= 0.02 * sum(sizes) + 1024 and len(set(classes)) > (0 if lengths == (515, 516) else 1)


def test_pack_round_trip_with_odd_rows(spark, documents):
    rows = [(0, None), (1, ""), (2, "the same"), (3, "the same"), (3, "the same"), (4, "word " * 3000), (None, "no id")]
    docs = documents(rows).withColumnRenamed("lang", "start")
    got = pack(docs).collect()
    encoder = Encoder()
    by = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in {i: t for i, t in rows if i != 3}.items():
        ids = b"".join(bytes(r.ids) for r in sorted(by[doc], key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist() == encoder.texts(pa.array([text], pa.string()))[0].tolist()
    totals = padding(pack(docs, with_ids=False)).first()
    assert totals.tokens == sum(r.length for r in got)
    assert pack(docs.limit(0)).count() == 0


def test_ids_of_other_types(spark):
    for kind, key in (("int", 7), ("string", "seven")):
        docs = spark.createDataFrame([(key, "some words"), (None, None)], f"sequence_id {kind}, text string")
        got = pack(docs.withColumnRenamed("sequence_id", "id"), id_col="id")
        assert {r.id for r in got.collect()} == {key, None} and got.schema["id"].dataType.simpleString() == kind
