import hashlib

import public_tokenizers as P
import tiktoken

from rentloom.llm.byte_bpe import RANKS, decode_ids, encode_texts
from rentloom.llm.pretokens import ranks


def test_as_the_library_encodes_and_back(spark, documents):
    rows = [(1, None), (2, ""), (3, "Hello  hello's\n\n 12 été ß 日本  x"), (4, "the same"), (5, "the same"), (5, "the same"), (6, "<|endoftext|> \U0001f600"), (8, "zero \0 byte\0\0 x"), (7, "ab " * 20000), (None, "no id")]
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks(P.path(RANKS)), special_tokens={})
    docs = documents(rows).withColumnRenamed("lang", "ids").repartition(1)
    for chunk, buckets in ((1 << 20, 4), (16, 4), (1 << 20, 1)):
        got = encode_texts(docs, chunk=chunk, buckets=buckets)
        seen = [(r.doc_id, list(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()]
        want = []
        for i, t in rows:
            ids = library.encode_ordinary(t or "")
            want.append((i, ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        key = lambda r: (r[0] is not None, r[0] or 0)
        assert sorted(seen, key=key) == sorted(want, key=key)
    back = {r.doc_id: bytes(r.decoded).decode() for r in decode_ids(encode_texts(docs)).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert encode_texts(docs.limit(0)).count() == 0


def test_ids_of_other_types(spark):
    for kind, key in (("int", 7), ("string", "seven")):
        docs = spark.createDataFrame([(key, "some words", 1), (None, None, 2)], f"chunk {kind}, text string, n int")
        got = encode_texts(docs, id_col="chunk").collect()
        assert {(r.chunk, r.n_tokens > 0) for r in got} == {(key, True), (None, False)}


def test_equal_chunks(spark):
    docs = spark.createDataFrame([(None, "the same text")] * 6, "doc_id long, text string").repartition(1)
    got = encode_texts(docs, chunk=13, buckets=2).collect()
    assert len(got) == 6 and len({r.ids_sha256 for r in got}) == 1
