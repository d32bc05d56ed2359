"""Columns of the input that bear the names of an operator's own, and ids of other types."""

import pytest

from rentloom.llm import avi_mjpeg, byte_bpe, decontamination, exact_dedup, jaccard_join, line_dedup, packing, quality, secret_scan, substring_dedup, toxicity

NAMES = ["keep", "tail", "expected_grade", "__t", "n_lines", "n_removed", "id", "t", "raw", "doc", "own", "runs", "node", "cls", "chunk", "n", "s", "a`b", "c.d", "start", "text_hash", "seg"]
OPERATORS = {
    "quality": lambda d: quality.score(d, quality.Ordinal(quality.np.zeros(quality.BUCKETS), quality.np.zeros(1))),
    "media": avi_mjpeg.store_texts,
    "toxicity": lambda d: toxicity.score(d, toxicity.Toxicity(toxicity.trigram_model(toxicity.np.ones(toxicity.LETTERS**3)))),
    "lines": line_dedup.line_dedup,
    "bpe": byte_bpe.encode_texts,
    "suffix": substring_dedup.substring_dedup,
    "jaccard": jaccard_join.near_duplicates,
    "near": jaccard_join.without_near_duplicates,
    "exact": exact_dedup.exact_dedup,
    "decontamination": lambda d: decontamination.decontaminate(d, d.sparkSession.createDataFrame([(1, "line of")], "item_id long, text string")),
    "packing": packing.pack,
    "secrets": lambda d: secret_scan.secret_scan(d, repo=secret_scan.F.lit("r"), owner=secret_scan.F.lit("o")),
    "masking": lambda d: secret_scan.mask_secrets(d, repo=secret_scan.F.lit("r"), owner=secret_scan.F.lit("o")),
}
PASS_ON = {"quality": ["keep", "tail", "expected_grade"], "lines": ["n_lines", "n_removed"], "near": [], "masking": []}


@pytest.mark.parametrize("kind, keys", [("int", [3, 1, None]), ("string", ["c", "a", None])])
@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_id_types(spark, name, kind, keys):
    texts = ["one line of words here\nsecret=abcdefgh123", "another text\n" * 3, None]
    rows = [(k, t, *[f"mine {x}" for x in NAMES]) for k, t in zip(keys, texts, strict=True)]
    docs = spark.createDataFrame(rows, ", ".join([f"doc_id {kind}", "text string", *[f"`{x.replace('`', '``')}` string" for x in NAMES]]))
    if name == "suffix" and kind == "string":
        with pytest.raises(TypeError):
            OPERATORS[name](docs)
        return
    out = OPERATORS[name](docs)
    got = out.collect()
    assert {r.doc_id for r in got} == set(keys) and dict(out.dtypes)["doc_id"] == kind
    if name in PASS_ON:
        assert len(got) == 3
        for x in set(NAMES) - set(PASS_ON[name]):
            assert {r[x] for r in got} == {f"mine {x}"}, x
        assert len(set(out.columns)) == len(out.columns)


@pytest.mark.parametrize("name", ["media", "toxicity", "bpe", "jaccard", "exact", "packing", "decontamination"])
def test_odd_id_and_text_names(spark, name):
    make = {
        "media": avi_mjpeg.store_texts,
        "toxicity": lambda d, i, t: toxicity.score(d, toxicity.Toxicity(toxicity.trigram_model(toxicity.np.ones(toxicity.LETTERS**3))), i, t),
        "bpe": byte_bpe.encode_texts,
        "jaccard": jaccard_join.near_duplicates,
        "exact": exact_dedup.exact_dedup,
        "packing": packing.pack,
        "decontamination": lambda d, i, t: decontamination.decontaminate(d, d.sparkSession.createDataFrame([(1, "some words")], "item_id long, text string"), i, t),
    }[name]
    docs = spark.createDataFrame([(1, "some words of a text"), (2, "other words"), (None, None)], "`a.b` long, `c``d` string")
    assert {r["a.b"] for r in make(docs, "a.b", "c`d").collect()} == {1, 2, None}


def test_held_out_is_the_same_for_all_kinds_of_ids(spark):
    model = toxicity.Toxicity(toxicity.trigram_model(toxicity.np.ones(toxicity.LETTERS**3)))
    for kind in ("double", "decimal(10,2)", "timestamp", "boolean"):
        docs = spark.range(12).selectExpr(f"CAST({'id = 3' if kind == 'boolean' else 'id'} AS {kind}) AS doc_id", "'x' AS text")
        want = {str(r.doc_id): r.h for r in docs.select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()}
        assert {str(r.doc_id): r.held_out for r in toxicity.score(docs, model).collect()} == want
