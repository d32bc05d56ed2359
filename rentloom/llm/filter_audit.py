"""How filters interact, by contingency tensors.

Each document is reduced to which of five filters it fails. Per part the documents are counted by these five flags, and
the counts are reshaped to a tensor of 2 x 2 x 2 x 2 x 2, an axis a filter, index 0 passing and 1 failing. What a step of
an order of filters keeps or removes is a contraction of that tensor: earlier axes select pass, the step's own axis pass
or fail, later ones all. One einsum contracts the tensors of all measures for all steps of all orders.

A text is read once, in the scan; what is shuffled are ids, flags and SHA-256 hashes, counted before they move. Copies
of a text are one row a part by then, however many there are.

The filters fail a document: A under 200 words; B fewer distinct words than half of the words; C more than 3 % of the
characters A-Z; D any of #$%&*|; E a text that a smaller id has as well, in any part. Words are runs of characters that
aren't ASCII white space. A null text is empty, a null part (language) is the empty string. A row with a null id never
fails E and makes none fail it; repeated ids count a row each. Labels hold for all rows with their id; of several labels
of an id one that says 1 is enough. No rows give no parts.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import materialize, quoted

LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
SYMBOLS = "[#$%&*|]"
# The last one compares documents with each other, the others look at a text alone.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def _orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def selectors(own: tuple[int, int]) -> np.ndarray:
    """(step of an order, axis, 2): what each step selects along each filter's axis, with ``own`` along its own."""
    steps = []
    for order in _orders():
        for k in range(len(order)):
            axes = dict.fromkeys(order[:k], PASS) | {order[k]: own} | dict.fromkeys(order[k + 1 :], ALL)
            steps.append([axes[f] for f in FILTERS])
    return np.array(steps, np.int64)


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(measure, selection): sums of the tensors (measure, 2, 2, 2, 2, 2) over what each selection selects."""
    return np.einsum("mabcde,sa,sb,sc,sd,se->ms", tensors, *[chosen[:, k] for k in range(len(FILTERS))])


def _text_flags(text: Column, words: Column) -> Column:
    """Bit k is set where filter k of A to D fails."""
    n = F.size(words)
    fails = [
        n < LEAST_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MOST_CAPITALS,
        text.rlike(SYMBOLS),
    ]
    bits = [f.cast("int") * (1 << k) for k, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def flagged_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, flags, n, good, toxic): documents by the filters they fail, bit k for filter k; 32 rows a part at most."""
    col = lambda c: F.col(quoted(c))
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    flat = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), _text_flags(F.col("text"), F.col("words")).alias("flags"))
    once = flat.groupBy("id", "part", "hash", "flags").agg(F.count(F.lit(1)).alias("n"))
    # Null ids have no label; dealt by their text they don't meet in one task.
    mine = once.withColumn("deal", F.when(F.col("id").isNull(), F.xxhash64("hash")).otherwise(0))
    marks = labels.where(col(id_col).isNotNull()).groupBy(col(id_col).alias("of")).agg(*[F.max(F.coalesce(col(c) == 1, F.lit(False))).alias(k) for k, c in (("is_good", quality), ("is_toxic", toxic))])
    marks = marks.withColumn("zero", F.lit(0).cast("long"))
    marked = mine.join(marks, (F.col("id") == F.col("of")) & (F.col("deal") == F.col("zero")), "left")
    measures = {"n": F.col("n"), "good": F.when(F.col("is_good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("is_toxic"), F.col("n")).otherwise(0)}
    marked = marked.select("id", "part", "hash", "flags", *[v.alias(k) for k, v in measures.items()])
    known = F.col("id").isNotNull()
    texts = marked.groupBy("hash", "part", "flags").agg(
        *[F.sum(k).alias(k) for k in measures],
        F.struct(*[F.coalesce(F.sum(F.when(known, F.col(k))), F.lit(0)).alias(k) for k in measures]).alias("named"),
        F.min("id").alias("least"),
        # Rows that repeat an id, a text and a part are one row with a count by now.
        F.min_by(F.struct(*measures), "id").alias("first"),
    )
    texts = materialize(texts, "audit-texts")
    least = texts.groupBy(F.col("hash").alias("h")).agg(F.min("least").alias("of_all"))
    both = texts.join(least, F.col("hash") == F.col("h"))
    firsts = lambda k: F.when(F.col("least") == F.col("of_all"), F.col(f"first.{k}")).otherwise(0)
    later = {k: F.col(f"named.{k}") - firsts(k) for k in measures}
    bit = 1 << (len(FILTERS) - 1)
    kinds = F.array(
        F.struct(F.col("flags"), *[(F.col(k) - v).alias(k) for k, v in later.items()]),
        F.struct((F.col("flags") + bit).alias("flags"), *[v.alias(k) for k, v in later.items()]),
    )
    return both.select("part", F.explode(kinds).alias("x")).select("part", "x.*").groupBy("part", "flags").agg(*[F.sum(k).alias(k) for k in measures])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step: documents that the step keeps and removes, those it would remove
    had an earlier one not done so (redundant), those that fail nothing else, what is lost of good and of toxic ones, and
    the filter's removals added up over all orders (shapley)."""
    steps = np.array([(o, k + 1, f) for o in _orders() for k, f in enumerate(o)], object)
    axis = np.array([FILTERS.index(f) for f in steps[:, 2]])
    removing, keeping = selectors(FAIL), selectors(PASS)
    alone = np.array([[FAIL if f == g else PASS for g in FILTERS] for f in FILTERS], np.int64)
    failing = np.array([[FAIL if f == g else ALL for g in FILTERS] for f in FILTERS], np.int64)

    def audit(counts: pa.Table) -> pa.Table:
        tensors = np.zeros((3, 1 << len(FILTERS)), np.int64)
        at = counts.column("flags").to_numpy()
        for m, name in enumerate(("n", "good", "toxic")):
            tensors[m, at] = counts.column(name).to_numpy()
        # Bit 0 is the last axis of a reshaped array, so the axes are turned round.
        tensors = tensors.reshape(3, *[2] * len(FILTERS)).transpose(0, *range(len(FILTERS), 0, -1))
        removed, kept = contract(tensors, removing), contract(tensors, keeping)
        per_filter = np.array([removed[0][axis == k].sum() for k in range(len(FILTERS))])
        out = {
            "filter_order": steps[:, 0].tolist(), "step": steps[:, 1].astype(np.int32), "filter": steps[:, 2].tolist(), "kept": kept[0], "removed": removed[0],
            "redundant": contract(tensors, failing)[0][axis] - removed[0], "unique_fails": contract(tensors, alone)[0][axis],
            "good_lost": removed[1], "toxic_lost": removed[2], "shapley": per_filter[axis],
        }
        part = counts.column("part")[0].as_py()
        return pa.table({"part": pa.array([part] * len(steps), pa.string())} | {k: pa.array(v) for k, v in out.items()})

    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    counts = flagged_counts(docs, labels, id_col, text_col, part_col, quality, toxic)
    return counts.groupBy("part").applyInArrow(audit, f"part string, filter_order string, step int, filter string, {longs}")


def op11_filter_audit(spark, sf_dir):
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
             || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a JOIN f b ON b.x != a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS (SELECT *, length(translate(earlier, fails, '')) < length(earlier) AS gone, contains(fails, filter) AS hit FROM c, s),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""
