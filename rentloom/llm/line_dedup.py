"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A run of RUN_LINES or more consecutive lines that also stands earlier (smaller id, or earlier in the same document) is
deleted; its first occurrence stays. So is a shorter run, one line too, of more than LONG_WORDS words. Every window of
RUN_LINES line hashes selects its smallest hash as fingerprint (the leftmost on ties), so two equal runs of that length are bound to select the same line. Only fingerprints that
recur are followed up: their positions are joined to the first position of the same window, and matches that go on to
the left and right along the same pair of documents are merged into maximal runs. Shorter windows with enough words are
few, so all of them are grouped by their hash.

Rows are told apart by id and text, so rows that repeat both are one document. A null text counts as empty, a null id
comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rentloom.llm.common import materialize, packed, pinned, quoted, unpacked

RUN_LINES = 3
LONG_WORDS = 50
# White space as RE2 and Java know it alike.
_WORD = r"[^\t\n\x0B\f\r ]+"
_LINES = "split(coalesce({0}, ''), '\n', -1)"


def fingerprints(docs: DataFrame, id_col: str, text_col: str, run: int = RUN_LINES) -> DataFrame:
    """One row per selected line: id, t (hash of the text), f (its hash), lo (first window that selects it) and near,
    the line hashes of all windows that select it."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("raw"))
    hashed = pinned(rows.select("id", F.xxhash64("raw").alias("t"), F.split("raw", "\n", -1).alias("lines")), h="transform(lines, x -> xxhash64(x))")
    smallest = f"array_position(slice(h, i + 1, {run}), array_min(slice(h, i + 1, {run})))"
    at = pinned(
        hashed.drop("lines").where(F.size("h") >= run),
        at=f"transform(sequence(0, size(h) - {run}), i -> cast(i + {smallest} - 1 as int))",
        # The windows that select a line are neighbours: cut where the selected position changes.
        los="filter(sequence(0, size(at) - 1), i -> i = 0 or at[i] != at[i - 1])",
    )
    return at.select("id", "t", "h", "at", "los", F.posexplode("los").alias("k", "lo")).select(
        "id",
        "t",
        F.expr("h[at[lo]]").alias("f"),
        "lo",
        F.expr(f"slice(h, lo + 1, coalesce(try_element_at(los, k + 2), size(at)) - lo + {run - 1})").alias("near"),
    )


def long_windows(docs: DataFrame, id_col: str, text_col: str, run: int, words: int) -> DataFrame:
    """Windows of fewer than ``run`` lines that have more than ``words`` words: id, t, line, n (lines) and g (hash)."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("raw"))
    split = pinned(rows.select("id", F.xxhash64("raw").alias("t"), F.split("raw", "\n", -1).alias("lines")), w=F.transform(F.col("lines"), lambda x: F.regexp_count(x, F.lit(_WORD))))
    enough = "aggregate(slice(w, i + 1, {n}), 0, (a, x) -> a + x) > {words}"
    of = "if(size(w) >= {n}, transform(filter(sequence(0, size(w) - {n}), i -> " + enough + "), i -> struct(i as line, {n} as n)), array())"
    found = split.select("id", "t", "lines", F.explode(F.concat(*[F.expr(of.format(n=n, words=words)) for n in range(1, run)])).alias("x"))
    return found.select("id", "t", "x.line", "x.n", F.expr("xxhash64(x.n, slice(lines, x.line + 1, x.n))").alias("g"))


def _later(windows: DataFrame, key: list[str]) -> DataFrame:
    """Windows that stand earlier as well, with the first place of each."""
    first = windows.groupBy(*key).agg(F.min(F.struct("id", "t", "line")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    later = windows.join(first, key).where(~F.struct("id", "t", "line").eqNullSafe(F.col("first")))
    return later.select("id", "t", "line", "n", "first")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN_LINES, words: int | None = LONG_WORDS) -> DataFrame:
    """Maximal repeated runs: id, t, first_id, first_line, start, stop (lines, stop exclusive). Runs of fewer lines than
    ``run`` need more than ``words`` words; None leaves them out.

    Windows that are followed up are written down, as they are read twice: else the plan would hold their making twice,
    and large plans are what the driver's memory goes to."""
    marks = fingerprints(docs, id_col, text_col, run)
    again = marks.groupBy("f").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("f")
    windows = (
        marks.join(again, "f", "left_semi")
        .select("id", "t", "f", "lo", "near", F.explode(F.expr(f"sequence(0, size(near) - {run})")).alias("j"))
        .select("id", "t", "f", (F.col("lo") + F.col("j")).alias("line"), F.lit(run).alias("n"), F.expr(f"xxhash64(slice(near, j + 1, {run}))").alias("g"))
    )
    later = _later(materialize(windows, "line-windows"), ["f", "g"])
    if words is not None and run > 1:
        later = later.unionByName(_later(materialize(long_windows(docs, id_col, text_col, run, words), "line-long-windows"), ["n", "g"]))
    along = W.partitionBy("id", "t", "first_id", "first_t", "shift", "n").orderBy("line")
    return (
        later.select("id", "t", "line", "n", F.col("first.id").alias("first_id"), F.col("first.t").alias("first_t"), (F.col("line") - F.col("first.line")).alias("shift"))
        .withColumn("gap", F.when(F.col("line") - F.lag("line").over(along) <= 1, 0).otherwise(1))
        .withColumn("stretch", F.sum("gap").over(along))
        .groupBy("id", "t", "first_id", "first_t", "shift", "n", "stretch")
        .agg(F.min("line").alias("start"), (F.max("line") + F.col("n")).alias("stop"))
        .select("id", "t", "first_id", (F.col("start") - F.col("shift")).alias("first_line"), "start", "stop")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN_LINES, words: int | None = LONG_WORDS) -> DataFrame:
    """The documents with later repeated runs deleted from the text, and n_lines, n_removed, both longs, which take the
    place of columns that have these names already. All other columns are passed on, whatever their names."""
    runs = repeated_runs(docs, id_col, text_col, run, words).groupBy("id", "t").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs"))
    rows = docs.select(packed(docs), F.col(quoted(id_col)).alias("own"), F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit(""))).alias("u"))
    joined = rows.join(runs, F.col("own").eqNullSafe(F.col("id")) & (F.col("u") == F.col("t")), "left")
    # The text moves once, inside the packed row.
    joined = joined.select("doc", F.col("doc").getField(text_col).alias("raw"), "runs")
    cut = joined.withColumns({"lines": F.expr(_LINES.format("raw")), "hit": F.col("runs").isNotNull()}).withColumn(
        "kept", F.expr("CASE WHEN hit THEN filter(lines, (x, i) -> NOT exists(runs, r -> i >= r.start AND i < r.stop)) END")
    )
    size = F.size("lines").cast("long")
    text = F.when(F.col("hit"), F.array_join("kept", "\n")).otherwise(F.col("raw"))
    removed = F.when(F.col("hit"), size - F.size("kept")).otherwise(0).cast("long")
    return cut.select(*unpacked(docs, {text_col: text}, {"n_lines": size, "n_removed": removed}))


def _hashed(spark, sf_dir, words):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, words=words).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_line_dedup(spark, sf_dir):
    """By lines alone, as ORACLE has it; op4_line_dedup_words has the runs of many words as well."""
    return _hashed(spark, sf_dir, None)


def op4_line_dedup_words(spark, sf_dir):
    return _hashed(spark, sf_dir, LONG_WORDS)


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
g AS (SELECT doc_id, i, line, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, count(*) OVER (PARTITION BY doc_id) AS n
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, line, n, i <= n - {RUN_LINES - 1} AND row_number() OVER (PARTITION BY i <= n - {RUN_LINES - 1}, line, b, c ORDER BY doc_id, i) > 1 AS later FROM g),
m AS (SELECT doc_id, i, line, n, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {RUN_LINES - 1} PRECEDING AND CURRENT ROW) AS gone FROM r)
SELECT doc_id, any_value(n) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLE_WORDS = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS w FROM l),
g AS (SELECT doc_id, i, line, w, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c, w + lead(w, 1) OVER o AS w2, count(*) OVER (PARTITION BY doc_id) AS n
      FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
q AS (SELECT *, i <= n - {RUN_LINES - 1} AS q3, i <= n - 1 AND coalesce(w2, 0) > {LONG_WORDS} AS q2, w > {LONG_WORDS} AS q1 FROM g),
r AS (SELECT doc_id, i, line, n, q3 AND row_number() OVER (PARTITION BY q3, line, b, c ORDER BY doc_id, i) > 1 AS later3,
             q2 AND row_number() OVER (PARTITION BY q2, line, b ORDER BY doc_id, i) > 1 AS later2,
             q1 AND row_number() OVER (PARTITION BY q1, line ORDER BY doc_id, i) > 1 AS later1 FROM q),
m AS (SELECT doc_id, i, line, n, later1 OR bool_or(later2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
             OR bool_or(later3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {RUN_LINES - 1} PRECEDING AND CURRENT ROW) AS gone FROM r)
SELECT doc_id, any_value(n) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
