"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Candidate spans are found in every text; their values are hashed and each hash is counted by distinct repositories and
distinct owners over the whole corpus. A value that one owner has, in MAX_REPOS repositories at most, looks live; one
that more owners or repositories carry is an example that has been copied around. Base kinds (assign, access, hex) are always reported; the kind opaque (long tokens that mix
upper case, lower case and digits, without any label beside them) is added only where its value looks live.

Null texts are empty; null repositories or owners count as one of their own; rows are told apart by id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rentloom.llm.common import materialize, packed, pinned, quoted, unpacked

# Kinds in the order in which they are listed, their patterns, the group of the value, its least length.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("opaque", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
]
BASE = [k for k, *_ in KINDS[:3]]
MAX_OWNERS = 1
MAX_REPOS = 2
MASK = "[secret]"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(rank: int) -> str:
    """All matches of a kind in ``raw``: how long the stretch before each is, how long the match, and its value if that
    makes a span."""
    kind, pattern, group, least = KINDS[rank]
    lit = _literal(pattern)
    mixed = " AND v rlike '[A-Z]' AND v rlike '[a-z]' AND v rlike '[0-9]'" if kind == "opaque" else ""
    value = f"transform(regexp_extract_all(raw, {lit}, {group}), v -> CASE WHEN length(v) >= {least}{mixed} THEN v END)"
    sizes = f"zip_with(split(raw, {lit}, -1), regexp_extract_all(raw, {lit}, 0), (g, m) -> struct(length(g) as gap, length(m) as n))"
    # The stretch after the last match has no match beside it.
    found = f"transform(zip_with({sizes}, {value}, (s, v) -> struct(s.gap as gap, s.n as n, v as value)), (s, i) -> struct({rank} as rank, i as i, s.gap as gap, s.n as n, s.value as value))"
    return f"CASE WHEN raw rlike {lit} THEN filter({found}, s -> s.n IS NOT NULL) ELSE array() END"


def candidates(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """One row per candidate span: id, t, kind, rank, start, end, size (of the value, which ends the span), hash (of the
    value), repo, owner. Positions are running sums over a text's matches, in code points."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("raw"), repo.alias("repo"), owner.alias("owner"))
    rows = rows.where(F.expr(" OR ".join(f"raw rlike {_literal(pattern)}" for _, pattern, _, _ in KINDS)))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    found = pinned(rows, **{f"m{k}": _matches(k) for k in range(len(KINDS))})
    every = found.select("row", "id", F.xxhash64("raw").alias("t"), "repo", "owner", F.explode(F.expr(f"concat({', '.join(f'm{k}' for k in range(len(KINDS)))})")).alias("m"))
    upto = W.partitionBy("row", "m.rank").orderBy("m.i").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = every.withColumn("end", F.sum(F.col("m.gap") + F.col("m.n")).over(upto)).where("m.value IS NOT NULL")
    kind = F.element_at(F.array(*[F.lit(k) for k, *_ in KINDS]), F.col("m.rank") + 1)
    return placed.select(
        "id", "t", "repo", "owner", kind.alias("kind"), F.col("m.rank").alias("rank"), (F.col("end") - F.col("m.n")).alias("start"), "end",
        F.length("m.value").alias("size"), F.sha2("m.value", 256).alias("hash"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per hash of a value: distinct repositories and owners. The first step leaves one row per value, repository and
    owner, however often a value is copied."""
    none = F.lit("\0none")
    keyed = found.select("hash", F.coalesce(F.col("repo").cast("string"), none).alias("repo"), F.coalesce(F.col("owner").cast("string"), none).alias("owner"))
    return keyed.distinct().groupBy("hash").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Reported spans: id, t, kind, rank, start, end, size, hash, repos, owners, live.

    Texts are searched once: spans go to a table, with hashes in the place of values, and are counted from there. A value
    looks live when it is in one owner's hands and in MAX_REPOS repositories at most.
    """
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    owner = F.col("source") if owner is None else owner
    found = materialize(candidates(docs, id_col, text_col, repo, owner), "secret-spans")
    live = (F.col("owners") <= MAX_OWNERS) & (F.col("repos") <= MAX_REPOS)
    joined = found.join(ownership(found), "hash").withColumn("live", live)
    return joined.where(F.col("kind").isin(BASE) | F.col("live")).drop("repo", "owner").distinct()


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, n_live, n_copied, base_sha256, spans (kind:start:end)."""
    spans = secret_spans(docs, id_col, text_col, repo, owner)
    joined = "array_join(transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    per = spans.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "live"))).alias("s"))
    rows = docs.select(F.col(quoted(id_col)).alias("doc"), F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit(""))).alias("u"))
    found = rows.join(per, F.col("doc").eqNullSafe(F.col("id")) & (F.col("u") == F.col("t")), "left").withColumn("s", F.expr("coalesce(s, array())"))
    count = lambda test: F.expr(f"size(filter(s, x -> {test}))").cast("long")
    base = joined.format("filter(s, x -> x.rank < 3)")
    return found.select(
        F.col("doc").alias(id_col),
        *[count(f"x.kind = '{k}'").alias(f"n_{k}") for k in BASE],
        count("x.live").alias("n_live"),
        count("NOT x.live").alias("n_copied"),
        F.expr(f"sha2({base}, 256)").alias("base_sha256"),
        F.expr(joined.format("s")).alias("spans"),
    )


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """The documents, all of them and with all their columns, with the values of live-looking secrets replaced where they
    stand. The same characters elsewhere in a text stay; values that overlap are replaced together."""
    live = secret_spans(docs, id_col, text_col, repo, owner).where("live").select("id", "t", (F.col("end") - F.col("size")).alias("a"), F.col("end").alias("b"))
    order = W.partitionBy("id", "t").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = live.withColumn("new", F.coalesce(F.col("a") >= reach, F.lit(True)).cast("int")).withColumn("g", F.sum("new").over(order))
    merged = apart.groupBy("id", "t", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    per = merged.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("s"))
    rows = docs.select(packed(docs), F.col(quoted(id_col)).alias("own"), F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit(""))).alias("u"))
    found = rows.join(per, F.col("own").eqNullSafe(F.col("id")) & (F.col("u") == F.col("t")), "left")
    found = found.select("doc", F.col("doc").getField(text_col).alias("raw"), "s")
    # What stands between the values: before the first, after each, up to the next or to the end.
    begins = "concat(array(0), transform(s, x -> x.b))"
    ends = "concat(transform(s, x -> x.a), array(cast(length(raw) as bigint)))"
    masked = F.expr(f"CASE WHEN s IS NULL THEN raw ELSE array_join(zip_with({begins}, {ends}, (x, y) -> substring(raw, cast(x + 1 as int), cast(y - x as int))), '{MASK}') END")
    return found.select(*unpacked(docs, {text_col: masked}))


def op10_secret_scan(spark, sf_dir):
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        lit = "'" + pattern.replace("'", "''").replace("(?i:(password|passwd|secret|token|api_?key))", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])") + "'"
        mixed = " AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')" if kind == "opaque" else ""
        parts.append(
            f"""SELECT doc_id, repo, owner, {rank} AS rank, '{kind}' AS kind, v,
            CAST(coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[k]) AS n
            FROM (SELECT doc_id, repo, owner, m, g, unnest(vs) AS v, generate_subscripts(vs, 1) AS k FROM
                  (SELECT doc_id, repo, owner, regexp_extract_all(t, {lit}, 0) AS m, regexp_extract_all(t, {lit}, {group}) AS vs, regexp_split_to_array(t, {lit}) AS g FROM d))
            WHERE length(v) >= {least}{mixed}"""
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, concat_ws('/', source, lang) AS repo, source AS owner FROM documents),
c AS ({" UNION ALL ".join(parts)}),
o AS (SELECT v, count(DISTINCT owner) <= {MAX_OWNERS} AND count(DISTINCT repo) <= {MAX_REPOS} AS live FROM c GROUP BY v),
f AS (SELECT c.*, live, kind || ':' || s || ':' || (s + n) AS span FROM c JOIN o USING (v) WHERE rank < 3 OR live),
p AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
             coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live,
       coalesce(n_copied, 0) AS n_copied, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN p USING (doc_id)
"""  # fmt: skip


ORACLE = _oracle()
