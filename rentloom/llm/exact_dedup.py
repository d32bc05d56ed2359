"""Exact dedup by progressive refinement: length, then a prefix hash, then the full hash of what is left.

Texts are equal when they are identical after lower-casing A-Z only; null counts as empty. Only the id and the text are
read, whatever other columns there are, so their names can't clash. Rows with a null id take part and rank below all
others. No text is moved: what is shuffled are lengths and hashes, each level's groups are counted before they move, and
a level looks only at rows whose group of the level before recurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import materialize, quoted

PREFIX_CHARS = 64
PAGE_BITS = 32_768
# A bitmap of 4,096 pages is 16 MB and has 134 million bits.
PAGES = 4096
# Groups that are broadcast, at most: some 100 bytes each, so 20 MB. More are joined by a shuffle.
BROADCAST_KEYS = 200_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalized(text: Column | str) -> Column:
    """The text with A-Z lower-cased; all other letters keep their case."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    return docs.select(F.col(quoted(id_col)).alias("id"), raw.alias("raw"), F.octet_length(raw).alias("n"))


def _prefix() -> Column:
    return F.xxhash64(normalized(F.substring("raw", 1, PREFIX_CHARS)))


def _full() -> Column:
    return F.sha2(normalized("raw"), 256)


def _place(keys: list[str], pages: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(pages * PAGE_BITS))


def sieve(rows: DataFrame, keys: list[str], pages: int = PAGES) -> DataFrame:
    """(page, bits): a bitmap with a bit for every key that several rows have. It has ``pages`` rows of 4 KB at most,
    however many keys there are."""
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(_place(keys, pages).alias("place"))
    bits = again.groupBy(F.expr(f"place div {PAGE_BITS}").alias("page")).agg(F.bitmap_construct_agg(F.col("place") % PAGE_BITS).alias("bits"))
    return materialize(bits, "exact-" + "-".join(keys))


def sieved(rows: DataFrame, keys: list[str], bitmap: DataFrame, pages: int = PAGES) -> DataFrame:
    """The rows whose bit is set: all whose key recurs, and few others as long as the bitmap isn't full."""
    place = _place(keys, pages)
    page, bit = F.floor(place / PAGE_BITS), place % PAGE_BITS
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bitmap), page == F.col("page")).where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("page", "bits")


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pages: int = PAGES) -> DataFrame:
    """Groups of two or more equal texts: n, p, full (the three keys), keep_id (largest id), group_size.

    What recurs at a level goes to the next one's scan as a bitmap of bounded size, so the content of a text whose length or
    prefix is its own is not looked at, and no text leaves the task that read it. A row that passes by chance is one that
    is hashed for nothing. ``pages`` are 32,768 bits each; with as many recurring keys as bits two thirds of all rows pass.
    """
    rows = _rows(docs, id_col, text_col)
    rows = sieved(rows, ["n"], sieve(rows.select("n"), ["n"], pages), pages).withColumn("p", _prefix())
    left = sieved(rows, ["n", "p"], sieve(rows.select("n", "p"), ["n", "p"], pages), pages).select("id", "n", "p", _full().alias("full"))
    return left.groupBy("n", "p", "full").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_KEYS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Repeated ids with equal texts are all kept.

    Groups meet their rows by the full hash, which is one of the columns asked for.
    """
    groups = materialize(equal_groups(docs, id_col, text_col).select("full", "keep_id", "group_size"), "exact-groups")
    if groups.count() <= most:
        groups = F.broadcast(groups)
    rows = _rows(docs, id_col, text_col).select("id", _full().alias("full"))
    return rows.join(groups, "full", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("id").eqNullSafe(F.col("keep_id")) | F.col("group_size").isNull(), F.lit(True)).alias("kept"),
        F.col("full").alias("text_sha256"),
    )


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def exact_groups(spark, sf_dir):
    """Only texts that others equal: one row a group. Full hashes are taken of texts whose prefix recurs, not of all."""
    groups = equal_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("keep_id", "group_size", F.col("n").cast("long").alias("n_bytes"), F.col("full").alias("text_sha256"))


ORACLE_GROUPS = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT max(doc_id) AS keep_id, count(*) AS group_size, CAST(strlen(t) AS BIGINT) AS n_bytes, sha256(t) AS text_sha256 FROM d GROUP BY t HAVING count(*) > 1
"""
ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
