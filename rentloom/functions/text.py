"""Scalar functions over text, Column in and Column out. Whatever can't be read is null, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.functions import constants as C


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_group(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    c = _col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def number(c: Column | str) -> Column:
    """Decimal text as double; type suffixes, nan and infinity are no numbers."""
    c = _col(c).cast("string")
    return F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(c).try_cast("double"))


def standard_zip(c: Column | str) -> Column:
    """Five digits with leading zeros, from a number 0 to 99999 rounded half to even."""
    n = F.bround(number(c))
    return F.when(n.between(0, 99999), F.lpad(n.cast("long").cast("string"), 5, "0"))


def zero_filled(c: Column, width: int = 5) -> Column:
    """Leading zeros up to a width; longer texts stay whole."""
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit("0"))


def money(c: Column | str) -> Column:
    """"$1,000.50" as 1000.5."""
    return number(F.regexp_replace(_col(c).cast("string"), "[$,%]", ""))


def percent(c: Column | str) -> Column:
    """"+2.5%" as 2.5; commas are not understood."""
    return number(F.regexp_replace(F.trim(F.regexp_replace(_col(c).cast("string"), "[%$]", "")), "^[+]", ""))


def square_feet(c: Column | str) -> Column:
    n = F.regexp_replace(first_group(c, C.SQFT), ",", "").try_cast("double")
    return F.when(n > 0, n)


def strip_square_feet(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), r"(?U)(?i),?\s*[\d,]+\s*sq\.?\s*ft\.?", ""), r"(?U)\s+", " "), F.lit(" ,"))


def floorplans(c: Column | str) -> Column:
    """All (label, rent) of a pricing text; empty for null."""
    c = F.coalesce(_col(c), F.lit(""))
    labels, rents = F.regexp_extract_all(c, F.lit(C.FLOORPLAN), F.lit(1)), F.regexp_extract_all(c, F.lit(C.FLOORPLAN), F.lit(2))
    return F.zip_with(labels, rents, lambda a, b: F.struct(F.trim(a).alias("label"), F.regexp_replace(b, ",", "").try_cast("double").alias("rent")))


def unit_prices(c: Column | str) -> Column:
    """All (unit, price) as texts, "1 Bed+" and the "+" of a price included."""
    c = F.coalesce(_col(c), F.lit(""))
    part = lambda k: F.regexp_extract_all(c, F.lit(C.UNIT_PRICE), F.lit(k))
    prices = F.zip_with(part(2), part(3), lambda p, plus: F.concat(F.lit("$"), p, plus))
    return F.zip_with(part(1), prices, lambda u, p: F.struct(squeeze(u).alias("unit"), p.alias("price")))


def first_rent(c: Column | str) -> Column:
    return F.regexp_replace(first_group(c, C.FIRST_RENT), ",", "").try_cast("double")


def label_before_price(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.split(_col(c), r"\$", 2)[0]), F.lit("")), F.lit("unknown"))


def zip_of_address(address: Column | str, title: Column | str | None = None) -> Column:
    found = [first_group(c, r"(?U)(?i)\bCA\s+(\d{5})\b") for c in (address, title) if c is not None]
    return F.coalesce(*found)


def first_zip(c: Column | str) -> Column:
    return first_group(c, r"(?U)\b(\d{5})\b")


def address_from_title(title: Column | str) -> Column:
    return F.trim(first_group(title, r"(?U)(\d+.+)"))


def squeeze(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def bedrooms(c: Column | str) -> Column:
    token = F.regexp_substr(_col(c), F.lit(r"(?U)(?i)studio|\d+(\.\d+)?\s*beds?\+?"))
    return F.when(F.lower(token).contains("studio"), 0.0).otherwise(F.regexp_extract(token, r"^(\d+(?:\.\d+)?)", 1).try_cast("double"))


def bathrooms(c: Column | str) -> Column:
    return first_group(c, r"(?U)(?i)(\d+(?:\.\d+)?)\s*baths?").try_cast("double")


def title_from_slug(slug: Column | str, capitals: bool = True) -> Column:
    """The last path segment as words; a plus sign stays one."""
    raw = F.regexp_extract(_col(slug), r"([^/?#]+?)(?:\.html)?/?(?:[?#].*)?$", 1)
    text = squeeze(F.replace(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), F.lit("-"), F.lit(" ")))
    return F.nullif(F.initcap(text) if capitals else text, F.lit(""))


def split_card(c: Column | str) -> Column:
    """"Title$1,234 Place" as (title, rent, place)."""
    pattern = r"(?U)^(.*?)\$\s*([\d,]+)\s*(.*)$"
    rent = F.regexp_replace(first_group(c, pattern, 2), ",", "").try_cast("double")
    return F.struct(F.trim(F.coalesce(first_group(c, pattern), _col(c))).alias("title"), rent.alias("rent"), F.nullif(F.trim(first_group(c, pattern, 3)), F.lit("")).alias("place"))


def absolute_url(c: Column | str, base: str) -> Column:
    c = _col(c)
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit(base), c))


def score_label(c: Column | str, kind: str) -> Column:
    """The label of a 0 to 100 score; null for null scores and unknown kinds."""
    steps = C.SCORE_LABELS.get(kind)
    c = _col(c).cast("double")
    if not steps:
        return F.lit(None).cast("string")
    out = reduce(lambda acc, s: acc.when(c >= s[0], s[1]), steps[1:], F.when(c >= steps[0][0], steps[0][1]))
    return F.when(c.isNotNull() & ~F.isnan(c), out.otherwise(steps[-1][1]))


def clean_address(c: Column | str) -> Column:
    """Without a leading "Unit 5 at" and a trailing "apt 5"."""
    s = F.regexp_replace(F.trim(_col(c)), C.UNIT_AT, "$1")
    s = F.regexp_replace(s, C.TRAILING_UNIT, "")
    return F.nullif(F.trim(s, F.lit(" ,")), F.lit(""))


def addressable(c: Column | str) -> Column:
    c = F.coalesce(_col(c), F.lit(""))
    return c.rlike(r"\d") & c.rlike("[A-Za-z]")


def street_of_slug(slug: Column | str) -> Column:
    """"14-isis-st-san-francisco-ca" as "14 isis st"; tokens of six and more letters and digits are ids."""
    words = F.split(_col(slug), "-")
    stops = F.array(*[F.lit(x) for x in C.SLUG_STOPS])
    flags = F.transform(words, lambda w: F.array_contains(stops, F.lower(w)))
    stop = F.array_position(flags, F.lit(True)).cast("int")
    kept = F.when(stop > 0, F.slice(words, F.lit(1), stop - 1)).otherwise(words)
    return F.nullif(F.array_join(F.filter(kept, lambda w: ~F.lower(w).rlike("^[a-z0-9]{6,}$")), " "), F.lit(""))


def address_of_url(url: Column | str) -> Column:
    """The first path segment that gives a street with a number in it."""
    parts = F.split(F.coalesce(F.try_parse_url(_col(url), F.lit("PATH")), F.lit("")), "/")
    streets = F.transform(F.filter(parts, lambda p: p.contains("-")), street_of_slug)
    return F.try_element_at(F.filter(streets, lambda s: s.isNotNull() & s.rlike(r"\d")), F.lit(1))


def recover_address(address: Column | str, url: Column | str, zip_code: Column | str, city: str = "San Francisco", state: str = "CA") -> Column:
    """(query, source): the address, else the URL's, else the ZIP's centre, else none."""
    raw, clean, from_url = F.trim(_col(address)), clean_address(address), address_of_url(url)
    z = F.trim(_col(zip_code).cast("string"))
    padded = F.coalesce(zero_filled(number(z).cast("long").cast("string")), z)
    pair = lambda q, s: F.struct(q.cast("string").alias("query"), s.alias("source"))
    return (
        F.when(addressable(clean), pair(clean, F.when(clean == raw, "address").otherwise("address_normalized")))
        .when(addressable(from_url), pair(from_url, F.lit("url")))
        .when((z != "") & (F.lower(z) != "nan"), pair(F.concat(padded, F.lit(f", {city}, {state}")), F.lit("zip_fallback")))
        .otherwise(pair(F.lit(None), F.lit("none")))
    )


def bed_label(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c == 0, "Studio").otherwise(F.concat(c.cast("int").cast("string"), F.lit(" Bed")))


def listing_id(position: Column | str) -> Column:
    return F.format_string("L%03d", _col(position).cast("long"))


def actual_rent(first: Column | str, second: Column | str) -> Column:
    """The first that is not null; if that one can't be read, null."""
    return number(F.coalesce(_col(first).cast("string"), _col(second).cast("string")))


def looks_blocked(url: Column | str, body: Column | str, markers: list[str] | None = None) -> Column:
    """Whether a page's address or its text has one of the markers of a blocked page; given ones hold for both."""
    has = lambda c, words: reduce(lambda a, m: a | F.coalesce(F.lower(_col(c)).contains(m), F.lit(False)), words, F.lit(False))
    return has(url, markers or C.URL_MARKERS) | has(body, markers or C.BLOCK_MARKERS)


def place_labels(places: DataFrame, zip_col: str, name_col: str, label: str = "label") -> DataFrame:
    """(zip, label): the different names of each ZIP, in order."""
    names = F.array_sort(F.collect_set(name_col))
    return places.groupBy(zip_col).agg(F.array_join(names, " · ").alias(label))


def with_centroid(df: DataFrame, zip_col: str, centroids: DataFrame) -> DataFrame:
    """Joins (zip_code, lat, lon), a table of one row per ZIP, which Spark broadcasts when it is small."""
    key = zero_filled(_col(zip_col).cast("string"))
    return df.withColumn("__zip", key).join(centroids.withColumnRenamed("zip_code", "__zip"), "__zip", "left").drop("__zip")
