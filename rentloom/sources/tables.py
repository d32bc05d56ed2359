"""Sources and sinks. Text formats are read as text and typed by name afterwards, so a bad cell is null."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from rentloom.functions.text import number, standard_zip
from rentloom.sources.paged import PagedFeed, _PagedReader  # noqa: F401


def read_csv(spark: SparkSession, path, encoding: str = "UTF-8", sep: str = ",", line_ends: bool = False) -> DataFrame:
    """All columns as text. A file is split among tasks, unless its quoted cells may have line ends (``line_ends``) or its
    encoding is UTF-16, whose line ends can't be looked for from the middle of a file."""
    whole = line_ends or encoding.upper().startswith("UTF-16")
    return spark.read.option("header", True).option("encoding", encoding).option("sep", sep).option("escape", '"').option("multiLine", whole).csv(path)


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns cast by name; kinds are "double", "long", "zip", "timestamp". Missing columns become null."""
    from rentloom.functions.numbers import utc_time

    how = {"double": number, "long": lambda c: F.bround(number(c)).cast("long"), "zip": standard_zip, "timestamp": utc_time}
    return df.withColumns({c: how[k](F.col(c) if c in df.columns else F.lit(None).cast("string")) for c, k in kinds.items()})


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def with_columns_or_null(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in its order."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def read_optional(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet") -> DataFrame:
    """A table, or no rows of its schema if it isn't there."""
    try:
        return with_columns_or_null(spark.read.format(form).option("header", True).load(path), schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


POLYGON = T.StructType(
    [
        T.StructField("zipcode", T.StringType()),
        T.StructField("population", T.LongType()),
        T.StructField("area", T.DoubleType()),
        T.StructField("contour", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)


def read_polygons(spark: SparkSession, path) -> DataFrame:
    """(zip_code, population, contour, position) of rings of four points or more; position breaks ties."""
    raw = spark.read.schema(POLYGON).option("multiLine", True).json(path)
    rows = raw.withColumn("zip_code", standard_zip("zipcode")).withColumn("position", F.monotonically_increasing_id())
    return rows.where("zip_code IS NOT NULL AND size(contour) >= 4 AND NOT exists(contour, p -> p IS NULL OR size(p) < 2 OR p[0] IS NULL OR p[1] IS NULL)").select("zip_code", "population", "contour", "position")


def zip_population(polygons: DataFrame) -> DataFrame:
    """(zip_code, population): the first that is known."""
    return polygons.where("population IS NOT NULL").groupBy("zip_code").agg(F.min_by("population", "position").alias("population"))


def read_json_matrix(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """A document [[names], [row], ...] as a table of the given columns, all text; one that it hasn't got is null."""
    doc = spark.read.option("wholetext", True).text(path)
    rows = doc.select(F.from_json("value", "array<array<string>>").alias("m")).select(F.col("m")[0].alias("names"), F.posexplode("m").alias("k", "row")).where("k > 0")
    return rows.select(*[F.try_element_at("row", F.nullif(F.array_position("names", F.lit(c)), F.lit(0)).cast("int")).alias(c) for c in columns])


def read_pages(spark: SparkSession, path, schema: T.StructType, start: str, date_col: str, id_col: str, max_rows: int | None = None) -> DataFrame:
    """Saved pages of a feed from a start date on, ordered by id where a number of rows is asked for."""
    rows = spark.read.schema(schema).json(path).where(F.col(date_col) >= F.lit(start))
    return rows if max_rows is None else rows.orderBy(id_col).limit(max_rows)


HEADER_BYTES = 1 << 20


def read_headers(spark: SparkSession, paths: list[str], most: int = HEADER_BYTES) -> DataFrame:
    """(path, header, problem): the first line of each file, of ``most`` bytes at most, or why it can't be read. Tasks read
    the beginnings of files; nothing else of them is looked at."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    store, place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
                    with store.open_input_stream(place) as f:
                        line = f.read(most).split(b"\n")[0].rstrip(b"\r").removeprefix(b"\xef\xbb\xbf")
                    out.append((path, line.decode(), None))
                except (OSError, pa.ArrowException, UnicodeDecodeError) as e:
                    out.append((path, None, str(e).splitlines()[0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["path", "header", "problem"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths) // 8, 1000)))
    return files.mapInArrow(heads, "path string, header string, problem string")


def discover(spark: SparkSession, paths: list[str], required: list[str], skip: str = "_clean", skipped: list | None = None) -> DataFrame | None:
    """Union of the CSV files whose header has the required columns, with source_file; files whose name ends with ``skip``
    are left out, and those whose header can't be read are noted in ``skipped`` as (path, reason).

    Headers are read by tasks, and files with the same header are read together, so there are as many scans as headers.
    """
    wanted = sorted(p for p in paths if not p.rsplit("/", 1)[-1].removesuffix(".csv").endswith(skip))
    skipped = [] if skipped is None else skipped
    same: dict[str, list[str]] = {}
    for path, header, problem in sorted(tuple(r) for r in read_headers(spark, wanted).collect()) if wanted else []:
        if problem is not None:
            skipped.append((path, problem))
        elif set(required) <= {c.strip().strip('"') for c in header.split(",")}:
            same.setdefault(header, []).append(path)
    out = None
    for files in same.values():
        df = read_csv(spark, files)
        if not set(required) <= set(df.columns):
            continue
        # As it was given: the reader says it as a URI, with signs written as %xx.
        plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        named = F.regexp_replace(plain, "^file:/+", "/") if not files[0].startswith("file:") else F.regexp_replace(plain, "^file:/+", "file:///")
        df = df.select("*", named.alias("source_file"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def literal_struct(c, schema: str):
    """A Python-literal dict text as a struct. Names of constants are translated outside of quotes only, and texts without
    any are taken as they are."""
    quoted = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
    pieces = F.regexp_extract_all(F.col(c), F.lit(f"{quoted}|[^'\"]+|['\"]"), F.lit(0))
    plain = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    text = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^['\"]"), p).otherwise(plain(p))), "")
    text = F.when(F.col(c).rlike("None|True|False"), text).otherwise(F.col(c))
    return F.from_json(text, schema, {"allowSingleQuotes": "true"})


def score_response(c: str):
    """A score service's answer: status class and six fields. 1 is ok, 2 and 31 transient, 30 bad place, 40-42 fatal."""
    schema = "status int, walkscore double, description string, transit struct<score:double,description:string>, bike struct<score:double,description:string>"
    r = F.from_json(F.col(c), schema)
    ok = r["status"] == 1
    state = F.when(ok, "ok").when(r["status"].isin(2, 31), "transient").when(r["status"] == 30, "bad_place").when(r["status"].isin(40, 41, 42), "fatal").otherwise("unknown")
    field = lambda v, n: F.when(ok, v).alias(n)
    return F.struct(state.alias("state"), field(r["walkscore"], "walk_score"), field(r["description"], "walk_description"), field(r["transit"]["score"], "transit_score"), field(r["transit"]["description"], "transit_description"), field(r["bike"]["score"], "bike_score"), field(r["bike"]["description"], "bike_description"))


def geocode_response(c: str):
    first = F.try_element_at(F.from_json(F.col(c), "array<struct<lat:string,lon:string>>"), F.lit(1))
    return F.struct(first["lat"].try_cast("double").alias("lat"), first["lon"].try_cast("double").alias("lon"))


def read_json_rows(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """A JSON array of records, or none if the file is missing."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_features(spark: SparkSession, path, target: str = "rent_usd") -> DataFrame:
    return spark.read.parquet(path).where(F.col(target).isNotNull())


def write_tables(tables: dict[str, DataFrame | None], folder: str, form: str = "parquet") -> None:
    """Each table that there is, to its own folder. Quotes within CSV cells are doubled, as ``read_csv`` has them."""
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").option("header", True).option("escape", '"').format(form).save(f"{folder}/{name}")


def write_sorted(df: DataFrame, keys: list[str], folder: str, columns: list[str] | None = None) -> None:
    """Globally sorted, nulls last, as CSV and Parquet; other columns are left out."""
    out = df.select(*(columns or df.columns)).orderBy(*[F.asc_nulls_last(k) for k in keys])
    out.write.mode("overwrite").parquet(f"{folder}/parquet")
    # The CSV comes from the Parquet, so the plan runs once.
    out = df.sparkSession.read.schema(out.schema).parquet(f"{folder}/parquet").orderBy(*[F.asc_nulls_last(k) for k in keys])
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/csv")


def append_run(metrics: DataFrame, run: str, path: str) -> None:
    """Metrics of a run, in the run's own partition."""
    metrics.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
