"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCOPES: list[list[str]] = []
SMALL_ROWS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one does for
    a local session, whose executors are the driver; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="rentloom-")
        where = _LOCAL[app]
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own there; it goes at the end of the ``scope`` it was made in, if there is one."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A table written there and read back, so that later jobs neither compute it again nor depend on the executors that
    made it."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_small(df: DataFrame, name: str, most: int = SMALL_ROWS) -> DataFrame:
    """The rows themselves, as part of the plan, if there are ``most`` at most; a written table otherwise. They are
    computed once in either case."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return materialize(df, name)
    return df.sparkSession.createDataFrame(rows, schema=df.schema)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Folders made within are removed at its end. What is computed from them has to be written, or collected, before."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            remove(spark, path)
