"""A table whose files count once a manifest names them.

Tasks write Parquet files of their own; nobody reads them before the job's end puts their names into the manifest, which
is replaced in one move. A job that fails half-way, or a task that is run again, leaves files that no manifest names, and
readers see the table as it was. One job at a time may write to a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

MANIFEST = "_manifest.json"


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def manifest(path: str) -> dict:
    """{schema, files, batches}: the files that count, and by stream the last batch that they hold."""
    fs, root = _store(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pa.fs.FileType.NotFound:
        return {"schema": None, "files": [], "batches": {}}
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def _replace(path: str, new: dict) -> None:
    fs, root = _store(path)
    fs.create_dir(root, recursive=True)
    staged = f"{root}/.{MANIFEST}-{uuid.uuid4().hex}"
    with fs.open_output_stream(staged) as f:
        f.write(json.dumps(new).encode())
    fs.move(staged, f"{root}/{MANIFEST}")


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def _write(path: str, batches: Iterator[pa.RecordBatch]) -> _Written:
    fs, root = _store(path)
    name, out, sink = f"part-{uuid.uuid4().hex}.parquet", None, None
    for batch in batches:
        if out is None:
            fs.create_dir(root, recursive=True)
            sink = fs.open_output_stream(f"{root}/{name}")
            out = pq.ParquetWriter(sink, batch.schema)
        out.write_batch(batch)
    if out is not None:
        out.close()
        sink.close()
    return _Written([name] if out is not None else [])


def _discard(path: str, messages: list) -> None:
    fs, root = _store(path)
    for m in messages:
        for f in m.files if m is not None else []:
            fs.delete_file(f"{root}/{f}")


class Published(DataSource):
    """Format ``published``: option path; as the target of a stream also ``stream``, a name that its restarts share, so
    that a batch which was published already isn't again."""

    @classmethod
    def name(cls) -> str:
        return "published"

    def schema(self) -> str:
        known = manifest(self.options["path"])["schema"]
        if known is None:
            raise ValueError("nothing has been published there")
        return T._parse_datatype_json_string(known)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"], schema, self.options.get("stream", "stream"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = path, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        # One part that reads nothing, where there are no files.
        return [InputPartition(f) for f in manifest(self.path)["files"] or [None]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        fs, root = _store(self.path)
        with fs.open_input_file(f"{root}/{partition.value}") as f:
            yield from pq.ParquetFile(f).iter_batches(columns=self.names)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema.json(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return _write(self.path, iterator)

    def commit(self, messages: list) -> None:
        old = manifest(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        _replace(self.path, {"schema": self.schema, "files": files if self.overwrite else old["files"] + files, "batches": {} if self.overwrite else old["batches"]})

    def abort(self, messages: list) -> None:
        _discard(self.path, messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: T.StructType, stream: str):
        self.path, self.schema, self.stream = path, schema.json(), stream

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return _write(self.path, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        old = manifest(self.path)
        if old["batches"].get(self.stream, -1) >= batchId:
            _discard(self.path, messages)
            return
        files = [f for m in messages if m is not None for f in m.files]
        _replace(self.path, {"schema": self.schema, "files": old["files"] + files, "batches": old["batches"] | {self.stream: batchId}})

    def abort(self, messages: list, batchId: int) -> None:
        _discard(self.path, messages)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table as its manifest says now, through Spark's own Parquet reader, so that filters and columns reach it."""
    now = manifest(path)
    if now["schema"] is None:
        raise ValueError("nothing has been published there")
    schema = T.StructType.fromJson(json.loads(now["schema"]))
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in now["files"]]) if now["files"] else spark.createDataFrame([], schema)


def sweep_unpublished(path: str) -> int:
    """Removes files that the manifest doesn't name, of failed jobs and of versions before; how many. Not while a job
    writes or reads."""
    fs, root = _store(path)
    known = {*manifest(path)["files"], MANIFEST}
    extra = [f.path for f in fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)) if f.base_name not in known]
    for f in extra:
        fs.delete_file(f)
    return len(extra)
