import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rentloom.sources import paged, published
from rentloom.sources import staging as G
from rentloom.streaming import feeds as S
from rentloom.streaming import seen
from rentloom.streaming.seen import first_ever, state_on_disk


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) for x in r])


def rows_of(df):
    return in_order(df.collect())


def test_keys_are_known_for_ever(spark, tmp_path):
    schema = "k string, at int, v string"
    got = []
    # Each list is what a run of the stream gets; the stream is stopped in between.
    for rows in ([("a", 2, "x"), ("a", 1, "y"), (None, 5, "n"), ("b", 9, "z")], [("a", 0, "late")], [("c", None, "u"), ("c", 1, "w"), ("b", 1, "late"), (None, 1, "late")], []):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with state_on_disk(spark):
            stream = first_ever(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], ["at"])
            S.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        got.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert got == [3, 3, 4, 4]
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == in_order([("a", 1, "y"), (None, 5, "n"), ("b", 9, "z"), ("c", None, "u")])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None


def test_a_trigger_is_cut_down_before_the_state(spark, tmp_path, monkeypatch):
    """Keys recur within and between tasks, in parts of a few rows; the state gets one row of each key."""
    monkeypatch.setattr(seen, "PART", 5, raising=False)
    rng = random.Random(3)
    schema = "k string, j int, at int, v long"
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), rng.choice([None, *range(50)]) if v % 7 else v - 300, v) for v in range(400)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = first_ever(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k", "j"], ["at", "v"])
    with state_on_disk(spark):
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        query.awaitTermination()
    want = {}
    for r in in_order(rows):
        key = (r[0], r[1])
        want[key] = min(want.get(key, r), r, key=lambda x: [(x[2] is not None, x[2] or 0), x[3]])
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == in_order(want.values())
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) == len(want)
    assert [s["operatorName"] for s in query.lastProgress["stateOperators"]] == ["dedupe"]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    spark.dataSource.register(published.Published)
    path = str(tmp_path / "t")
    write = lambda df, mode: df.write.format("published").mode(mode).option("path", path).save()
    with pytest.raises(ValueError):
        published.read_published(spark, path)
    write(spark.range(10).repartition(3), "append")
    write(spark.range(10, 15), "append")
    assert rows_of(published.read_published(spark, path)) == [(k,) for k in range(15)]
    breaks = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).cast("long").alias("id"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="half-way"):
            write(breaks, mode)
        assert published.read_published(spark, path).count() == 15
        assert rows_of(spark.read.format("published").option("path", path).load()) == [(k,) for k in range(15)]
    published.sweep_unpublished(path)
    before = {f for f in os.listdir(path) if f.startswith("part")}
    write(spark.range(3), "overwrite")
    assert rows_of(published.read_published(spark, path)) == [(0,), (1,), (2,)]
    assert before < set(os.listdir(path)) and published.sweep_unpublished(path) == len(before)
    write(spark.range(0), "overwrite")
    assert published.read_published(spark, path).count() == 0 == spark.read.format("published").option("path", path).load().count()


def test_a_batch_is_published_once(tmp_path):
    path = str(tmp_path / "t")
    schema = published.T.StructType([published.T.StructField("v", published.T.LongType())])
    writer = published._StreamWriter(path, schema, "s")
    put = lambda: writer.write(iter([pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["v"])]))
    first = put()
    writer.commit([first, None], 0)
    writer.commit([put()], 0)
    assert published.manifest(path)["files"] == first.files and len([f for f in os.listdir(path) if f.startswith("part")]) == 1
    again = put()
    writer.abort([again, None], 1)
    assert published.manifest(path)["batches"] == {"s": 0} and len(os.listdir(path)) == 2


def pages(spark, tmp_path, n):
    spark.range(0, n, 1, 3).withColumn("name", F.concat(F.lit("row"), "id")).write.option("parquet.block.size", 1000).parquet(str(tmp_path / "feed"))
    return {"schema": "id long, name string", "page": 3, "fetcher": "rentloom.sources.paged:parquet_page", "path": str(tmp_path / "feed"), "columns": "id,name"}


def test_a_feed_goes_on_where_it_stopped(spark, tmp_path):
    options = pages(spark, tmp_path, 23)
    spark.dataSource.register(paged.PagedFeed)
    spark.dataSource.register(published.Published)
    path = str(tmp_path / "t")
    counts = []
    for there in (9, 9, 16, None):
        more = {} if there is None else {"total": there}
        stream = spark.readStream.format("paged_feed").options(**options, **more).load()
        stream.writeStream.format("published").option("path", path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        counts.append(published.read_published(spark, path).count())
    assert counts == [9, 9, 16, 23]
    assert rows_of(published.read_published(spark, path).select("id")) == [(k,) for k in range(23)]
    table = spark.read.format("paged_feed").options(**options).load()
    assert rows_of(table) == rows_of(published.read_published(spark, path)) and table.where("id < 5").count() == 5
    assert spark.read.format("paged_feed").options(**options, max_rows=8).load().count() == 8


def test_the_end_of_a_feed_is_found(spark, tmp_path):
    for n in (0, 1, 2, 13, 64):
        folder = tmp_path / str(n)
        folder.mkdir()
        options = {k: str(v) for k, v in pages(spark, folder, n).items()}
        reader = paged._PagedStream(options)
        assert reader.latestOffset() == {"offset": n}
        assert [p.value for p in reader.partitions({"offset": 0}, {"offset": min(n, 7)})] == [(k, min(3, min(n, 7) - k)) for k in range(0, min(n, 7), 3)]


def test_folders_go_with_their_scope(spark, tmp_path):
    with G.scope(spark):
        folder = G.new_folder(spark, "x")
        spark.range(2).write.parquet(folder)
    assert not os.path.exists(folder.removeprefix("file://"))
