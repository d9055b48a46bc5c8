"""The store's own data source: batch and stream, reading and writing."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.sources import datasource, filesets
from noticeloom.sources.segments import Segments

ROWS = "doc_id long, rev string, value string"
KEYED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("value", T.StringType())])


@pytest.fixture
def store(spark, tmp_path):
    datasource.register(spark)
    held = Segments(spark, f"file://{tmp_path}/s", buckets=4, most=3)
    held.write(spark.range(200).select(F.col("id").alias("doc_id"), F.lit("1-a").alias("rev"), F.concat(F.lit("v"), "id").alias("value")))
    for turn in range(2):
        held.merge(spark.createDataFrame([(3, f"{turn + 2}-a", f"turn {turn}"), (1000 + turn, "1-a", None)], ROWS))
    return held


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reads_what_the_store_reads(spark, store):
    df = spark.read.format("segments").load(store.folder)
    assert df.columns == ["doc_id", "rev", "value", "version"]
    assert rows(df.drop("version")) == rows(store.read()) and df.where("doc_id = 3").first().version == 3
    old = spark.read.format("segments").option("version", 1).load(store.folder)
    assert rows(old.drop("version")) == rows(store.read(1)) and df.rdd.getNumPartitions() > 4


def test_streams_changes(spark, store, tmp_path):
    def drained(name, **options):
        q = spark.readStream.format("segments").options(**options).load(store.folder).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        return q

    q = drained("all_changes")
    now = drained("new_changes", since="now")
    assert spark.table("all_changes").count() == 204 and spark.table("new_changes").count() == 0
    store.merge(spark.createDataFrame([(7, "2-a", "late")], ROWS))
    store.compact(1)  # moves rows, changes none
    q.processAllAvailable(), now.processAllAvailable()
    assert spark.table("all_changes").count() == 205 and [tuple(r) for r in spark.table("new_changes").collect()] == [(7, "2-a", "late", 4)]
    q.stop(), now.stop()


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_writes_segments_that_the_store_reads(spark, tmp_path, kind):
    datasource.register(spark)
    folder = f"file://{tmp_path}/w"
    new = spark.range(50).select(F.col("id").cast(kind).alias("k"), F.concat(F.lit("v"), "id").alias("value"), F.array("id").alias("l")).repartition(3)
    new.write.format("segments").option("key", "k").option("buckets", 4).mode("append").save(folder)
    held = Segments(spark, folder, "k", 4)
    assert rows(held.read()) == rows(new)
    new.where("value IN ('v1', 'v2')").withColumn("value", F.lit("again")).write.format("segments").mode("append").save(folder)
    assert held.version() == 2 and held.read().where("value = 'again'").count() == 2 and held.read().count() == 50
    held.compact(1)  # buckets are those that Spark's hash gives
    assert held.read().count() == 50 and held.read().where("value = 'again'").count() == 2
    new.limit(5).write.format("segments").mode("overwrite").save(folder)
    assert held.read().count() == 5


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    datasource.register(spark)
    folder = f"file://{tmp_path}/w"
    bad = spark.range(20).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15, F.lit("x")).otherwise(F.raise_error(F.lit("no"))).alias("value"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("segments").mode("append").save(folder)
    assert not Segments(spark, folder).version() and not list((tmp_path / "w").glob("s0*"))


def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path):
    writer = datasource.Writer(str(tmp_path / "w"), KEYED, {"buckets": 4}, False)
    late = datasource.Writer(str(tmp_path / "w"), writer.schema, {"buckets": 4}, False)
    late.segment = writer.segment

    def killed(rows, abort_at):
        for i in range(rows):
            if i == abort_at:  # the driver's copy of the writer, while the task reads rows
                writer.abort([None])
            yield Row(doc_id=i, value="x")

    for at in (0, 3, 9):
        with pytest.raises(RuntimeError, match="aborted"):
            late.write(killed(10, at))
        assert not list(tmp_path.glob("w/s0*"))
    with pytest.raises(RuntimeError, match="aborted"):
        late.write(killed(10, -1))  # a task that starts after all
    assert not list(tmp_path.glob("w/s0*"))


@pytest.mark.parametrize("which", [filesets.Writer, datasource.Writer])
def test_files_made_while_a_job_is_aborted_go_with_their_task(tmp_path, monkeypatch, which):
    folder = tmp_path / "w"
    if which is filesets.Writer:
        writer, rows = which(str(folder), False), [Row(name=f"{i}.bin", content=b"x") for i in range(6)]
    else:
        writer, rows = which(str(folder), KEYED, {}, False), [Row(doc_id=i, value="x") for i in range(6)]
    seen = datasource.Folder.going_on

    def meanwhile(self, name):
        seen(self, name)
        writer.abort([None])  # after the task has looked, before it makes its file

    monkeypatch.setattr(datasource.Folder, "going_on", meanwhile)
    try:
        writer.write(iter(rows))
    except RuntimeError:
        pass
    assert not [p for p in folder.rglob("*") if p.is_file()]
    assert [p.name for p in folder.iterdir()] == ["_aborted"]


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    datasource.register(spark)
    folder = f"file://{tmp_path}/w"
    spark.range(30).select(F.col("id").alias("doc_id"), F.lit("x").alias("value")).repartition(3).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("doc_id long, value string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def start(checkpoint):
        q = read().writeStream.format("segments").option("stream", "one").option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start(folder)
        assert q.awaitTermination(120)

    start("c1")
    held = Segments(spark, folder)
    assert held.version() == 3 and held.read().count() == 30
    start("c2")  # the same batches of the same stream again
    assert held.version() == 3 and len(list((tmp_path / "w").glob("s0*"))) == 3
