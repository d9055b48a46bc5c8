"""Files of rows, crops of pictures, files found by pattern and depth, saves by revision."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeloom.functions import images
from noticeloom.operators import crops, fuzzy
from noticeloom.sources import files, filesets, store
from noticeloom.sources.segments import Segments


def held(spark, folder, number=None):
    return sorted((r["name"], bytes(r["content"])) for r in filesets.read_files(spark, folder, number).collect())


def test_rows_become_files_and_sets_add_up(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    df = spark.createDataFrame([("a.txt", b"one", 1), ("b/c.txt", b"two", 2), (None, b"x", 3), ("d", None, 4), ("empty", b"", 5)], "name string, content binary, more int")
    filesets.write_files(df, folder)
    filesets.write_files(df.limit(0), folder)
    filesets.write_files(spark.createDataFrame([("e", b"\x00\xff")], "name string, content binary"), folder)
    assert held(spark, folder, 1) == held(spark, folder, 2) == [("a.txt", b"one"), ("b/c.txt", b"two")] and held(spark, folder) == [("a.txt", b"one"), ("b/c.txt", b"two"), ("e", b"\x00\xff")]
    filesets.write_files(df.where("more = 1"), folder, "overwrite")
    assert held(spark, folder) == [("a.txt", b"one")] and held(spark, f"{folder}-none") == []


def test_a_task_that_runs_twice_leaves_each_file_once(spark, tmp_path):
    writer = filesets.Writer(str(tmp_path), False)
    rows = [{"name": f"{i}.bin", "content": bytes([i])} for i in range(3)]
    lost, counted = writer.write(iter(rows)), writer.write(iter(rows))
    assert lost.folder != counted.folder
    writer.commit([counted, None])
    assert held(spark, str(tmp_path)) == [(f"{i}.bin", bytes([i])) for i in range(3)]


def test_a_job_that_fails_leaves_no_files(spark, tmp_path):
    one = [("ok", b"1"), ("../x", b"2")]
    for bad in (one, [("same", b"1"), ("same", b"2")], [("_hidden", b"1")]):
        with pytest.raises(Exception, match="no name for a file|two rows are named"):
            filesets.write_files(spark.createDataFrame(bad, "name string, content binary").coalesce(1), str(tmp_path / "s"))
        assert held(spark, str(tmp_path / "s")) == [] and not [p for p in (tmp_path / "s").rglob("*") if p.is_file()]


def test_files_are_read_from_lists_that_tasks_share(spark, tmp_path):
    folder = str(tmp_path / "many")
    rows = spark.range(500).select(F.concat(F.lit("a b/"), "id", F.lit(".bin")).alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    filesets.write_files(rows.repartition(3), folder)
    filesets.write_files(rows.where("id < 20").coalesce(1), folder)
    found = filesets.read_files(spark, folder)
    assert len(found.inputFiles()) == 4 and found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert held(spark, folder) == sorted([(r["name"], bytes(r["content"])) for r in rows.collect()] + [(f"a b/{i}.bin", str(i).encode()) for i in range(20)])
    assert found.agg(F.sum("bytes")).first()[0] == 10 + 2 * 90 + 3 * 400 + 10 + 2 * 10
    for path in tmp_path.glob("many/*/files-*/a b/7.bin"):  # names and sizes need no contents
        path.unlink()
    assert found.select("name", "bytes").where("bytes = 1").count() == 20 and found.where("name LIKE '%/8.bin'").count() == 2
    with pytest.raises(Exception, match="7.bin"):
        found.where("name LIKE '%/7.bin'").collect()


def test_large_files_and_sets_without_lists(spark, tmp_path):
    folder = str(tmp_path / "large")
    size = 6 << 20
    filesets.write_files(spark.range(12).select(F.col("id").cast("string").alias("name"), F.rpad(F.col("id").cast("string"), size, "x").cast("binary").alias("content")).repartition(2), folder)
    digest = lambda df: sorted(map(tuple, df.select("name", "bytes", F.sha2("content", 256)).collect()))
    wanted = sorted(map(tuple, spark.range(12).select(F.col("id").cast("string"), F.lit(size).cast("long"), F.sha2(F.rpad(F.col("id").cast("string"), size, "x").cast("binary"), 256)).collect()))
    assert digest(filesets.read_files(spark, folder)) == wanted
    manifest = tmp_path / "large/_sets/00000001"
    manifest.write_text(json.dumps([{k: v for k, v in p.items() if k != "names"} for p in json.loads(manifest.read_text())]))
    filesets.write_files(spark.createDataFrame([("new", b"n")], "name string, content binary"), folder)
    assert digest(filesets.read_files(spark, folder).where("name <> 'new'")) == wanted and filesets.read_files(spark, folder).count() == 13


def decoded(data):
    """Pixels of a PNG file without filters, read chunk by chunk."""
    at, lines = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            cols, rows, depth, colour = struct.unpack(">IIBB", body[:10])
        lines += body if kind == b"IDAT" else b""
        at += 12 + size
    n = {0: 1, 2: 3, 6: 4}[colour]
    flat = np.frombuffer(zlib.decompress(lines), np.uint8).reshape(rows, 1 + cols * n)
    assert depth == 8 and not flat[:, 0].any()
    return flat[:, 1:].reshape(rows, cols, n)


def test_crops_are_the_pixels_that_boxes_touch(spark, tmp_path):
    pixels = np.random.default_rng(5).integers(0, 256, (30, 40, 3), dtype=np.uint8)
    picture = spark.createDataFrame([(1, (30, 40, 3, pixels.tobytes())), (2, (1, 1, 1, b"\x07")), (3, (None, None, None, None)), (None, (1, 1, 1, b"\x07"))], "doc_id long, image struct<rows:int,cols:int,elem_size:int,data:binary>")
    boxes = [(1, 0, 3.0, 4.0, 10.0, 5.0), (1, 1, -5.0, -5.0, 6.5, 6.5), (1, 2, 35.0, 25.0, 100.0, 100.0), (1, 3, 50.0, 0.0, 5.0, 5.0), (1, 4, None, 0.0, 5.0, 5.0), (1, 5, float("nan"), 0.0, 5.0, 5.0), (1, 6, 0.0, 0.0, 0.0, 5.0),
             (1, None, 0.0, 0.0, 5.0, 5.0), (2, 0, 0.0, 0.0, 9.0, 9.0), (3, 0, 0.0, 0.0, 9.0, 9.0), (4, 0, 0.0, 0.0, 9.0, 9.0), (None, 0, 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(boxes, "doc_id long, ord int, x double, y double, width double, height double").withColumn("image", F.lit("a name in use"))
    found = {(r["doc_id"], r["ord"]): r for r in crops.crops(picture, df).collect()}
    wanted = {(1, 0): pixels[4:9, 3:13], (1, 1): pixels[0:2, 0:2], (1, 2): pixels[25:30, 35:40], (2, 0): np.full((1, 1, 1), 7, np.uint8)}
    assert set(found) == set(wanted)
    for key, part in wanted.items():
        got = decoded(bytes(found[key]["content"]))
        assert np.array_equal(got[:, :, ::-1] if part.shape[2] == 3 else got, part) and (found[key]["rows"], found[key]["cols"]) == part.shape[:2]
    many = spark.range(2500).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("ord"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("width"), F.lit(2.0).alias("height"))
    assert crops.crops(picture, many).count() == 2500 and crops.crops(picture, many.limit(0)).count() == 0
    crops.save_crops(crops.crops(picture, df), f"{tmp_path}/c")
    assert [n for n, _ in held(spark, f"{tmp_path}/c")] == ["line-1-0.png", "line-1-1.png", "line-1-2.png", "line-2-0.png"]


def test_boxes_of_one_picture_are_the_work_of_many_tasks(spark, tmp_path):
    picture = spark.createDataFrame([(1, (2, 2, 1, b"abcd"))], "doc_id long, image struct<rows:int,cols:int,elem_size:int,data:binary>")
    boxes = spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("ord"), *(F.lit(v).alias(c) for c, v in (("x", 0.0), ("y", 0.0), ("width", 1.0), ("height", 1.0))))
    found = crops.crops(picture, boxes)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and len(sizes) > 4 and max(sizes) < 30_000


def test_pictures_are_attached_as_png(spark):
    df = spark.createDataFrame([((1, 2, 4, bytes(range(8))),), ((None, None, None, None),)], "i struct<rows:int,cols:int,elem_size:int,data:binary>")
    first, second = [r.p for r in df.select(images.png("i").alias("p")).collect()]
    assert decoded(bytes(first)).tolist() == [[[2, 1, 0, 3], [6, 5, 4, 7]]] and second is None
    with pytest.raises(ValueError):
        images.png_bytes(np.zeros((1, 1, 2), np.uint8))


def test_files_by_pattern_and_depth(spark, tmp_path):
    for name, text in {"words_de.txt": "Haus", "words_en.txt": "house", "x/words_de.txt": "Hof", "x/y/words_de.txt": "Hut", "x/names.txt": "Ann"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text + "\n")
    for root in (str(tmp_path), f"file://{tmp_path}", f"file://{tmp_path}/"):
        terms = lambda **k: sorted(r.term for r in fuzzy.read_dictionaries(spark, root, **k).collect())  # noqa: E731, B023
        assert terms() == ["Ann", "Haus", "Hof", "Hut", "house"] and terms(depth=0) == ["Haus", "house"] and terms(depth=1) == ["Ann", "Haus", "Hof", "house"]
        assert terms(pattern=r"words_.*\.txt", depth=1) == ["Haus", "Hof", "house"] and terms(pattern="words") == []
        found = lambda *a: sorted(r.path.removeprefix("file:").replace("//", "/").removeprefix(str(tmp_path)) for r in files.located(spark, [root, f"{tmp_path}/none"], *a).collect())  # noqa: E731, B023
        assert found(".*_de.*") == ["/words_de.txt", "/x/words_de.txt", "/x/y/words_de.txt"] and found(".*_de.*", 1) == ["/words_de.txt", "/x/words_de.txt"]
    assert files.first_located(spark, [f"{tmp_path}/x", str(tmp_path)], "words_de.txt").endswith("/x/words_de.txt") and files.first_located(spark, [f"{tmp_path}/none"], ".*") is None


def test_edits_are_saved_by_revision(spark, tmp_path):
    documents, records = Segments(spark, f"{tmp_path}/d", buckets=2), Segments(spark, f"{tmp_path}/r", key="event_id", buckets=2)
    documents.write(spark.createDataFrame([("a", "1-x", None), ("b", "1-x", None), ("c", "1-x", "event-c")], "doc_id string, rev string, event_id string"))
    edit = lambda *rows: spark.createDataFrame(rows, "doc_id string, doc_rev string, event_id string, rev string, title string")
    away = store.save_edits(edit(("a", "1-x", None, None, "A"), ("b", "0-x", None, None, "B"), ("none", None, None, None, "N"), (None, None, None, None, "0")), documents, records)
    assert sorted((r.doc_id for r in away.collect()), key=str) == [None, "b", "none"]
    link = lambda: {r.doc_id: r.event_id for r in documents.read().collect()}
    title = lambda: {r.event_id: r.title for r in records.read().collect()}
    assert link() == {"a": "event-a", "b": None, "c": "event-c"} and title() == {"event-a": "A"}
    rev = {r.doc_id: r.rev for r in documents.read().collect()}
    own = records.read().first().rev
    # another editor had a revision of the record that is gone
    assert store.save_edits(edit(("a", rev["a"], "event-a", "0-x", "A2")), documents, records).count() == 1 and title() == {"event-a": "A"}
    assert store.save_edits(edit(("a", rev["a"], "event-a", own, "A3")), documents, records).count() == 0 and title() == {"event-a": "A3"}
    # the first half of a save was done before: the record is there, the link is not
    records.put(spark.createDataFrame([("event-b", None, "B")], "event_id string, rev string, title string"), "event_id")
    assert store.save_edits(edit(("b", "1-x", None, None, "B")), documents, records).count() == 0 and link()["b"] == "event-b"
