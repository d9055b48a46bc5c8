"""Tables from files: documents, pictures, JSON records, dictionaries, feeds."""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.functions.text import data_url, plain_base64
from noticeloom.operators.selector import find
from noticeloom.sources.shared import shared_folder

RECORD = """text ARRAY<STRUCT<text: STRING, confidence: DOUBLE, x: INT, y: INT, width: INT, height: INT, id: STRING, baseid: STRING,
 replaces: ARRAY<STRUCT<text: STRING, confidence: DOUBLE>>>>, filename STRING, images STRUCT<original: INT, best: INT, text: INT, edges: INT, contours: INT>"""
POSTERS = """doc_id STRING, rev STRING, version STRING, created TIMESTAMP, processed_by STRING, event_id STRING, user_event STRING,
 attachments MAP<STRING, STRUCT<content_type: STRING, data: BINARY>>, deleted BOOLEAN"""


def table(spark: SparkSession, folder: str, name: str, prefix: str = "") -> DataFrame:
    """A Parquet table; a prefix chooses another set of tables, such as a trial one."""
    return spark.read.parquet(f"{folder}/{prefix}{name}.parquet")


def image_files(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png,gif}") -> DataFrame:
    """(filename, modified, size, content) of picture files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("filename"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def json_records(spark: SparkSession, path: str | list[str], schema: T.StructType | str = RECORD) -> DataFrame:
    """One record a file."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("source", F.input_file_name())


def parsed_records(rows: DataFrame, column: str = "json", schema: T.StructType | str = RECORD) -> DataFrame:
    """rows with record, an empty one where the text is no JSON, and failed, whether that was so."""
    parsed = F.from_json(column, schema)
    return rows.withColumn("failed", F.try_parse_json(column).isNull() & F.col(column).isNotNull()).withColumn("record", F.when(~F.col("failed"), parsed))


def boxes_of(records: DataFrame, key: str = "doc_id", record: str = "record") -> DataFrame:
    """(key, ord, box members): one row a text box."""
    return records.select(key, F.posexplode(F.col(record)["text"]).alias("ord", "b")).select(key, "ord", "b.*")


def exists(spark: SparkSession, name: str) -> bool:
    """Whether a name is the path of a file or folder in its store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def document(documents: DataFrame, doc_id, rev: str | None = None, attachments: bool = True) -> DataFrame:
    """One document, perhaps of a given revision, perhaps without its attachments (which are then not read)."""
    out = documents.where(F.col("doc_id") == F.lit(doc_id))
    out = out.where(F.col("rev") == rev) if rev is not None else out
    return out if attachments or "attachments" not in out.columns else out.drop("attachments")


def event(events: DataFrame, event_id: str, rev: str | None = None) -> DataFrame:
    """One event record, perhaps of a given revision."""
    out = events.where(F.col("event_id") == F.lit(event_id))
    return out if rev is None else out.where(F.col("rev") == rev)


def new_documents(before: DataFrame, now: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of now whose ids were not there before."""
    return now.join(before.select(key).distinct(), key, "left_anti")


def has_picture(attachments: Column, name: str = "userimage") -> Column:
    """Whether an attachment of that name holds any bytes."""
    return F.coalesce(F.octet_length(F.try_element_at(attachments, F.lit(name))["data"]) > 0, F.lit(False))


def shown_picture(attachments: Column, thumb: str = "userimage-thumb", full: str = "userimage") -> Column:
    """Data URL of the thumbnail, or of the full picture where there is none; null without either."""
    one = lambda n: F.when(has_picture(attachments, n), data_url(F.try_element_at(attachments, F.lit(n))["content_type"], F.try_element_at(attachments, F.lit(n))["data"]))
    return F.coalesce(one(thumb), one(full))


def path_parts(path: Column) -> Column:
    """(folder, name, extension) of a file's path."""
    name = F.substring_index(path, "/", -1)
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    return F.struct(folder.alias("folder"), name.alias("name"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"))


def attachment(documents: DataFrame, doc_id, name: str) -> DataFrame:
    """(doc_id, content_type, data as base64) of an attachment; an empty text if there is none."""
    a = F.element_at("attachments", F.lit(name))
    return documents.where(F.col("doc_id") == F.lit(doc_id)).select("doc_id", a["content_type"].alias("content_type"), F.coalesce(plain_base64(a["data"]), F.lit("")).alias("data"))


def ids(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select("doc_id", *more)


#: Parts that a range is cut into at once; rows that are ordered in one task.
PARTS, FEW = 64, 10_000


def nth_id(documents: DataFrame, n: int, few: int = FEW) -> DataFrame:
    """The id at a place in the order of ids (nulls first), counted from 0.

    Ids of a sample part a range, the parts are counted, and the part that holds the place is the next
    range, until it has few rows or ids; only those are put in order."""
    ids = documents.select("doc_id")
    nulls = ids.where("doc_id IS NULL").count()
    if n < nulls:
        return ids.where("doc_id IS NULL").limit(1)
    rest, n = ids.where("doc_id IS NOT NULL"), n - nulls
    while True:
        sample = sorted({r[0] for r in rest.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(PARTS).collect()})
        if len(sample) < PARTS:  # few ids: counted one by one
            break
        part = F.size(F.filter(F.array(*map(F.lit, sample)), lambda x: x <= F.col("doc_id")))
        counts = dict(rest.groupBy(part.alias("part")).count().collect())
        at = 0
        while at < PARTS and n >= counts.get(at, 0):
            n -= counts.get(at, 0)
            at += 1
        bounds = ([F.col("doc_id") >= sample[at - 1]] if at else []) + ([F.col("doc_id") < sample[at]] if at < PARTS else [])
        for b in bounds:
            rest = rest.where(b)
        if counts.get(at, 0) <= few:
            return rest.orderBy("doc_id").offset(n).limit(1)
    for value, count in sorted(rest.groupBy("doc_id").count().collect()):
        if n < count:
            return rest.where(F.col("doc_id") == value).limit(1)
        n -= count
    return ids.limit(0)


def selected_ids(documents: DataFrame, selector, limit: int = 25) -> DataFrame:
    """Ids and revisions of the first matching documents by id."""
    return find(documents, selector, ["doc_id", "rev"], limit, "doc_id")


def posters_of_events(posters: DataFrame, events: DataFrame, selector, limit: int = 25) -> DataFrame:
    """Posters whose event matches a selector: the first matching events, then the first posters."""
    some = find(events, selector, ["event_id"], limit, "event_id")
    return posters.join(some, "event_id", "left_semi").orderBy("doc_id").limit(limit)


def newest_first(documents: DataFrame, by: str = "created", key: str = "doc_id") -> DataFrame:
    """documents, newest first and then by key, with place, counted from 1; those without a time come last.

    Rows are dealt to ranges of both columns, so one time may hold all of them. Each range is numbered as it is
    written to the shared folder; a range's first place follows from the numbers of rows in those before it."""
    order = [F.col(by).desc_nulls_last(), F.col(key)]
    spark, folder = documents.sparkSession, shared_folder(documents.sparkSession, "places")
    names = documents.columns

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            more = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(range(done + 1, done + 1 + batch.num_rows), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "_part", "_rank"])
            done += batch.num_rows

    schema = T.StructType([*documents.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())])
    documents.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(numbered, schema).write.parquet(folder)
    rows = spark.read.schema(schema).parquet(folder)
    counts = sorted(map(tuple, rows.groupBy("_part").count().collect()))  # one row a range
    before = [(p, b) for (p, _), b in zip(counts, itertools.accumulate((n for _, n in counts), initial=0))]
    offsets = spark.createDataFrame(before, "_part int, _before long")
    return rows.join(F.broadcast(offsets), "_part").select(*names, (F.col("_before") + F.col("_rank")).alias("place")).orderBy("place")


def change_feed(spark: SparkSession, path: str, schema: T.StructType | str, files: int = 5) -> DataFrame:
    """Stream of the change files that arrive in a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def read_config(paths: list[str]) -> dict:
    """Settings of the first file that exists; none is an empty one."""
    for p in paths:
        if os.path.exists(p):
            with open(p, encoding="utf-8") as f:
                return json.load(f)
    return {}


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's whole name, with the scheme of its store and as files below it are named."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def chosen(path: Column, root: str, pattern: str | None, depth: int) -> Column:
    """Whether a file's whole name fits a pattern and it lies at most depth folders below a root (negative: at any depth)."""
    # a store's name is written with one slash or three
    below = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^/+", "").substr(F.lit(len(root.replace("file:", "", 1).strip("/")) + 2), F.lit(1 << 30))
    fits = F.lit(True) if pattern is None else F.substring_index(path, "/", -1).rlike(f"^(?:{pattern})$")
    return fits & (F.lit(depth < 0) | (F.char_length(F.regexp_replace(below, "[^/]", "")) <= depth))


def located(spark: SparkSession, folders: list[str], pattern: str, depth: int = -1) -> DataFrame:
    """(place, path) of files whose whole name fits a pattern, at most depth folders below one of the folders, whose place is its number.

    A depth of 0 means the folder itself, a negative one any. Folders that do not exist are passed over."""
    out = spark.createDataFrame([], "place int, path string")
    for place, folder in enumerate(folders):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            out = out.unionByName(found.where(chosen(F.col("path"), qualified(spark, folder), pattern, depth)).select(F.lit(place).alias("place"), "path"))
    return out


def first_located(spark: SparkSession, folders: list[str], pattern: str, depth: int = -1) -> str | None:
    """The first such file by folder, then the least deep, then by path; None if there is none."""
    deep = F.char_length(F.regexp_replace("path", "[^/]", ""))
    found = located(spark, folders, pattern, depth).agg(F.min(F.struct("place", deep.alias("deep"), "path"))["path"].alias("path")).first()
    return found["path"]
