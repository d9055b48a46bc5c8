"""Helpers that the corpus operators share: shared storage, tables, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below sf_dir, which may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one if Spark runs on one
    machine; on a cluster that is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            found = jsc.getCheckpointDir().get()
        elif spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="noticeloom-")
            spark.sparkContext.setCheckpointDir(found)
            found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there,
    and losing an executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noticeloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Most rows and bytes of an Arrow batch of texts, unless the session says otherwise: texts may be very long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def give_back() -> None:
    """Return memory that a task no longer uses to the system; else idle Python workers keep as much as their largest task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches that stay small when texts are long."""
    conf = df.sparkSession.conf
    for key, value in BATCHES.items():
        if conf.get(key, None) is None:
            conf.set(key, value)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


#: Rows of texts that a task works on at once; Arrow batches hold more.
SLICE_ROWS = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most that many rows, which bounds what is made of their texts at once."""
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            yield whole.slice(start, rows)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores before it until no column of df has it, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value, body):
    """A column from body(x), with x bound to value and evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
