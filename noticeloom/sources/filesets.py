"""Rows as files: ``df.write.format("fileset").mode(...).save(folder)`` makes a file of each row (name, content).

Each attempt of a task writes into a folder of its own. When all tasks are done, the folders of the attempts that
counted are named in one manifest, which is made whole or not at all; files of other attempts are never read, and
those of a job that fails are deleted, also by tasks that outlive it (see ``datasource``). ``append`` keeps the files of earlier sets, ``overwrite`` no longer names them.
Each attempt lists its files in a Parquet file, so readers list no folders and tasks of any number share the files.

Names are paths below the folder, of parts that begin with neither a dot nor an underscore (Spark would not read them).
Rows without a name or any content make no file (Spark does not read empty ones); a name that a task meets again is an error, as its first file would be lost. Other columns are not
written. A name that other tasks or sets have too is another file. An empty table makes an empty set.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from noticeloom.sources.datasource import Folder

NAME = "fileset"
PART = re.compile(r"[^/._][^/]*")

#: Files, and their bytes, that a task reads; bytes that it holds at once.
FILES, BYTES, BATCH_BYTES = 10_000, 128 << 20, 16 << 20


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int
    bytes: int
    names: str


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> Written:
        folder, number, made, folders = Folder(self.path), uuid.uuid4().hex, {}, set()
        own, names = f"{self.job}/files-{number}", f"{self.job}/names-{number}.parquet"
        try:
            for row in iterator:
                name, content = row["name"], row["content"]
                if name is None or not content:
                    continue
                if not all(PART.fullmatch(p) for p in name.split("/")):
                    raise ValueError(f"no name for a file: {name}")
                if name in made:
                    raise ValueError(f"two rows are named {name}")
                made[name] = len(content)
                full = f"{folder.root}/{own}/{name}"
                if (above := full.rsplit("/", 1)[0]) not in folders:
                    folder.going_on(self.job)
                    folder.fs.create_dir(above, recursive=True)
                    folders.add(above)
                with folder.fs.open_output_stream(full) as f:
                    f.write(bytes(content))
            if made:
                with folder.fs.open_output_stream(f"{folder.root}/{names}") as f:
                    pq.write_table(pa.table({"folder": [own] * len(made), "name": list(made), "bytes": pa.array(made.values(), pa.int64())}), f)
        finally:
            folder.swept(self.job)
        return Written(own, len(made), sum(made.values()), names)

    def commit(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        number = len(folder.names("_sets"))
        held = [] if self.overwrite or not number else json.loads(folder.text(f"_sets/{number:08d}"))
        new = [{"folder": m.folder, "files": m.files, "bytes": m.bytes, "names": m.names} for m in messages if m and m.files]
        folder.put_text(f"_sets/{number + 1:08d}", json.dumps(held + new))

    def abort(self, messages: list[Written | None]) -> None:
        Folder(self.path).abort(self.job)


class FileSetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        missing = {"name", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> str:
    """Make the format known to a session; its name."""
    spark.dataSource.register(FileSetSource)
    return NAME


def write_files(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Write the rows of df(name, content) as files of a set."""
    df.select("name", "content").write.format(register(df.sparkSession)).mode(mode).save(folder)


def _content(folder: str, name: Column, size: Column) -> Column:
    """Contents of files below a folder, some at a time by their sizes."""

    @F.pandas_udf(T.BinaryType())
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        store = Folder(folder)
        for names, sizes in batches:
            held, left = [], BATCH_BYTES
            for n, more in zip(names, sizes, strict=True):
                if held and more > left:
                    yield pd.Series(held, dtype=object)
                    held, left = [], BATCH_BYTES
                with store.fs.open_input_file(f"{store.root}/{n}") as f:
                    held.append(f.read())
                left -= more
            yield pd.Series(held, dtype=object)

    return read(name, size)


def read_files(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """(name, bytes, content) of the files of the newest set, or of that number; contents are read only where they are used."""
    held, root = Folder(folder), folder.rstrip("/")
    names = held.names("_sets")
    parts = json.loads(held.text(f"_sets/{number:08d}" if number else f"_sets/{names[-1]}")) if names else []
    out = spark.createDataFrame([], "name string, bytes long, content binary")
    if listed := [p for p in parts if "names" in p]:
        files, size = (sum(p[k] for p in listed) for k in ("files", "bytes"))
        tasks = min(files, max(spark.sparkContext.defaultParallelism, -(-files // FILES), -(-size // BYTES)))
        rows = spark.read.schema("folder string, name string, bytes long").parquet(*(f"{root}/{p['names']}" for p in listed)).repartition(tasks, "folder", "name")
        out = rows.select("name", "bytes", _content(folder, F.concat_ws("/", "folder", "name"), F.col("bytes")).alias("content"))
    if older := [f"{root}/{p['folder']}" for p in parts if "names" not in p]:  # sets of before attempts listed their files
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(older)
        out = out.unionByName(files.select(F.regexp_extract("path", r"/files-[0-9a-f]{32}/(.*)$", 1).alias("name"), F.col("length").alias("bytes"), "content"))
    return out
