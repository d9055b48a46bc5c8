"""The store of segments as a format of Spark's: ``spark.read.format("segments").load(folder)``, ``readStream`` and both writers.

Rows have the store's columns and ``version``, the version that put them in. A batch read gives the rows
of a version (option ``version``, default the newest) in one partition for each base file and one for each
bucket's later segments; base files leave out keys that are in later ones of their bucket. A stream
read gives the rows that versions put in, in their order, from option ``since`` on (a version, or ``now``).
Writers make one segment of each bucket and task and commit one version when all tasks are done; tasks' files of
a job that fails are deleted, also those of tasks that go on for a while after it: an empty folder ``_aborted/...``, which stays,
tells them. (What a process leaves that is killed at that moment stays, unnamed; so do files of a stream's tasks that fail.) A stream's writer notes its batch in the version (option ``stream``): a
batch that runs again is not written twice.

Files are reached by pyarrow (local folders, HDFS, S3, GCS). Keys are whole numbers or text, hashed as Spark
does. A pointer is made exclusively on local folders; elsewhere a folder should have one writer of this kind.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "segments"


class Folder:
    """Pointers, manifests and files of a store, without a session."""

    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            scheme, _, rest = path.partition(":")
            path = f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest.lstrip('/') if scheme not in ('file', 'hdfs') else '/' + rest.lstrip('/') if scheme == 'file' else rest.removeprefix('//')}"
            self.fs, self.root = pafs.FileSystem.from_uri(path)
        else:
            self.fs, self.root = pafs.LocalFileSystem(), os.path.abspath(path)

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if not f.base_name.startswith((".", "_SUCCESS")))

    def text(self, name: str) -> str:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read().decode()

    def put_text(self, name: str, text: str) -> None:
        path = f"{self.root}/{name}"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        if isinstance(self.fs, pafs.LocalFileSystem):
            with open(path, "xb") as f:
                f.write(text.encode())
            return
        if self.fs.get_file_info(path).type != pafs.FileType.NotFound:
            raise FileExistsError(path)
        with self.fs.open_output_stream(path) as f:
            f.write(text.encode())

    def delete(self, name: str) -> None:
        """Delete a folder, if it is there; others may write to it or delete it meanwhile."""
        for left in reversed(range(5)):
            try:
                if self.fs.get_file_info(f"{self.root}/{name}").type == pafs.FileType.Directory:
                    self.fs.delete_dir(f"{self.root}/{name}")
                return
            except OSError:
                if not left:
                    raise

    def abort(self, name: str) -> None:
        """Delete the folder of a job that failed. Tasks that Spark has killed may write for a while yet, so the mark
        comes first: files made before it are deleted here, later ones by their tasks."""
        self.fs.create_dir(f"{self.root}/_aborted/{name}", recursive=True)
        self.delete(name)

    def aborted(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/_aborted/{name}").type != pafs.FileType.NotFound

    def going_on(self, name: str) -> None:
        """An error if the job of a folder was aborted."""
        if self.aborted(name):
            raise RuntimeError(f"the job that writes {name} was aborted")

    def swept(self, name: str) -> None:
        """Delete the folder if its job was aborted: called by each task when it ends, however it does."""
        if self.aborted(name):
            self.delete(name)

    def versions(self) -> list[int]:
        return [int(n) for n in self.names("_current") if n.isdigit()]

    def manifest(self, version: int) -> dict:
        return json.loads(self.text(self.text(f"_current/{version:08d}")))

    def files(self, segment: dict, bucket: str) -> list[str]:
        return [f"{segment['path']}/_bucket={bucket}/{n}" for n in self.names(f"{segment['path']}/_bucket={bucket}") if n.endswith(".parquet")]

    def table(self, name: str) -> pa.Table:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return pq.ParquetFile(f).read()


def batches(table: pa.Table, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows of files as the source's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = ["_number" if n == "version" else n for n in schema.fieldNames()]
    yield from table.select(names).rename_columns(schema.fieldNames()).cast(to_arrow_schema(schema)).to_batches(10_000)


@dataclass
class Files(InputPartition):
    """Files to read; of each key only the row of the latest, without the keys that later files hold."""

    own: list[str]
    later: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, version: int | None):
        self.path, self.schema, self.version = path, schema, version

    def partitions(self) -> list[InputPartition]:
        folder = Folder(self.path)
        held = folder.manifest(self.version or folder.versions()[-1])
        buckets: dict[str, list[dict]] = {}
        for s in sorted(held["segments"], key=lambda s: s["number"]):
            for b in s["bytes"]:
                buckets.setdefault(b, []).append(s)
        out: list[InputPartition] = []
        for b, segments in buckets.items():
            later = [f for s in segments[1:] for f in folder.files(s, b)]
            out += [Files([f], later) for f in folder.files(segments[0], b)]
            out += [Files(later, [])] if later else []
        self.key = held["key"]
        return [Files([*p.own, f"key={self.key}"], p.later) for p in out] if out else [Files([], [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.path)
        if not partition.own:
            return
        key = partition.own[-1].removeprefix("key=")
        own = [folder.table(f) for f in partition.own[:-1]]
        table = pa.concat_tables(own).sort_by("_number") if len(own) > 1 else own[0]
        if partition.later:
            keys = pa.concat_tables([folder.table(f).select([key]) for f in partition.later]).column(key)
            table = table.filter(pc.invert(pc.is_in(table.column(key), keys)))
        elif len(own) > 1:
            places = pa.table({"k": table.column(key), "at": pa.array(range(len(table)))}).group_by("k").aggregate([("at", "max")])
            table = table.take(places.column("at_max").combine_chunks().sort())
        yield from batches(table, self.schema)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: T.StructType, since: str):
        self.path, self.schema, self.since = path, schema, since

    def _newest(self) -> int:
        return max(Folder(self.path).versions(), default=0)

    def initialOffset(self) -> dict:
        return {"version": self._newest() if self.since == "now" else int(self.since)}

    def latestOffset(self) -> dict:
        return {"version": self._newest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        folder, out = Folder(self.path), []
        for number in range(start["version"] + 1, end["version"] + 1):
            for s in folder.manifest(number)["segments"]:
                if s["number"] == number and not s.get("moved"):
                    out += [Files([f], []) for b in s["bytes"] for f in folder.files(s, b)]
        return out or [Files([], [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for name in partition.own:
            yield from batches(Folder(self.path).table(name), self.schema)


def bucket_of(key, kind: T.DataType, buckets: int) -> int:
    """The bucket that Spark's hash gives a key."""
    import xxhash

    if isinstance(kind, T.StringType):
        raw = key.encode()
    else:
        raw = struct.pack("<q" if isinstance(kind, T.LongType) else "<i", key)
    h = xxhash.xxh64_intdigest(raw, 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


@dataclass
class Written(WriterCommitMessage):
    segment: str
    sizes: dict[str, int]


class Writer(DataSourceWriter):
    """Rows of distinct keys, merged (or, with overwrite, put in place of all) as one version."""

    def __init__(self, path: str, schema: T.StructType, options: dict, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.schema = T.StructType([f for f in schema if f.name != "version"])
        folder = Folder(path)
        self.base = max(folder.versions(), default=0)
        held = folder.manifest(self.base) if self.base else None
        self.key = held["key"] if held else options.get("key", "doc_id")
        self.buckets = held["buckets"] if held else int(options.get("buckets", 64))
        self.stream, self.segment = options.get("stream", "stream"), f"s{self.base + 1:08d}-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        from pyspark.sql.pandas.types import to_arrow_schema

        folder, kind, waiting, sizes = Folder(self.path), self.schema[self.key].dataType, {}, {}
        arrow = to_arrow_schema(self.schema)
        attempt = uuid.uuid4().hex

        def flush(bucket: str) -> None:
            folder.going_on(self.segment)
            rows = waiting.pop(bucket)
            table = pa.table([pa.array([r[c] for r in rows], f.type) for c, f in zip(self.schema.fieldNames(), arrow, strict=True)], schema=arrow)
            table = table.append_column("_number", pa.array([self.base + 1] * len(rows), pa.int32()))
            name = f"{folder.root}/{self.segment}/_bucket={bucket}"
            folder.fs.create_dir(name, recursive=True)
            part = f"{name}/part-{attempt}-{sizes.get(bucket, 0)}.parquet"
            with folder.fs.open_output_stream(part) as f:
                pq.write_table(table, f)
            sizes[bucket] = sizes.get(bucket, 0) + folder.fs.get_file_info(part).size

        try:
            for row in iterator:
                b = str(bucket_of(row[self.key], kind, self.buckets))
                waiting.setdefault(b, []).append(row)
                if len(waiting[b]) >= 50_000:
                    flush(b)
            for b in list(waiting):
                flush(b)
        finally:
            folder.swept(self.segment)
        return Written(self.segment, sizes)

    def _commit(self, messages: list[Written | None], batch: int | None = None) -> None:
        folder, sizes = Folder(self.path), {}
        number = max(folder.versions(), default=0)
        held = folder.manifest(number) if number else {"segments": [], "streams": {}}
        streams = held.get("streams", {})
        if batch is not None:
            if streams.get(self.stream, -1) >= batch:
                return self._abort(messages)
            streams = streams | {self.stream: batch}
        elif number != self.base:
            self._abort(messages)
            raise RuntimeError(f"version {self.base + 1} of {self.path} was written meanwhile")
        # a stream's tasks have another copy of the writer than its commits, so they name their segment
        for m in messages:
            for b, n in (m.sizes if m else {}).items():
                held_by = sizes.setdefault(m.segment, {})
                held_by[b] = held_by.get(b, 0) + n
        schema = held["schema"] if number and not self.overwrite else T.StructType([T.StructField(f.name, f.dataType) for f in self.schema]).jsonValue()
        segments = ([] if self.overwrite else held["segments"]) + [{"path": path, "number": number + 1, "bytes": n, "moved": False} for path, n in sizes.items()]
        name = f"_manifests/{number + 1:08d}-{uuid.uuid4().hex}"
        folder.put_text(name, json.dumps({"schema": schema, "key": self.key, "buckets": self.buckets, "segments": segments, "streams": streams}))
        folder.put_text(f"_current/{number + 1:08d}", name)

    def _abort(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        for segment in {self.segment, *(m.segment for m in messages if m)}:
            folder.delete(segment)

    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        Folder(self.path).abort(self.segment)


class StreamWriter(Writer, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._abort(messages)


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        folder = Folder(self.options["path"])
        held = T.StructType.fromJson(folder.manifest(int(self.options.get("version", 0)) or folder.versions()[-1])["schema"])
        return T.StructType([*held.fields, T.StructField("version", T.IntegerType())])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("version", 0)) or None)

    def streamReader(self, schema: T.StructType) -> StreamReader:
        return StreamReader(self.options["path"], schema, self.options.get("since", "0"))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, dict(self.options), overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> str:
    """Make the format known to a session; its name."""
    spark.dataSource.register(SegmentSource)
    return NAME
