"""Dictionary-compressed WARC archives.

Records are grouped by payload digest in the JVM, so the archive writers see one stream of rows
that already know whether they are responses or revisits. Each task writes archives of bounded
size to shared storage. An archive starts with a skippable Zstandard frame (magic 0x184D2A5D) that
holds a dictionary trained on the archive's own records; every record follows as a frame of its own
and can be read alone. Every attempt of a task writes to a folder of its own, which becomes the partition's
folder by a rename when it is whole; of several attempts the first stays and the others are deleted.
Archives are read back with Spark's binary file source from any store.

Defined results: a null payload is an empty response; payloads under DEDUP_BYTES are always
responses; among equal larger payloads every row with the smallest page_id is the response (so
repeated rows of that id are responses too) and the others revisit it; rows with a null page_id
revisit like any other and are responses if all ids of their group are null. An empty table writes
no archive and reads back as an empty result. A null url reads back as null, and line breaks in urls as
%0D and %0A. Records are named by page_id and digest, so that revisits name what they refer to even where
ids repeat. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import shared_dir, stored

DEDUP_BYTES = 100
#: Bytes of records in an archive before the next one begins, of a dictionary, of what trains it.
ARCHIVE_BYTES, DICT_BYTES, TRAIN_BYTES = 24 << 20, 16 << 10, 1 << 20
DICT_MAGIC = 0x184D2A5D
LEVEL = 3


def record_types(pages: DataFrame, dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """pages(page_id, url, html) with payload_digest, payload_bytes, record_type and refers_to.

    Only digests and ids are shuffled to find the groups; they are pre-aggregated, so a payload
    with many copies is one row from each task. Payloads meet their group's row in a join by digest
    that only rows of repeated payloads take part in."""
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", text.alias("payload"), F.sha2(text.cast("binary"), 256).alias("payload_digest"), F.octet_length(text).cast("long").alias("payload_bytes"))
    groups = rows.where(F.col("payload_bytes") >= dedup_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = (
        rows.where(F.col("payload_bytes") >= dedup_bytes).select("page_id", "payload_digest")
        .join(groups, "payload_digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    )
    repeated = stored(repeated, "warc-repeated")  # a table, so that rows without an id are joined in parts
    out = rows.join(repeated, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    return out.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def record_name(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record_bytes(page_id, url, kind: str, refers_to, payload: bytes, digest: str, size: int) -> bytes:
    """One WARC/1.1 record; a revisit has no block and names what it refers to."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_name(page_id, digest)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to, digest)}"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    return fields, rest[:size]


def archive_bytes(records: list[bytes], level: int = LEVEL, dict_bytes: int = DICT_BYTES) -> bytes:
    """The archive of some records. Too few or too small records to train on give an empty dictionary."""
    samples, room = [], TRAIN_BYTES
    for r in records[:: max(1, len(records) // 256)]:
        samples.append(r[:room][:65536])
        room -= len(samples[-1])
        if room <= 0:
            break
    try:
        trained = zstandard.train_dictionary(dict_bytes, samples, k=256, d=8).as_bytes() if len(samples) > 7 else b""
    except zstandard.ZstdError:
        trained = b""
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    out = io.BytesIO()
    out.write(struct.pack("<II", DICT_MAGIC, len(trained)))
    out.write(trained)
    for r in records:
        out.write(compressor.compress(r))
    return out.getvalue()


def archive_records(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != DICT_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    trained = raw[8 : 8 + size]
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    rest = memoryview(raw)[8 + size :]
    while len(rest):
        frame = decompressor.decompressobj()
        yield frame.decompress(rest)
        rest = rest[len(rest) - len(frame.unused_data) :]


def _store(path: str):
    """The store of a URI or local path, and the name there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def take_place(work: str, final: str) -> None:
    """Rename an attempt's folder to the partition's, or delete it if another attempt was first."""
    from pyarrow import fs

    store, a = _store(work)
    z = _store(final)[1]
    if store.get_file_info(a).type == fs.FileType.NotFound:
        return  # no rows, no archives
    there = lambda: store.get_file_info(z).type != fs.FileType.NotFound
    if not there():
        try:
            store.move(a, z)
            return
        except OSError:
            if not there():
                raise
    store.delete_dir(a)


def put(path: str, data: bytes) -> None:
    """Write a file to the store of its URI; it appears whole or not at all."""
    store, name = _store(path)
    part = f"{name}.{uuid.uuid4().hex}.tmp"
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, name)


def write_archives(records: DataFrame, folder: str, archive_size: int = ARCHIVE_BYTES) -> DataFrame:
    """Write record_types() rows as archives below folder, which is emptied first.

    Returns (path, archives, records, bytes) of each partition's folder, lazily."""
    jvm = records.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(records.sparkSession.sparkContext._jsc.hadoopConfiguration())
    store.delete(path, True)
    store.mkdirs(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"part-{TaskContext.get().partitionId():06d}"
        own = f"{folder}/_attempts/{part}-{uuid.uuid4().hex}"  # names with an underscore are not read
        number, held, size, count, written = 0, [], 0, 0, 0

        def flush():
            nonlocal number, held, size, count, written
            data = archive_bytes(held)
            put(f"{own}/{number:05d}.warc.zst", data)
            number, held, size, count, written = number + 1, [], 0, count + len(held), written + len(data)

        for batch in batches:
            for page_id, url, payload, digest, n, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record_bytes(page_id, url, kind, refers_to, b"" if kind == "revisit" else payload.encode(), digest, n))
                size += len(held[-1])
                if size >= archive_size:
                    flush()
        if held:
            flush()
        if count:
            take_place(own, f"{folder}/{part}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{part}"]), *(pa.array([x], pa.int64()) for x in (number, count, written))], names=["path", "archives", "records", "bytes"])

    columns = ("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to")
    return records.select(*columns).mapInArrow(run, "path string, archives long, records long, bytes long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, stored digest and length) of every record below folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows = [parse_record(r) for r in archive_records(raw.as_py())]
                number = lambda x: int(x) if x else None
                page = lambda x: number(x.removeprefix("<urn:page:").split(":", 1)[0])
                whole = [hashlib.sha256(p).hexdigest() for _, p in rows]
                stated = [f["WARC-Payload-Digest"].removeprefix("sha256:") for f, _ in rows]
                for (f, p), digest, said in zip(rows, whole, stated, strict=True):
                    if f["WARC-Type"] == "response" and (digest != said or len(p) != int(f["X-Payload-Length"])):
                        raise ValueError(f"record {f['WARC-Record-ID']} does not hold its payload")
                yield pa.RecordBatch.from_arrays([
                    pa.array([page(f["WARC-Record-ID"]) for f, _ in rows], pa.int64()), pa.array([f.get("WARC-Target-URI") for f, _ in rows], pa.string()), pa.array([f["WARC-Type"] for f, _ in rows]),
                    pa.array([page(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None for f, _ in rows], pa.int64()),
                    pa.array([p for _, p in rows], pa.binary()), pa.array(stated), pa.array([int(f["X-Payload-Length"]) for f, _ in rows], pa.int64()),
                ], names=["page_id", "url", "record_type", "refers_to", "payload", "payload_digest", "payload_bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    return files.select("content").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string, payload_bytes long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/noticeloom/warc-{uuid.uuid4().hex}"
    write_archives(record_types(pages), folder).agg(F.sum("records")).collect()
    return read_archives(spark, folder)
