"""A store that writes only what changes: hash buckets of segments, named by a manifest for each version.

A merge adds one segment to each bucket that it touches; readers take of every key the row of the
latest segment. A bucket's first segment is its base; rows of the later ones are few, so they are
broadcast, by the sizes that the manifest knows, against the base; many are joined by sorting. A bucket of more than ``most``
segments is merged into one by ``compact``, which every merge calls for. Segments are never changed: readers of
an older version go on reading its own until ``vacuum`` drops what no kept version names.

A bucket is a folder, not a task: writes are rebalanced by Spark, so large buckets are several files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.sources.store import Snapshots, upserts

#: Bytes of segments, as Parquet, up to which their keys are broadcast. Columns of few values hardly count in files, so a
#: megabyte may hold half a million keys, which take some tens of them in the driver.
BROADCAST = 1 << 20


def beside(keys: DataFrame, size: int) -> DataFrame:
    """keys to join by, out of segments of so many bytes: few are broadcast. Many are sorted, as Spark's own guess from the size of files is too low for them to pass through the driver."""
    return F.broadcast(keys) if size <= BROADCAST else keys.hint("merge")


class Segments(Snapshots):
    """Versions of a table of one row a key."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", buckets: int = 64, most: int = 6):
        super().__init__(spark, folder)
        self.key, self.buckets, self.most = key, buckets, most

    def manifest(self, version: int | None = None) -> dict | None:
        """schema, key, number of buckets and segments ({path, number, bytes of each bucket}) of a version."""
        _, name = self._named(version)
        return json.loads(self._text(name)) if name else None

    def _commit(self, number: int, segments: list[dict], schema: T.StructType) -> int:
        name = f"_manifests/{number:08d}-{uuid.uuid4().hex}"
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self._put_text(name, json.dumps({"schema": nullable.jsonValue(), "key": self.key, "buckets": self.buckets, "segments": [s for s in segments if s["bytes"]]}))
        self._point(number, name)
        return number

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _segment(self, rows: DataFrame, number: int, buckets: int, moved: bool = False) -> dict:
        """Write rows as a segment of a version; moved: they were held before."""
        path = f"s{number:08d}-{uuid.uuid4().hex}"
        rows.withColumn("_number", F.lit(number)).withColumn("_bucket", self._bucket(buckets)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{path}")
        held = {}
        for f in self._fs.listStatus(self._path(f"{self.folder}/{path}")):
            name = f.getPath().getName()
            if name.startswith("_bucket="):
                held[name.removeprefix("_bucket=")] = self._fs.getContentSummary(f.getPath()).getLength()
        return {"path": path, "number": number, "bytes": held, "moved": moved}

    def _rows(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        """The rows that a manifest's segments hold (in some buckets)."""
        schema = T.StructType.fromJson(manifest["schema"])
        first, later, size = [], [], 0
        seen: set[str] = set()
        for s in sorted(manifest["segments"], key=lambda s: s["number"]):
            for b, n in s["bytes"].items():
                if only is None or b in only:
                    (later if b in seen else first).append(f"{self.folder}/{s['path']}/_bucket={b}")
                    size += n if b in seen else 0
                    seen.add(b)
        with_number = T.StructType([*schema.fields, T.StructField("_number", T.IntegerType())])
        load = lambda paths: self.spark.read.schema(with_number).parquet(*paths) if paths else self.spark.createDataFrame([], with_number)
        base = load(first).drop("_number")
        if not later:
            return base
        last = load(later).groupBy(self.key).agg(F.max_by(F.struct(*schema.fieldNames()), "_number").alias("r")).select("r.*")
        keys = last.select(self.key)
        return base.join(beside(keys, size), self.key, "left_anti").select(*schema.fieldNames()).unionByName(last)

    def read(self, version: int | None = None) -> DataFrame | None:
        found = self.manifest(version)
        return self._rows(found) if found else None

    def changes(self, since: int, upto: int | None = None) -> DataFrame | None:
        """(columns, version): the rows that the versions after since and up to another (default: the newest) put in.

        All rows that are held, under that version, if some of those versions are forgotten."""
        upto = self.version() if upto is None else upto
        held = self.manifest(upto)
        if held is None:
            return None
        schema = T.StructType([*T.StructType.fromJson(held["schema"]).fields, T.StructField("_number", T.IntegerType())])
        known = {int(p) for p in self._pointers()}
        if any(n not in known for n in range(since + 1, upto + 1)):
            return self._rows(held).withColumn("version", F.lit(upto))
        own = self._own(since, upto)
        paths = [f"{self.folder}/{s['path']}/_bucket={b}" for s in own for b in s["bytes"]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.withColumnRenamed("_number", "version")

    def _own(self, since: int, upto: int) -> list[dict]:
        """The segments that the versions after since and up to another put in."""
        return [s for n in range(since + 1, upto + 1) for s in self.manifest(n)["segments"] if s["number"] == n and not s["moved"]]

    def changed(self, since: int, upto: int) -> int:
        """Bytes of what ``changes`` reads between two versions."""
        known = {int(p) for p in self._pointers()}
        if any(n not in known for n in range(since + 1, upto + 1)):
            return self.size(upto)
        return sum(sum(s["bytes"].values()) for s in self._own(since, upto))

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """Put df in place of all that is held, as the version after the newest (or the given) one."""
        number = (self.version() if after is None else after) + 1
        return self._commit(number, [self._segment(df, number, self.buckets)], df.schema)

    def merge(self, rows: DataFrame, after: int | None = None, key: str | None = None) -> int:
        """Put rows (of distinct keys) in place of those of their keys, as the next version. Buckets that grow too many segments are compacted after it."""
        if key not in (None, self.key):
            raise ValueError(f"this store is kept by {self.key}")
        version = self.version() if after is None else after
        held = self.manifest(version)
        if held is None:
            return self.write(rows, version)
        schema = T.StructType.fromJson(held["schema"])
        self._commit(version + 1, [*held["segments"], self._segment(rows.select(*schema.fieldNames()), version + 1, held["buckets"])], schema)
        self.compact()
        return version + 1

    def crowded(self, manifest: dict, most: int) -> set[str]:
        counts: dict[str, int] = {}
        for s in manifest["segments"]:
            for b in s["bytes"]:
                counts[b] = counts.get(b, 0) + 1
        return {b for b, n in counts.items() if n > most}

    def compact(self, most: int | None = None) -> int | None:
        """Merge each bucket of more than most segments into one segment; the new version, or None if there was nothing to do or another writer came first."""
        version = self.version()
        held = self.manifest(version)
        full = self.crowded(held, self.most if most is None else most) if held else set()
        if not full:
            return None
        rest = [s | {"bytes": {b: n for b, n in s["bytes"].items() if b not in full}} for s in held["segments"]]
        made = self._segment(self._rows(held, full), version + 1, held["buckets"], moved=True)
        try:
            return self._commit(version + 1, [*rest, made], T.StructType.fromJson(held["schema"]))
        except RuntimeError:  # the other writer's version stands; the next merge calls again
            return None

    def put(self, changes: DataFrame, key: str | None = None, order: str | None = None, fence: str | None = None) -> int:
        """Upsert changes, reading only the buckets that they touch."""
        if not self.version():
            return super().put(changes, self.key, order, fence)

        def new(now: DataFrame, number: int) -> DataFrame:
            held = self.manifest(number - 1)
            rows = changes.select(*[c for c in now.columns if c != "rev"])
            if dict(changes.dtypes)[self.key] == "string":  # null ones are named by their content
                return upserts(now, rows, self.key, order, fence)
            touched = {str(r[0]) for r in rows.select(self._bucket(held["buckets"])).distinct().collect()}  # at most the number of buckets
            size = sum(n for s in held["segments"] for b, n in s["bytes"].items() if b in touched)
            now = self._rows(held, touched)
            return upserts(now.hint("merge") if size > BROADCAST else now, rows, self.key, order, fence)

        return self.change(new, self.key)[0]

    def size(self, version: int | None = None) -> int:
        """Bytes of the segments of a version."""
        held = self.manifest(version)
        return sum(sum(s["bytes"].values()) for s in held["segments"]) if held else 0

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last versions and delete the segments that none of them names; returns how many went."""
        pointers = self._pointers()
        kept = {s["path"] for p in pointers[-keep:] for s in (self.manifest(int(p)) or {"segments": []})["segments"]}
        old = {s["path"] for p in pointers[:-keep] for s in (self.manifest(int(p)) or {"segments": []})["segments"]} - kept
        for p in pointers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/_current/{p}"), False)
        for path in old:
            self._fs.delete(self._path(f"{self.folder}/{path}"), True)
        return len(old)
