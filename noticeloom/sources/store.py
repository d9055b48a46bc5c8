"""A store of documents in Parquet: every write is a new snapshot that a pointer names.

A revision is a counter and a hash of the content. Snapshots are written whole and the pointer is
replaced last, so readers see one state or the next, and a failed write changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.functions.text import record_id
from noticeloom.sources.shared import shared_folder

UNTITLED = "Unbekannt"


def next_rev(rev: Column, *content: Column) -> Column:
    """``n-hash``: one more than the revision before, with a hash of the content."""
    n = F.coalesce(F.substring_index(rev, "-", 1).cast("int"), F.lit(0)) + 1
    return F.concat(n.cast("string"), F.lit("-"), F.substring(F.md5(F.to_json(F.struct(*content))), 1, 12))


def _contents(df: DataFrame, key: str) -> list[Column]:
    return [F.col(c) for c in df.columns if c not in (key, "rev")]


def one_a_key(changes: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """One row of each key: the last by the order column (nulls first), then by its content as JSON. Null text keys all stay."""
    if key != order:
        by = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct(*changes.columns)))
        known = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*changes.columns), by).alias("r")).select("r.*")
        return known.unionByName(changes.where(F.col(key).isNull()))
    raise ValueError("rows of one key cannot be ordered by the key")


def upserts(base: DataFrame, changes: DataFrame, key: str = "doc_id", order: str | None = None, fence: str | None = None) -> DataFrame:
    """The rows that changes add to base or replace in it, with their next revisions.

    Of a key that stands more than once in the changes its last row counts (see ``one_a_key``). Changes whose
    content is what base holds change nothing; nor do those with a smaller number in the fence column than
    base has. Null text keys get one made of the row's content; other null keys are an error."""
    columns = [F.col(c) for c in changes.columns]
    text = dict(changes.dtypes)[key] == "string"
    name = F.concat(F.lit("id-"), F.md5(F.to_json(F.struct(*columns)))) if text else F.raise_error(F.lit(f"a change has no {key}")).cast(dict(changes.dtypes)[key])
    named = one_a_key(changes, key, order).withColumn(key, F.coalesce(F.col(key), name))
    old = base.select(key, F.col("rev").alias("_rev"), *([F.col(fence).alias("_fence")] if fence else []))
    new = named.drop("rev").join(old, key, "left").withColumn("rev", next_rev(F.col("_rev"), *_contents(named, key)))
    same = F.substring_index("rev", "-", -1).eqNullSafe(F.substring_index("_rev", "-", -1))
    late = F.coalesce(F.col(fence) < F.col("_fence"), F.lit(False)) if fence else F.lit(False)
    return new.where(~same & ~late).select(*base.columns)


def replaced(base: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """base with rows put in place of those of their keys."""
    return base.join(rows.select(key), key, "left_anti").unionByName(rows)


def upsert(base: DataFrame, changes: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """base with changes put in: rows of new keys are added, others replaced with the next revision; see ``upserts``."""
    return replaced(base, upserts(base, changes, key, order), key)


def compare_and_set(base: DataFrame, changes: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(base with the changes whose revision is the stored one, the rejected changes)."""
    good, bad = revised(base, changes, key)
    return upsert(base, good, key), bad


def revised(base: DataFrame, changes: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(changes whose revision is the stored one, the others)."""
    now = base.select(key, F.col("rev").alias("_rev"))
    checked = changes.join(now, key, "left").withColumn("_ok", F.col("rev").eqNullSafe(F.col("_rev")))
    return checked.where("_ok").drop("_ok", "_rev"), checked.where("NOT _ok").drop("_ok", "_rev")


def tombstone(base: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """base with the documents of gone(key) marked deleted."""
    marked = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    out = base.join(marked, key, "left")
    return out.withColumn("rev", F.when(F.col("_gone"), next_rev(F.col("rev"), F.lit(True).alias("deleted"))).otherwise(F.col("rev"))).withColumn("deleted", F.coalesce("_gone", "deleted", F.lit(False))).select(*base.columns)


def live(base: DataFrame) -> DataFrame:
    return base.where(~F.coalesce("deleted", F.lit(False)))


def last_revision(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a key: the highest revision by counter, then hash."""
    by = F.struct(F.substring_index("rev", "-", 1).cast("int").alias("n"), F.col("rev"))
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), by).alias("r")).select("r.*")


def replicate(left: DataFrame, right: DataFrame, wanted: DataFrame | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Both sides after a sync of the wanted keys (all, if none are given): the last revision of each wins on both."""
    some = lambda df: df if wanted is None else df.join(wanted, key, "left_semi")
    rest = lambda df: df.limit(0) if wanted is None else df.join(wanted, key, "left_anti")
    both = last_revision(some(left).unionByName(some(right)), key)
    return rest(left).unionByName(both), rest(right).unionByName(both)


def update_field(base: DataFrame, changes: DataFrame, field: str, key: str = "doc_id") -> DataFrame:
    """base with one column taken from changes(key, field) where they have the key."""
    new = changes.select(key, F.col(field).alias("_new"), F.lit(True).alias("_hit"))
    out = base.join(new, key, "left").withColumn(field, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(field)))
    return out.withColumn("rev", F.when(F.col("_hit"), next_rev(F.col("rev"), F.col(field))).otherwise(F.col("rev"))).select(*base.columns)


def results(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event records, links doc_id -> event_id) of resolved documents; events without a title get a standard one, known ids are kept."""
    named = events.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)))
    old = F.col("event_id") if "event_id" in events.columns else F.lit(None).cast("string")
    named = named.withColumn("event_id", F.coalesce(old, F.concat(F.lit("event-"), F.col("doc_id").cast("string"))))
    return named, named.select("doc_id", "event_id")


def save_results(events: DataFrame, documents: Snapshots, records: Snapshots, best: str = "image") -> None:
    """Put resolved documents into both stores: event records by their ids, then the documents' links to them.

    A document gets its event's id, and its best picture (column best, where there is one) as an attachment."""
    named, links = results(events)
    records.put(named.drop("rev", best).withColumn("rev", F.lit(None).cast("string")), "event_id")

    def linked(held: DataFrame, _: int) -> DataFrame:
        linked = held.drop("event_id").join(links, "doc_id").select(*held.columns)
        if best in events.columns:
            linked = linked.join(events.select("doc_id", best), "doc_id")
            linked = linked.where(F.col(best).isNull()).unionByName(attach(linked.where(F.col(best).isNotNull()), "image", F.col(best))).select(*held.columns)
        return upserts(held, linked)

    documents.change(linked)


def save_edits(edits: DataFrame, documents: Snapshots, records: Snapshots) -> DataFrame:
    """Save edited event records and link their documents; returns the edits that were turned away.

    edits has doc_id, doc_rev (the document's revision that the editor saw) and the columns of an event record (event_id, rev
    and fields). An edit counts if both revisions are the stored ones (a record not saved before has none), and is then
    saved as a whole: first the record, then the link, each only where it changes. Without an event_id the record is named by its
    document. A batch that ends in between can run again: the record is what is stored by then, which counts as seen."""
    none = F.lit(None).cast("string")
    named = edits.withColumn("event_id", F.coalesce("event_id", F.concat(F.lit("event-"), F.col("doc_id").cast("string"))))
    held = documents.read().select("doc_id", F.col("rev").alias("_doc_rev"), F.lit(True).alias("_known"))
    now = records.read()
    fields = [c for c in named.columns if c not in ("doc_id", "doc_rev")]
    if now is None:
        seen = named.withColumn("_rev", none).withColumn("_same", F.lit(False))
    else:
        content = lambda: F.to_json(F.struct(*(c for c in fields if c != "rev")))
        stored = now.select("event_id", F.col("rev").alias("_rev"), F.md5(content()).alias("_content"))
        seen = named.join(stored, "event_id", "left").withColumn("_same", F.coalesce(F.col("_content") == F.md5(content()), F.lit(False))).drop("_content")
    good = F.col("doc_rev").eqNullSafe(F.col("_doc_rev")) & F.col("_known") & (F.col("_same") | F.col("rev").eqNullSafe(F.col("_rev")))
    checked = seen.join(held, "doc_id", "left").withColumn("_good", F.coalesce(good, F.lit(False)))
    spark, folder = edits.sparkSession, shared_folder(edits.sparkSession, "edits")
    checked.select(*named.columns, "_good").write.parquet(folder)  # what counts is decided once, before anything is saved
    decided = spark.read.parquet(folder)
    some = decided.where("_good")
    records.put(some.select(*fields), "event_id")
    links = some.select("doc_id", F.col("event_id").alias("_event"))

    def linked(stored: DataFrame, _: int) -> DataFrame:
        return upserts(stored, stored.join(links, "doc_id").withColumn("event_id", F.col("_event")).select(*stored.columns))

    documents.change(linked)
    return decided.where("NOT _good").drop("_good")


def created(pictures: DataFrame, thumb: Column, full: Column, now: Column, version: str = "0.2") -> DataFrame:
    """New posters of pictures(filename, ...): a name of their own, both pictures attached, no event yet."""
    one = lambda data: F.struct(F.lit("image/jpeg").alias("content_type"), data.alias("data"))
    attachments = F.create_map(F.lit("userimage"), one(full), F.lit("userimage-thumb"), one(thumb))
    none = F.lit(None).cast("string")
    return pictures.select(record_id(F.col("filename"), now.cast("string")).alias("doc_id"), none.alias("rev"), F.lit(version).alias("version"), now.alias("created"), none.alias("processed_by"),
                           none.alias("event_id"), none.alias("user_event"), attachments.alias("attachments"), F.lit(False).alias("deleted"))


def attach(documents: DataFrame, name: str, data: Column, content_type: str = "image/jpeg") -> DataFrame:
    """documents with an attachment put in under a name."""
    one = F.create_map(F.lit(name), F.struct(F.lit(content_type).alias("content_type"), data.alias("data")))
    rest = F.map_filter(F.coalesce("attachments", F.create_map().cast("map<string,struct<content_type:string,data:binary>>")), lambda k, v: k != name)
    return documents.withColumn("attachments", F.map_concat(rest, one))


def serialized(df: DataFrame, images: bool = False, pretty: bool = False, name: str = "json") -> DataFrame:
    """df with the row as JSON text, with or without its pictures."""
    columns = [c for c in df.columns if images or c not in ("images", "serialized_images", "attachments", "content")]
    return df.withColumn(name, F.to_json(F.struct(*columns), {"pretty": str(pretty).lower()}))


def export_json(df: DataFrame, path: str) -> None:
    """The rows as JSON lines, a file for each partition."""
    df.write.mode("overwrite").json(path)


def id_report(df: DataFrame, key: str = "doc_id", per_line: int = 1000) -> DataFrame:
    """(part, ids): distinct ids in order, joined by commas. Parts are ranges of per_line whole numbers; other ids are dealt by hash, about per_line to a part."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    line = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",")
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    part = F.floor(F.col(key) / per_line) if whole else F.pmod(F.xxhash64(key), F.lit(ids.count() // per_line + 1))
    return ids.groupBy(part.alias("part")).agg(line.alias("ids"))


class Snapshots:
    """Versions of a table below a folder of any store; the newest pointer names the current one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        where = self._path(f"{self.folder}/_current")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def version(self) -> int:
        """Number of the newest version; 0 if there is none."""
        found = self._pointers()
        return int(found[-1]) if found else 0

    def _named(self, version: int | None) -> tuple[int, str | None]:
        """The number of a version (default: the newest) and the name that its pointer holds; the one before if it is just being written."""
        number = self.version() if version is None else version
        while number:
            name = self._text(f"_current/{number:08d}")
            if name:
                return number, name
            number -= 1
        return 0, None

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put_text(self, name: str, text: str) -> None:
        """A new file with this text; an error if there is one."""
        out = self._fs.create(self._path(f"{self.folder}/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _point(self, number: int, name: str) -> None:
        try:
            self._put_text(f"_current/{number:08d}", name)
        except Exception as error:
            raise RuntimeError(f"version {number} of {self.folder} was written meanwhile") from error

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest snapshot, or that of a version."""
        _, name = self._named(version)
        return self.spark.read.parquet(f"{self.folder}/{name}") if name else None

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """Write a snapshot and then point to it, as the version after the newest (or the given) one; returns its number.

        A version's pointer is a file named by its number, made only if there is none: of two writers of
        one version the second fails, and its snapshot is never read."""
        number = (self.version() if after is None else after) + 1
        name = f"v{number:08d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        self._point(number, name)
        return number

    def merge(self, rows: DataFrame, after: int | None = None, key: str = "doc_id") -> int:
        """Put rows in place of those of their keys, as the next version."""
        version = self.version() if after is None else after
        now = self.read(version)
        return self.write(rows if now is None else replaced(now, rows, key), version)

    def change(self, make: Callable[[DataFrame, int], DataFrame], key: str = "doc_id", tries: int = 5) -> tuple[int, DataFrame] | None:
        """Merge the rows make(what the store holds, the new version's number), again from what it then holds if another writer was first.

        Returns the new version and what was held before; None if the store is empty."""
        for left in reversed(range(tries)):
            version = self.version()
            now = self.read(version)
            if now is None:
                return None
            try:
                return self.merge(make(now, version + 1), version, key), now
            except RuntimeError:
                if not left:
                    raise
        return None

    def put(self, changes: DataFrame, key: str = "doc_id", order: str | None = None, fence: str | None = None) -> int:
        """Upsert changes as the next version; an empty store takes them as they are, with first revisions."""
        if self.version():
            return self.change(lambda now, _: upserts(now, changes.select(*[c for c in now.columns if c != "rev"]), key, order, fence), key)[0]
        columns = changes.columns if "rev" in changes.columns else [*changes.columns, "rev"]
        none = changes.limit(0).drop("rev").withColumn("rev", F.lit(None).cast("string")).select(*columns)
        return self.write(upserts(none, changes, key, order), 0)
